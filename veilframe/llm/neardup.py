"""b-bit MinHash near-duplicates: packed low bits of the minima, band candidates, exact confirmation, components.

1. Sign: words are hashed, shingles are hashed words in a row, and n_hashes minima are taken over the distinct
   shingles. n_bands bands of `rows` minima are hashed to band keys; of every minimum, `bits` low bits are packed into longs.
2. Collapse: equal shingle sets (equal digests, so equal texts too) are one class, a node with a number of its own. One of
   the texts of its least doc_id stands for it. Classes of one doc_id are linked.
3. Candidates: classes that share a band key. Copies in a band are never expanded into all pairs: in the first round
   the other classes of a band pair with its least node. In the second, every band has `pivots` classes, the first in as
   many hash orders, and a class pairs with the first of each order over all its bands: `pivots` others at most. Classes
   of one component, or of sizes that allow no link, don't pair; nor do those whose collision-corrected estimate is far
   below the threshold.
4. Confirm: links are decided on the full shingle sets. Confirmed links merge components; bands whose classes are all in
   one component are done.
5. The rest: in a band that still has several components, every class outside its largest component meets every class
   of another component. Bands are dealt in blocks of at most about block_rows rows and block_bytes of shingles; two
   blocks meet in one task, which estimates, confirms, merges components as it goes, and gives out only the links that
   join two of them: never more than it has rows. A pair is compared in the first band that it shares.
   So there are three rounds at most, and the components are those of the whole candidate graph.

Rows: null or wordless text has no shingles, is linked with nothing and is its own component. Rows that share a doc_id
are one document: their links unite. A row with a null doc_id is linked with nothing and stays (component null).
Repeated rows come back as often as they came. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, gram_hashes, mix, read, slices, word_hashes, word_spans

_SIGNED = "doc_id long, text_key long, n_shingles long, key binary, sig array<long>, bands array<long>"


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (lower-cased ASCII, words between ASCII white space)."""
    buf = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    starts, ends = word_spans(buf)
    words = word_hashes(buf, starts, ends)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    edges = np.r_[0, np.cumsum(lens + 1)]
    cut = np.searchsorted(starts, edges)
    grams = gram_hashes(words, k)
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        n = b - a
        if n >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif n:
            out.append(gram_hashes(words[a:b], n) + np.uint64(n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _text_key(text_col: str) -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(F.col(text_col).cast("string")).alias("text_key")


def sign(docs: DataFrame, k: int, n_hashes: int, n_bands: int, rows: int, bits: int, id_col: str, text_col: str) -> DataFrame:
    rng = np.random.default_rng(7)
    xors = rng.integers(0, 2**63, n_hashes, dtype=np.uint64)
    mults = rng.integers(0, 2**62, n_hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    per_long = 64 // bits

    def run(batches):
        import hashlib

        for part in slices(batches, rows=192):
            sets = shingle_sets([t or b"" for t in part.column(2).to_pylist()], k)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            full = np.flatnonzero(sizes)
            minima = np.zeros((n_hashes, len(full)), np.uint64)
            if len(full):
                shingles = np.concatenate([sets[i] for i in full])
                at = np.r_[0, np.cumsum(sizes[full])[:-1]]
                for h in range(n_hashes):
                    minima[h] = np.minimum.reduceat((shingles ^ xors[h]) * mults[h], at)
            bands = np.zeros((n_bands, len(full)), np.uint64)
            for b in range(n_bands):
                for r in range(rows):
                    bands[b] = mix(bands[b] * np.uint64(0x9E3779B97F4A7C15) + minima[b * rows + r] + np.uint64(b + 1))
            low = (minima >> np.uint64(32)) & np.uint64((1 << bits) - 1)
            packed = np.zeros((n_hashes // per_long, len(full)), np.uint64)
            for h in range(n_hashes):
                packed[h // per_long] |= low[h] << np.uint64(bits * (h % per_long))
            where = {int(i): c for c, i in enumerate(full)}
            sig, band = packed.T.copy().view(np.int64).tolist(), bands.T.copy().view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(sizes),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([sig[where[i]] if i in where else None for i in range(len(sets))], pa.list_(pa.int64())),
                    pa.array([band[where[i]] if i in where else None for i in range(len(sets))], pa.list_(pa.int64())),
                ],
                ["doc_id", "text_key", "n_shingles", "key", "sig", "bands"],
            )

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_key(text_col), F.col(text_col).cast("string").cast("binary").alias("text"))
    return plain.mapInArrow(run, _SIGNED)


def estimate(a: str, b: str, n_hashes: int, bits: int) -> Column:
    """Similarity from packed minima: differing places by bit counts, corrected for chance agreement of low bits."""
    mask = sum(1 << (i * bits) for i in range(64 // bits))
    mask -= (mask >> 63) << 64

    def differing(i: int) -> str:
        x = f"({a}[{i}] ^ {b}[{i}])"
        folded = " | ".join(f"shiftrightunsigned({x}, {s})" if s else x for s in range(bits))
        return f"bit_count(({folded}) & {mask}L)"

    differ = " + ".join(differing(i) for i in range(n_hashes * bits // 64))
    chance = 2.0**-bits
    return F.expr(f"(1 - ({differ}) / {n_hashes}D - {chance}D) / {1 - chance}D")


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose shingle sets have 100 * intersection >= percent * union."""

    def run(batches):
        last, own = None, None
        for part in slices(batches, rows=256):
            a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
            others = shingle_sets(part.column(3).to_pylist(), k)
            keep = []
            for x, text, other in zip(a, part.column(2), others, strict=True):
                if x != last:
                    last, own = x, shingle_sets([text.as_py()], k)[0]
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    other = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(other, "b").join(own, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) of every node of the edges (a, b): comp is the least node of its connected component.

    Every component takes its least neighbour as parent, chains of parents are doubled up to their roots, and the edges
    are contracted, until no edge joins two components. At least half of the joined components go in each round.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = scratch.table(both.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct(), f"{name}-labels0")
    links = scratch.table(edges.select("a", "b").where("a != b").distinct(), f"{name}-links0")
    turn = 0
    while links.limit(1).count():
        turn += 1
        sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = scratch.table(sides.groupBy(F.col("a").alias("c")).agg(F.least(F.col("c"), F.min("b")).alias("p")), f"{name}-parent{turn}-0")
        step = 0
        while True:
            up = parent.select(F.col("c").alias("p"), F.col("p").alias("q"))
            jumped = parent.join(up, "p").select("c", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved"))
            step += 1
            jumped = scratch.table(jumped, f"{name}-parent{turn}-{step}")
            scratch.drop(f"{name}-parent{turn}-{step - 1}")
            parent = jumped.select("c", "p")
            if not jumped.where("moved").limit(1).count():
                break
        labels = labels.join(parent, labels.comp == parent.c, "left").select("node", F.coalesce("p", "comp").alias("comp"))
        labels = scratch.table(labels, f"{name}-labels{turn}")
        ends = links.join(parent.toDF("a", "pa"), "a").join(parent.toDF("b", "pb"), "b")
        links = scratch.table(ends.select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a != b").distinct(), f"{name}-links{turn}")
        scratch.drop(f"{name}-labels{turn - 1}", f"{name}-links{turn - 1}", f"{name}-parent{turn}-{step}")
    return labels


def _likely(a: np.ndarray, b: np.ndarray, n_hashes: int, bits: int) -> np.ndarray:
    """The estimate of `estimate` for one packed signature against many."""
    x = b ^ a
    for s in (1 << i for i in range(bits.bit_length() - 1)):
        x = x | (x >> np.uint64(s))
    mask = np.uint64(sum(1 << (i * bits) for i in range(64 // bits)))
    differ = np.bitwise_count(x & mask).sum(axis=1, dtype=np.int64)
    chance = 2.0**-bits
    return (1 - differ / n_hashes - chance) / (1 - chance)


def _meet(k: int, percent: int, n_hashes: int, bits: int, slack: float):
    """For one pair of blocks of a band: the links that join components, confirmed on full sets."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        u, v = key[1].as_py(), key[2].as_py()
        block = table.column("own").to_numpy()
        node, comp, size = (table.column(c).to_numpy().copy() for c in ("node", "comp", "n_shingles"))
        place = table.column("i")[0].as_py()
        sig, bands = (pa.compute.list_flatten(table.column(c)).to_numpy().view(np.uint64).reshape(len(node), -1) for c in ("sig", "bands"))
        texts, sets = table.column("text"), {}

        def own(rows: list[int]) -> list[np.ndarray]:
            new = [r for r in rows if r not in sets]
            if new:
                sets.update(zip(new, shingle_sets([texts[r].as_py() for r in new], k), strict=True))
            return [sets[r] for r in rows]

        left, right = np.flatnonzero(block == u), np.flatnonzero(block == v)
        out = []
        for at, x in enumerate(left.tolist()):
            ys = right[at + 1 :] if u == v else right
            ys = ys[comp[ys] != comp[x]]
            low, high = np.minimum(size[ys], size[x]), np.maximum(size[ys], size[x])
            ys = ys[100 * low >= percent * high]
            ys = ys[~(bands[ys, :place] == bands[x, :place]).any(axis=1)]
            ys = ys[_likely(sig[x], sig[ys], n_hashes, bits) >= percent / 100 - slack]
            for i in range(0, len(ys), 256):
                part = ys[i : i + 256]
                part = part[comp[part] != comp[x]]
                if not len(part):
                    continue
                [mine], others = own([x]), own(part.tolist())
                shingles = np.concatenate(others)
                found = mine[np.minimum(np.searchsorted(mine, shingles), len(mine) - 1)] == shingles
                both = np.add.reduceat(found, np.r_[0, np.cumsum([len(o) for o in others])[:-1]], dtype=np.int64)
                for y in part[100 * both >= percent * (size[part] + size[x] - both)].tolist():
                    if comp[y] != comp[x]:
                        out.append((int(node[x]), int(node[y])))
                        comp[comp == comp[y]] = comp[x]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _rest(labelled: DataFrame, signs: DataFrame, texts: DataFrame, meet, block_rows: int, block_bytes: int) -> DataFrame:
    """Links (a, b) between classes of a band that are in two components; labelled: band, i, node, n_shingles, comp.

    Blocks are numbered: first those outside the band's largest component, then those of it. A row of the former goes to
    its pairs with all blocks, a row of the latter to its pairs with the former only.
    """
    per_comp = labelled.groupBy("band", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    mixed = per_comp.groupBy("band").agg(F.max(F.struct("n", "s", "comp")).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("comps"))
    blocks = lambda n, s: F.greatest(F.ceil(n / block_rows), F.ceil(8 * s / block_bytes)).cast("int")
    mixed = mixed.where("comps > 1").select("band", F.col("main.comp").alias("main"), blocks(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("others"), blocks(F.col("main.n"), F.col("main.s")).alias("mains"))
    rows = labelled.join(mixed, "band").withColumn("in_main", F.expr("comp = main"))
    rows = rows.withColumn("own", F.expr("if(in_main, others + pmod(xxhash64(node), mains), pmod(xxhash64(node), others))").cast("int"))
    met = F.expr("transform(sequence(0, if(in_main, others, others + mains) - 1), j -> struct(least(own, j) as u, greatest(own, j) as v))")
    dealt = rows.select("node", "comp", "band", "i", "own", F.explode(met).alias("m")).select("node", "comp", "band", "i", "own", "m.*")
    full = dealt.join(signs.select("node", "n_shingles", "sig", "bands"), "node").join(texts, "node")
    return full.groupBy("band", "u", "v").applyInArrow(meet, "a long, b long")


def _pivot_pairs(labelled: DataFrame, percent: int, pivots: int, in_all: bool) -> DataFrame:
    """Pairs (a, b) of a class and a pivot of a band: of other components, and of sizes that allow a link.

    One pivot a band is its least node; several are the first in as many hash orders. in_all: a class meets the first of
    each order over all its bands, `pivots` others at most, and not up to `pivots` in each of its bands.
    """
    order = lambda n: F.xxhash64("node", F.lit(n)) if pivots > 1 else F.col("node")
    places = [f"p{n}" for n in range(pivots)]
    chosen = [F.min(F.struct(order(n).alias("o"), "node", "comp", "n_shingles")).alias(p) for n, p in enumerate(places)]
    mixed = labelled.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *chosen).where("lo != hi").drop("lo", "hi")
    fits = lambda p: F.expr(f"if(comp != {p}.comp and 100 * least(n_shingles, {p}.n_shingles) >= {percent} * greatest(n_shingles, {p}.n_shingles), {p}, null)")
    met = labelled.join(mixed, "band").select("node", *(fits(p).alias(p) for p in places))
    if in_all:
        met = met.groupBy("node").agg(*(F.min(p).alias(p) for p in places))
    each = met.select("node", F.explode(F.array(*(F.col(f"{p}.node") for p in places))).alias("other")).where("other is not null")
    return each.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    k: int = 5,
    percent: int = 80,
    n_hashes: int = 512,
    n_bands: int = 32,
    rows: int = 4,
    bits: int = 4,
    slack: float = 0.1,
    pivots: int = 8,
    block_rows: int = 2048,
    block_bytes: int = 32 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    A pair at the threshold shares no band once in 2e7; its estimate is `slack` (5.4 standard deviations) too low once in
    3e7, and less often the more alike the texts are.
    """
    import pyarrow.compute  # noqa: F401

    scratch = Scratch(docs.sparkSession, "neardup")
    signed = scratch.table(sign(docs, k, n_hashes, n_bands, rows, bits, id_col, text_col), "signed")
    known = signed.where("n_shingles > 0 and doc_id is not null")
    one = known.groupBy("key").agg(F.min(F.struct("doc_id", "text_key", "n_shingles", "sig", "bands")).alias("m"))
    classes = scratch.table(one.select(F.monotonically_increasing_id().alias("node"), "key", "m.*"), "classes")
    # Rows of one doc_id with several texts: their classes are linked.
    several = known.groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo != hi").select("doc_id")
    own = known.join(several, "doc_id", "left_semi").select("doc_id", "key").distinct().join(classes.select("key", "node"), "key")
    same_id = own.join(own.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")).where("a != b")

    band = classes.select("node", "n_shingles", F.posexplode("bands").alias("i", "v")).select(F.xxhash64("i", "v").alias("band"), "i", "node", "n_shingles")
    shared = band.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("band")
    band = scratch.table(band.join(shared, "band").distinct(), "band")
    signs = scratch.table(classes.join(band.select("node").distinct(), "node", "left_semi").select("node", "sig", "n_shingles", "bands", "doc_id", "text_key"), "signs")
    # All rows of a class's text and id have the same text, whatever other texts the id has.
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_key(text_col), F.col(text_col).cast("string").cast("binary").alias("t")).where("doc_id is not null and t is not null")
    texts = scratch.table(plain.join(signs.select("doc_id", "text_key", "node"), ["doc_id", "text_key"]).groupBy("node").agg(F.max("t").alias("text")), "texts")
    a = signs.select(F.col("node").alias("a"), F.col("sig").alias("sa"), F.col("n_shingles").alias("na"))
    b = signs.select(F.col("node").alias("b"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb"))
    near = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)") & (estimate("sa", "sb", n_hashes, bits) >= percent / 100 - slack)

    links = scratch.table(same_id, "links-0")
    comps = components(links, scratch, "start")
    for turn in (1, 2, 3):
        labelled = band.join(comps, "node", "left").select("band", "i", "node", "n_shingles", F.coalesce("comp", "node").alias("comp"))
        if turn == 3:
            found = _rest(labelled, signs, texts, _meet(k, percent, n_hashes, bits, slack), block_rows, block_bytes)
        else:
            pairs = _pivot_pairs(labelled, percent, 1 if turn == 1 else pivots, in_all=turn > 1)
            likely = scratch.table(pairs.join(a, "a").join(b, "b").where(near).select("a", "b"), f"pairs-{turn}")
            found = _confirm(likely, texts, k, percent)
        found = scratch.table(found, f"links-{turn}")
        if not found.limit(1).count():
            continue
        links = links.unionByName(found)
        comps = components(links, scratch, f"comp{turn}")
    # A component is named by the least doc_id of its classes, each of which has its own least.
    ids = classes.select("node", "key", "doc_id").join(comps, "node", "left")
    least = comps.join(classes.select("node", "doc_id"), "node").groupBy("comp").agg(F.min("doc_id").alias("least"))
    named = ids.join(least, "comp", "left").select("key", F.coalesce("least", "doc_id").alias("class_comp"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(named, "key", "left")
    comp = F.coalesce("class_comp", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=4, percent=80)

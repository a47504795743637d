"""Benchmark decontamination by SimHash windows, with DataFrame functions only.

1. Words are lower-cased runs of letters, digits and other non-ASCII characters; shingles are five words, hashed to 64
   bits. (An item or window with fewer words is one shingle.)
2. Windows have the item's length in words and may start at any word; a shorter text is one window. A window of n
   shingles can only reach the similarity s with an item of m if s * (n + m) / (1 + s) of its places hold a shingle of
   some item of that length, so just the windows with so many are laid: document shingles meet the benchmark's distinct
   shingles in one join, and the hit places of a text, in order, give the starts.
3. Every window and item gets a 64-bit SimHash of its shingles, each weighted by its number of occurrences.
4. Multi-index Hamming blocks: fingerprints are cut into 8 blocks of 8 bits. Items are listed under every block value
   that differs from theirs in at most 2 bits. Two fingerprints at distance 23 or less (8 * 3 - 1) have a block that
   differs in at most 2 bits, so a join on (length, block, value) finds all of them.
5. Candidates within the radius are verified: sum of minima over sum of maxima of the shingle counts, at least 0.8.

The side of the benchmark is broadcast only if its shingles, ids and listed block values are counted and at most `broadcast_rows` rows; beyond that, the
joins are left to Spark. Null or empty texts and items match nothing; a null doc_id counts as one document and a null
item_id as one item; repeated rows of a doc_id are matched as separate texts and reported once; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read

K = 5


def words_of(text: Column) -> Column:
    """Lower-case words: runs of ASCII letters and digits and non-ASCII characters."""
    return F.filter(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def shingles_of(text: Column, k: int = K) -> Column:
    """Hashes of k words in a row of a text; fewer words are one shingle, none is none.

    The words are bound by a lambda over a one-element array: an attribute could be inlined, when filters are pushed
    down, into the inner lambda, which would split the text again for every shingle.
    """

    def hashed(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(w) >= k, many).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "), F.lit(0)))).otherwise(none)

    return F.get(F.transform(F.array(words_of(text)), hashed), F.lit(0))


def _simhash(rows: DataFrame, key: list[str], shingle: str) -> DataFrame:
    """key and fp: bit j is set if more than half of the weighted shingles have it. 32 sums of two 32-bit lanes, so texts
    of up to 2**31 shingles are counted exactly."""
    lanes = [F.sum(F.expr(f"shiftrightunsigned({shingle}, {j}) & 4294967297L")).alias(f"s{j}") for j in range(32)]
    sums = rows.groupBy(*key).agg(F.count("*").alias("n"), *lanes)
    bits = [f"(case when 2 * (shiftrightunsigned(s{j}, {32 * i}) & 4294967295L) > n then shiftleft(1L, {32 * i + j}) else 0L end)" for j in range(32) for i in range(2)]
    return sums.select(*key, F.expr(" | ".join(bits)).alias("fp"))


def _block(fp: str, i: int) -> str:
    return f"cast(shiftrightunsigned({fp}, {8 * i}) & 255 as int)"


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    min_similarity: float = 0.8,
    radius: int = 23,
    k: int = K,
    broadcast_rows: int = 1_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """doc_id, item_id, first_word, n_item_words, similarity: the best window of every document for every item it has."""
    if not 0 <= radius <= 23:
        raise ValueError("8 blocks with 2 differing bits guarantee a radius of 23 at most")
    scratch = Scratch(docs.sparkSession, "decontam")
    body = F.col("text").cast("string")
    item = items.select(F.col(item_col).cast("long").alias("item_id"), F.size(words_of(body)).alias("len"), shingles_of(body, k).alias("sh"))
    item = scratch.table(item, "shingles").where("len > 0")
    item = scratch.table(item.groupBy("len", "sh").agg(F.collect_set(F.struct("item_id")).alias("ids"), F.min(F.coalesce("item_id", F.lit(-1))).alias("rank")).select("len", "sh", "ids", F.xxhash64("len", "sh", "rank").alias("item")), "items")
    places = scratch.table(item.select("len", F.explode("sh").alias("h")).distinct(), "places")
    # What is broadcast: the places, the items with their ids, and the rows that list an item's block values.
    listings = 8 * (1 + 8 + 28)
    sizes = item.agg(F.coalesce(F.sum(F.lit(listings) + F.size("ids")), F.lit(0))).first()[0]
    small = places.count() + sizes <= broadcast_rows

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), shingles_of(F.col(text_col).cast("string"), k).alias("sh"))
    # The outer form: the inner one would infer a filter on the array's size and evaluate the shingles twice.
    doc = texts.select("doc_id", F.xxhash64("sh").alias("text_key"), F.size("sh").alias("n"), F.posexplode_outer("sh").alias("p", "h"))
    # Only the shingles that some item has are needed to lay windows; their neighbours come from the second pass below.
    hits = scratch.table(doc.join(side(places.select("h").distinct()), "h", "left_semi").distinct(), "hits")
    key = ["doc_id", "text_key", "start", "len"]
    placed = hits.join(side(places), "h").groupBy("doc_id", "text_key", "n", "len").agg(F.sort_array(F.collect_set("p")).alias("ps"))
    # m and w: shingles of an item and of a window; need: the least number of hit places in the window, rounded up.
    placed = placed.withColumn("m", F.greatest(F.lit(1), F.col("len") - (k - 1))).withColumn("w", F.least("m", "n"))
    placed = placed.withColumn("need", F.greatest(F.lit(1), F.ceil(F.lit(min_similarity / (1 + min_similarity)) * (F.col("w") + F.col("m")) - 1e-6).cast("int")))
    # The starts whose first hit is ps[i] are those after ps[i - 1]; they have enough hits if ps[i + need - 1] is inside.
    least = "greatest(0, get(ps, i - 1) + 1, get(ps, i + need - 1) - w + 1)"
    runs = f"transform(sequence(0, size(ps) - need), i -> struct({least} as a, least(get(ps, i), n - w) as b))"
    starts = placed.where("size(ps) >= need").select("doc_id", "text_key", "len", F.expr(f"explode(filter({runs}, r -> r.a <= r.b))").alias("r"))
    starts = starts.select("doc_id", "text_key", "len", F.explode(F.expr("sequence(r.a, r.b)")).alias("start"))
    spans = scratch.table(starts.select(*key), "starts")
    marked = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "len")).alias("windows"))
    texts = texts.withColumn("text_key", F.xxhash64("sh"))
    same = texts["doc_id"].eqNullSafe(marked["doc_id"]) & (texts["text_key"] == marked["text_key"])
    window = texts.join(marked, same).select(texts["doc_id"], texts["text_key"], "sh", F.explode("windows").alias("x"))
    grams = F.expr(f"slice(sh, x.start + 1, greatest(1, x.len - {k - 1}))")
    window = scratch.table(window.select("doc_id", "text_key", F.col("x.start").alias("start"), F.col("x.len").alias("len"), grams.alias("own")).distinct(), "windows")

    prints = scratch.table(_simhash(window.select(*key, F.explode("own").alias("h")), key, "h"), "window-prints")
    item_prints = scratch.table(_simhash(item.select("item", "len", F.explode("sh").alias("h")), ["item", "len"], "h"), "prints")
    near = [0] + [1 << i for i in range(8)] + [1 << i | 1 << j for i in range(8) for j in range(i)]
    listed = item_prints.select("item", "len", F.col("fp").alias("ifp"), F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.expr(_block("fp", i)).alias("v")) for i in range(8)])).alias("b"))
    listed = listed.select("item", "len", "ifp", "b.block", F.explode(F.array(*[F.expr(f"b.v ^ {x}") for x in near])).alias("value"))
    probes = prints.select(*key, "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.expr(_block("fp", i)).alias("value")) for i in range(8)])).alias("b")).select(*key, "fp", "b.block", "b.value")
    close = probes.join(side(listed), ["len", "block", "value"]).where(F.expr(f"bit_count(fp ^ ifp) <= {radius}"))
    pairs = close.select(*key, "item").distinct()

    both = pairs.join(window, [F.coalesce(pairs["doc_id"], F.lit(-1)) == F.coalesce(window["doc_id"], F.lit(-1)), *(pairs[c] == window[c] for c in key[1:])]).select(pairs["doc_id"], pairs["text_key"], pairs["start"], pairs["len"], "own", "item")
    both = both.join(side(item.select("item", "sh", "ids")), "item")
    count = "size(filter({}, y -> y = x))"
    overlap = f"aggregate(array_distinct(array_intersect(own, sh)), 0, (s, x) -> s + least({count.format('own')}, {count.format('sh')}))"
    sim = both.withColumn("both", F.expr(overlap)).withColumn("similarity", F.expr("both / (size(own) + size(sh) - both)"))
    sim = sim.where(F.col("similarity") >= min_similarity)
    rows = sim.withColumn("id", F.explode("ids")).select("doc_id", "id.item_id", F.col("start").alias("first_word"), F.col("len").alias("n_item_words"), "similarity")
    best = rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("first_word")).alias("neg"), "n_item_words")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.neg")).cast("long").alias("first_word"), F.col("b.n_item_words").cast("long").alias("n_item_words"), F.round("b.similarity", 6).alias("similarity"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))

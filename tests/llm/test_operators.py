"""The operators against brute force, round trips and held-out accuracy, on small hand-made tables with odd rows."""

import inspect
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import decontam, langid, licences, media, neardup, packing, quality, sharding, substring, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, key string"
WORDS = [f"w{i}" for i in range(400)]


def _texts():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base, passage = say(60), say(55)
    out = [base, base, base.replace("w1", "x1", 1), say(30) + "\n" + passage, passage + " " + say(9), None, "", "  ", "one", "Ä ö\tü", say(3000)]
    return out + [say(rng.randint(1, 80)) for _ in range(20)] + [base + " tail"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "a", "b") for i, t in enumerate(_texts())]
    rows += [rows[3], (None, "null id text here", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(empty, spark):
    items = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = f"{neardup.Scratch(spark, 'test').root}"
    for df in (langid.predict(empty, langid.fit(empty)), packing.pack_documents(empty, packing.default_tokenizer()), neardup.near_duplicates(empty), substring.remove_repeats(empty), decontam.find_contamination(empty, items), sharding.kd_shards(empty, 4), licences.scan(empty), media.store_payloads(empty), warc.read_back(warc.write(pages, folder), folder)):
        assert df.count() == 0


def test_packing(docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack_documents(docs, packing.default_tokenizer(), max_length=64, open_bins=4, with_ids=True).collect()
    texts = dict((r.doc_id, r.text or "") for r in docs.collect())
    for i, t in texts.items():
        ids = [*tk.encode(t, add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)[: -(-len(ids) // 64) * 99]
        got = {r.start: np.frombuffer(r.ids, "<u4").tolist() for r in own}
        assert [x for s in sorted(got) for x in got[s]] == ids
        assert all(zlib.crc32(r.ids) == r.ids_crc32 and r.length <= 64 for r in own)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64


def test_near_duplicates(docs):
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    rows = [(r.doc_id, low(r.text)) for r in docs.collect() if r.doc_id is not None]
    sets = {i: {tuple(w[j : j + 4]) for j in range(len(w) - 3)} or ({tuple(w)} if w else set()) for i, w in rows}
    group = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
    got = neardup.near_duplicates(docs, k=4).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), group[r.doc_id], group[r.doc_id] == r.doc_id)


def test_packing_special_tokens(spark):
    from tokenizers import Tokenizer

    texts = ["a<|endoftext|>b", "<|startoftext|> Hello, <|endoftext|>", "x <|endoftext|>\x1c y's", "<|ENDOFTEXT|> <| endoftext|>", "<|endoftext|><|endoftext|>"]
    tk = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), packing.default_tokenizer(), with_ids=True).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == {i: [*tk.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}


def _brute_groups(rows, k):
    """The least id of each row's group: nodes are rows, links have similarity 0.8 or one id."""
    sets = [{tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for w in (t.split() for _, t in rows)]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and (rows[i][0] == rows[j][0] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min(i, least.get(g, i))
    return {i: least[g] for (i, _), g in zip(rows, group, strict=True)}


@pytest.mark.parametrize("block_rows", [16, 2048])
def test_near_duplicates_just_below_the_threshold(spark, block_rows):
    """A family at similarity 0.7 or so, with a few copies: pivots link little, blocks of a band decide the rest."""
    rng = random.Random(3)
    base = [rng.choice(WORDS) for _ in range(90)]
    rows = []
    for i in range(60):
        own = list(base)
        own[i % 80 + 4] = f"own{i}"
        rows.append((i, " ".join([*own, *(f"end{i}x{j}" for j in range(5))])))
    rows += [(100 + i, rows[i][1] + " more") for i in range(0, 60, 9)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=5, pivots=2, block_rows=block_rows).collect()
    assert {r.doc_id: r.component_id for r in got} == _brute_groups(rows, 5)


def test_near_duplicates_large_family_ends(spark):
    """1,300 texts of 103 common and 21 own words: similarity 0.70, no link; three rounds see all of them."""
    rng = random.Random(4)
    base = [rng.choice(WORDS) for _ in range(103)]
    rows = [(i, " ".join([*base, *(f"own{i}x{j}" for j in range(21))])) for i in range(1300)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert len(got) == 1300 and all(r.kept and r.component_id == r.doc_id for r in got)


def test_pivots_of_a_class_do_not_grow_with_its_bands(spark):
    """400 classes, none linked, of which a different half is in each of 32 bands; the last 40 are too long for the others."""
    rng = random.Random(3)
    rows = [(b, b, n, 100 if n < 360 else 200, n) for b in range(32) for n in rng.sample(range(400), 200)]
    labelled = spark.createDataFrame(rows, "band long, i int, node long, n_shingles long, comp long")
    members = {b: {r[2] for r in rows if r[0] == b} for b in range(32)}
    for pivots, in_all in ((1, False), (8, True)):
        pairs = [tuple(r) for r in neardup._pivot_pairs(labelled, 80, pivots, in_all).collect()]
        assert all(a < b and (a < 360) == (b < 360) and any({a, b} <= m for m in members.values()) for a, b in pairs)
        assert len(set(pairs)) == len(pairs) <= (8 * 400 if in_all else len(rows))


def test_estimate_loses_no_more_than_the_bands():
    """By the normal tail, a pair at 0.8 (chance agreement of the low bits included) against its chance to share no band."""
    p = {n: x.default for n, x in inspect.signature(neardup.near_duplicates).parameters.items()}
    chance = 2.0 ** -p["bits"]
    agree = 0.8 + 0.2 * chance
    deviation = math.sqrt(agree * (1 - agree) / p["n_hashes"]) / (1 - chance)
    assert math.erfc(p["slack"] / deviation / math.sqrt(2)) / 2 <= (1 - 0.8 ** p["rows"]) ** p["n_bands"]


def test_near_duplicates_of_each_text_of_an_id(spark):
    """One id with several texts: near copies of every one of them join its component."""
    rng = random.Random(8)
    say = lambda: " ".join(rng.choice(WORDS) for _ in range(60))
    a, b, c, d, e = say(), say(), say(), say(), say()
    rows = [(1, a), (1, b), (1, c), (1, c), (5, a + " end"), (6, b + " end"), (7, c + " end"), (9, d), (3, d), (9, e), (4, e + " end"), (11, say())]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    want = _brute_groups(rows, 4)
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == want[r.doc_id]) for r in got)


def test_scratch_tables_leave_no_shuffle_files(spark):
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    files = lambda: {f for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|").split("|") if "shuffle_" in (f := d)}
    old = files()
    table = neardup.Scratch(spark, "test").table(spark.range(10_000).groupBy((F.col("id") % 500).alias("k")).count(), "t")
    end = time.time() + 20
    while (left := files() - old) and time.time() < end:
        time.sleep(0.2)
    assert not left and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before
    assert table.count() == 500 and table.agg(F.sum("count")).first()[0] == 10_000


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(50, 60), (60, 55), (70, 70)]
    got = neardup.components(spark.createDataFrame(edges, "a long, b long"), neardup.Scratch(spark, "cc"), "t").collect()
    assert {r.node: r.comp for r in got} == {**{i: 0 for i in range(41)}, 50: 50, 60: 50, 55: 50, 70: 70}


def test_substring(docs):
    rows = sorted(((r.doc_id if r.doc_id is not None else -(2**63), (r.text or "").split()) for r in docs.collect()), key=lambda x: x[0])
    first, want = {}, {}
    for i, w in rows:
        for a in range(len(w) - 19):
            first.setdefault(tuple(w[a : a + 20]), (i, a))
    for i, w in rows:
        gone = {x for a in range(len(w) - 19) if first[tuple(w[a : a + 20])] < (i, a) for x in range(a, a + 20)}
        want[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    for block in (64, 1 << 20):
        got = substring.remove_repeats(docs, block_bytes=block).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_words, r.n_removed, r.kept_text) == want[r.doc_id if r.doc_id is not None else -(2**63)]


def test_later_decides_by_words():
    text = [b"a", b"b", b"a", b"b"]
    flags = substring._later(np.zeros(4, np.uint64), np.array([0, 1, 2, 3]), np.zeros(4, np.int64), lambda i: text[i])
    assert flags.tolist() == [False, False, True, True]


def test_decontamination(spark, docs):
    passage = _texts()[4].split()[:55]
    near = [*passage[:20], "changed", *passage[21:]]
    items = spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(near)), (3, "never seen in any text at all of this"), (4, None), (5, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.find_contamination(docs, items).collect()}
    assert {k for k in got if got[k] == 1} == {(3, 1), (4, 1)}
    assert set(got) == {(3, 1), (4, 1), (3, 2), (4, 2)} and got[3, 2] >= 0.8


def _best_windows(docs, items, k=decontam.K):
    """(doc_id, item_id): similarity (rounded) and first word of the best of all windows of the item's length."""
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    grams = lambda w: Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])
    best = {}
    for i, text in docs:
        for j, item in items:
            w, own = cut(text), cut(item)
            for s in range(max(1, len(w) - len(own) + 1)) if w and own else ():
                a, b = grams(w[s : s + len(own)]), grams(own)
                sim = (a & b).total() / (a | b).total()
                if sim >= 0.8 and sim > best.get((i, j), (0,))[0]:
                    best[i, j] = (sim, s)
    return {x: (round(sim, 6), s) for x, (sim, s) in best.items()}


def test_decontamination_all_windows(spark):
    """Against all windows: items cut at the edges of a text, texts shorter than the item, and swapped halves."""
    rng = random.Random(11)
    say = lambda n: [rng.choice(WORDS) for _ in range(n)]
    item, short, line = say(50), say(12), say(4)
    around = [say(30), item, say(30)]
    texts = [item[a:] + say(40) for a in range(1, 7)] + [say(40) + item[: 50 - a] for a in range(1, 7)] + [item[:-1], item[1:], item[:44], item[3:48]]
    texts += [say(30) + item[25:] + item[:25] + say(30), say(20) + item[:24] + say(2) + item[24:] + say(20), say(9) + item[:20] + ["odd"] + item[21:] + say(9)]
    texts += [sum(around, []), short[:-1], say(5) + short, short[1:] + say(5), line * 30, say(200), [], say(3), item + item[2:]]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(98, None), (99, "")]
    items = [(1, " ".join(item)), (2, " ".join(short)), (3, " ".join(line * 10)), (4, None), (5, " ".join(item[:-2] + ["new", "end"]))]
    want = _best_windows(docs, items)
    got = decontam.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in got} == want
    assert {(i, 1) for i in (0, 1, 2, 6, 7, 12, 13, 16)} <= set(want)


def test_decontamination_null_item_id(spark, docs):
    texts = _texts()
    items = spark.createDataFrame([(None, texts[4]), (None, texts[0]), (7, texts[0])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_contamination(docs, items).collect()}
    assert {(4, None), (0, None), (1, None), (0, 7), (1, 7)} <= got


def test_shards(docs):
    got = sharding.kd_shards(docs, 4).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert len(got) == docs.count() and set(by) <= set(range(4))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.size == len(texts[r.doc_id]) + 16 for r in got)


def test_shards_near_equal(spark):
    df = spark.range(5000).selectExpr("id % 50 + 7 * id doc_id", "repeat('x', cast(id % 90 as int)) text", "'one' source", "'en' lang")
    sums = [r.s for r in sharding.kd_shards(df, 40).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sums) == 40 and max(sums) < 1.05 * min(sums)


def test_shards_of_equal_rows(spark):
    """4,000 rows of null id and null text: the law of near equal bytes holds for them too."""
    rows = spark.range(4000).selectExpr("cast(null as long) doc_id", "cast(null as string) text", "cast(null as string) lang", "cast(null as string) source")
    got = sharding.kd_shards(rows, 4).collect()
    for shard in range(4):
        own = sorted(r.slot for r in got if r.shard == shard)
        assert own == list(range(len(own))) and abs(len(own) - 1000) <= 10


def test_shards_of_target_bytes(spark):
    df = spark.range(1000).selectExpr("id doc_id", "repeat('x', 84) text")
    sums = [r.s for r in sharding.kd_shards(df, target_bytes=12_500).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sums) == 8 and max(sums) <= 1.02 * 12_500


def test_licences(spark):
    texts = ["Released under the terms of the MIT License.", "This program is licensed under the GNU Lesser General Public License, version 3.", "mit license, MIT-License", "Licensed under CC BY-NC 4.0", "unlicensed", None]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (got[0].labels, got[0].base_labels, got[0].first_word) == ("mit,mit-grant", "mit", 6)
    assert got[1].labels == "gpl,gpl-notice" and got[2].n_base == 2 and got[2].labels == "mit"
    assert got[3].labels == "cc-by-nc-4.0" and got[3].base_labels == "" and (got[4].score, got[5].n_words) == (0, 0)


def test_media():
    rng = np.random.default_rng(1)
    for n in (0, 1, 576, 577, 5000, 40_000):
        payload = media.padded(rng.integers(0, 256, n, dtype=np.uint8).tobytes())
        raw = media.encode_payload(payload)
        fast, slow = media.decode(raw), media.decode(raw, fast=False)
        assert media.payload_of(fast) == media.payload_of(slow) == payload
        assert fast.rgb().shape == (fast.height, fast.width, 3)
    with pytest.raises(ValueError):
        media.decode(b"no image")


def test_inverse_transform():
    """A DC of 8 * 50 lifts all samples by 50; a single AC gives its cosine."""
    image = media.Image(8, 8, [{"id": 1, "h": 1, "v": 1, "tq": 0, "quant": np.ones(64, np.int64)}])
    image.parts[0]["coefs"][0, 0, 0] = 400
    assert (image.rgb() == 178).all()
    image.parts[0]["coefs"][0, 0, 1] = 100
    wave = 178 + 100 / 4 * np.sqrt(0.5) * np.cos((2 * np.arange(8) + 1) * np.pi / 16)
    assert np.abs(image.rgb()[3, :, 0] - wave).max() <= 1


def test_refinement_scan_with_new_coefficients():
    """Zero runs, new values and corrections, by hand: band 1 to 3 of one block, low bit 0."""
    codes = media._codes(media.AC_TABLE)
    bits = lambda s: format(codes[s][0], f"0{codes[s][1]}b")
    word = bits(0x11) + "1" + "1" + bits(0x00)  # after one zero a new +1; on the way a correction of the non-zero
    data = int(word.ljust(-(-len(word) // 8) * 8, "1"), 2).to_bytes(-(-len(word) // 8), "big")
    out = np.array([[2, 0, 0]], np.int32)
    media._ac_refine(media._Bits(data), out, media.AC_TABLE, 0)
    assert out.tolist() == [[3, 0, 1]]


def test_media_table(spark, docs):
    got = media.decode_media(media.store_payloads(docs)).collect()
    assert len(got) == docs.count() and all(len(r.rgb) == r.width * r.height * 3 for r in got)


def test_warc(spark):
    html = ["x" * 200, "x" * 200, "short", "short", None, "ü" * 90]
    pages = spark.createDataFrame([(9 - i, f"http://e.x/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    folder = neardup.Scratch(spark, "warc").root
    got = {r.page_id: r for r in warc.read_back(warc.write(pages, folder, shard_bytes=700, file_bytes=300), folder).collect()}
    assert (got[9].record_type, got[9].refers_to, got[8].record_type) == ("revisit", 8, "response")
    assert got[5].payload_bytes == 0 and got[7].record_type == got[6].record_type == "response" and got[4].payload_bytes == 180
    again = neardup.Scratch(spark, "warc").root
    a, b = warc.write(pages, folder, shard_bytes=700), warc.write(pages.repartition(3), again, shard_bytes=700)
    assert sorted((r.file, r.sha256) for r in a.collect()) == sorted((r.file, r.sha256) for r in b.collect())


def test_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lang = langid.op1_language(spark, folder).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred != 'und'")
    assert lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.96
    scored = quality.op4_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    assert scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.95


def test_sql_twins(spark, tmp_path):
    import duckdb

    from veilframe.llm import registry

    texts = _texts()
    long, short = "<p>" + "ä" * 80 + "</p>", "<p>"
    html = [long, short, None, long, "", short, long + " ", None, "x" * 100, "x" * 100, "y" * 99, "y" * 99]
    tables = {"documents": ("doc_id long, text string", list(enumerate(texts))), "pages": ("page_id long, url string, html string", [(i, f"http://a/{i}", h) for i, h in enumerate(html)])}
    con = duckdb.connect()
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name, sql in registry.ORACLE_SQL.items():
        want = con.sql(sql)
        got = registry.QUERIES[name](spark, str(tmp_path)).select(want.columns).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall())), name

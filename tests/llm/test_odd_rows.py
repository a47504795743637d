"""Queries against plain Python versions, on nulls, empty and repeated rows, ties and columns with the operators' own names."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import decontam, langid, licences, media, neardup, packing, quality, sharding, substring, warc

WORDS = [f"w{i}" for i in range(300)]


def _say(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents, labels and pages with odd rows: null ids and texts, repeated rows, equal texts, a long text."""
    rng = random.Random(2)
    spoken = {"en": "the of and to in is that it was for on are with they be at one have this from", "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als", "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au"}
    rows = []
    for i in range(60):
        lang = list(spoken)[i % 3]
        text = " ".join(rng.choice(spoken[lang].split()) for _ in range(rng.randint(20, 90)))
        rows.append((i, text + (" !!! ### " * 9 if i % 5 == 1 else "."), lang, f"s{i % 4}", len(text)))
    rows += [(60, None, "en", None, None), (61, "", "de", "s", 0), (62, "  \n", None, "s", 3), (63, "12345 ---", "en", "s", 9), (None, "the of and to", None, None, None), (None, None, None, None, None)]
    rows += [rows[3], rows[3], (64, rows[5][1], "fr", "s9", 5), (65, " ".join([rows[0][1]] * 400), "en", "s", 1), (66, "x", None, "s", 1), (67, "é" * 700, "fr", "s", 1)]
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 1), 0) for i in range(60)] + [(None, 1, 0), (3, 1, 0), (5, None, 0), (7, 9, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    html = ["<p>" + "a" * 200, "<p>" + "a" * 200, "x", "x", None, "", "<p>" + "b" * 300]
    pages = [(i, f"http://e.x/{i}", h) for i, h in enumerate(html)] + [(None, "http://e.x/n", html[0]), (None, None, None), (1, "http://e.x/1", html[1]), (6, "http://e.x/6b", "other " * 30)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


def _docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_language_by_brute_force(spark, folder):
    """Every answer from its definition, with the dictionaries of the fit; equal texts get equal answers."""
    import zstandard as zstd

    docs = _docs(spark, folder)
    model = langid.fit(langid.learn_rows(docs))
    packs = {}
    for lang, content in model.items():
        given = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        given.precompute_compress(level=6)
        packs[lang] = zstd.ZstdCompressor(level=6, dict_data=given, write_content_size=False, write_checksum=False)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(re.sub(r"[^\W\d_]+|(.)", lambda m: m[0] if m[1] is None else " ", (r.text or "").lower(), flags=re.S))
    got = langid.op1_language(spark, folder).collect()
    assert len(got) == docs.count()
    for r in got:
        wanted = set()
        for t in texts[r.doc_id]:
            raw = " ".join(t.split()).encode()
            sizes = {k: sum(len(p.compress(b" " * 256 + raw[i : i + 4096])) for i in range(0, len(raw), 4096)) for k, p in packs.items()}
            best = min(sizes, key=lambda k: (sizes[k], list(sizes).index(k))) if raw else "und"
            wanted.add((best, round(1 / sum(math.exp((sizes[best] - s) / 4) for s in sizes.values()), 9) if raw else 0.0))
        assert (r.lang_pred, round(r.score, 9)) in wanted and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_media_by_brute_force(spark, folder):
    texts = [(r.doc_id, (r.text or "").encode()) for r in _docs(spark, folder).collect()]
    want = []
    for i, t in texts:
        n = max(576, -(-len(t) // 576) * 576)
        payload = t + b"\xff" * (n - len(t))
        want.append((i, len(t), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    got = media.op2_media(spark, folder).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got))) == sorted(map(repr, want))
    by = {}
    for r in got:
        by.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by.values())


def test_quality_rows(spark, folder):
    docs = _docs(spark, folder)
    got = quality.op4_quality(spark, folder).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[3]) == 1 and by[64] == by[5] and len(by[None]) <= 2
    marked = [r.score for r in got if r.doc_id is not None and r.doc_id < 60 and r.doc_id % 5 == 1]
    assert max(marked) < min(s for i, v in by.items() if i is not None and i < 60 and i % 5 != 1 for s in v)


def test_quality_sums_do_not_depend_on_partitions(spark, folder):
    stats = quality.document_statistics(_docs(spark, folder))
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    one, many = (quality.fit(stats.repartition(n), labels).weights for n in (1, 5))
    assert np.allclose(one, many)


def test_isotonic_by_hand():
    steps = quality.isotonic(np.array([0.0, 2, 1, 0, 4]), np.array([2.0, 2, 2, 0, 4]), 0.5)
    assert np.allclose(steps, [0.5 / 3, 3.5 / 5, 3.5 / 5, (3.5 / 5 + 4.5 / 5) / 2, 4.5 / 5]) and (np.diff(steps) >= 0).all()


def test_shards_rows(spark, folder):
    docs = _docs(spark, folder)
    got = sharding.op5_shards(spark, folder).collect()
    want = sorted(map(repr, ((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())))
    assert sorted(map(repr, ((r.doc_id, r.size, r.text_crc32) for r in got))) == want
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_licence_base_by_brute_force(spark, folder):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    extra = ["MIT license, apache LICENSE; General Public License general public license", "mit é license", "amit license", None, "", "mit  \n license" * 3]
    texts = [(r.doc_id, r.text) for r in _docs(spark, folder).collect()] + [(1000 + i, t) for i, t in enumerate(extra)]
    got = {}
    for r in licences.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))
    for i, t in texts:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        at = [(j, label) for p, label in phrases.items() for j in range(len(w)) if tuple(w[j : j + len(p)]) == p]
        starts = [j for j, _ in at]
        assert (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))) in got[i]


def test_licence_templates(spark):
    texts = [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
        "# SPDX-License-Identifier: Apache-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org",
        "This software is provided 'as-is', without any implied warranty.",
    ]
    got = {r.doc_id: set(r.labels.split(",")) for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert "gpl-header" in got[0] and "spdx-tag" in got[1] and "mpl-2.0-notice" in got[2] and got[3] == {""}


def test_warc_odd_rows(spark, folder):
    """Null and repeated page ids: every record has an id of its own, every row comes back."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    at = neardup.Scratch(spark, "odd-warc").root
    manifest = warc.write(pages, at, shard_bytes=600, file_bytes=400)
    got = sorted(repr((r.page_id, r.payload_bytes, r.record_type, r.refers_to)) for r in warc.read_back(manifest, at).collect())
    html = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, h in html:
        if i is not None and len(h) >= 100:
            first[h] = min(i, first.get(h, i))
    want = [(i, len(h), "revisit" if i is not None and first.get(h, i) != i else "response", first[h] if i is not None and first.get(h, i) != i else None) for i, h in html]
    assert got == sorted(map(repr, want))
    names = [h[b"WARC-Record-ID"] for r in manifest.collect() for h in _heads(f"{at}/{r.file}")]
    assert len(names) == len(set(names))


def _heads(path):
    with open(path.removeprefix("file://"), "rb") as f:
        for member in warc.members(f):
            head = dict(x.split(b": ", 1) for x in member.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:])
            yield head


def test_fingerprint_of_many_shingles(spark):
    """More occurrences than 16 bits count: the fingerprint of one shingle is that shingle."""
    rows = spark.range(70_000).selectExpr("0L as item", "1 as len", "-81985529216486896L as h")
    assert decontam._simhash(rows, ["item", "len"], "h").first().fp == -81985529216486896


CLASHING = "doc_id text_key n_shingles sig bands node comp band shard slot size score kept spans stats media payload place row which accepted hits piece key b r len starts windows p".split()


def _sorted(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("name", ["langid", "quality", "media", "shards", "licences", "substring", "packing", "neardup", "decontam"])
def test_clashing_columns(spark, folder, name):
    """Columns with the operators' own names change nothing."""
    docs = _docs(spark, folder).where("doc_id < 20 or doc_id is null or doc_id = 64")
    more = docs.withColumns({c: F.lit("x") for c in CLASHING if c not in docs.columns})
    items = docs.where("doc_id in (3, 8)").selectExpr("doc_id item_id", "text")
    model = langid.fit(docs)
    run = {
        "langid": lambda d: langid.predict(d, model),
        "quality": lambda d: quality.document_statistics(d),
        "media": lambda d: media.store_payloads(d),
        "shards": lambda d: sharding.kd_shards(d, 3).select("doc_id", "size", "text_crc32"),
        "licences": lambda d: licences.scan(d),
        "substring": lambda d: substring.remove_repeats(d),
        "packing": lambda d: packing.pack_documents(d, packing.default_tokenizer()).select("doc_id", "piece", "length", "ids_crc32"),
        "neardup": lambda d: neardup.near_duplicates(d),
        "decontam": lambda d: decontam.find_contamination(d, items),
    }[name]
    got = _sorted(run(more))
    assert got == _sorted(run(docs)) and got

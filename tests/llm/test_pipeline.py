"""The corpus pipeline, stage by stage, against a plain Python version, on real texts with planted copies and passages."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from veilframe.llm import packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """120 documents of the smallest tables, and planted: exact and near copies, shared passages, benchmark passages
    cut, whole and changed, nulls, an empty and a long text."""
    rng = random.Random(9)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120).select(corpus_pipeline.COLUMNS).collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(12).select("item_id", "text").collect()]
    clean = [d for d in docs if d[1] and 60 <= len(d[1].split()) <= 250]
    passage = clean[1][1].split()[:55]

    def mixed(words, at):
        host = rng.choice(clean)[1].split()
        return " ".join([*host[:at], *words, *host[at : at + 30]])

    texts = [clean[0][1], clean[0][1] + " again", clean[2][1].replace(" ", "  ", 3), mixed(passage, 20), mixed(passage, 5), None, "", " ".join([clean[3][1]] * 30)]
    for _, text in items[:4]:
        w = text.split()
        texts += [mixed(w, 10), mixed(w[2:], 25), mixed([*w[: len(w) // 2], "changed", *w[len(w) // 2 + 1 :]], 8)]
    rows = docs + [(10_000 + i, t, "en", "planted", len(t or "")) for i, t in enumerate(texts)] + [(None, clean[4][1] + " null", "en", "planted", 9)]
    at = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([*items, (None, "a null id is an item of its own here"), (99, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def _rows(df):
    return [tuple(r) for r in df.select(corpus_pipeline.COLUMNS).collect()]


def _near(rows):
    """Rows whose id is the least of its group; rows of one id are one document."""
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words = [low(r[1]) for r in rows]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in words]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or group[i] == group[j]:
                continue
            if rows[i][0] == rows[j][0] or sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for r, g in zip(rows, group, strict=True):
        if r[0] is not None:
            least[g] = min(r[0], least.get(g, r[0]))
    return [r for r, g in zip(rows, group, strict=True) if r[0] is None or r[0] == least[g]]


def _cut(rows):
    order = sorted(rows, key=lambda r: -(2**63) if r[0] is None else r[0])
    seen, out = {}, []
    for r in order:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        for a in range(len(w) - 19):
            seen.setdefault(tuple(w[a : a + 20]), (r[0], a))
    for r in order:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        gone = {x for a in range(len(w) - 19) if seen[tuple(w[a : a + 20])] != (r[0], a) for x in range(a, a + 20)}
        text = " ".join(x for i, x in enumerate(w) if i not in gone)
        if not gone:
            out.append(r)
        elif text:
            out.append((r[0], text, r[2], r[3], len(text)))
    return out


def _leaks(rows, items):
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    grams = lambda w: Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    out = set()
    for i, text, *_ in rows:
        w = cut(text)
        every = set(grams(w))
        for _, item in items:
            own = cut(item)
            b = grams(own)
            if not own or not every & set(b):
                continue
            for s in range(max(1, len(w) - len(own) + 1)):
                a = grams(w[s : s + len(own)])
                if (a & b).total() >= 0.8 * (a | b).total():
                    out.add(i)
                    break
    return out


def test_stages_by_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    scratch = corpus_pipeline.Scratch(spark, "test-pipeline")

    def step(name, df):
        out = stages[name](spark, df, folder)
        assert out.columns == corpus_pipeline.COLUMNS
        return scratch.table(out, name)

    known = step("language_id", docs)
    rows, before = _rows(known), _rows(docs)
    assert set(map(repr, rows)) <= set(map(repr, before)) and not any(r[1] is None or not re.search(r"[^\W\d_]", r[1]) for r in rows)
    assert len(rows) >= 0.95 * sum(bool(r[1] and re.search(r"[^\W\d_]", r[1])) for r in before)
    near = step("minhash_near_dedup", known)
    assert sorted(map(repr, _rows(near))) == sorted(map(repr, _near(rows)))
    assert not {10_000, 10_001, 10_002} & {r[0] for r in _rows(near)}
    passages = step("substring_dedup", near)
    assert sorted(map(repr, _rows(passages))) == sorted(map(repr, _cut(_rows(near))))
    clean = step("benchmark_decontamination", passages)
    leaks = _leaks(_rows(passages), items)
    assert sorted(map(repr, _rows(clean))) == sorted(repr(r) for r in _rows(passages) if r[0] not in leaks) and leaks
    packed = corpus_pipeline.run(spark, folder).collect()
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for i, t, *_ in _rows(clean):
        want[i] += len(tk.encode(t or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == want


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""Substring dedup by super-k-mers: windows of words that share a minimiser travel as one packed string.

1. Each task takes blocks of whole documents. Words are joined by one space; every window of `window` words is hashed,
   and windows of equal words within the block are found by sorting and confirmed byte by byte. Only the first in a
   block travels; later ones are known to be repeats and travel as spans of word positions only. So a passage that
   millions of documents share adds one window per block to its bucket.
2. A window's minimiser is the least hash of its `gram`-word grams. Consecutive travelling windows with one minimiser are
   one string, packed with others of the same block and bucket.
3. In a bucket, the windows are sorted; equal hashes are confirmed byte by byte. A window whose words also start at a
   smaller (doc_id, start) is a repeat.
4. The spans of repeats join the documents, and the words that they cover go.

Rows: null text has no words. A null doc_id counts as the smallest id. Rows that share a doc_id are separate texts of
equal rank: windows at the same start in them are no repeats of each other. Spans find their row by (doc_id, text hash).
A word may be of any length, a document too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, gram_hashes, mix, read, slices, word_hashes

_ROUTED = "bucket int, doc_id long, row_key long, first long, last long, blob binary"
_SPANS = "doc_id long, row_key long, first long, last long"
_SPACE = np.uint8(32)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts joined by one space; word starts and ends, and the first word of each text."""
    words = [t.split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    raw = b" ".join([b" ".join(w) for w in words if w])
    buf = np.frombuffer(raw, np.uint8)
    gaps = np.flatnonzero(buf == _SPACE)
    starts = np.r_[0, gaps + 1] if len(buf) else np.zeros(0, np.int64)
    ends = np.r_[gaps, len(buf)] if len(buf) else np.zeros(0, np.int64)
    return buf, raw, starts, ends, np.r_[0, np.cumsum(counts)]


def _later(hashes: np.ndarray, doc: np.ndarray, start: np.ndarray, text_of) -> np.ndarray:
    """True for windows whose words also stand at a smaller (doc, start). text_of(i) is a window's string."""
    order = np.lexsort((start, doc, hashes))
    h = hashes[order]
    new = np.r_[True, h[1:] != h[:-1]]
    later = np.zeros(len(h), bool)
    if new.all():
        return later
    groups = np.flatnonzero(new)
    head = np.repeat(groups, np.diff(np.r_[groups, len(h)]))
    lead = order[head]
    later[order] = (doc[order] != doc[lead]) | (start[order] != start[lead])
    odd = set()
    for i in np.flatnonzero(~new).tolist():
        if text_of(order[i]) != text_of(lead[i]):
            odd.add(int(head[i]))
    for g in odd:  # equal hashes of different words: decide the whole group by the words
        end = int(np.searchsorted(groups, g, "right"))
        members = order[g : groups[end] if end < len(groups) else len(h)]
        first: dict[bytes, tuple[int, int]] = {}
        for m in members.tolist():
            at = (int(doc[m]), int(start[m]))
            later[m] = first.setdefault(text_of(m), at) != at
    return later


def _runs(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs of true flags; breaks[i]: a run may not go on from i-1 to i."""
    begin = flags & (np.r_[True, ~flags[:-1]] | breaks)
    end = flags & np.r_[~flags[1:] | breaks[1:], True] if len(flags) else flags
    return np.flatnonzero(begin), np.flatnonzero(end)


def _minimum_over(x: np.ndarray, width: int) -> np.ndarray:
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def _pack(arrays: dict[str, np.ndarray], text: bytes) -> bytes:
    import zstandard as zstd

    parts = [a.astype(np.int64).tobytes() for a in arrays.values()]
    return zstd.ZstdCompressor(level=3).compress(len(parts[0]).to_bytes(8, "little") + b"".join(parts) + text)


def _unpack(blob: bytes) -> tuple[np.ndarray, bytes]:
    import zstandard as zstd

    raw = zstd.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(raw, np.int64, 4 * n // 8, 8).reshape(4, -1), raw[8 + 4 * n :]


def route(docs: DataFrame, window: int, gram: int, buckets: int, block_bytes: int) -> DataFrame:
    """Rows for the buckets: blobs of super-k-mers, and spans of repeats that a block already knows (blob null)."""

    def block(ids, keys, texts):
        order = sorted(range(len(ids)), key=lambda i: (ids[i], keys[i]))
        ids = np.array([ids[i] for i in order], np.int64)
        keys = np.array([keys[i] for i in order], np.int64)
        buf, raw, starts, ends, cut = _joined([texts[i] for i in order])
        words = word_hashes(buf, starts, ends)
        n = len(words) - window + 1
        if n <= 0:
            return None
        of = np.repeat(np.arange(len(ids)), np.diff(cut))
        whole = of[:n] == of[window - 1 :]
        place = np.arange(len(words)) - cut[of]
        hashes = gram_hashes(words, window)
        at = np.flatnonzero(whole)
        later = np.zeros(n, bool)
        later[at] = _later(hashes[at], ids[of[at]], place[at], lambda i: raw[starts[at[i]] : ends[at[i] + window - 1]])
        least = _minimum_over(gram_hashes(words, gram), window - gram + 1)[:n]
        new_doc = np.r_[True, of[1:n] != of[: n - 1]]
        a, b = _runs(later & whole, new_doc)
        spans = (ids[of[a]], keys[of[a]], place[a], place[b] + window - 1)
        a, b = _runs(~later & whole, new_doc | np.r_[True, least[1:] != least[:-1]])
        bucket = (mix(least[a]) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        a, b, bucket = a[by], b[by], bucket[by]
        text = [raw[s:e] for s, e in zip(starts[a].tolist(), ends[b + window - 1].tolist(), strict=True)]
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(a) else np.zeros(0, np.int64)
        blobs = []
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            own = slice(s, e)
            arrays = {"doc": ids[of[a[own]]], "key": keys[of[a[own]]], "start": place[a[own]], "n": b[own] - a[own] + 1}
            blobs.append((int(bucket[s]), _pack(arrays, b" ".join(text[own]))))
        return spans, blobs

    def run(batches):
        held: tuple[list, list, list] = ([], [], [])
        size = 0

        def flush():
            out = block(*held)
            for x in held:
                x.clear()
            if out is None:
                return
            (d, k, f, t), blobs = out
            nb, ns = len(blobs), len(d)
            # Known spans only pass through a bucket: any will do, so they are spread evenly, those of copies too.
            own = mix(np.asarray(d, np.int64).view(np.uint64)) + np.asarray(k, np.int64).view(np.uint64) + np.asarray(f, np.int64).view(np.uint64)
            spread = (mix(own) % np.uint64(buckets)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[np.array([x for x, _ in blobs], np.int64), spread].astype(np.int32)),
                    *(pa.concat_arrays([pa.nulls(nb, pa.int64()), pa.array(np.asarray(x, np.int64))]) for x in (d, k, f, t)),
                    pa.concat_arrays([pa.array([x for _, x in blobs], pa.binary()), pa.nulls(ns, pa.binary())]),
                ],
                ["bucket", "doc_id", "row_key", "first", "last", "blob"],
            )

        for part in slices(batches, rows=1024):
            for i, k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                held[0].append(i), held[1].append(k), held[2].append(t)
                size += len(t)
                if size >= block_bytes:
                    yield from flush()
                    size = 0
        if held[0]:
            yield from flush()

    return docs.mapInArrow(run, _ROUTED)


def _bucket(window: int):
    def run(table: pa.Table) -> pa.Table:
        blobs = table.column("blob")
        known = table.filter(pa.compute.is_null(blobs)).select(["doc_id", "row_key", "first", "last"])
        columns, texts = [], []
        for blob in blobs.drop_null().to_pylist():
            arrays, text = _unpack(blob)
            columns.append(arrays)
            texts.append(text)
        if not texts:
            return known
        doc, key, start, n = np.concatenate(columns, axis=1)
        raw = b" ".join(texts)
        del texts, columns
        buf = np.frombuffer(raw, np.uint8)
        gaps = np.flatnonzero(buf == _SPACE)
        starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(buf)]
        hashes = gram_hashes(word_hashes(buf, starts, ends), window)
        first = np.r_[0, np.cumsum(n + window - 1)[:-1]]  # the first word of each string
        run_of = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(run_of)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        at = first[run_of] + inside
        place = start[run_of] + inside
        later = _later(hashes[at], doc[run_of], place, lambda i: raw[starts[at[i]] : ends[at[i] + window - 1]])
        a, b = _runs(later, np.r_[True, run_of[1:] != run_of[:-1]])
        own = run_of[a]
        found = pa.table({"doc_id": doc[own], "row_key": key[own], "first": place[a], "last": place[b] + window - 1})
        return pa.concat_tables([known.cast(found.schema), found])

    return run


def repeated_spans(docs: DataFrame, window: int = 20, gram: int = 3, bucket_bytes: int = 6 << 20, block_bytes: int = 1 << 20) -> DataFrame:
    """Spans of word positions (first to last, both included) that later copies of windows cover, by (doc_id, row_key).

    docs: doc_id (not null), row_key, text as binary (not null). The number of buckets follows the bytes of text.
    """
    import pyarrow.compute  # noqa: F401

    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(64, -(-total // bucket_bytes))
    return route(docs, window, gram, buckets, block_bytes).groupBy("bucket").applyInArrow(_bucket(window), _SPANS)


_CUT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
_NO_ID = -(2**63)


def with_spans(docs: DataFrame, window: int, id_col: str, text_col: str, carry: list[str], **tuning) -> DataFrame:
    """doc_id (null as the least long), text as binary, spans (null where nothing repeats), carried columns."""
    scratch = Scratch(docs.sparkSession, "substring")
    text = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"), *(F.col(c).alias(f"carried_{c}") for c in carry))
    found = repeated_spans(plain.select("doc_id", "row_key", "text"), window, **tuning)
    spans = scratch.table(found.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "spans")
    return plain.join(spans, ["doc_id", "row_key"], "left").drop("row_key")


def remaining(text: bytes, spans: list[dict] | None) -> tuple[int, list[bytes]]:
    """The number of words, and those that no span covers."""
    words = text.split()
    if not spans:
        return len(words), words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, [s["first"] for s in spans], 1)
    np.add.at(change, [s["last"] + 1 for s in spans], -1)
    return len(words), [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def cut_documents(docs: DataFrame, columns: list[str], window: int = 20, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", **tuning) -> DataFrame:
    """docs with repeats cut from the text and size_col its new length; rows that lose all their words go.

    A row that loses nothing stays as it is.
    """
    given = with_spans(docs, window, id_col, text_col, columns, **tuning)

    def run(batches):
        for part in slices(batches, rows=512):
            texts, stays = [], []
            for text, spans in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                out = b" ".join(remaining(text, spans)[1]) if spans else None
                texts.append(None if out is None else out.decode())
                stays.append(out != b"")
            got = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *part.columns[2:]], ["cut", *part.schema.names[2:]])
            yield got.filter(pa.array(stays, pa.bool_()))

    fields = [T.StructField("cut", T.StringType()), *(T.StructField(f"carried_{c}", docs.schema[c].dataType) for c in columns)]
    done = given.select("text", "spans", *(f"carried_{c}" for c in columns)).mapInArrow(run, T.StructType(fields))
    new = {text_col: F.coalesce("cut", f"carried_{text_col}"), size_col: F.when(F.col("cut").isNull(), F.col(f"carried_{size_col}")).otherwise(F.length("cut").cast("long"))}
    return done.select(*(new.get(c, F.col(f"carried_{c}")).alias(c) for c in columns))


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", **tuning) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text (joined by one space), kept_sha256."""
    given = with_spans(docs, window, id_col, text_col, [], **tuning)

    def run(batches):
        for part in slices(batches, rows=512):
            cols: list[list] = [[], [], [], []]
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                n, kept = remaining(text, spans)
                out = b" ".join(kept)
                for c, v in zip(cols, (n, n - len(kept), out.decode(), hashlib.sha256(out).hexdigest()), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [x.split()[0] for x in _CUT.split(", ")])

    cut = given.select("doc_id", "text", "spans").mapInArrow(run, _CUT)
    return cut.withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The contract of op7 in DuckDB SQL: every window of 20 words as one string, later ones of equal strings are repeats.
OP7_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, first, array_to_string(words[first + 1 : first + 20], ' ') AS window_text
  FROM (SELECT doc_id, words, unnest(range(len(words) - 19)) AS first FROM texts)
), repeats AS (
  SELECT doc_id, first FROM windows
  QUALIFY row_number() OVER (PARTITION BY window_text ORDER BY doc_id, first) > 1
), covered AS (
  SELECT DISTINCT doc_id, first + step AS place FROM repeats CROSS JOIN range(20) AS steps(step)
), places AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS place FROM texts
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS kept_text
  FROM places ANTI JOIN covered USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept_text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""

"""Language ID by compression: the language whose dictionary shortens a text most wins.

Texts are folded first: lower case, and every run of other characters than letters is one space. Fit: per language, the
whole folded texts of a bounded sample of labelled rows (max_docs rows of the least id hash) are the raw content of a
zstandard dictionary. Predict: every block of the whole folded text is encoded with each dictionary, all at one level, and
the sums of the sizes are compared. A run of blanks before every block keeps the encoder from storing it raw, which would
hide all differences. A narrow margin between the two smallest sums is a rejection.

Rows: null text or a text without a letter is `und`, score 0, rejected. Ties go to the language with most labelled rows, then the first by name. A null
id stays null, repeated rows get equal answers, an empty table gives no rows, other columns are ignored. Without any
labelled row the model is empty and every text is `und`.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of_id, read, slices

SCHEMA = "doc_id long, lang_pred string, score double, margin_bytes long, accepted boolean"
UND = "und"
_LEAD = b" " * 256


def fold(text) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def fit(
    labelled: DataFrame,
    max_docs: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> dict[str, bytes]:
    """Language to dictionary content, most frequent language first, from the whole texts of max_docs labelled rows of
    each (rows without a letter count too). One pass ranks ids, without texts, the other reads the chosen rows' texts."""
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    rows = rows.where("l is not null and i is not null")
    langs = [r.l for r in rows.groupBy("l").count().orderBy(F.desc("count"), "l").collect()]
    # Ranks beyond the bound are cut in every partition before the shuffle, so a hot language is no hot task.
    ranked = rows.selectExpr("i", "l", "row_number() over (partition by l order by xxhash64(i), i) as r").where(F.col("r") <= max_docs)
    ids = sorted({r.i for r in ranked.select("i").collect()})
    found = rows.where(F.col("i").isin(ids) & F.col("t").isNotNull()).select("i", "l", fold(F.col("t")).alias("t")).where("t != ''").distinct()
    texts: dict[str, dict[str, None]] = {lang: {} for lang in langs}
    for r in sorted(found.collect(), key=lambda r: (zlib.crc32(str(r.i).encode()), r.i, r.l, r.t)):
        texts[r.l].setdefault(r.t)
    content = {lang: " ".join(texts[lang]).encode() for lang in langs}
    return {lang: c for lang, c in content.items() if len(c) >= 8}


def predict(
    docs: DataFrame,
    model: dict[str, bytes],
    block_bytes: int = 4096,
    level: int = 6,
    min_margin_bytes: int = 1,
    min_margin: float = 0.004,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """doc_id, lang_pred, score, margin_bytes, accepted for every row, and the columns named in carry as they are; accepted is false for narrow margins and `und`."""
    langs, carry = list(model), carry or []
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import zstandard as zstd

        packers = []
        for lang in langs:
            content = zstd.ZstdCompressionDict(given.value[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            packers.append(zstd.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_checksum=False).compress)
        for part in slices(batches, rows=2048, max_bytes=16 << 20):
            ids, texts = part.column(0), part.column(1)
            pred, score, margin, accepted = [], [], [], []
            for text in texts:
                raw = memoryview(text.as_buffer() or b"")
                if not len(raw) or not langs:
                    pred.append(UND), score.append(0.0), margin.append(0), accepted.append(False)
                    continue
                blocks = [_LEAD + raw[i : i + block_bytes] for i in range(0, len(raw), block_bytes)]
                sizes = [sum([len(pack(b)) for b in blocks]) for pack in packers]
                best = int(np.argmin(sizes))
                rest = sorted(sizes)
                gap = (rest[1] - rest[0]) if len(rest) > 1 else rest[0]
                share = 1 / sum(math.exp((rest[0] - s) / 4) for s in rest)
                pred.append(langs[best]), score.append(share), margin.append(gap)
                accepted.append(gap >= min_margin_bytes and gap >= min_margin * (rest[1] if len(rest) > 1 else 0))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.int64()), pa.array(accepted, pa.bool_()), *part.columns[2:]],
                [x.split()[0] for x in SCHEMA.split(", ")] + [f"carried_{c}" for c in carry],
            )

    text = F.col(text_col).cast("string")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), fold(text).cast("binary").alias("text"), *(F.col(c).alias(f"carried_{c}") for c in carry))
    kinds = T.StructType([T.StructField(f"carried_{c}", docs.schema[c].dataType) for c in carry])
    out = plain.mapInArrow(run, T.StructType([*T.StructType.fromDDL(SCHEMA).fields, *kinds.fields]))
    names = [c for c in out.columns[:5] if c not in carry]
    return out.select(*names, *(F.col(f"carried_{c}").alias(c) for c in carry))


def learn_rows(docs: DataFrame) -> DataFrame:
    """The rows whose id's crc32 modulo 4 is not 2."""
    return docs.where(crc_of_id() % 4 != 2)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = predict(docs, fit(learn_rows(docs)))
    return found.select("doc_id", F.coalesce(crc_of_id() % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin_bytes", "accepted")

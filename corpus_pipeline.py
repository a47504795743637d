"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, packing.

Every stage takes the rows that the one before it kept, written as Parquet and read again, and all but the last return
the columns of documents. run() writes between the stages to the folder that the cluster shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import decontam, langid, neardup, packing, substring
from veilframe.llm.common import Scratch, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is accepted; texts without a letter and narrow margins go. The labels stay as they are."""
    answers = langid.predict(docs, langid.fit(langid.learn_rows(docs)), carry=COLUMNS)
    return answers.where("accepted").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the row with the least doc_id.

    Rows that share a doc_id stay or go together; equal rows with a null doc_id all stay.
    """
    gone = neardup.near_duplicates(docs, k=5, percent=80).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs.doc_id == F.col("gone"), "left_anti").select(COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that stand earlier, joined by one space; a text that loses all goes.

    A text that loses nothing stays as it is, white space included.
    """
    return substring.cut_documents(docs, COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of documents that hold no benchmark item."""
    leaks = decontam.find_contamination(docs, read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leak")).distinct()
    return docs.join(leaks, docs.doc_id == F.col("leak"), "left_anti").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("language_id", keep_known_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Compression, MinHash and BPE are beyond SQL. tests/llm checks the columns and counts of each stage, and each operator by brute force.
ORACLE_SQL = None

"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: tab to carriage return, and space.
ASCII_SPACE = b"\x09\x0a\x0b\x0c\x0d\x20"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else the session's checkpoint folder.

    Only a local master, where driver and executors are one process, may fall back to a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        found = tempfile.mkdtemp(prefix="veilframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found.rstrip("/")


#: Spark removes a query's shuffle files when it ends, not when the driver's garbage is collected.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables that cut lineage, written under one fresh folder of the shared scratch root."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/veilframe-{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back; no read infers a schema, so empty tables work.

        What was shuffled for it is removed at once: only the table is read from here on.
        """
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(_FREE)
        self.spark.conf.set(_FREE, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_FREE, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def crc_of_id(id_col: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, as the folds of the contracts define it."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def slices(batches, rows: int = 256, max_bytes: int = 4 << 20):
    """Arrow batches cut so that a slice has at most `rows` rows and about max_bytes bytes (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(rows, int(n * max_bytes / max(batch.nbytes, 1))))
        for i in range(0, n, step):
            yield batch.slice(i, step)


# ---- words as hashes, by numpy over the bytes of many texts at once ----

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[list(ASCII_SPACE)] = 0
_MULT = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(ASCII_SPACE)] = True


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        size = max(64, 1 << int(n - 1).bit_length())
        _POWERS = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, np.uint64(0xD6E8FEB86659FD93))])
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) in a byte array."""
    gap = IS_SPACE[buf]
    edge = np.flatnonzero(np.diff(np.r_[True, gap, True].view(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 16) -> np.ndarray:
    """A 64-bit hash of each word's bytes. The bytes between words must be white space.

    Works on `piece` words at a time: the arrays over bytes stay small for texts of any length.
    """
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), piece):
        begin, end = starts[i : i + piece], ends[i : i + piece]
        part = buf[begin[0] : end[-1]]
        seg = begin - begin[0]
        lens = np.diff(np.r_[seg, len(part)])
        inside = np.arange(len(part), dtype=np.int64)
        inside -= np.repeat(seg, lens)
        vals = _powers(int(lens.max()))[inside]
        vals *= _BYTE[part]
        out[i : i + piece] = mix(np.add.reduceat(vals, seg) + (end - begin).astype(np.uint64) * _MULT)
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive words; position i covers words i to i+k-1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[k - 1 : k - 1 + n].copy()
    for j in range(k - 2, -1, -1):
        out *= _MULT
        out += words[j : j + n]
    return mix(out)

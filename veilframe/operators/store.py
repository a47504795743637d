"""The session store: versions of an encrypted Parquet map, numbering that goes on from run to run, statistics, metrics.

A version is a folder; a small pointer table names the current one, so a reader never sees half a write: the version is
written first, the pointer last. Originals that are known keep their pseudonyms; new ones are numbered from the highest
number of their family on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pseudonyms import ANONYMIZED, REDACTED, allocate, family, pseudonym
from .session import decrypt, encrypt, original_hash, rotate

SCHEMA = "original_hash string, original_enc binary, pseudonym string, layer string, type string, sentinel boolean, counter string, n long"


class Store:
    """A folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(conf).exists(at)

    def _current(self) -> str | None:
        if not self._exists(f"{self.folder}/pointers"):
            return None
        last = self.spark.read.schema("turn long, version string").parquet(f"{self.folder}/pointers").orderBy(F.desc("turn")).limit(1).collect()
        return last[0].version if last else None

    def rows(self) -> DataFrame:
        """The current version, encrypted; empty where there is none."""
        at = self._current()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/versions/{at}") if at else self.spark.createDataFrame([], SCHEMA)

    def replace(self, rows: DataFrame) -> None:
        version = uuid.uuid4().hex
        rows.select([c.split()[0] for c in SCHEMA.split(", ")]).write.parquet(f"{self.folder}/versions/{version}")
        turn = 0
        if self._exists(f"{self.folder}/pointers"):
            turn = self.spark.read.schema("turn long, version string").parquet(f"{self.folder}/pointers").agg(F.coalesce(F.max("turn"), F.lit(-1))).first()[0] + 1
        self.spark.createDataFrame([(turn, version)], "turn long, version string").write.mode("append").parquet(f"{self.folder}/pointers")

    def load(self, key: str) -> tuple[DataFrame, int]:
        """The map with originals, and how many rows did not open with the key (they are left out)."""
        rows = self.rows()
        opened = decrypt(rows, key)
        return opened, rows.count() - opened.count()

    def upsert(self, session: DataFrame, key: str) -> None:
        """New originals join the map; of known ones the first write stays. Two originals never share a pseudonym."""
        known = self.rows()
        fresh = encrypt(session.join(known.select("original_hash"), "original_hash", "left_anti"), key)
        both = known.unionByName(fresh.select(known.columns))
        clash = both.where("not sentinel and type != 'tech-version'").groupBy("pseudonym").agg(F.count_distinct("original_hash").alias("originals")).where("originals > 1").limit(1).collect()
        if clash:
            raise ValueError(f"two originals share the pseudonym {clash[0].pseudonym}")
        self.replace(both)

    def rotate(self, old_key: str, new_key: str) -> None:
        """All rows under the new key, or, if one does not open, none: the pointer moves last."""
        self.replace(rotate(self.rows(), old_key, new_key))

    def clear(self) -> None:
        self.replace(self.spark.createDataFrame([], SCHEMA))


def shaped_like_marker(original: Column) -> Column:
    """Originals that look like a one-way marker never enter a map."""
    return original.rlike(r"^\*\*\*[A-Z]+\*\*\*$")


def extend(found: DataFrame, known: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows for the originals of found that known lacks, numbered from the highest number of their family on.

    known has original_hash, counter, n. Blocks of numbers are disjoint: each run starts beyond all that came before.
    """
    new = found.where("layer != 'code'").where(~shaped_like_marker(F.col("match"))).withColumn("original_hash", original_hash(F.col("match")))
    new = new.join(known.select("original_hash"), "original_hash", "left_anti")
    high = known.groupBy("counter").agg(F.max("n").alias("high"))
    numbered = allocate(new, id_col).withColumn("counter", family(F.col("type"))).join(F.broadcast(high), "counter", "left")
    numbered = numbered.withColumn("n", F.col("n") + F.coalesce("high", F.lit(0)))
    fake = F.when(F.col("layer") == "secrets", F.lit(REDACTED)).otherwise(pseudonym(F.col("type"), F.col("n"), F.col("match"), F.col("total")))
    return numbered.select(original_hash(F.col("match")).alias("original_hash"), F.col("match").alias("original"), fake.alias("pseudonym"), "layer", "type", "counter", "n").withColumn("sentinel", F.col("pseudonym").isin(REDACTED, ANONYMIZED))


def reserve(known: DataFrame, wanted: DataFrame, block: int = 100_000) -> DataFrame:
    """counter, start, end: a block of numbers for each (counter, taker) of wanted, disjoint, beyond all known ones.

    wanted: counter, taker. A taker of a counter gets the next whole block.
    """
    high = known.groupBy("counter").agg(F.max("n").alias("high"))
    place = F.expr("row_number() over (partition by counter order by taker) - 1")
    out = wanted.distinct().withColumn("place", place).join(high, "counter", "left")
    start = F.coalesce("high", F.lit(0)) + 1 + F.col("place") * block
    return out.select("counter", "taker", start.cast("long").alias("start"), (start + block - 1).cast("long").alias("end"))


def stats(session: DataFrame) -> DataFrame:
    """One row: size, longest pseudonym (characters), sentinels, most originals of one marker."""
    fan = session.where("sentinel").groupBy("pseudonym").agg(F.count_distinct("original_hash").alias("c")).agg(F.coalesce(F.max("c"), F.lit(0)).alias("fan_out"))
    return session.agg(F.count("*").alias("size"), F.coalesce(F.max(F.length("pseudonym")), F.lit(0)).cast("long").alias("longest"), F.count_if(F.col("sentinel")).alias("sentinels")).crossJoin(fan)


METRICS = {
    "requests_total": "counter",
    "findings_total": "counter",
    "session_entries": "gauge",
    "session_longest_pseudonym": "gauge",
    "sentinel_originals": "gauge",
    "chain_broken": "gauge",
    "hmac_failures": "gauge",
    "undecryptable_rows": "gauge",
    "pending_originals": "gauge",
}


def metric_lines(values: DataFrame, prefix: str = "veilframe") -> DataFrame:
    """line: the text exposition of (name, label, value) rows, families in order; label may be null."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in METRICS.items() for x in kv]), F.col("name"))
    full = F.concat(F.lit(f"{prefix}_"), "name")
    head = values.select("name", kind.alias("kind")).distinct().select("name", F.lit(0).alias("o"), F.lit("").alias("l"), F.concat(F.lit("# TYPE "), full, F.lit(" "), F.coalesce("kind", F.lit("untyped"))).alias("line"))
    label = F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit('{key="'), F.replace(F.replace("label", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"}')))
    body = values.select("name", F.lit(1).alias("o"), F.coalesce("label", F.lit("")).alias("l"), F.concat(full, label, F.lit(" "), F.col("value").cast("string")).alias("line"))
    return head.unionByName(body).orderBy("name", "o", "l").select("line")

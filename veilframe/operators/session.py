"""The session map: originals by hash, pseudonyms, encrypted originals; anonymise and rehydrate with it.

Joins on the map are equi joins on the match's type and text; AQE broadcasts the map only when it is small. The rewrite
joins texts with their replacements by id: where that side is too large to broadcast, texts are shuffled once.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from .code import rebuild
from .detect import detect
from .pseudonyms import ANONYMIZED, REDACTED, allocate, pseudonym
from .spans import replace_spans


def original_hash(original: Column, salt: str = "") -> Column:
    return F.sha2(F.concat(F.lit(salt), original), 256)


@lru_cache(maxsize=1)
def _shapes(application: str) -> Column:
    """All shapes as one column, built once a session: it is a large expression."""
    return pseudonym(F.col("type"), F.col("n"), F.col("match"), F.col("total"))


def build_map(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """original_hash, original, pseudonym, layer, type, sentinel. Secrets share the one-way marker.

    Identifiers and domain terms of the code layer are rebuilt from their parts (`code.rebuild`).
    """
    # The map reads the findings several times; without a cache each would be a detection of its own.
    found = found if found.is_cached else found.persist(StorageLevel.MEMORY_AND_DISK)
    plain = found.where("layer != 'code' and type != 'company'")
    numbered = allocate(plain, id_col)
    fake = F.when(F.col("layer") == "secrets", F.lit(REDACTED)).otherwise(_shapes(found.sparkSession.sparkContext.applicationId))
    named = numbered.select("match", fake.alias("pseudonym"), "layer", "type")
    named = named.unionByName(rebuild(found.where("layer = 'code'"), id_col, found.where("type = 'company'")))
    return named.select(original_hash(F.col("match")).alias("original_hash"), F.col("match").alias("original"), "pseudonym", "layer", "type").withColumn("sentinel", F.col("pseudonym").isin(REDACTED, ANONYMIZED))


def encrypt(session: DataFrame, key: str) -> DataFrame:
    """AES-256-GCM with a fresh vector per row; key is 64 hex digits."""
    return session.withColumn("original_enc", F.aes_encrypt("original", F.unhex(F.lit(key)), F.lit("GCM"))).drop("original")


def decrypt(session: DataFrame, key: str) -> DataFrame:
    """Rows that do not open are dropped."""
    opened = F.try_aes_decrypt("original_enc", F.unhex(F.lit(key)), F.lit("GCM")).cast("string")
    return session.withColumn("original", opened).where("original is not null").drop("original_enc")


def rotate(session: DataFrame, old_key: str, new_key: str) -> DataFrame:
    """All or nothing: a row that does not open fails the job."""
    opened = F.aes_decrypt("original_enc", F.unhex(F.lit(old_key)), F.lit("GCM")).cast("string")
    return encrypt(session.withColumn("original", opened).drop("original_enc"), new_key)


def collisions(session: DataFrame) -> DataFrame:
    """Reversible pseudonyms that stand for several originals; should be empty."""
    return session.where("not sentinel and type != 'tech-version'").groupBy("pseudonym").agg(F.count_distinct("original_hash").alias("originals")).where("originals > 1")


def anonymise(docs: DataFrame, rules=None, id_col: str = "doc_id", text_col: str = "text", config: Config | None = None) -> DataFrame:
    """id, text_anon, n_findings, replacements (type, offset, length, original, pseudonym).

    The kept findings, not the texts, are persisted: they are read for the map and for the rewrite. They stay until the
    caller clears the session's cache; where they are lost with an executor, detection runs again and gives the same.
    """
    kept = detect(docs.select(id_col, text_col), rules, config, text_col)
    found = kept.select(id_col, F.explode_outer("kept").alias("h")).where("h is not null").select(id_col, "h.layer", "h.type", "h.offset", "h.length", "h.match")
    found = found.persist(StorageLevel.MEMORY_AND_DISK)
    session = build_map(found, id_col).select("type", F.col("original").alias("match"), "pseudonym")
    named = found.join(session, ["type", "match"]).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("offset", "length", "type", "match", "pseudonym"))).alias("replacements"))
    out = docs.select(id_col, text_col).join(named, id_col, "left")
    text = F.when(F.col("replacements").isNull(), F.col(text_col)).otherwise(replace_spans(F.col(text_col), F.col("replacements"), lambda h: h["pseudonym"]))
    return out.select(id_col, text.alias("text_anon"), F.coalesce(F.size("replacements"), F.lit(0)).cast("long").alias("n_findings"), "replacements")


def rehydrate_own(anonymised: DataFrame) -> DataFrame:
    """Texts with the pseudonyms of their own replacements undone, by position; one-way ones too, for round trips."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("from"), F.array().cast("array<string>").alias("out"))
    text = F.col("text_anon")

    def step(acc: Column, h: Column) -> Column:
        gap = h["offset"] - acc["at"]
        piece = F.substring(text, acc["from"] + 1, gap)
        return F.struct((h["offset"] + h["length"]).alias("at"), (acc["from"] + gap + F.length(h["pseudonym"])).alias("from"), F.concat(acc["out"], F.array(piece, h["match"])).alias("out"))

    whole = F.aggregate("replacements", start, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(text, acc["from"] + 1, F.length(text)))), ""))
    return anonymised.withColumn("text", F.when(F.col("replacements").isNull(), text).otherwise(whole))

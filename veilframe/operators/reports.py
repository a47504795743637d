"""Reports over findings: histograms, top lists, totals, filters by type and preset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Gated types, those that presets switch on, and types that are always off for an external rule set.
GATED = ["australian-medicare", "australian-tfn", "canadian-sin", "brazilian-cpf", "brazilian-cnpj", "mexican-curp", "mexican-rfc", "south-korean-rrn", "south-africa-id", "indonesia-nik", "india-aadhaar", "india-pan", "hungarian-tax-id", "hungarian-personal-id", "ssn", "driving-license-us", "passport-us"]
PRESETS = {"hipaa": ["ssn", "driving-license-us", "passport-us"], "ccpa": ["ssn", "driving-license-us", "passport-us"], "healthcare": ["ssn"], "pci-dss": [], "finance": [], "gdpr": []}
CARD_PRESETS = ["pci-dss", "finance"]
ALWAYS_OFF = ["zip-code-us", "zip-code", "date", "instagram-username", "twitter-username", "tiktok-username", "facebook-username", "social-media-username", "name", "person-name", "phone", "heroku-api-key"]


def drop_types(found: DataFrame, types: list[str]) -> DataFrame:
    return found.where(~F.col("type").isin(types)) if types else found


def preset_filter(found: DataFrame, preset: str | None) -> DataFrame:
    """Gated types need a preset that names them."""
    allowed = PRESETS.get((preset or "").lower(), [])
    return found.where(~F.col("type").isin(GATED) | F.col("type").isin(allowed or [""]))


def histogram(found: DataFrame) -> DataFrame:
    return found.groupBy("layer", "type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "layer", "type")


def top_documents(found: DataFrame, n: int = 10, hot: int = 100, id_col: str = "doc_id") -> DataFrame:
    counts = found.groupBy(id_col).agg(F.count("*").alias("n"))
    return counts.withColumn("hot", F.col("n") >= hot).orderBy(F.desc("n"), id_col).limit(n)


def top_values(found: DataFrame, col: str, n: int = 10) -> DataFrame:
    return found.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).limit(n)


def totals(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.agg(F.count("*").alias("scanned")).crossJoin(found.agg(F.count_distinct(id_col).alias("with_findings"), F.count("*").alias("findings"), F.count_distinct("type", "match").alias("originals")))


def layer_stats(found: DataFrame) -> DataFrame:
    return found.agg(*(F.count_if(F.col("layer") == x).alias(x) for x in ("secrets", "config", "identity", "code")), F.count("*").alias("total"))


def sentinel_fanout(session: DataFrame) -> DataFrame:
    return session.where("sentinel").groupBy("pseudonym").agg(F.count_distinct("original_hash").alias("originals"))


def nearest_rank(df: DataFrame, col: str, ranks=(50, 95, 99)) -> DataFrame:
    """Nearest-rank percentiles: the least value with at least that share of rows at or below it."""
    return df.agg(*(F.expr(f"percentile_disc({r / 100}) within group (order by {col})").alias(f"p{r}") for r in ranks))

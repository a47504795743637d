"""JSON and headers: rewriting string leaves under per-key rules, chat formats, header rules."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Keys whose values stay as they are, and headers that pass through.
SCALAR_KEYS = {"model", "max_tokens", "stream", "temperature", "top_p", "top_k", "n", "presence_penalty", "frequency_penalty", "logit_bias", "seed", "tool_choice"}
PASSTHROUGH = ["authorization", "x-api-key", "anthropic-version", "anthropic-beta", "openai-organization", "openai-project", "openai-beta", "content-type", "content-length", "content-encoding", "transfer-encoding", "accept", "accept-encoding", "accept-language", "connection", "host", "cache-control", "pragma"]


def walk(value, change: Callable[[str], str], key: str | None = None):
    """Strings changed, keys and scalar keys untouched; strings in lists have their list's key."""
    if isinstance(value, str):
        return value if key in SCALAR_KEYS else change(value)
    if isinstance(value, list):
        return [walk(v, change, key) for v in value]
    if isinstance(value, dict):
        return {k: walk(v, change, k) for k, v in value.items()}
    return value


def rewrite_json(df: DataFrame, col: str, change: Callable[[str], str]) -> DataFrame:
    """Every string leaf of a JSON column changed; malformed JSON is changed as one string."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            try:
                return json.dumps(walk(json.loads(t), change), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return change(t)

        return texts.map(one)

    return df.withColumn(col, run(F.col(col)))


def api_format(path: Column, body: Column) -> Column:
    """By path, then by shape."""
    system = F.get_json_object(body, "$.system").isNotNull()
    roles = F.get_json_object(body, "$.messages[*].role")
    return F.when(path.contains("/v1/messages"), "anthropic").when(path.contains("/v1/chat/completions"), "openai").when(system, "anthropic").when(roles.contains('"system"'), "openai").otherwise("unknown")


def anonymise_headers(headers: Column, change: Callable[[Column], Column]) -> Column:
    """MAP<STRING, ARRAY<STRING>>: values of headers that do not pass through are changed, item by item."""
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(PASSTHROUGH), v).otherwise(F.transform(v, change)))

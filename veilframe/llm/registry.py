"""The queries of the training-data operators, by name. op3 and op7 have SQL; each module's docstring says what is
computed, and tests/llm holds every query against a brute-force version, an exact round trip or held-out accuracy."""

from __future__ import annotations

from . import decontam, langid, licences, media, neardup, packing, quality, sharding, substring, warc

QUERIES = {
    f.__name__: f
    for f in (
        langid.op1_language,
        media.op2_media,
        warc.op3_warc,
        quality.op4_quality,
        sharding.op5_shards,
        licences.op6_licences,
        substring.op7_substring_dedup,
        neardup.op8_near_dedup,
        decontam.op9_decontaminate,
        packing.op10_pack,
    )
}
ORACLE_SQL: dict[str, str] = {"op3_warc": warc.OP3_SQL, "op7_substring_dedup": substring.OP7_SQL}

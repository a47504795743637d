"""Reports and maintenance around the operators: scan, preview, doctor, filters, configuration, glossary.

Each takes DataFrames or plain values and returns a DataFrame or plain values; nothing prints and nothing exits.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as settings
from .operators import reports, session
from .operators.detect import detect
from .operators.filters import Filter, check_filter, select_filters


def found_in(docs: DataFrame, config: settings.Config | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Kept findings of all layers, one row each."""
    kept = detect(docs.select(id_col, text_col), None, config, text_col)
    return kept.select(id_col, F.explode_outer("kept").alias("h")).where("h is not null").select(id_col, "h.layer", "h.type", "h.offset", "h.length", "h.match")


def scan(docs: DataFrame, config: settings.Config | None = None, top: int = 10, id_col: str = "doc_id") -> dict[str, DataFrame]:
    """The scan report: totals, histogram by layer and type, documents and pseudonyms with most findings."""
    found = found_in(docs, config, id_col).persist()
    named = found.join(session.build_map(found, id_col).select("type", F.col("original").alias("match"), "pseudonym"), ["type", "match"])
    return {
        "totals": reports.totals(docs, found, id_col),
        "histogram": reports.histogram(found),
        "documents": reports.top_documents(found, top, id_col=id_col),
        "pseudonyms": reports.top_values(named, "pseudonym", top),
    }


def preview(docs: DataFrame, config: settings.Config | None = None, masked: bool = True, id_col: str = "doc_id") -> DataFrame:
    """id, text_anon, findings as JSON in order of layer and offset; masked: without the originals."""
    rank = {"secrets": 0, "config": 1, "identity": 1, "names": 1, "code": 2}
    order = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    done = session.anonymise(docs, id_col=id_col, config=config)
    found = found_in(docs, config, id_col).select(id_col, "layer", F.col("offset").alias("at"))
    layers = found.groupBy(id_col).agg(F.map_from_entries(F.collect_set(F.struct("at", "layer"))).alias("layers"))

    def item(r):
        layer = F.element_at("layers", r["offset"])
        fields = [order[layer].alias("o"), r["offset"].alias("offset"), layer.alias("layer"), r["type"].alias("type"), r["length"].alias("length"), r["pseudonym"].alias("pseudonym")]
        return F.struct(*fields, *([] if masked else [r["match"].alias("original")]))

    sorted_ = F.array_sort(F.transform(F.coalesce("replacements", F.array().cast("array<struct<offset:int,length:int,type:string,match:string,pseudonym:string>>")), item))
    shown = F.transform(sorted_, lambda x: x.dropFields("o"))
    return done.join(layers, id_col, "left").select(id_col, "text_anon", F.to_json(shown).alias("findings"))


def doctor(tree: dict | None, has_config: bool = True, skipped_folders: list[str] = (), checkpoint: bool = True, strict: bool = False, force: bool = False) -> tuple[list[tuple[str, str, str]], int]:
    """Rows (check, ok | warn | fail, detail) about a configuration, and the exit code: 1 on a failure, on an empty
    identity unless forced, and, if strict, on any warning."""
    rows = [("config", "ok" if has_config else "warn", "" if has_config else "defaults are used")]
    errors, warnings = settings.validate(tree or {})
    rows += [("config.schema", "fail", e) for e in errors] + [("config.schema", "warn", w) for w in warnings]
    tree = tree if isinstance(tree, dict) else {}
    identity = tree.get("identity") or {}
    for name in ("company", "domains", "people"):
        given = identity.get(name) if isinstance(identity, dict) else None
        rows.append((f"identity.{name}", "ok" if given else "warn", "" if given else "nothing configured: such names are not found"))
    code = tree.get("code") or {}
    language = code.get("language", "unknown") if isinstance(code, dict) else "unknown"
    rows.append(("code.language", "ok" if language != "unknown" else "warn", language))
    rows.append(("skipped folders", "ok", ", ".join(skipped_folders) or "none"))
    rows.append(("audit checkpoint", "ok" if checkpoint else "warn", "" if checkpoint else "no checkpoint: a cut log is not noticed"))
    states = [s for _, s, _ in rows]
    bare = any(s == "warn" and n.startswith("identity.") for n, s, _ in rows)
    return rows, int("fail" in states or bare and not force or strict and "warn" in states)


def list_filters(disable: list[str] = (), extra: list[Filter] = ()) -> list[tuple[str, str]]:
    """(id, description) of the effective chain, in order."""
    return [(f.id, f.description) for f in select_filters(disable, extra)]


def validate_filters(candidates: list[object]) -> dict[str, list[str]]:
    """Faults by id (or place) of objects that are to be filters."""
    return {str(getattr(c, "id", None) or i): check_filter(c) for i, c in enumerate(candidates)}


# Sections and keys of older configurations and where their values are now.
RENAMED = {("identity", "names"): ("identity", "people"), ("behavior", "compliance"): ("behavior", "preset"), ("code", "domainTerms"): ("code", "domain_terms"), ("code", "sensitivePaths"): ("code", "sensitive_paths"), ("code", "redactBodies"): ("code", "redact_bodies"), ("behavior", "auditFailure"): ("behavior", "audit_failure")}
CURRENT = 2


def migrate(tree: dict) -> tuple[dict, list[str]]:
    """The tree in the current form with defaults filled in, and what was changed; unknown keys stay."""
    out = json.loads(json.dumps(tree))
    notes = []
    for (section, key), (new_section, new_key) in RENAMED.items():
        part = out.get(section)
        if isinstance(part, dict) and key in part:
            value = part.pop(key)
            if new_key in out.setdefault(new_section, {}):
                notes.append(f"{section}.{key} is dropped: {new_section}.{new_key} is there")
            else:
                out[new_section][new_key] = value
                notes.append(f"{section}.{key} is now {new_section}.{new_key}")
    for section, key, value in (("behavior", "aggression", "medium"), ("behavior", "audit_failure", "permit"), ("code", "language", "unknown")):
        if key not in out.setdefault(section, {}):
            out[section][key] = value
            notes.append(f"{section}.{key} is {value} by default")
    if out.get("version") != CURRENT:
        notes.append(f"version is {CURRENT}")
        out["version"] = CURRENT
    return out, notes


def init(metadata: dict) -> dict:
    """A configuration tree from what `sources.files.project_metadata` found."""
    identity = {k: v for k, v in {"company": metadata.get("company"), "people": list(metadata.get("people") or [])}.items() if v}
    code = {"language": metadata.get("language") or "unknown", "domain_terms": list(metadata.get("terms") or [])}
    return migrate({"version": CURRENT, "identity": identity, "code": code})[0]


def check_template(url: str, hosts: list[str]) -> list[str]:
    """Whether a template may be read from there: https, a listed host, no user data."""
    from urllib.parse import urlsplit

    found = settings.check_upstream(url)
    return found if urlsplit(url).hostname in hosts else [*found, "the host is not listed"]


_TERM = re.compile(r"[A-Za-z0-9_-]{1,100}")


def glossary_add(terms: list[str], new: list[str]) -> tuple[list[str], list[str]]:
    """The glossary with the valid new terms, sorted, and the refused ones."""
    good = [t for t in new if _TERM.fullmatch(t)]
    return sorted({*terms, *good}, key=lambda t: (t.lower(), t)), [t for t in new if not _TERM.fullmatch(t)]


def glossary_list(spark: SparkSession, terms: list[str]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in sorted(set(terms), key=lambda t: (t.lower(), t))], "term string")

"""Filters over findings and detector plugins: predicates on columns, user functions, registries, pinned modules."""

from __future__ import annotations

import hashlib
import re
import types
import warnings
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reports import ALWAYS_OFF, CARD_PRESETS, GATED, PRESETS


@dataclass(frozen=True)
class Filter:
    """Keeps a finding or not. accept is a column of (finding columns, preset), or, with python, a function of
    (type, match, preset) that runs on Arrow batches; if that raises, the finding stays."""

    id: str
    accept: Callable
    description: str = ""
    python: bool = False


def always_off(preset: str) -> Column:
    return ~F.col("type").isin(ALWAYS_OFF)


def country_ids(preset: str) -> Column:
    """Gated types need a preset that names them."""
    return ~F.col("type").isin(GATED) | F.col("type").isin(PRESETS.get(preset) or [""])


def card_preset(preset: str) -> Column:
    return (F.col("type") != "credit-card") | F.lit(preset in CARD_PRESETS)


BUILT_IN = [
    Filter("always-disabled", always_off, "types whose shape collides with ordinary code or prose"),
    Filter("country-ids", country_ids, "national identifiers, only under a preset that names them"),
    Filter("credit-card-preset", card_preset, "cards of an external rule set, only under a payment preset"),
]


def select_filters(disable: Iterable[str] = (), extra: Iterable[Filter] = (), source: Iterable[Filter] = tuple(BUILT_IN)) -> list[Filter]:
    """The chain without the disabled ones, and the extras behind it; of equal ids the first counts."""
    off, out = set(disable), {}
    for f in [*(f for f in source if f.id not in off), *extra]:
        out.setdefault(f.id, f)
    return list(out.values())


def _by_function(f: Filter, preset: str) -> Column:
    accept, name = f.accept, f.id

    @F.pandas_udf("boolean")
    def run(kinds: pd.Series, matches: pd.Series) -> pd.Series:
        told = False

        def one(kind, match):
            nonlocal told
            try:
                return bool(accept(kind, match, preset))
            except Exception as e:  # a broken filter must not lose protection: the finding stays
                if not told:
                    warnings.warn(f"filter {name} failed, its findings stay: {e}", stacklevel=2)
                    told = True
                return True

        return pd.Series([one(k, m) for k, m in zip(kinds, matches, strict=True)], dtype=bool)

    return run(F.col("type"), F.col("match"))


def run_filters(found: DataFrame, filters: Iterable[Filter], preset: str | None = None) -> DataFrame:
    """Findings that all filters keep; found has type and match. Column filters go first."""
    preset = (preset or "").lower()
    ordered = sorted(filters, key=lambda f: f.python)
    for f in ordered:
        found = found.where(_by_function(f, preset) if f.python else f.accept(preset))
    return found


def drop_disabled(found: DataFrame, ids: Iterable[str]) -> DataFrame:
    """Without the types of these names, and without those of the plugins of these ids."""
    ids = list(ids)
    plugin = F.regexp_extract("type", "^plugin:([^:]+):", 1)
    return found.where(~F.col("type").isin(ids) & ~plugin.isin(ids)) if ids else found


_ID = re.compile(r"[a-z][a-z0-9]*(?:[.-][a-z0-9]+)*")
CAPABILITIES = ("pii", "infra", "secrets", "code")


@dataclass(frozen=True)
class Plugin:
    """detect(text, context) gives (type, offset, length) of the original text; context has aggression and preset."""

    id: str
    version: str
    capabilities: tuple[str, ...]
    detect: Callable[[str, dict], Iterable[tuple[str, int, int]]]

    def __post_init__(self):
        if not _ID.fullmatch(self.id) or len(self.id) > 64:
            raise ValueError(f"not a plugin id: {self.id!r}")
        if not self.capabilities or set(self.capabilities) - set(CAPABILITIES):
            raise ValueError(f"capabilities are among {', '.join(CAPABILITIES)}")


class Registry:
    """Plugins by id, an id once."""

    def __init__(self, plugins: Iterable[Plugin] = ()):
        self.plugins: dict[str, Plugin] = {}
        for p in plugins:
            self.register(p)

    def register(self, plugin: Plugin) -> None:
        if plugin.id in self.plugins:
            raise ValueError(f"plugin {plugin.id} is registered already")
        self.plugins[plugin.id] = plugin

    def detect(self, docs: DataFrame, capabilities: Iterable[str], aggression: str = "medium", preset: str = "", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """id, type (plugin:<id>:<type>), offset, length, match, error of all plugins with any of the capabilities.

        A plugin that raises on a text gives one row with its error and no match there; the others go on.
        """
        wanted = set(capabilities)
        chosen = [p for p in self.plugins.values() if wanted & set(p.capabilities)]
        context = {"aggression": aggression, "preset": preset.lower()}
        kind = docs.schema[id_col].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]):
            for part in batches:
                rows = []
                for i, text in part.itertuples(index=False):
                    for p in chosen if text else ():
                        try:
                            rows += [(i, f"plugin:{p.id}:{t}", at, size, text[at : at + size], None) for t, at, size in p.detect(text, context) if size > 0 and 0 <= at <= len(text) - size]
                        except Exception as e:  # one plugin's fault stays its own
                            rows.append((i, f"plugin:{p.id}:", None, None, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["id", "type", "offset", "length", "match", "error"]).astype({"offset": "Int64", "length": "Int64"})

        out = docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInPandas(run, f"id {kind}, type string, offset long, length long, match string, error string")
        return out.withColumnRenamed("id", id_col)


def load_pinned(content: bytes, name: str, sha256: str | None = None, trusted: bool = False) -> types.ModuleType:
    """A module from bytes that were read once: run only if their digest is the pinned one, or if it is trusted."""
    digest = hashlib.sha256(content).hexdigest()
    if sha256 is not None and digest != sha256.lower():
        raise PermissionError(f"{name} has digest {digest}, not the pinned one")
    if sha256 is None and not trusted:
        raise PermissionError(f"{name} is neither pinned nor trusted")
    module = types.ModuleType(name)
    exec(compile(content, name, "exec"), module.__dict__)
    return module


def check_filter(candidate: object) -> list[str]:
    """What keeps an object from being a filter."""
    out = [] if isinstance(getattr(candidate, "id", None), str) and candidate.id else ["id is missing"]
    return out if callable(getattr(candidate, "accept", None)) else [*out, "accept is not callable"]


def load_filters(content: bytes, name: str, sha256: str | None = None, trusted: bool = False) -> list[Filter]:
    """FILTERS of a pinned module, each checked."""
    found = getattr(load_pinned(content, name, sha256, trusted), "FILTERS", None)
    if not isinstance(found, (list, tuple)):
        raise ValueError(f"{name} has no FILTERS")
    for f in found:
        if faults := check_filter(f):
            raise ValueError(f"{name}: {', '.join(faults)}")
    return list(found)

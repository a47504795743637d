"""Detection of all layers at once: the JVM tells which rules a text has matches of, Python places them.

Most texts match no rule and never leave the JVM. The others go, with the numbers of their rules, to one Arrow function
that runs just these, and folds overlaps; it walks a text once per matching rule, so its cost is linear in text and
findings, and the plan stays small however many rules there are. Texts that normalisation changes are normalised there,
and are searched for all rules. `spans.hits` is the same search as one native expression, for a rule or a few.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.detectors import RULES, SECRETS, Rule, custom_rules
from ..functions.text import is_plain, normalize_with_positions
from . import code as code_layer
from . import names as name_layer
from .spans import _RANK, HIT_TYPE, literal_rules

_MAC = re.compile(r"[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}")


def _luhn(match: str) -> bool:
    digits = [int(c) for c in match if c in "0123456789"]
    doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
    return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0


_CHECKS = {
    "luhn": _luhn,
    "not_local": lambda m: m not in ("127.0.0.1", "0.0.0.0", "255.255.255.255"),
    "not_mac": lambda m: m not in ("::", "::1") and not _MAC.fullmatch(m),
}


def _compiled(rule: Rule) -> re.Pattern:
    """The rule's pattern as Java reads it: classes of ASCII unless the pattern says otherwise."""
    flags = re.match(r"\(\?([a-z]+)\)", rule.pattern)
    on = flags[1] if flags else ""
    body = rule.pattern[flags.end() :] if flags else rule.pattern
    if "u" in on:
        return re.compile(body.replace(r"\d", "[0-9]").replace(r"\s", r"[ \t\n\x0b\f\r]"), re.I if "i" in on else 0)
    return re.compile(body, re.A | (re.I if "i" in on else 0))


def _place(rule: Rule, pattern: re.Pattern, text: str):
    """(start, end) of a rule's findings in a text."""
    before = 0
    for m in pattern.finditer(text):
        start, end = m.span(1 if rule.value else 0)
        if rule.grow:
            run = re.search(rf"[{rule.grow}\s]*\Z", text[before : m.start()])[0]
            start -= len(run.lstrip()) if run[-1:].isspace() else 0
        before = m.end()
        if end > start and (not rule.check or _CHECKS[rule.check](text[start:end])):
            yield start, end


def fold(found: list[tuple]) -> list[tuple]:
    """`spans.overlap_fold` on (layer, type, ord, offset, length, match)."""
    out: list[tuple] = []
    for h in sorted(found, key=lambda h: (h[3], _RANK.get(h[0], 9), -h[4], h[1])):
        if not out or h[3] >= out[-1][3] + out[-1][4]:
            out.append(h)
        elif h[4] > out[-1][4] and not (out[-1][0] == "secrets" and h[0] != "secrets"):
            out[-1] = h
    return out


def matching(text: Column, rules: list[Rule]) -> Column:
    """Numbers of the rules that have a match in a text; the cheap tests come first."""

    def test(rule: Rule) -> Column:
        out = text.rlike(rule.pattern)
        for t in ([text.rlike(rule.gate)] if rule.gate else []) + ([text.contains(rule.needs)] if rule.needs else []):
            out = t & out
        return out

    return F.filter(F.array(*[F.when(test(r), F.lit(i)) for i, r in enumerate(rules)]), lambda i: i.isNotNull())


def rules_of(config: Config) -> list[Rule]:
    """Secrets, the configuration's own patterns and names, identity and infrastructure, terms and package paths."""
    identity = literal_rules(config.identity.company, list(config.identity.domains), list(config.identity.people))
    out = [*SECRETS, *custom_rules(list(config.secret_patterns)), *identity, *RULES, *code_layer.term_rules(config.code)]
    if config.identity.company and config.behavior.aggression != "low":
        out.append(code_layer.package_rule(config.identity.company))
    return out


def detect(docs: DataFrame, rules: list[Rule] | None = None, config: Config | None = None, text_col: str = "text") -> DataFrame:
    """docs with `kept`: the findings of all layers, overlaps folded, offsets in the original text.

    With rules, only these; else those of the configuration, person names, and declared names of the code in a text.
    """
    config = config or Config()
    whole = rules is None
    chosen = rules_of(config) if whole else list(rules)
    language = config.code.language if whole else "unknown"
    preserve, off = tuple(config.code.preserve), frozenset(config.disabled_types)
    text = F.col(text_col)
    plain = is_plain(text)
    which = F.when(plain, matching(text, chosen))
    named = text.rlike(name_layer.gate()) if whole else F.lit(False)
    coded = code_layer.looks_coded(text) if language != "unknown" else F.lit(False)
    compiled: list[re.Pattern] = []

    def one(t: str, own, has_names: bool, has_code: bool) -> list[tuple]:
        read, at, to = (t, None, None) if own is not None else normalize_with_positions(t)
        found = []
        for i in range(len(chosen)) if own is None else own:
            rule = chosen[i]
            for n, (start, end) in enumerate(_place(rule, compiled[i], read)):
                if at is not None:
                    start, end = at[start], to[end - 1]
                found.append((rule.layer, rule.type, n, start, end - start, t[start:end]))
        if has_names:
            spaced = name_layer.normalize(t)
            for n, (start, size, name, _) in enumerate(name_layer.find_names(spaced)):
                start = start if len(spaced) == len(t) else t.find(name)
                if start >= 0:
                    found.append(("names", "person-name-ner", n, start, size, t[start : start + size]))
        if has_code:
            found += code_layer.place_names(t, language, preserve)
        return fold([h for h in found if h[1] not in off and not (h[0] == "code" and code_layer.stays(h[5], preserve))])

    @F.pandas_udf(HIT_TYPE)
    def place(texts: pd.Series, owns: pd.Series, names: pd.Series, codes: pd.Series) -> pd.Series:
        if not compiled:
            compiled.extend(map(_compiled, chosen))
        return pd.Series([None if t is None else one(t, own, n, c) for t, own, n, c in zip(texts, owns, names, codes, strict=True)], dtype=object)

    gated = docs.withColumns({"which_": which, "names_": F.coalesce(named, F.lit(False)), "code_": F.coalesce(coded, F.lit(False))})
    sent = F.when(F.col("which_").isNull() | (F.size("which_") > 0) | F.col("names_") | F.col("code_"), text)
    placed = gated.withColumn("kept", place(sent, F.col("which_"), F.col("names_"), F.col("code_")))
    return placed.withColumn("kept", F.coalesce("kept", F.array().cast(HIT_TYPE))).drop("which_", "names_", "code_")

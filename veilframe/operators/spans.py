"""Span operators: detection with exact offsets, containment, overlap folds, interval unions, rewriting.

All are native columns or joins; offsets count code points from 0 in the original text. Everything stays within a
document's row until findings are exploded, and then only ids, offsets and matches travel, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.detectors import CHECKS, RULES, SECRETS, Rule
from ..functions.text import detection_text

HIT = "array<struct<layer:string,type:string,ord:int,offset:int,length:int,match:string>>"
HIT_TYPE = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if n in ("ord", "offset", "length") else T.StringType()) for n in ("layer", "type", "ord", "offset", "length", "match")]))
_RANK = {"secrets": 0, "config": 1, "identity": 2, "names": 3, "code": 4}
_CHUNK = 64


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once: a lambda's free expressions are computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(lens: Column, body) -> Column:
    """body(sum_to), where sum_to(i) is the sum of lens[0..i]: in chunks, so that n sums cost n times a chunk."""
    total = lambda c: F.aggregate(F.slice(lens, c * _CHUNK + 1, F.lit(_CHUNK)), F.lit(0), lambda a, x: a + x)
    sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(lens) / _CHUNK).cast("int")), total)
    before = F.aggregate(sums, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def sum_to(base: Column):
        return lambda i: F.get(base, F.floor(i / _CHUNK).cast("int")) + F.aggregate(F.slice(lens, F.floor(i / _CHUNK).cast("int") * _CHUNK + 1, F.pmod(i, F.lit(_CHUNK)) + 1), F.lit(0), lambda a, x: a + x)

    return _let(before, lambda base: body(sum_to(base)))


def hits(text: Column, rule: Rule) -> Column:
    """The rule's findings in order. The gaps between matches give the offsets."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(1)) if rule.value else whole
    zipped = F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole)).alias("g"), whole.alias("w"), value.alias("v"))

    def one(p: Column, i: Column, end: Column) -> Column:
        # With grow, whole words that end where the match begins belong to it.
        run = F.regexp_replace(p["g"], rf"(?s)^.*[^{rule.grow}\s]", "") if rule.grow else None
        ahead = F.when(run.rlike(r"\s$"), F.ltrim(run, F.lit(" \t\n\x0b\x0c\r"))).otherwise("") if rule.grow else F.lit("")
        match = F.concat(ahead, p["v"]) if rule.grow else p["v"]
        return F.struct(F.lit(rule.layer).alias("layer"), F.lit(rule.type).alias("type"), i.alias("ord"), (end - F.length(match)).alias("offset"), F.length(match).alias("length"), match.alias("match"))

    def placed(parts: Column) -> Column:
        lens = F.transform(parts, lambda p: F.length(p["g"]) + F.length(p["w"]))
        return _let(lens, lambda n: _running(n, lambda sum_to: F.transform(parts, lambda p, i: one(p, i, sum_to(i)))))

    found = _let(zipped, placed)
    if rule.check:
        found = F.filter(found, lambda h: CHECKS[rule.check](h["match"]))
    found = F.filter(found, lambda h: h["length"] > 0)
    # Conditions are evaluated before the branch: most texts are through after a plain substring or a short pattern, and
    # those without a match after one pass of the pattern.
    test = text.rlike(rule.pattern)
    for t in (rule.gate and text.rlike(rule.gate), rule.needs and text.contains(rule.needs)):
        test = t & test if t is not None and t is not False else test
    return F.when(test, found).otherwise(F.array().cast(HIT))


def literal_rules(company: str | None = None, domains: list[str] = (), people: list[str] = ()) -> list[Rule]:
    """Configured names as rules, longest first; a person of two words counts with the words swapped, too."""
    import re

    from ..functions.text import _normalize

    given = [(company, "company")] * bool(company) + [(d, "domain") for d in domains] + [(p, "person") for p in people]
    out = []
    for value, kind in sorted(given, key=lambda x: -len(x[0])):
        words = value.split()
        for form in dict.fromkeys([value, " ".join(reversed(words))] if kind == "person" and len(words) == 2 else [value]):
            plain = _normalize(form)
            out.append(Rule(kind, re.escape(plain), "config", needs=plain))
    return out


def _original(found: Column, text: Column, read: Column) -> Column:
    """Findings in the normalised text, back on the original: whole clusters, and the original's characters."""

    def back(h: Column) -> Column:
        start = F.get(read["at"], h["offset"])
        size = F.get(read["to"], h["offset"] + h["length"] - 1) - start
        return F.struct(h["layer"].alias("layer"), h["type"].alias("type"), h["ord"].alias("ord"), start.alias("offset"), size.alias("length"), F.substring(text, start + 1, size).alias("match"))

    return F.when(read["at"].isNull(), found).otherwise(F.transform(found, back))


def with_hits(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", normalise: bool = True) -> DataFrame:
    """docs with `hits`: all findings of all rules, layer by layer, in the normalised text, placed in the original."""
    chosen = rules or [*SECRETS, *RULES]
    if not normalise:
        found = [F.coalesce(hits(F.col(text_col), r), F.array().cast(HIT)) for r in chosen]
        return docs.withColumn("hits", F.concat(*found) if len(found) > 1 else found[0])
    read = docs.withColumn("read_", detection_text(F.col(text_col)))
    found = [F.coalesce(hits(F.col("read_.norm"), r), F.array().cast(HIT)) for r in chosen]
    whole = F.concat(*found) if len(found) > 1 else found[0]
    return read.withColumn("hits", _original(whole, F.col(text_col), F.col("read_"))).drop("read_")


def overlap_fold(found: Column) -> Column:
    """Sorted by offset; a hit that begins before the last kept one ends replaces that only if it is strictly longer.

    Secrets win over everything that they touch: they sort by their layer first among hits at the same place.
    """
    rank = lambda h: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _RANK.items() for x in kv]), h["layer"]), F.lit(9))

    def order(a: Column, b: Column) -> Column:
        key = [(a["offset"], b["offset"]), (rank(a), rank(b)), (b["length"], a["length"]), (a["type"], b["type"])]
        out = F.lit(0)
        for x, y in reversed(key):
            out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
        return out

    def step(acc: Column, h: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = (h["length"] > last["length"]) & ~((last["layer"] == "secrets") & (h["layer"] != "secrets"))
        return F.when((F.size(acc) == 0) | (h["offset"] >= last["offset"] + last["length"]), F.concat(acc, F.array(h))).when(longer, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(h))).otherwise(acc)

    return F.aggregate(F.array_sort(found, order), F.array().cast(HIT), step)


def merge_contained(primary: Column, secondary: Column) -> Column:
    """All primary hits, and the secondary hits that lie in none of them."""
    inside = lambda s: F.exists(primary, lambda p: (s["offset"] >= p["offset"]) & (s["offset"] + s["length"] <= p["offset"] + p["length"]))
    return F.concat(primary, F.filter(secondary, lambda s: ~inside(s)))


def findings(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per finding: id, layer, type, ord, offset, length, match."""
    found = with_hits(docs.select(F.col(id_col), F.col(text_col)), rules, text_col)
    # The outer form and a filter behind it: the inner one would evaluate all patterns again in an inferred filter.
    return found.select(id_col, F.explode_outer("hits").alias("h")).where("h is not null").select(id_col, "h.layer", "h.type", F.col("h.ord").cast("long").alias("ord"), F.col("h.offset").cast("long").alias("offset"), F.col("h.length").cast("long").alias("length"), "h.match")


def interval_union(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Merged intervals (start, end) of each key's spans; touching ones are one."""
    ends = spans.selectExpr(key, "offset s", "offset + length e")
    marked = ends.selectExpr("*", f"case when s <= max(e) over (partition by {key} order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh")
    grouped = marked.selectExpr("*", f"sum(fresh) over (partition by {key} order by s, e rows unbounded preceding) as part")
    return grouped.groupBy(key, "part").agg(F.min("s").alias("start"), F.max("e").alias("end")).drop("part")


def replace_spans(text: Column, kept: Column, replacement) -> Column:
    """The text with each kept hit replaced; replacement(hit) is a column."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, h["offset"] - acc["at"])
        return F.struct((h["offset"] + h["length"]).alias("at"), F.concat(acc["out"], F.array(before, replacement(h))).alias("out"))

    return F.aggregate(kept, start, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.length(text)))), ""))

"""Code semantics: declared identifiers, preserved names, compound rewriting, body redaction, package paths, glossary."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Code
from ..functions.detectors import Rule
from ..functions.text import glob_match, split_identifier
from .pseudonyms import allocate, greek
from .spans import HIT, hits

# Declarations by language; group 1 is the name.
DECLARATIONS = {
    "java": [r"\b(?:class|interface|enum|record)\s+([A-Za-z_]\w*)", r"\b(?:public|private|protected|static|final|abstract|synchronized)\s+[\w<>\[\], ]+?\s+([a-z_]\w*)\s*\("],
    "kotlin": [r"\b(?:class|interface|object|fun|val|var|typealias)\s+([A-Za-z_]\w*)"],
    "python": [r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)", r"^\s*class\s+([A-Za-z_]\w*)", r"^([A-Za-z_]\w*)\s*(?::[^=\n]+)?=[^=]"],
    "typescript": [r"\b(?:class|interface|enum|type|function)\s+([A-Za-z_$][\w$]*)", r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)"],
    "go": [r"\bfunc\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", r"\b(?:type|var|const)\s+([A-Za-z_]\w*)"],
    "rust": [r"\b(?:fn|struct|enum|trait|mod|const|static|type)\s+([A-Za-z_]\w*)", r"\blet\s+(?:mut\s+)?([A-Za-z_]\w*)"],
    "php": [r"\b(?:class|interface|trait|function)\s+([A-Za-z_]\w*)", r"\$([A-Za-z_]\w*)\s*="],
    "csharp": [r"\b(?:class|interface|struct|enum|record|namespace)\s+([A-Za-z_][\w.]*)", r"\b(?:public|private|protected|internal|static)\s+[\w<>\[\], ]+?\s+([A-Za-z_]\w*)\s*[({]"],
}
DECLARATIONS["javascript"] = DECLARATIONS["typescript"]
KEYWORDS = set("abstract as async await break case catch class const continue def default do else enum export extends final finally for from fn func function go if impl import in interface internal is let match mod module mut namespace new null object override package pass private protected public record return self static struct super switch this throw trait try type typealias use using val var virtual void when where while with yield true false none".split())
# Parts of compound names that stay, technology names that stay, and the first segments of package paths.
STRUCTURAL_SUFFIXES = ["service", "controller", "repository", "repo", "factory", "builder", "handler", "manager", "provider", "client", "server", "router", "middleware", "guard", "interceptor", "resolver", "module", "config", "utils", "helper", "error", "exception", "event", "listener", "gateway", "proxy", "wrapper", "decorator", "adapter", "store", "state", "action", "reducer", "component", "hook", "context", "dto", "entity", "model", "schema", "validator", "parser", "mapper", "queue", "worker", "job", "task", "scheduler", "cache", "logger", "strategy", "observer", "command", "query", "pipe", "directive", "layout", "page", "view"]
STRUCTURAL_PREFIXES = ["get", "set", "find", "fetch", "create", "update", "delete", "remove", "validate", "handle", "process", "parse", "patch", "post", "put", "head", "options", "trace", "connect", "format", "convert", "transform", "map", "filter", "reduce", "sort", "merge", "split", "join", "group", "init", "setup", "teardown", "reset", "clear", "load", "save", "store", "read", "write", "open", "close", "start", "stop", "run", "execute", "send", "receive", "emit", "listen", "subscribe", "unsubscribe", "publish", "check", "verify", "assert", "test", "is", "has", "can", "should", "to", "from", "with", "by", "on", "of", "for", "in", "at", "build", "make", "new", "add", "append", "insert", "push", "pop", "apply", "resolve", "reject", "throw", "catch", "try", "log", "print", "render", "display", "show", "hide", "enable", "disable", "toggle", "register", "unregister", "bind", "unbind", "attach", "detach", "calculate", "compute", "count", "measure", "compare", "match", "search", "extract", "collect", "aggregate", "normalize", "sanitize", "escape"]
TECH_BRANDS = ["Kafka", "RabbitMQ", "ActiveMQ", "Pulsar", "NATS", "Redis", "Spring", "SpringBoot", "Quarkus", "Micronaut", "Rails", "Django", "Flask", "Express", "Postgres", "Postgresql", "Oracle", "MySQL", "MariaDB", "SQLite", "MongoDB", "Mongo", "Cassandra", "DynamoDB", "Neo4j", "Elasticsearch", "Opensearch", "Docker", "Kubernetes", "Helm", "Maven", "Gradle", "Bazel", "Jenkins", "Terraform", "Ansible"]
TLDS = ["com", "org", "net", "io", "co", "info", "biz", "app", "dev", "cloud", "de", "at", "ch", "eu", "uk", "fr", "es", "it", "nl", "be", "se", "no", "dk", "fi", "pl", "cz", "ru", "us", "ca", "au", "nz", "jp", "cn", "in", "br", "mx"]
#: Parts that a compound keeps, in lower case.
KEPT_PARTS = sorted({*STRUCTURAL_SUFFIXES, *STRUCTURAL_PREFIXES, *KEYWORDS, *(b.lower() for b in TECH_BRANDS)})


def preserved(name: Column, preserve: Iterable[str] = ()) -> Column:
    """Names that stay as they are: keywords, technology names, hooks, and what the configuration preserves."""
    return name.isin(sorted({*KEYWORDS, *TECH_BRANDS, *preserve})) | name.rlike("^use[A-Z]")


def _is_preserved(name: str, preserve: set[str]) -> bool:
    return name in KEYWORDS or name in TECH_BRANDS or name in preserve or re.match("use[A-Z]", name) is not None


def identifiers(text: str, language: str, preserve: Iterable[str] = ()) -> list[str]:
    """Distinct declared names in order, without keywords and preserved names."""
    kept = set(preserve)
    found = {m[1]: m.start() for p in reversed(DECLARATIONS.get(language, [])) for m in reversed(list(re.finditer(p, text, re.M)))}
    return [n for n in sorted(found, key=lambda n: (found[n], n)) if len(n) > 1 and n.lower() not in KEYWORDS and n not in kept]


def extract_identifiers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", language_col: str = "language") -> DataFrame:
    def run(batches: Iterable[pd.DataFrame]):
        for part in batches:
            rows = [(i, n) for i, t, lang in part.itertuples(index=False) if t for n in identifiers(t, lang)]
            yield pd.DataFrame(rows, columns=["doc_id", "identifier"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col), F.col(language_col)).mapInPandas(run, "doc_id long, identifier string")


_FENCE = r"```(?:[a-zA-Z0-9_+-]*)?\r?\n?([\s\S]*?)```"
_LOOKS = re.compile(r"^\s*(?:import|from|package|#include|require)\s+\S|^\s*(?:def|class|fn|func)\s+\w+[^\n]*[:({]|^\s*(?:const|let|var|pub|public|private|protected)\s+\w+\s*[:=(]", re.M)


def fenced_code(text: Column) -> Column:
    """Fenced blocks, and identifiers of 2 to 64 characters between single backticks outside of them."""
    outside = F.regexp_replace(text, _FENCE, "")
    return F.concat(F.filter(F.regexp_extract_all(text, F.lit(_FENCE), F.lit(1)), lambda x: x != ""), F.regexp_extract_all(outside, F.lit(r"`\s*([A-Za-z][A-Za-z0-9_.-]{1,63})\s*`"), F.lit(1)))


def code_names(text: str, language: str, preserve: Iterable[str] = ()) -> list[str]:
    """Names declared in the fenced code of a text (or in all of it, if that looks like code), and those in backticks."""
    blocks = [b for b in re.findall(_FENCE, text) if b]
    if not blocks and _LOOKS.search(text):
        blocks = [text]
    outside = re.sub(_FENCE, "", text)
    found = [n for b in blocks for n in identifiers(b, language, preserve)]
    found += re.findall(r"`\s*([A-Za-z][A-Za-z0-9_.-]{1,63})\s*`", outside)
    kept = set(preserve)
    return [n for n in dict.fromkeys(found) if not _is_preserved(n, kept)]


def looks_coded(text: Column) -> Column:
    """Texts that may hold names of code: a backtick, or lines that look like code."""
    return text.contains("`") | text.rlike("(?m)" + _LOOKS.pattern)


def place_names(text: str, language: str, preserve: Iterable[str]) -> list[tuple]:
    """Findings of declared names and names in backticks, in the whole text, prose included."""
    names = sorted(code_names(text, language, preserve), key=lambda n: (-len(n), n))
    if not names:
        return []
    found = re.finditer(rf"(?<![A-Za-z0-9_])(?:{'|'.join(map(re.escape, names))})(?![A-Za-z0-9_])", text)
    return [("code", "identifier", i, m.start(), len(m[0]), m[0]) for i, m in enumerate(found)]


def stays(name: str, preserve: Iterable[str] = ()) -> bool:
    return _is_preserved(name, set(preserve))


def term_rules(code: Code) -> list[Rule]:
    """Domain terms, longest first: inside longer names (the whole name is the finding), or alone."""
    terms = sorted(set(code.domain_terms) - set(code.preserve), key=lambda t: (-len(t), t))
    return [Rule("domain-term", rf"(?<![A-Za-z0-9_])[a-zA-Z]*{re.escape(t)}[a-zA-Z]*(?![A-Za-z0-9_])", "code", needs=t) for t in terms]


def term_hits(text: Column, code: Code) -> Column:
    """Domain terms as a native expression; preserved names stay."""
    found = [hits(text, r) for r in term_rules(code)]
    return F.filter(F.concat(F.array().cast(HIT), *found), lambda h: ~preserved(h["match"], code.preserve))


def package_rule(company: str) -> Rule:
    """Dotted paths <tld>.<company>.<segment>..., any case."""
    return Rule("package-path", rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(TLDS)})\.{re.escape(company)}(?:\.[a-z][a-z0-9_]*)+(?![A-Za-z0-9_])", "code", needs=".")


def package_hits(text: Column, company: str) -> Column:
    return hits(text, package_rule(company))


def _parts(kind: Column, match: Column) -> Column:
    """array<struct<sep, part, stays>>: segments by dots, humps and dashes; the first segment of a package path stays."""
    segments = F.split(match, r"\.")

    def of(segment: Column, j: Column) -> Column:
        return F.transform(split_identifier(segment), lambda p, k: F.struct(F.when((j > 0) & (k == 0), ".").otherwise("").alias("sep"), p.alias("part"), (((kind == "package-path") & (j == 0)) | F.lower(p).isin(KEPT_PARTS)).alias("stays")))

    return F.flatten(F.transform(segments, of))


def recased(stem: Column, term: Column) -> Column:
    """The stem in the case of the term that it replaces."""
    first = F.substring(term, 1, 1)
    return F.when((F.upper(term) == term) & (F.lower(term) != term), F.upper(stem)).when(F.lower(first) == first, F.concat(F.lower(F.substring(stem, 1, 1)), stem.substr(2, 64))).otherwise(F.concat(F.upper(F.substring(stem, 1, 1)), stem.substr(2, 64)))


def rebuild(found: DataFrame, id_col: str = "doc_id", companies: DataFrame | None = None) -> DataFrame:
    """match, pseudonym, layer, type of the code layer: every part that is neither structural, a keyword nor a technology
    gets a stem that all its spellings (order, Order, ORDER) share; parts are joined without their separators.

    A name all of whose parts stay is no finding: it does not come back. companies: findings of configured companies,
    whose pseudonyms are stems too and are counted with them.
    """
    names = found.groupBy("type", "match").agg(F.min("layer").alias("layer"), F.min(F.struct(F.col(id_col).alias("d"), (-F.col("offset")).alias("o"))).alias("k"))
    parts = names.select("type", "match", "layer", "k", F.posexplode(_parts(F.col("type"), F.col("match"))).alias("i", "p")).select("type", "match", "layer", "k", "i", "p.*")
    parts = parts.withColumn("term", F.when(~F.col("stays"), F.lower("part")))
    terms = parts.where("term is not null").select(F.lit("identifier").alias("type"), F.col("term").alias("match"), F.lit("code").alias("layer"), F.col("k.d").alias(id_col), (-F.col("k.o") * 64 - F.col("i")).alias("offset"))
    if companies is not None:
        terms = terms.unionByName(companies.select("type", "match", "layer", id_col, (F.col("offset") * 64).alias("offset")))
    numbered = allocate(terms, id_col)
    stems = numbered.where("layer = 'code'").select(F.col("match").alias("term"), "n", "total")
    joined = parts.join(stems, "term", "left")
    named = F.when(F.col("term").isNull(), F.col("part")).otherwise(recased(greek(F.col("n")), F.col("part")))
    # A stem that is the term itself would leave it as it is: it takes a number beyond all others.
    other = recased(greek(F.col("n") + F.col("total")), F.col("part"))
    text = F.when(F.col("term").isNotNull() & (named == F.col("part")), other).otherwise(named)
    whole = joined.groupBy("type", "match", "layer").agg(F.array_sort(F.collect_list(F.struct("i", F.concat("sep", text).alias("t")))).alias("l"), F.max(F.col("term").isNotNull()).alias("changed"))
    out = whole.where("changed").select("match", F.array_join(F.transform("l", lambda x: x["t"]), "").alias("pseudonym"), "layer", "type")
    if companies is None:
        return out
    own = F.when(greek(F.col("n")) == F.col("match"), greek(F.col("n") + F.col("total"))).otherwise(greek(F.col("n")))
    return out.unionByName(numbered.where("layer != 'code'").select("match", own.alias("pseudonym"), "layer", "type"))


def modes(path: Column, sensitive: list[str], aggression: str = "medium") -> Column:
    """high for sensitive paths, else the configured mode."""
    return F.when(glob_match(path, list(sensitive)), "high").otherwise(aggression) if sensitive else F.lit(aggression)


_VALUE = {"python": r"^([A-Za-z_]\w*)\s*(?::[^=\n]+)?=\s*(?!=)([^\n]+)$", "go": r"^(?:var|const)\s+\w+[^=\n]*=\s*([^\n]+)$", "kotlin": r"^(?:val|var)\s+\w+[^=\n]*=\s*([^\n]+)$"}
_VALUE["typescript"] = _VALUE["javascript"] = r"^(?:export\s+)?(?:const|let|var)\s+\w+[^=\n]*=\s*(?!.*(?:=>|\bfunction\b))([^\n;]+);?$"
_HEAD = {
    "typescript": r"\bfunction\s*\w*\s*\([^)]*\)[^{;\n]*\{|=\s*(?:async\s+)?(?:function\s*)?\([^)]*\)[^{;\n]*(?:=>)?\s*\{|^\s+(?:async\s+)?(?!if|for|while|switch|catch)\w+\s*\([^)]*\)[^{;\n]*\{",
    "java": r"\b[\w<>\[\]]+\s+(?!if|for|while|switch|catch)\w+\s*\([^)]*\)[^{;]*\{",
    "kotlin": r"\bfun\s+[^{=\n]*\{",
    "go": r"\bfunc\s+[^{\n]*\{",
    "rust": r"\bfn\s+[^{;]*\{",
    "php": r"\bfunction\s*\w*\s*\([^)]*\)[^{;]*\{",
}
_HEAD["javascript"], _HEAD["csharp"] = _HEAD["typescript"], _HEAD["java"]


def bodies(text: str, language: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of function bodies and top-level values, in order, nested ones left out.

    kind: brace (between the braces), block (an indented block), value (the right side of a top-level definition).
    """
    found = []
    if language == "python":
        for m in re.finditer(r"^([ \t]*)(?:async\s+)?def\s[^\n]*:[ \t]*\n", text, re.M):
            block = re.compile(rf"(?:{re.escape(m[1])}[ \t]+[^\n]*(?:\n|$)|[ \t]*\n)+").match(text, m.end())
            if block:
                found.append((m.end(), m.end() + len(block[0].rstrip()), "block"))
    else:
        for m in re.finditer(_HEAD.get(language, r"(?!)"), text, re.M):
            end = match_brace(text, m.end() - 1)
            if end >= 0:
                found.append((m.end(), end, "brace"))
    for m in re.finditer(_VALUE.get(language, r"(?!)"), text, re.M):
        found.append((*m.span(m.lastindex), "value"))
    out: list[tuple[int, int, str]] = []
    for span in sorted(found):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


def redact_bodies(text: str, language: str) -> str:
    """Bodies and top-level values replaced by markers; a file of an unknown language goes as a whole."""
    if language not in _HEAD and language != "python":
        return "/* redacted */"
    out, at = [], 0
    for start, end, kind in bodies(text, language):
        out += [text[at:start], {"brace": " /* redacted */ ", "value": '"redacted"'}.get(kind) or re.match(r"[ \t]*", text[start:end])[0] + "pass  # redacted"]
        at = end
    return "".join(out) + text[at:]


def redact_files(files: DataFrame, globs: list[str], text_col: str = "text", path_col: str = "path", language_col: str = "language") -> DataFrame:
    """Files on the given paths without bodies; in all files, bodies under a redact comment become a marker."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, languages: pd.Series, whole: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redact_annotated(redact_bodies(t, lang or "unknown") if w else t) for t, lang, w in zip(texts, languages, whole, strict=True)], dtype=object)

    return files.withColumn(text_col, run(F.col(text_col), F.col(language_col), glob_match(F.col(path_col), globs) if globs else F.lit(False)))


def apply_map(text: str, mapping: dict[str, str]) -> str:
    """All keys replaced in one pass, longest first, as whole words."""
    if not mapping:
        return text
    order = sorted(mapping, key=lambda k: (-len(k), k))
    return re.sub(rf"(?<![A-Za-z0-9_])(?:{'|'.join(map(re.escape, order))})(?![A-Za-z0-9_])", lambda m: mapping[m[0]], text)


def recase(term: str, stem: str) -> str:
    """The pseudonym's stem in the case of the term that it replaces."""
    if term.isupper():
        return stem.upper()
    if term.islower():
        return stem.lower()
    return stem[:1].upper() + stem[1:] if term[:1].isupper() else stem[:1].lower() + stem[1:]


def rewrite_compound(name: str, mapping: dict[str, str], preserve: Iterable[str] = ()) -> str:
    """Parts of a compound name replaced by their stems, structural parts and separators kept."""
    keep = set(KEPT_PARTS)
    if name in set(preserve):
        return name
    parts = re.split(r"([_-]+)|(?<=[a-z0-9])(?=[A-Z])", name)
    return "".join(p if not p or p.lower() in keep or p.lower() not in mapping else recase(p, mapping[p.lower()]) for p in parts if p is not None)


def match_brace(text: str, start: int) -> int:
    """Index of the brace that closes the one at start; strings and comments are skipped; -1 if none does."""
    depth, i = 0, start
    while i < len(text):
        c = text[i]
        if c in "\"'`":
            i += 1
            while i < len(text) and text[i] != c:
                i += 2 if text[i] == "\\" else 1
        elif text.startswith("//", i):
            i = (text.find("\n", i) + 1 or len(text)) - 1
        elif text.startswith("/*", i):
            i = (text.find("*/", i) + 2 if text.find("*/", i) >= 0 else len(text)) - 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return i
        i += 1
    return -1


def redact_annotated(text: str) -> str:
    """Bodies after a line with an `@...:redact` comment become a marker."""
    out, at = [], 0
    for m in re.finditer(r"@[\w-]+:redact[^\n]*\n[^\n]*\{[ \t]*\n", text):
        if m.start() < at:
            continue
        opened = text.rindex("{", m.start(), m.end())
        closed = match_brace(text, opened)
        if closed < 0:
            continue
        out += [text[at : opened + 1], " /* redacted */ "]
        at = closed
    return "".join(out) + text[at:]


def scan_identifiers(docs: DataFrame, text_col: str = "text", n: int = 500) -> DataFrame:
    """Pascal-case names of two humps or more, distinct, sorted, at most n."""
    found = F.regexp_extract_all(text_col, F.lit(r"(?<![A-Za-z0-9_])[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+(?![A-Za-z0-9_])"), F.lit(0))
    return docs.select(F.explode(found).alias("identifier")).distinct().orderBy("identifier").limit(n)


def suggest_terms(names: DataFrame, known: DataFrame, col: str = "identifier") -> DataFrame:
    """Parts of identifiers, three letters or more, that the glossary does not have."""
    parts = names.select(F.explode(split_identifier(F.col(col))).alias("part")).select(F.lower("part").alias("term")).where(F.length("term") >= 3).distinct()
    return parts.join(known.select(F.lower("term").alias("term")).distinct(), "term", "left_anti").orderBy("term")


def valid_term(term: Column) -> Column:
    return term.rlike("^[A-Za-z0-9_-]{1,100}$")

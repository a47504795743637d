"""Person names: prefix triggers, dictionary pairs, identifiers with names in them, runs of other scripts.

The dictionaries are our own small lists of common names; more come by parameter.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common given and family names, family-name endings, words that are no names.
FIRST = set("anna ben carla david elena emma erik felix finn greta hanna hans ida jan jonas julia karl klaus lara laura lea lena leon lisa lukas maria marie martin max maria mia michael moritz nina noah nora olga oskar otto paul paula peter petra robert sara sarah simon sofia stefan thomas tim tobias tom ulrich ute walter alice bob charles daniel edward frank george henry james jane john kate linda mark mary nancy oliver patrick richard susan william pierre jean claire luc camille antoine chloe juan carlos pablo carmen lucia jose miguel".split())
LAST = set("müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann schäfer koch bauer richter klein wolf schröder neumann schwarz zimmermann braun krüger hofmann hartmann lange schmitt werner krause meier lehmann smith johnson brown jones miller davis wilson anderson taylor moore jackson white harris clark lewis walker hall young king wright garcia martinez lopez gonzalez perez sanchez ramirez torres dubois moreau laurent simon michel lefebvre leroy roux".split())
ENDINGS = ("mann", "stein", "berg", "burg", "ner", "ler", "ger", "meyer", "meier", "maier", "müller", "mayer", "bauer", "huber", "feld", "dorf", "hof", "bach", "brück", "thal", "wald", "witz", "rath", "hagen", "kamp")
BLOCK = set("herr frau hr fr mr mrs ms dr prof ing person sehr dear hello the this that and with from team service support user order alpha beta gamma delta epsilon zeta theta kappa lambda omega monday friday january march april june july august".split())
NOUNS = set("manager service factory handler controller repository builder client server helper util test model view".split())
# Scripts and the lengths of their runs.
SCRIPTS = {"Han|IsHangul|IsHiragana|IsKatakana": (2, 8), "Arabic|IsHebrew|IsCyrillic|IsThai|IsDevanagari": (4, 20)}
# The words in front of a name.
TITLES = r"Herr|Frau|Hr\.|Fr\.|Mr\.?|Mrs\.?|Ms\.?"
DEGREES = r"Dr\.|Prof\.|Ing\."
ROLES = r"Author|Autor|Reviewer|Maintainer|Erstellt von|Geprüft von|Bearbeiter|Ansprechpartner|Kontakt|Verantwortlich|Assignee|Owner"
TRAILERS = r"Signed-off-by|Reported-by|Reviewed-by|Co-authored-by"
TAGS = r"@author|@since|@reviewer"

_PREFIX = re.compile(rf"(?:(?<!\w)(?:{TITLES}|{DEGREES})\s+|(?<!\w)(?i:{ROLES}|{TRAILERS}):\s*|(?<!\w)(?:von|by|from)\s+|(?i:{TAGS})\s+)(?:(?:{DEGREES})\s+)*((?:[A-ZÄÖÜÀ-Þ][\w'’-]+\s*){{1,4}})")
_RUN = re.compile(r"[A-ZÄÖÜÀ-Þ][a-zäöüßà-ÿ'’-]+(?:[ \t]+[A-ZÄÖÜÀ-Þ][a-zäöüßà-ÿ'’-]+)+")
_IDENT = re.compile(r"(?<!\w)[A-Za-z][A-Za-z0-9_-]{6,}(?!\w)")
_GUARD = re.compile(r"(?:class|const|let|var|function|def|interface|enum|import|package|new|type)\s+$")


def _plain(word: str) -> str:
    out = word.lower()
    for a, b in (("ae", "ä"), ("oe", "ö"), ("ue", "ü")):
        out = out.replace(a, b)
    return out


def is_first(word: str, names: set[str] = FIRST) -> bool:
    return word.lower() in names or _plain(word) in names


def is_last(word: str, names: set[str] = LAST) -> bool:
    low = word.lower()
    return low in names or _plain(word) in names or len(low) >= 4 and low.endswith(ENDINGS) and any(low.endswith(e) and len(low) >= len(e) + 2 for e in ENDINGS)


def _guarded(text: str, start: int, end: int) -> bool:
    before = text[max(0, start - 50) : start]
    return before.count("`") % 2 == 1 or bool(_GUARD.search(before)) or text[end : end + 1] in tuple(".(/<") and text[end : end + 1] != "" and not re.match(r"\.(\s|$)", text[end:])


def find_names(text: str) -> list[tuple[int, int, str, float]]:
    """(offset, length, name, confidence), sorted; a span inside an earlier one is left out."""
    out: list[tuple[int, int, str, float]] = []
    covered: list[tuple[int, int]] = []

    def add(start: int, name: str, confidence: float, cover: tuple[int, int] | None = None) -> None:
        end = start + len(name)
        if any(a <= start and end <= b for a, b in covered):
            return
        out.append((start, len(name), name, confidence))
        covered.append(cover or (start, end))

    for m in _PREFIX.finditer(text):
        words = list(re.finditer(r"[\w'’-]+", m[1]))
        while words and words[-1][0].lower() in BLOCK:
            words.pop()
        if words and any(is_first(w[0]) or is_last(w[0]) for w in words):
            start = m.start(1) + words[0].start()
            add(start, m[1][words[0].start() : words[-1].end()], 0.9, (start, m.end(1)))
    for m in _RUN.finditer(text):
        words = list(re.finditer(r"\S+", m[0]))
        i = 0
        while i + 1 < len(words):
            a, b = words[i][0], words[i + 1][0]
            start, end = m.start() + words[i].start(), m.start() + words[i + 1].end()
            if a.lower() in BLOCK or b.lower() in BLOCK or _guarded(text, start, end):
                i += 1
            elif is_first(a) and is_last(b):
                add(start, text[start:end], 0.85)
                i += 2
            elif is_first(a) or is_last(b) and not is_first(b):
                add(start, text[start:end], 0.7)
                i += 2
            else:
                i += 1
    for m in _IDENT.finditer(text):
        parts = [p for p in re.split(r"[_-]|(?<=[a-z0-9])(?=[A-Z])", m[0]) if p]
        pairs = zip(parts, parts[1:], strict=False)
        if any(not {a.lower(), b.lower()} & NOUNS and (is_first(a) and {b.lower(), _plain(b)} & LAST or {a.lower(), _plain(a)} & LAST and is_first(b)) for a, b in pairs):
            add(m.start(), m[0], 0.75)
    return sorted(out)


_SCHEMA = "doc_id long, offset long, length long, name string, confidence double"


def _trie(words: Iterable[str]) -> str:
    """One pattern for many words, by their common beginnings: a word costs its letters, not the number of words."""
    tree: dict = {}
    for word in words:
        at = tree
        for c in word:
            at = at.setdefault(c, {})
        at[""] = {}

    def spell(at: dict) -> str:
        ways = [re.escape(c) + spell(at[c]) for c in sorted(at) if c]
        inner = ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"
        return "" if not ways else f"(?:{inner})?" if "" in at else inner

    return spell(tree)


def gate() -> str:
    """A pattern that every text with a Latin name has: a word or hump of the dictionaries, or a family-name ending."""
    spelled = {w.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue") for w in FIRST | LAST}
    word = rf"(?:(?<![a-zß-ÿ])|(?=[A-ZÀ-Þ]))(?iu:{_trie(FIRST | LAST | spelled)})(?![a-zß-ÿ])"
    return rf"{word}|(?u)[A-ZÀ-Þ][\wÀ-ÿ'’-]+(?:{'|'.join(ENDINGS)})(?![a-zß-ÿ])"


def normalize(text: str) -> str:
    """Zero-width characters become spaces, every other character is composed for itself."""
    return "".join(" " if c in "\u200b\u200c\u200d\ufeff" else unicodedata.normalize("NFKC", c) for c in text)


def detect_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterable[pd.DataFrame]):
        for part in batches:
            rows = [(i, *hit) for i, t in zip(part["doc_id"], part["text"], strict=True) if t for hit in find_names(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "offset", "length", "name", "confidence"])

    # Texts without any word or ending of the dictionaries never leave the JVM.
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(gate()))
    return plain.mapInPandas(run, _SCHEMA)


def other_scripts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of other scripts of name length, native."""
    runs = [F.regexp_extract_all(text_col, F.lit(f"(?<!\\p{{L}})[{''.join(f'\\p{{{s if s.startswith('Is') else 'Is' + s}}}' for s in names.split('|'))}]{{{lo},{hi}}}(?!\\p{{L}})"), F.lit(0)) for names, (lo, hi) in SCRIPTS.items()]
    ascii_only = F.octet_length(text_col) == F.length(text_col)
    return docs.where(~ascii_only).select(F.col(id_col), F.explode(F.concat(*runs)).alias("name"))

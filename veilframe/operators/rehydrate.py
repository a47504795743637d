"""Rehydration: pseudonyms back to originals in foreign text, to a fixpoint; the map is a driver-side dictionary that is
broadcast only up to a checked size, else texts meet it by tokens."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .pseudonyms import REDACTED

_FORMAT = re.compile("[­​-‏‪-‮⁠-⁤﻿︀-️ᅟᅠㅤﾠ͏]")


def _trie(words: list[str]) -> str:
    """One pattern for many words: by common beginnings, the longest first, so its cost doesn't grow with their number.
    A word that ends in a letter or digit must not go on in lower case or digits."""
    tree: dict = {}
    for word in words:
        at = tree
        for c in word:
            at = at.setdefault(c, {})
        at[""] = word[-1]

    def spell(at: dict) -> str:
        ways = [re.escape(c) + spell(at[c]) for c in sorted(c for c in at if c)]
        if "" in at:
            ways.append("(?![a-z0-9])" if re.match("[A-Za-z0-9]", at[""]) else "")
        return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

    return spell(tree)


_HEX = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*(?![0-9A-Za-z:.])")


def _address(text: str) -> str | None:
    """The full form of an IPv6 address."""
    import ipaddress

    try:
        return ipaddress.IPv6Address(text).exploded
    except ValueError:
        return None


class Rehydrator:
    """Longest pseudonym first, word edges where it begins or ends in word characters, at most ten passes.

    Originals that are no pseudonym themselves are left alone where they stand: a pseudonym inside one is none. IPv6
    pseudonyms are known in all their spellings.
    """

    def __init__(self, pairs: dict[str, str], allowed: set[str] | None = None, passes: int = 10):
        self.pairs = {p: o for p, o in pairs.items() if p and p != REDACTED and (allowed is None or p in allowed)}
        words, others = ([p for p in sorted(self.pairs) if bool(re.match("[A-Za-z0-9_]", p)) == w] for w in (True, False))
        ways = [w for w in (words and "(?<![A-Za-z0-9_])" + _trie(words), others and _trie(others)) if w]
        self.pattern = re.compile("|".join(ways)) if ways else None
        self.addresses = {a: o for p, o in self.pairs.items() if (a := _address(p))}
        own = sorted({o for o in self.pairs.values() if o and o not in self.pairs and self.pattern.search(o)}, key=lambda o: (-len(o), o))
        self.guarded = re.compile("|".join(map(re.escape, own))) if own else None
        self.passes = passes
        self.longest = max(map(len, self.pairs), default=0)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, original) of what a pass replaces: the earliest, of these the longest."""
        safe = [m.span() for m in self.guarded.finditer(text)] if self.guarded else []
        found = [(*m.span(), self.pairs[m[0]]) for m in self.pattern.finditer(text)]
        if self.addresses:
            found += [(*m.span(), self.addresses[a]) for m in _HEX.finditer(text) if (a := _address(m[0])) in self.addresses and self.addresses[a] != m[0]]
        out: list[tuple[int, int, str]] = []
        for start, end, original in sorted(found, key=lambda h: (h[0], -h[1])):
            if (not out or start >= out[-1][1]) and not any(a <= start and end <= b for a, b in safe):
                out.append((start, end, original))
        return out

    def __call__(self, text: str | None) -> str | None:
        if text is None or self.pattern is None:
            return text
        text = _FORMAT.sub("", text)
        for _ in range(self.passes):
            parts, at = [], 0
            for start, end, original in self.spans(text):
                parts += [text[at:start], original]
                at = end
            new = "".join(parts) + text[at:]
            if new == text:
                break
            text = new
        return text


def pairs_of(session: DataFrame, max_rows: int = 200_000) -> dict[str, str]:
    """pseudonym -> original on the driver, refused beyond max_rows; larger maps go through request scopes."""
    rows = session.where("not sentinel").select("pseudonym", "original").limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError("the map is too large to broadcast: rehydrate by request, with request_scope()")
    return {r.pseudonym: r.original for r in rows}


def rehydrate(df: DataFrame, pairs: dict[str, str], text_col: str = "text", allowed: set[str] | None = None) -> DataFrame:
    given = df.sparkSession.sparkContext.broadcast(Rehydrator(pairs, allowed))

    @F.pandas_udf(StringType())
    def back(texts: pd.Series) -> pd.Series:
        return texts.map(given.value)

    return df.withColumn(text_col, back(F.col(text_col)))


def request_scope(texts: DataFrame, sent: DataFrame, session: DataFrame, request_col: str = "request_id", text_col: str = "text") -> DataFrame:
    """Rehydrate each request with only the pseudonyms sent on it: sent has (request, pseudonym)."""
    own = sent.join(session.where("not sentinel"), "pseudonym").groupBy(request_col).agg(F.map_from_entries(F.collect_set(F.struct("pseudonym", "original"))).alias("own"))

    @F.pandas_udf(StringType())
    def back(text: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([t if m is None else Rehydrator(dict(m))(t) for t, m in zip(text, own, strict=True)])

    return texts.join(own, request_col, "left").withColumn(text_col, back(F.col(text_col), F.col("own"))).drop("own")

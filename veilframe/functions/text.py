"""Text normalisation as native columns; NFKC alone needs an Arrow function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# Look-alike characters (code points) and the ASCII characters that they stand for.
# fmt: off
CONFUSABLES = {chr(k): v for k, v in {
    # Latin letters that NFKC leaves alone
    0x017F: "s", 0x0131: "i", 0x0130: "i",
    # Cyrillic small letters
    0x0430: "a", 0x0435: "e", 0x043E: "o", 0x0440: "p", 0x0441: "c", 0x0445: "x", 0x0443: "y", 0x0456: "i", 0x0458: "j", 0x0455: "s", 0x04BB: "h", 0x051B: "q", 0x051D: "w",
    # Cyrillic capitals
    0x0410: "A", 0x0412: "B", 0x0415: "E", 0x041A: "K", 0x041C: "M", 0x041D: "H", 0x041E: "O", 0x0420: "P", 0x0421: "C", 0x0422: "T", 0x0425: "X", 0x0423: "Y", 0x0406: "I", 0x0408: "J", 0x0405: "S", 0x0417: "3",
    # Greek small letters
    0x03BF: "o", 0x03B1: "a", 0x03C1: "p", 0x03C5: "u", 0x03C7: "x",
    # Greek capitals
    0x0391: "A", 0x0392: "B", 0x0395: "E", 0x0396: "Z", 0x0397: "H", 0x0399: "I", 0x039A: "K", 0x039C: "M", 0x039D: "N", 0x039F: "O", 0x03A1: "P", 0x03A4: "T", 0x03A5: "Y", 0x03A7: "X",
    # Letter-like symbols
    0x210D: "H", 0x210E: "h", 0x2115: "N", 0x2124: "Z", 0x2128: "Z", 0x212F: "e", 0x2130: "E", 0x2131: "F", 0x2133: "M", 0x2134: "o", 0x2139: "i", 0x211D: "R",
    # Armenian
    0x0555: "O", 0x0585: "o", 0x054F: "S", 0x057D: "s",
    # Cherokee
    0x13A0: "A", 0x13A3: "D", 0x13A6: "E", 0x13B3: "L", 0x13B7: "M", 0x13D9: "V", 0x13DE: "T",
    # Old Italic
    0x10300: "A", 0x10302: "C", 0x10304: "E", 0x10308: "I", 0x1030A: "K", 0x1030E: "M", 0x1030F: "O", 0x10310: "P", 0x10317: "V", 0x1031A: "X",
    # Gothic
    0x10330: "A", 0x10343: "G", 0x10349: "R", 0x1034A: "S",
    # Deseret
    0x10400: "E", 0x1040D: "S",
}.items()}
# fmt: on
#: Invisible characters: format controls, variation selectors, fillers.
FORMAT_CHARS = r"[\p{Cf}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{034F}]"


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def strip_format_chars(text: Column) -> Column:
    return F.when(is_ascii(text), text).otherwise(F.regexp_replace(text, FORMAT_CHARS, ""))


def fold_confusables(text: Column) -> Column:
    return F.translate(text, "".join(CONFUSABLES), "".join(CONFUSABLES.values()))


def asciify(text: Column) -> Column:
    out = F.lower(text)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def split_identifier(name: Column) -> Column:
    """Parts of a camel, Pascal, snake or kebab case name."""
    humps = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(humps, "[ _-]+"), lambda x: x != "")


def sanitize_tty(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0A-\x1F\x7F]", "")


def canonical_ipv6(address: Column) -> Column:
    """Eight groups of four hex digits; null for zones, dotted tails and malformed addresses."""
    sides = F.split(F.lower(address), "::")
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    left, right = groups(F.get(sides, F.lit(0))), F.coalesce(groups(F.get(sides, F.lit(1))), F.array().cast("array<string>"))
    gap = F.lit(8) - F.size(left) - F.size(right)
    zeros = F.when((F.size(sides) == 2) & (gap >= 1), F.array_repeat(F.lit("0"), gap)).otherwise(F.array().cast("array<string>"))
    whole = F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0"))
    good = F.lower(address).rlike("^[0-9a-f:]+$") & (F.size(whole) == 8) & F.forall(F.concat(left, right), lambda g: F.length(g) <= 4)
    return F.when(good, F.array_join(whole, ":"))


def glob_regex(glob: str) -> str:
    """`**` any text, `*` any text without a slash; without stars, the path itself or a folder above."""
    import re

    glob = glob.replace("\\", "/")
    if "*" not in glob:
        return f"^{re.escape(glob)}(/.*)?$"
    return "^" + "".join(".*" if x == "**" else "[^/]*" if x == "*" else re.escape(x) for x in re.split(r"(\*\*|\*)", glob)) + "$"


def glob_match(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | F.replace(path, F.lit("\\"), F.lit("/")).rlike(glob_regex(g))
    return out


def _normalize(text: str) -> str:
    kept = (c for c in text if unicodedata.category(c) != "Cf" and not 0xFE00 <= ord(c) <= 0xFE0F and not 0xE0100 <= ord(c) <= 0xE01EF and ord(c) not in (0x115F, 0x1160, 0x3164, 0xFFA0, 0x034F))
    return "".join(CONFUSABLES.get(c, c) for c in unicodedata.normalize("NFKC", "".join(kept)))


def clusters(text: str) -> list[tuple[int, str]]:
    """Start and characters of each base with its marks (joiners and Hangul vowels included)."""
    out: list[tuple[int, str]] = []
    for i, c in enumerate(text):
        joins = unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me", "Mc", "Cf") or 0x1160 <= ord(c) <= 0x11FF or 0xFE00 <= ord(c) <= 0xFE0F
        if joins and out:
            out[-1] = (out[-1][0], out[-1][1] + c)
        else:
            out.append((i, c))
    return out


def normalize_with_positions(text: str) -> tuple[str, list[int], list[int]]:
    """Normalised text, and for each of its characters the start and the end of the cluster that it came from."""
    parts, at, to = [], [], []
    for start, cluster in clusters(text):
        n = _normalize(cluster)
        parts.append(n)
        at += [start] * len(n)
        to += [start + len(cluster)] * len(n)
    return "".join(parts), at, to


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _normalize(t))


def is_plain(text: Column) -> Column:
    """Only ASCII and composed Latin-1 letters: normalisation leaves such a text as it is."""
    return ~text.rlike(r"[^\x00-\x7F\xC0-\xD6\xD8-\xF6\xF8-\xFF]")


def normalize_for_detection(text: Column) -> Column:
    """Format characters off, NFKC, confusables folded. Plain text, most of it, never goes to Python."""
    return F.when(is_plain(text), text).otherwise(_nfkc(F.when(~is_plain(text), text)))


_READ = StructType([StructField("norm", StringType()), StructField("at", ArrayType(IntegerType())), StructField("to", ArrayType(IntegerType()))])


@F.pandas_udf(_READ)
def _with_positions(texts: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None) if t is None else normalize_with_positions(t) for t in texts]
    return pd.DataFrame(rows, columns=["norm", "at", "to"])


def detection_text(text: Column) -> Column:
    """struct<norm, at, to>: what detectors read; at and to are null where it is the text itself."""
    return F.when(is_plain(text), F.struct(text.alias("norm"), F.lit(None).cast("array<int>").alias("at"), F.lit(None).cast("array<int>").alias("to"))).otherwise(_with_positions(F.when(~is_plain(text), text)))


def normalize_for_names(text: Column) -> Column:
    """For name recognition: zero-width characters become spaces, every character is composed for itself."""
    spaced = F.translate(text, "\u200b\u200c\u200d\ufeff", "    ")
    return F.when(is_plain(text), text).otherwise(_nfkc_each(F.when(~is_plain(text), spaced)))


@F.pandas_udf(StringType())
def _nfkc_each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else "".join(unicodedata.normalize("NFKC", c) for c in t))

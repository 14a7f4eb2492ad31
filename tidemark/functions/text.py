"""String normalisers.  Each has its own definition; none is built from another.

NFKC and full case folding have no built-in, so one Arrow function does the
Unicode part of a whole group of columns in a single round trip; everything
else is built-in.  On text known to be ASCII the ``ascii`` forms stay native.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space for stripping and collapsing, and the subset with the Unicode property White_Space.
PY_SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE_SPACE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache
def _members(space: str) -> str:
    """The characters of a class."""
    return "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{space}]", c))


def strip(c: Column, space: str = PY_SPACE) -> Column:
    """Trimmed by a set of characters, which looks at the ends only."""
    return F.btrim(c, F.lit(_members(space)))


def collapse(c: Column, space: str = PY_SPACE) -> Column:
    return F.regexp_replace(c, rf"[{space}]+", " ")


def _nfkc(x: str) -> str:
    return x if x.isascii() else unicodedata.normalize("NFKC", x)


def _upper(x: str) -> str:
    return _nfkc(x).upper()


def _fold(x: str) -> str:
    return _nfkc(x).casefold()


def _search(x: str) -> str:
    """Folded, runs of white space as one space; a run at an end that folding brings about stays as one too."""
    y = _fold(x.strip())
    words = y.split()
    if y[:1].isspace():
        words.insert(0, "")
    if words and y[-1:].isspace():
        words.append("")
    return " ".join(words)


def _arrow(convert, c: Column) -> Column:
    def one(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else convert(x) for x in column.to_pylist()], pa.string())

    one.__name__ = convert.__name__.strip("_")
    one.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(one, "string")(c)


def nfkc(c: Column) -> Column:
    """NFKC; null becomes empty."""
    return _arrow(_nfkc, F.coalesce(c, F.lit("")))


def identity_normalize(c: Column) -> Column:
    """Strip, NFKC, upper case; punctuation and inner space stay."""
    return _arrow(_upper, strip(F.coalesce(c, F.lit(""))))


def loose_key(c: Column) -> Column:
    """NFKC, then ASCII letters and digits only, upper case."""
    return F.upper(F.regexp_replace(nfkc(c), "[^0-9A-Za-z]", ""))


#: Decimal digits of all scripts, by the character database of Python, and the ASCII digit of each.
DIGITS = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Nd"]
ASCII_DIGITS = "".join(str(unicodedata.decimal(c)) for c in DIGITS)


def plain_digits(c: Column) -> Column:
    """Decimal digits of any script as ASCII digits; only text beyond ASCII is translated."""
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.translate(c, "".join(DIGITS), ASCII_DIGITS))


def conflict_text(c: Column) -> Column:
    """NFKC without any white space."""
    return F.regexp_replace(nfkc(c), rf"[{PY_SPACE}]+", "")


def search_normalize(c: Column) -> Column:
    """Strip, NFKC, full case folding, white space collapsed."""
    return _arrow(_search, F.coalesce(c, F.lit("")))


def facet_normalize(c: Column) -> Column:
    """NFKC, runs of White_Space are one space, strip; case and zero-width characters stay."""
    return strip(collapse(nfkc(c), WHITE_SPACE), " ")


def has_ascii_alnum(c: Column) -> Column:
    return nfkc(c).rlike("[0-9A-Za-z]")


def search_normalize_text(q: str) -> str:
    """search_normalize for a query string; the same definition on both sides of a search."""
    return " ".join(_nfkc(q.strip()).casefold().split())


def identity_normalize_text(x: str) -> str:
    return _nfkc(x.strip()).upper()

"""Matrices of the typed projections; each row names what a weaker version would get wrong."""

import datetime as dt
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemark.functions import parse, text

NUMERIC = [
    ("", None, None, None, ["numericMissing"]),
    (" 　", None, None, None, ["numericMissing"]),
    ("0", "int", 0, 0, ["sourceZero"]),
    ("007", "int", 7, 7, []),
    ("４２", "int", 42, 42, []),  # full width digits
    ("9007199254740991", "int", 2**53 - 1, 2**53 - 1, []),
    ("9007199254740992", None, None, None, ["numericOutOfRange"]),
    ("9" * 60, None, None, None, ["numericOutOfRange"]),
    ("20-40", "range", 20, 40, ["numericRange"]),
    ("20～40", "range", 20, 40, ["numericRange"]),
    ("20 至 40", "range", 20, 40, ["numericRange"]),
    ("20—20", "range", 20, 20, ["numericRange"]),  # not an integer
    ("20-9007199254740992", None, None, None, ["numericOutOfRange", "numericRange"]),
    ("9007199254740992-1", None, None, None, ["numericRangeInvalid"]),  # order is tested before size
    (f"{'9' * 40}-{'9' * 39}", None, None, None, ["numericRangeInvalid"]),
    ("-5", None, None, None, ["numericImplausible"]),
    ("約400", None, None, None, ["numericUnparsed"]),
    ("1,200", None, None, None, ["numericUnparsed"]),
]


def test_numeric(spark):
    df = spark.createDataFrame([(r[0],) for r in NUMERIC], "raw string").withColumn("i", F.monotonically_increasing_id())
    got = {r.raw: r.v for r in df.select("raw", parse.parse_numeric(F.col("raw")).alias("v")).collect()}
    for raw, kind, lo, hi, flags in NUMERIC:
        v = got[raw]
        assert (v.raw, v.typed.kind, v.typed.lo, v.typed.hi, v.flags) == (raw, kind, lo, hi, flags)


PAIRS = [
    ("numeric", "20", "020", True), ("numeric", "20", "20-20", False), ("numeric", "", " ", True), ("numeric", "約400", "約 400", True), ("numeric", "約400", "約401", False),
    ("numeric", "9007199254740992", "9007199254740992", True), ("numeric", "0", "0", True), ("text", "a b", "ab", True), ("text", "N/A", "NA", False), ("text", "", "N/A", False),
    ("period", "2024/01/02", " 2024/01/02", True), ("period", "", "x", False), ("categorical", "0", " 0", True), ("categorical", "", "0", False), ("categorical", "A", "A ", True), ("categorical", "?", "? ", True),
]


@pytest.mark.parametrize("kind", ["numeric", "text", "period", "categorical"])
def test_comparison_keys(spark, kind):
    make = {"numeric": parse.parse_numeric, "text": parse.parse_text, "period": lambda c: parse.parse_period(c, True), "categorical": lambda c: parse.parse_categorical(c, ("A", "B"))}[kind]
    rows = [(a, b, same) for k, a, b, same in PAIRS if k == kind]
    df = spark.createDataFrame(rows, "a string, b string, same boolean")
    key = lambda c: parse.comparison_key(kind, make(F.col(c)))
    for r in df.select("a", "b", "same", key("a").alias("x"), key("b").alias("y")).collect():
        assert (r.x == r.y) == r.same, (r.a, r.b, r.x, r.y)


def test_key_outside_the_table_raises(spark):
    odd = parse.value(F.lit("x"), parse.typed("int", None, F.lit(1), F.lit(1)), parse.flags("numericMissing", "sourceZero"))
    with pytest.raises(Exception, match="no comparison key"):
        spark.range(1).select(parse.comparison_key("numeric", odd)).collect()


def test_dates(spark):
    rows = [("2024/02/29", dt.date(2024, 2, 29), None), ("2023/02/29", None, "dateUnparsed"), ("2026/13/45", None, "dateUnparsed"), ("0000/01/01", None, "dateUnparsed"), ("2024-01-01", None, "dateUnparsed"),
            ("", None, "dateMissing"), ("２０２４/０１/０１", dt.date(2024, 1, 1), None), ("2024/06/01", dt.date(2024, 6, 1), None), ("2024/06/02", dt.date(2024, 6, 2), "dateFuture")]
    df = spark.createDataFrame([(r[0],) for r in rows], "raw string").select("raw", parse.parse_updated(F.col("raw"), dt.date(2024, 6, 1)).alias("u"))
    got = {r.raw: r.u for r in df.collect()}
    for raw, day, flag in rows:
        assert (got[raw].date, got[raw].flag, got[raw].usable) == (day, flag, day is not None and flag is None)


def test_normalisers(spark):
    samples = ["", " a　B\x1c ", "ﬁ ß ſ", "Ａ１ｂ-２", "x​y", "\x85t t", "Åé 日本  ", "É́", "İI", "a\x1fb"]
    df = spark.createDataFrame([(x,) for x in [*samples, None]], "x string")
    x = F.col("x")
    got = {r.x: r for r in df.select("x", text.nfkc(x).alias("n"), text.identity_normalize(x).alias("i"), text.loose_key(x).alias("l"), text.conflict_text(x).alias("c"), text.search_normalize(x).alias("s"), text.facet_normalize(x).alias("f"), text.has_ascii_alnum(x).alias("h")).collect()}
    nf = lambda v: unicodedata.normalize("NFKC", v)
    for v in samples:
        r = got[v]
        assert r.n == nf(v) and r.i == nf(v.strip()).upper() and r.c == "".join(nf(v).split())
        assert r.s == " ".join(nf(v.strip()).casefold().split()) == text.search_normalize_text(v)
        assert r.l == "".join(c for c in nf(v) if c.isascii() and c.isalnum()).upper() and r.h == bool(r.l)
    assert got[None].n == "" and got[None].s == ""
    assert got["x​y"].f == "x​y" and got["a\x1fb"].f == "a\x1fb" and got[" a　B\x1c "].f == "a B\x1c"


def test_canonical_and_control_characters(spark):
    df = spark.createDataFrame([("é", ""), ("a", None)], "x string, y string")
    assert [r[0] for r in df.select(parse.canonical(("x", "y"))).collect()] == ["2\x1fé\x1f0\x1f", "1\x1fa\x1f0\x1f"]
    with pytest.raises(Exception, match="SOURCE_CONTROL_CHAR"):
        spark.createDataFrame([("a\x1fb",)], "x string").select(parse.canonical(("x",))).collect()


def test_taipei_day():
    utc = dt.timezone.utc
    assert parse.build_date_of(dt.datetime(2024, 1, 1, 15, 59, tzinfo=utc)) == dt.date(2024, 1, 1)
    assert parse.build_date_of(dt.datetime(2024, 1, 1, 16, 0, tzinfo=utc)) == dt.date(2024, 1, 2)


def test_digits_of_other_scripts(spark):
    df = spark.createDataFrame([("\u0664\u0662", "\u0662\u0660\u0662\u0664/\u0660\u0663/\u0660\u0669"), ("\U000104a1-\u0967\u0968", "2024/02/30")], "n string, d string")
    n = parse.parse_numeric(F.col("n"))["typed"]
    got = df.select(n["lo"].alias("lo"), n["hi"].alias("hi"), parse.calendar_date(F.col("d")).cast("string").alias("d")).collect()
    assert [(r.lo, r.hi, r.d) for r in got] == [(42, 42, "2024-03-09"), (1, 12, None)]


def test_strip_takes_every_kind_of_space_from_both_ends(spark):
    from tidemark.functions import text

    kinds = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and c.isspace()]
    rows = [(c + "a" + c + "b" + c,) for c in kinds] + [("\u200bx\u200b",), ("".join(kinds),), ("",), (None,)]
    got = spark.createDataFrame(rows, "s string").select("s", text.strip(F.col("s")).alias("a"), text.strip(F.col("s"), " ").alias("b")).collect()
    for r in got:
        assert r.a == (None if r.s is None else r.s.strip()) and r.b == (None if r.s is None else r.s.strip(" "))


def test_search_normalize_keeps_what_folding_brings_about(spark):
    from tidemark.functions import text

    rows = ["", " ", "\u3000\u00a8a\u2028 \t b\u00a0", "\u00a8", "Stra\u00dfe\x1c\x1fX", "a\u00b8 ", "\u200b a", None]
    got = spark.createDataFrame([(x,) for x in rows], "s string").select("s", text.search_normalize(F.col("s")).alias("a")).collect()
    plain = lambda x: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x.strip()).casefold())
    assert {r.s: r.a for r in got} == {x: plain(x or "") for x in rows}

"""Typed projections: raw text -> struct<raw, typed, flags>; raw is never rewritten.

typed is struct<kind, str, lo, hi, dt>: kind is null where there is no value,
``int`` and ``range`` stay apart even when a range is one number wide.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.spec import MAX_INT, SnapshotSpec
from .text import PY_SPACE, conflict_text, nfkc, plain_digits, strip

TYPED = "struct<kind:string,str:string,lo:bigint,hi:bigint,dt:date>"
SEPARATOR = "\x1f"


def typed(kind: str | None = None, text: Column | None = None, lo: Column | None = None, hi: Column | None = None, day: Column | None = None) -> Column:
    none = F.lit(None)
    parts = (F.lit(kind), text, lo, hi, day)
    return F.struct(*(p if p is not None else none for p in parts)).cast(TYPED)


def flags(*names: str) -> Column:
    """Flags are sorted and distinct."""
    return F.array(*map(F.lit, sorted(set(names)))).cast("array<string>")


def with_flag(found: Column, name: str) -> Column:
    return F.array_sort(F.array_union(found, F.array(F.lit(name))))


def value(raw: Column, kind: Column, found: Column) -> Column:
    return F.struct(raw.alias("raw"), kind.alias("typed"), found.alias("flags"))


def _pair(kind: Column, found: Column) -> Column:
    return F.struct(kind.alias("t"), found.alias("f"))


def _digits(c: Column) -> Column:
    """A digit string as decimal, which holds what a long cannot; null if absurdly long."""
    bare = F.regexp_replace(c, "^0+(?=.)", "")
    return F.when(F.length(bare) <= 18, bare.try_cast("bigint"))


def _norm(raw: Column, norm: Column | None) -> Column:
    """norm is nfkc(raw) where the caller has it as a column already: one round trip to Python serves all uses."""
    return plain_digits(nfkc(raw) if norm is None else norm)


#: What may stand between the ends of a range.
RANGE_SIGN = "[-~～〜–—]|至"


def parse_numeric(raw: Column, norm: Column | None = None) -> Column:
    """Integers, closed ranges, and what is wrong with the rest; the first rule that fits wins."""
    v = strip(_norm(raw, norm))
    pattern = rf"^([0-9]+)[{PY_SPACE}]*(?:{RANGE_SIGN})[{PY_SPACE}]*([0-9]+)$"
    whole, lo, hi = _digits(v), _digits(F.regexp_extract(v, pattern, 1)), _digits(F.regexp_extract(v, pattern, 2))
    bare = lambda g: F.regexp_replace(F.regexp_extract(v, pattern, g), "^0+(?=.)", "")
    # Digit strings compare by length, then by text; no size is too large.
    backwards = (F.length(bare(1)) > F.length(bare(2))) | ((F.length(bare(1)) == F.length(bare(2))) & (bare(1) > bare(2)))
    fits = lambda x: x.isNotNull() & (x <= MAX_INT)
    is_int, is_range = v.rlike("^[0-9]+$"), v.rlike(pattern)
    none = typed()
    chosen = (
        F.when(v == "", _pair(none, flags("numericMissing")))
        .when(is_int & fits(whole), _pair(typed("int", None, whole, whole), F.when(whole == 0, flags("sourceZero")).otherwise(flags())))
        .when(is_int, _pair(none, flags("numericOutOfRange")))
        .when(is_range & backwards, _pair(none, flags("numericRangeInvalid")))
        .when(is_range & fits(hi), _pair(typed("range", None, lo, hi), flags("numericRange")))
        .when(is_range, _pair(none, flags("numericOutOfRange", "numericRange")))
        .when(v.rlike("^-[0-9]+$"), _pair(none, flags("numericImplausible")))
        .otherwise(_pair(none, flags("numericUnparsed")))
    )
    return value(raw, chosen["t"], chosen["f"])


def parse_categorical(raw: Column, legal: tuple[str, ...]) -> Column:
    v = strip(raw)
    kind = F.when(v.isin(*legal), typed("cat", v)).otherwise(typed())
    return value(raw, kind, F.when(v == "0", flags("categoricalUnprovided")).when(v.isin(*legal), flags()).otherwise(flags("categoricalUnknown")))


def parse_text(raw: Column) -> Column:
    return value(raw, F.when(raw == "", typed()).otherwise(typed("text", raw)), flags())


def calendar_date(raw: Column, norm: Column | None = None) -> Column:
    """A real calendar day written yyyy/MM/dd, or null; year 0000 is none."""
    v = strip(_norm(raw, norm))
    return F.when(v.rlike(r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$") & ~v.startswith("0000"), F.try_to_date(v, "yyyy/MM/dd"))


def parse_period(raw: Column, end: bool, norm: Column | None = None) -> Column:
    side = "End" if end else "Start"
    day = calendar_date(raw, norm)
    blank = strip(_norm(raw, norm)) == ""
    kind = F.when(day.isNotNull(), typed("date", None, None, None, day)).otherwise(typed())
    return value(raw, kind, F.when(blank, flags(f"period{side}Missing")).when(day.isNull(), flags(f"period{side}Unparsed")).otherwise(flags()))


def parse_updated(raw: Column, build_date: dt.date, norm: Column | None = None) -> Column:
    """struct<raw, date, flag, usable>; a date after the build keeps its value and is not usable."""
    day = calendar_date(raw, norm)
    flag = F.when(strip(_norm(raw, norm)) == "", "dateMissing").when(day.isNull(), "dateUnparsed").when(day > F.lit(build_date), "dateFuture")
    return F.struct(raw.alias("raw"), day.alias("date"), flag.alias("flag"), (day.isNotNull() & flag.isNull()).alias("usable"))


def period_order_anomaly(start: Column, end: Column) -> Column:
    return F.coalesce(end["typed"]["dt"] < start["typed"]["dt"], F.lit(False))


def parse_field(spec: SnapshotSpec, name: str, raw: Column, norm: Column | None = None) -> Column:
    if name == spec.updated:
        raise ValueError("the update date is not a presentation column")
    kind = spec.kind(name)
    if kind == "numeric":
        return parse_numeric(raw, norm)
    if kind == "categorical":
        return parse_categorical(raw, spec.categorical[name])
    return parse_period(raw, name == spec.period_end, norm) if kind == "period" else parse_text(raw)


def suspected_test_row(spec: SnapshotSpec, norms: dict[str, Column] | None = None) -> Column:
    of = lambda c: strip(_norm(F.col(f"`{c}`"), (norms or {}).get(c)))
    blank = lambda c: of(c) == ""
    words = [F.lower(of(c)) == "test" for c in spec.presentation]
    marks = [F.col(f"`{spec.identity}`").contains(m) for m in spec.test_marks]
    found = F.lit(False)
    if spec.applicant and spec.title:
        found = blank(spec.applicant) & blank(spec.title)
    for x in words + marks:
        found = found | x
    return found


def comparison_key(kind: str, v: Column, norm: Column | None = None) -> Column:
    """Key by which two values of a column agree; a combination outside the table is a bug and raises."""
    key = lambda *parts: F.concat_ws(SEPARATOR, *(F.lit(p) if isinstance(p, str) else p for p in parts))
    raw, kinds, found = v["raw"], v["typed"]["kind"], F.array_join(v["flags"], ",")
    text = conflict_text(raw) if norm is None else F.regexp_replace(norm, rf"[{PY_SPACE}]+", "")
    if kind == "text":
        return key("text", text)
    if kind == "numeric":
        out = F.when((kinds == "int") & found.isin("", "sourceZero"), key("int", v["typed"]["lo"].cast("string")))
        out = out.when((kinds == "range") & (found == "numericRange"), key("range", v["typed"]["lo"].cast("string"), v["typed"]["hi"].cast("string")))
        out = out.when(kinds.isNull() & (found == "numericMissing"), F.lit("numericMissing"))
        out = out.when(kinds.isNull() & found.isin("numericUnparsed", "numericImplausible", "numericRangeInvalid"), key(found, text))
        out = out.when(kinds.isNull() & found.isin("numericOutOfRange", "numericOutOfRange,numericRange"), key("numericOutOfRange", text))
    elif kind == "categorical":
        out = F.when(found == "categoricalUnprovided", F.lit("unprovided")).when(found == "categoricalUnknown", key("categoricalUnknown", text)).when((kinds == "cat") & (found == ""), key("cat", v["typed"]["str"]))
    else:
        out = F.when((kinds == "date") & (found == ""), key("date", v["typed"]["dt"].cast("string"))).when(kinds.isNull() & found.rlike("^period(Start|End)(Missing|Unparsed)$"), key(found, text))
    return out.otherwise(F.raise_error(F.concat(F.lit(f"no comparison key for a {kind} value: "), F.coalesce(kinds, F.lit("none")), F.lit(" "), found)).cast("string"))


def canonical(columns: tuple[str, ...]) -> Column:
    """<utf-8 length> US <value> of each column, joined by US; a value with US is an error."""
    parts = []
    for c in columns:
        v = F.coalesce(F.col(f"`{c}`"), F.lit(""))
        safe = F.when(v.contains(SEPARATOR), F.raise_error(F.lit(f"SOURCE_CONTROL_CHAR in {c}")).cast("string")).otherwise(v)
        parts += [F.octet_length(v).cast("string"), safe]
    return F.concat_ws(SEPARATOR, *parts)


def slash_date(c: Column) -> Column:
    return F.date_format(c, "yyyy/MM/dd")


def taipei_timestamp(c: Column) -> Column:
    """A UTC time string as local time eight hours ahead; null if it is none."""
    return F.try_to_timestamp(c) + F.expr("INTERVAL 8 HOURS")


def build_date_of(now: dt.datetime, hours: int = 8) -> dt.date:
    """Calendar day eight hours ahead of UTC; now must carry a zone."""
    return now.astimezone(dt.timezone(dt.timedelta(hours=hours))).date()

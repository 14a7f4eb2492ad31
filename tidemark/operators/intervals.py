"""Overlap join of closed intervals without comparing all pairs.

An interval's level is that of the smallest power of two no shorter than it, so
it lies in two bins of its level at most.  A pair meets in a bin of the longer
one's level: each side is joined with its own level's bins to the other side's
bins of that level, in two equi-joins, so that two short intervals never meet
in a long one's bin.  Of the two bins that a pair may share the first counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_A, _B = "__a_", "__b_"


def _sided(rows: DataFrame, low: str, high: str, side: str) -> DataFrame:
    """Numbers for the ends (dates as days), and the level; rows whose ends are unknown or crossed overlap nothing."""
    kind = dict(rows.dtypes)
    number = lambda c: (F.unix_date(c) if kind[c] == "date" else F.col(c)).cast("long")
    out = rows.withColumn(f"{side}lo", number(low)).withColumn(f"{side}hi", number(high)).where(F.col(f"{side}lo") <= F.col(f"{side}hi"))
    size = F.col(f"{side}hi") - F.col(f"{side}lo")
    level = F.when(size <= 0, 0).otherwise(F.ceil(F.log2(size.cast("double") + 1)).cast("int"))
    return out.withColumn(f"{side}level", level)


def _bins(rows: DataFrame, side: str, level: Column) -> DataFrame:
    """A row for each bin of a level that the interval lies in."""
    rows = rows.withColumn(f"{side}m", level)
    first, last = (F.expr(f"shiftright({side}{c}, {side}m)") for c in ("lo", "hi"))
    return rows.withColumn(f"{side}bin", F.explode(F.sequence(first, last)))


def overlap_join(a: DataFrame, b: DataFrame, a_ends: tuple[str, str], b_ends: tuple[str, str]) -> DataFrame:
    """All pairs of rows whose closed intervals share a point; columns of both sides, which must differ in name.

    Ends are whole numbers or dates.  Intervals may be of any length: an
    interval has a row for each level of the other side that is longer, of
    which there are at most 64, and these are looked up first.
    """
    a, b = _sided(a, *a_ends, _A), _sided(b, *b_ends, _B)
    levels = {s: sorted(r[0] for r in x.select(f"{s}level").distinct().collect()) for s, x in ((_A, a), (_B, b))}

    def lifted(rows: DataFrame, side: str, others: list[int], longer_only: bool) -> DataFrame:
        own = F.col(f"{side}level")
        fits = [F.when((F.lit(m) > own) if longer_only else (F.lit(m) >= own), F.lit(m)) for m in others]
        each = rows.withColumn("__to", F.explode(F.array_compact(F.array(*fits)))) if fits else rows.withColumn("__to", F.lit(0)).where("false")
        return _bins(each, side, F.col("__to")).drop("__to")

    long_a = _bins(a, _A, F.col(f"{_A}level")).join(lifted(b, _B, levels[_A], False), _same())
    long_b = lifted(a, _A, levels[_B], True).join(_bins(b, _B, F.col(f"{_B}level")), _same())
    met = reduce(DataFrame.unionByName, [long_a, long_b])
    start = F.expr(f"shiftright(greatest({_A}lo, {_B}lo), {_A}m)")
    met = met.where((F.col(f"{_A}lo") <= F.col(f"{_B}hi")) & (F.col(f"{_B}lo") <= F.col(f"{_A}hi")) & (F.col(f"{_A}bin") == start))
    return met.drop(*(f"{s}{c}" for s in (_A, _B) for c in ("lo", "hi", "level", "m", "bin")))


def _same() -> Column:
    return (F.col(f"{_A}m") == F.col(f"{_B}m")) & (F.col(f"{_A}bin") == F.col(f"{_B}bin"))

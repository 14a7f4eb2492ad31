"""Places in a total order of all rows, without one task that sees them all.

Rows are range-partitioned by the order, sorted within partitions and written
once; the sizes of the partitions, summed up, say where each begins.  Only one
number a partition is gathered.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import Staging, lasting

#: monotonically_increasing_id() holds the partition above these bits and the row in it below.
ROW_BITS = 33


def with_positions(rows: DataFrame, order: list[Column], name: str = "position", run: Staging | None = None) -> DataFrame:
    """rows and their place from 0 in the given order, which should tell all rows apart.

    Rows that the order does not tell apart have neighbouring places in any
    order, and stay in one task: name a key last.  Name columns of ``rows``
    only, or their asc() and desc() forms.
    """
    at = f"__at_{name}"
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    placed = (run or lasting(rows.sparkSession)).table(placed, "positions")
    part = F.shiftright(at, ROW_BITS)
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts = [0, *accumulate(n for _, n in sizes)][: len(sizes)]
    if not sizes:
        return placed.withColumn(name, F.lit(0).cast("long")).drop(at)
    first = rows.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts, strict=True)], f"__part long, {name} long")
    inside = F.col(at).bitwiseAND((1 << ROW_BITS) - 1)
    out = placed.withColumn("__part", part.cast("long")).join(F.broadcast(first), "__part")  # one row a partition
    return out.withColumn(name, F.col(name) + inside).drop("__part", at)


def misplaced(rows: DataFrame, key: str, *stored: str | Column, run: Staging | None = None) -> DataFrame:
    """Rows (key, place, want) whose place by the columns ``stored`` is not the one that the order of ``key`` gives.

    ``stored`` says where rows stand, over all files; equal keys may stand in any order among themselves.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in stored]
    named = rows.select(key, *(c.alias(f"s{k}") for k, c in enumerate(by)))
    own = run or lasting(rows.sparkSession)
    placed = with_positions(named, [F.col(f"s{k}") for k in range(len(by))], "place", own)
    wanted = with_positions(placed.select(key, "place"), [F.col(key).asc_nulls_last(), F.col("place")], "want", own)
    return wanted.where("place <> want")


def ordinals(rows: DataFrame, group: list[str], order: list[str], name: str = "ordinal", run: Staging | None = None) -> DataFrame:
    """group, order columns and the place from 0 within the group: a group with most of the rows is many tasks' work.

    Give narrow rows (digests and keys), and join what they stand for afterwards.
    """
    whole = f"__{name}"
    placed = with_positions(rows.select(*group, *order), [F.col(c) for c in (*group, *order)], whole, run)
    first = placed.groupBy(*(F.col(c).alias(f"__g{k}") for k, c in enumerate(group))).agg(F.min(whole).alias("__first"))
    same = [F.col(c).eqNullSafe(F.col(f"__g{k}")) for k, c in enumerate(group)]
    joined = placed.join(first, same)
    return joined.select(*group, *order, (F.col(whole) - F.col("__first")).alias(name))

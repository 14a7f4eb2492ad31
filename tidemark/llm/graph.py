"""Connected components by repeated contraction, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import staged


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of longs -> (id, root): root is the smallest id reachable from id.

    Only ids with a link to another id are returned.  Each round hooks every
    node to its smallest neighbour, jumps pointers, and keeps the links that
    still join two different roots; nodes that stay are at most those smaller
    than all their neighbours, so rounds are few.  Nothing is collected: the
    driver sees only whether links are left.  Groups are aggregated as
    minima, so a node with a third of all links is combined before shuffling.
    """
    live = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    label = None
    while live.limit(1).count():
        low = live.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up"))
        nodes = live.select(F.col("a").alias("id")).union(live.select("b")).distinct()
        up = nodes.join(low, "id", "left").select("id", F.coalesce("up", "id").alias("up"))
        up = staged(up, "up")
        jump = up.select(F.col("id").alias("up"), F.col("up").alias("up2"))
        up = up.join(jump, "up").select("id", F.col("up2").alias("up"))
        jump = up.select(F.col("id").alias("up"), F.col("up").alias("up2"))
        up = staged(up.join(jump, "up").select("id", F.col("up2").alias("up")), "roots")
        to = lambda c: up.select(F.col("id").alias(c), F.col("up").alias(f"{c}2"))
        live = staged(
            live.join(to("a"), "a").join(to("b"), "b")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a < b").distinct(),
            "links",
        )
        step = up.select(F.col("id").alias("root"), F.col("up").alias("next"))
        label = up.select("id", F.col("up").alias("root")) if label is None else staged(
            label.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "labels")
    return edges.sparkSession.createDataFrame([], "id long, root long") if label is None else label

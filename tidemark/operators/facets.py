"""Facet categories, counts, checks and option order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import CONFLICTED, ENROLL_BUCKETS, UNPROVIDED


def category(conflict: Column, value: Column) -> Column:
    """Exactly one of: conflicted, unprovided (null or empty), the value."""
    return F.when(F.coalesce(conflict, F.lit(False)), F.lit(CONFLICTED)).when(value.isNull() | (value == ""), F.lit(UNPROVIDED)).otherwise(value)


def facet_counts(entities: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """entities -> facet, kind, value, count: all facets in one pass over the entities."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("facet"), c.alias("value")) for k, c in facets.items())))
    kind = F.when(F.col("value") == CONFLICTED, "conflicted").when(F.col("value") == UNPROVIDED, "unprovided").otherwise("bucket")
    out = entities.select(pairs.alias("x")).select("x.facet", "x.value").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count"))
    return out.select("facet", kind.alias("kind"), F.when(kind == "bucket", F.col("value")).alias("value"), "count")


def denominator_check(counts: DataFrame, total: DataFrame) -> DataFrame:
    """facet, counted, entities, matches: every facet's counts sum to the number of entities."""
    sums = counts.groupBy("facet").agg(F.sum("count").alias("counted"))
    return sums.crossJoin(F.broadcast(total.agg(F.count(F.lit(1)).alias("entities")))).withColumn("matches", F.col("counted") == F.col("entities"))


def option_order(counts: DataFrame) -> list[Column]:
    return [F.col("facet"), (F.col("kind") != "bucket").desc(), F.col("count").desc(), F.col("value").asc_nulls_first()]


def buckets_of(low: Column, high: Column, buckets=ENROLL_BUCKETS) -> Column:
    """Labels of all closed buckets that a closed interval overlaps; none for a null interval."""
    hits = [F.when((low <= (F.lit(b) if b is not None else high)) & (high >= F.lit(a)), F.lit(label)) for label, a, b in buckets]
    return F.array_compact(F.array(*hits))


def bucket_labels(conflict: Column, low: Column, high: Column, buckets=ENROLL_BUCKETS) -> Column:
    """What an entity counts as and is filtered by: conflicted alone, else unprovided alone without an interval, else its buckets."""
    special = F.when(F.coalesce(conflict, F.lit(False)), F.lit(CONFLICTED)).when(low.isNull() | high.isNull(), F.lit(UNPROVIDED))
    return F.when(special.isNotNull(), F.array(special)).otherwise(buckets_of(low, high, buckets))


def bucket_counts(entities: DataFrame, low: Column, high: Column, buckets=ENROLL_BUCKETS, conflict: Column | None = None) -> DataFrame:
    """bucket, count: an entity counts in each bucket it overlaps, or as conflicted or unprovided."""
    labels = bucket_labels(F.lit(False) if conflict is None else conflict, low, high, buckets)
    return entities.select(F.explode(labels).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("count"))

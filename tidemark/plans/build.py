"""From raw rows to publishable tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import search_normalize
from ..operators import converge, facets, identity
from ..staging import Staging, lasting
from .spec import SnapshotSpec


def build(rows: DataFrame, spec: SnapshotSpec, build_date: dt.date, run: Staging | None = None) -> dict[str, DataFrame]:
    """trials, records, search and stats tables; collisions raise first.

    Parsed records are written once, in ``run``; close it when the tables have been published.

    search holds one row a record with short and long fields normalised once
    and in_cohort, so a scope is a filter on it.
    """
    records = (run or lasting(rows.sparkSession)).table(converge.build_records(rows, spec, build_date), "records")
    keyed = records.select(F.col("protocol").alias(spec.identity), "norm", "hash", "key", "tid", "rid")
    identity.require_no_collision(keyed, spec.identity)
    identity.require_no_truncation(keyed)
    trials, dated = converge.build_trials(records, spec)
    trials = converge.facet_keys(trials, spec)
    fold = lambda c: search_normalize(F.col("raw")[c]).alias(c)
    search = dated.select(F.col("rid").alias("r"), F.col("tid").alias("t"), F.col("day").alias("d"), "in_cohort",
                          F.struct(*map(fold, spec.short_search)).alias("short"), F.struct(*map(fold, spec.long_search)).alias("long"))
    return {"trials": trials, "records": dated.withColumn("shard", identity.shard_of(F.col("tid"))), "search": search, "stats": facets.facet_counts(trials, categories(spec))}


def categories(spec: SnapshotSpec) -> dict:
    """Facet name -> category column over trials."""
    out = {}
    for name, column in spec.facets.items():
        text = F.col("display_fields")[column]["typed"]["str"]
        out[name] = facets.category(F.array_contains("conflict_fields", column), converge.facet_key(spec, column, text))
    return out


def detail(records: DataFrame, spec: SnapshotSpec, tid: str) -> DataFrame:
    """day, record_ids, differing: an entity's records by usable day, latest first, undated last; the shard prunes the read."""
    own = records.where((F.col("shard") == tid[1:3]) & (F.col("tid") == tid))
    differs = [F.when(F.min(F.col("raw")[c]) != F.max(F.col("raw")[c]), F.lit(c)) for c in spec.presentation]
    out = own.groupBy("day").agg(F.array_sort(F.collect_list("rid")).alias("record_ids"), F.array_compact(F.array(*differs)).alias("differing"))
    return out.orderBy(F.col("day").desc_nulls_last())


def card(trials: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """tid, field, conflict, raw, flags for the card columns; a conflicting field has no raw value."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.array_contains("conflict_fields", c).alias("conflict"), F.col("display_fields")[c]["raw"].alias("raw"), F.col("display_fields")[c]["flags"].alias("flags")) for c in spec.card)))
    return trials.select("tid", each.alias("x")).select("tid", "x.*")

"""Convergence: records of an entity -> its latest cohort -> one value a field, or a conflict and no value."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.text import facet_normalize, loose_key, nfkc
from ..plans.spec import SnapshotSpec
from . import identity


def latest_cohort(records: DataFrame, entity: str, day: Column) -> DataFrame:
    """records + latest_date, in_cohort: the rows of an entity's latest usable day, ties kept; all rows if no day is usable.

    A maximum per entity joined back, not a window: it combines before the
    shuffle, and a very large entity can be split by skew handling.
    """
    latest = records.groupBy(entity).agg(F.max(day).alias("latest_date"))
    joined = records.join(latest.withColumnRenamed(entity, "__entity"), F.col(entity).eqNullSafe(F.col("__entity"))).drop("__entity")
    return joined.withColumn("in_cohort", F.col("latest_date").isNull() | F.coalesce(day == F.col("latest_date"), F.lit(False)))


def resolve(cohort: DataFrame, entity: str, rid: str, field: str = "field", key: str = "key", raw: str = "raw", value: str = "value") -> DataFrame:
    """Long form (entity, rid, field, key, raw, value) -> entity, field, conflict, raw_variants, value.

    More than one distinct key is a conflict, which has no value; otherwise the
    value of the smallest record id.  Minima and maxima tell whether values
    differ, so no distinct set is kept.
    """
    out = cohort.groupBy(entity, field).agg(
        (F.min(key) != F.max(key)).alias("conflict"), (F.min(raw) != F.max(raw)).alias("raw_variants"), F.min_by(value, rid).alias("value"))
    return out.select(entity, field, "conflict", (~F.col("conflict") & F.col("raw_variants")).alias("raw_variants"), F.when(~F.col("conflict"), F.col("value")).alias("value"))


def conflicting(cohort: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """entity, cohort_count, conflict_fields (names joined by a comma, sorted) for plain columns; nulls are values."""
    differs = [F.when((F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1)))), F.lit(c)) for c in sorted(columns)]
    return cohort.groupBy(entity).agg(F.count(F.lit(1)).alias("cohort_count"), F.concat_ws(",", *differs).alias("conflict_fields"))


def record_order(records: DataFrame, entity: str, day: str, rid: str) -> DataFrame:
    """entity, record_ids: usable days latest first, the others last, then by record id."""
    entry = F.struct(F.col(day).isNull().alias("none"), (-F.unix_date(day)).alias("late"), F.col(rid).alias("rid"))
    return records.groupBy(entity).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["rid"]).alias("record_ids"))


def build_records(rows: DataFrame, spec: SnapshotSpec, build_date: dt.date) -> DataFrame:
    """Raw rows -> rid, tid, key, raw map, fields array, updated, record_flags; one row each."""
    at = lambda c: F.col(f"`{c}`")
    names = (*spec.presentation, spec.updated)
    norm = {c: F.col(f"n{k}") for k, c in enumerate(names)}
    # In steps, each a projection: normal forms (one round trip to Python), typed values, comparison keys.
    rows = rows.select("*", *(nfkc(at(c)).alias(f"n{k}") for k, c in enumerate(names)), parse.canonical(spec.columns).alias("canon"))
    values = {c: F.col(f"v{k}") for k, c in enumerate(spec.presentation)}
    rows = rows.select("*", *(parse.parse_field(spec, c, at(c), norm[c]).alias(f"v{k}") for k, c in enumerate(spec.presentation)))
    rows = rows.select("*", *(parse.comparison_key(spec.kind(c), values[c], norm[c]).alias(f"k{k}") for k, c in enumerate(spec.presentation)))
    fields = F.array(*(F.struct(F.lit(c).alias("field"), values[c].alias("value"), F.col(f"k{k}").alias("key")) for k, c in enumerate(spec.presentation)))
    raw = F.map_from_arrays(F.array(*map(F.lit, spec.columns)), F.array(*map(at, spec.columns)))
    late = parse.period_order_anomaly(values[spec.period_start], values[spec.period_end]) if spec.period_start and spec.period_end else F.lit(False)
    marks = F.array_compact(F.array(F.when(late, F.lit("periodEndBeforeStart")), F.when(parse.suspected_test_row(spec, norm), F.lit("suspectedTestRow"))))
    updated = parse.parse_updated(at(spec.updated), build_date, norm[spec.updated])
    rows = rows.select(at(spec.identity), "canon", raw.alias("raw"), fields.alias("fields"), updated.alias("updated"), marks.alias("record_flags"))
    keyed = identity.assign_keys(rows, spec.identity)
    out = keyed.select("rid", "tid", "key", "norm", "hash", at(spec.identity).alias("protocol"), "raw", "fields", "updated", "record_flags")
    return out.withColumn("day", F.when(F.col("updated.usable"), F.col("updated.date")))


def facet_key(spec: SnapshotSpec, column: str, text: Column) -> Column:
    return facet_normalize(text) if column in spec.folded_facets else text


def build_trials(records: DataFrame, spec: SnapshotSpec) -> tuple[DataFrame, DataFrame]:
    """records -> (trials, records with latest_date and in_cohort)."""
    dated = latest_cohort(records, "tid", F.col("day"))
    long = dated.where("in_cohort").select("tid", "rid", F.explode("fields").alias("x")).select("tid", "rid", "x.field", "x.key", F.col("x.value.raw").alias("raw"), F.col("x.value").alias("value"))
    fields = resolve(long, "tid", "rid")
    marked = F.when(F.col("raw_variants"), F.struct("value.raw", "value.typed", parse.with_flag(F.col("value.flags"), "rawVariants").alias("flags"))).otherwise(F.col("value"))
    by_trial = fields.groupBy("tid").agg(
        F.array_sort(F.collect_list(F.when(F.col("conflict"), F.col("field")))).alias("conflict_fields"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(~F.col("conflict"), F.struct("field", marked.alias("value"))))).alias("d")).alias("display_fields"))
    entry = F.struct(F.col("day").isNull().alias("none"), (-F.unix_date("day")).alias("late"), F.col("rid").alias("rid"))
    whole = dated.groupBy("tid").agg(
        F.min("key").alias("key"), F.array_sort(F.collect_set("protocol")).alias("protocol_raw"),
        (F.max(F.length(loose_key(F.col("protocol")))) == 0).alias("protocol_non_identifier"),
        F.bool_or(F.array_contains("record_flags", "suspectedTestRow")).alias("suspected_test_row"),
        F.max("latest_date").alias("latest_date"), F.count_if("in_cohort").alias("cohort_count"), F.count(F.lit(1)).alias("record_count"),
        F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["rid"]).alias("record_ids"),
        F.array_sort(F.collect_list(F.when(F.col("in_cohort"), F.col("rid")))).alias("latest_cohort"))
    loose = identity.near_members(dated.where("norm <> ''").select(loose_key(F.col("protocol")).alias("l"), "tid").distinct(), F.col("l"), "tid")
    near = loose.groupBy(F.col("key").alias("tid")).agg(F.min("loose").alias("near_group"))
    trials = whole.join(by_trial, "tid").join(near, "tid", "left")
    return trials.select(
        "tid", "key", "protocol_raw", "protocol_non_identifier", "suspected_test_row", "near_group", "latest_date", F.col("latest_date").isNull().alias("date_unknown"),
        "cohort_count", "record_count", ((F.col("cohort_count") > 1) & (F.size("conflict_fields") > 0)).alias("latest_ambiguous"),
        "conflict_fields", "display_fields", "record_ids", "latest_cohort", identity.shard_of(F.col("tid")).alias("shard")), dated


def facet_keys(trials: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """trials + facet_keys: only the keys that differ from the typed text, also where the key is empty."""
    pairs = []
    for name, column in spec.facets.items():
        text = F.col("display_fields")[column]["typed"]["str"]
        key = facet_key(spec, column, text)
        pairs.append(F.when(text.isNotNull() & (key != text), F.struct(F.lit(name).alias("k"), key.alias("v"))))
    return trials.withColumn("facet_keys", F.map_from_entries(F.array_compact(F.array(*pairs))))


def source_updated_at(trials: DataFrame) -> DataFrame:
    return trials.agg(F.max("latest_date").alias("source_updated_at"))

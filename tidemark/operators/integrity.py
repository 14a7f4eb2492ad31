"""Integrity of published tables: each rule is a query for the rows that break it.

A rule whose precondition is missing is reported as unevaluable, not violated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SnapshotError
from .positions import misplaced


def missing_or_extra(declared: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, side (missing, extra) of a full comparison of two sets."""
    a = declared.select(key).distinct().withColumn("d", F.lit(1))
    b = found.select(key).distinct().withColumn("f", F.lit(1))
    return a.join(b, key, "full_outer").where("d is null or f is null").select(key, F.when(F.col("f").isNull(), "missing").otherwise("extra").alias("side"))


def orphans(child: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    return child.join(parent.select(*key), key, "left_anti")


def not_owned_once(owners: DataFrame, key: str) -> DataFrame:
    return owners.groupBy(key).agg(F.count(F.lit(1)).alias("owners")).where("owners <> 1")


def out_of_order(rows: DataFrame, by: list[str], position: str, order: list[str]) -> DataFrame:
    """Rows whose stored position is not the one their order gives."""
    from pyspark.sql import Window

    return rows.withColumn("want", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).where(F.col("want") != F.col(position))


def out_of_order_in_files(rows: DataFrame, key: str) -> DataFrame:
    """Rows that do not stand where the order of ``key`` over all files of a table puts them.

    Files count in the order of their names, rows in the order in which a file
    stores them; equal keys may stand in any order among themselves.
    """
    stands = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    return misplaced(rows, key, *stands).select(key)


def differences(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    return stored.exceptAll(recomputed).withColumn("side", F.lit("stored")).unionByName(recomputed.exceptAll(stored).withColumn("side", F.lit("recomputed")))


def violations(trials: DataFrame, records: DataFrame, facets: DataFrame, recomputed: DataFrame, version: str, stored: DataFrame | None = None) -> dict[str, DataFrame | None]:
    """Rule -> rows that break it, over the tables of a published version.

    trials: tid, shard, record_ids, latest_cohort, counts, day order; records:
    rid, tid, shard, day; all carry the version they were written with.
    stored: trials as read from their files, whose order is checked.
    """
    held = trials.select("tid", "shard", F.posexplode("record_ids").alias("pos", "rid"))
    cohort = trials.select("tid", F.posexplode("latest_cohort").alias("pos", "rid"))
    day = records.select("rid", "day")
    dated = held.join(day, "rid")
    return {
        "I2": trials.select("version").union(records.select("version")).where(F.col("version") != version),
        "I3.shard": records.where(F.col("shard") != F.substring("rid", 2, 2)),
        "I3.owner": not_owned_once(held, "rid"),
        "I3.orphan": records.select("rid").join(held.select("rid"), "rid", "left_anti").union(held.select("rid").join(records.select("rid"), "rid", "left_anti")),
        "I3.subset": trials.where(F.size(F.array_except("latest_cohort", "record_ids")) > 0),
        "I4.records": trials.where(F.size("record_ids") != F.col("record_count")),
        "I4.cohort": trials.where(F.size("latest_cohort") != F.col("cohort_count")),
        "identity": trials.where(F.col("tid") != F.concat(F.lit("t"), F.substring(F.sha2(F.col("key").cast("binary"), 256), 1, 16))),
        "I5.trials": None if stored is None else out_of_order_in_files(stored, "tid"),
        "I5.records": out_of_order(dated, ["tid"], "pos", [F.col("day").desc_nulls_last(), "rid"]),
        "I5.cohort": out_of_order(cohort, ["tid"], "pos", ["rid"]),
        "I6": differences(facets, recomputed),
    }


def evaluate(rules: dict[str, DataFrame | None]) -> tuple[list[str], list[str]]:
    """(violated, unevaluable) rule names."""
    parts = [df.limit(1).select(F.lit(name).alias("rule")) for name, df in rules.items() if df is not None]
    found = {r.rule for r in reduce(DataFrame.union, parts).collect()} if parts else set()
    return [n for n in rules if n in found], [n for n, df in rules.items() if df is None]


def require(rules: dict[str, DataFrame | None]) -> None:
    violated, lost = evaluate(rules)
    if violated or lost:
        raise SnapshotError("INTEGRITY_DIGEST", violated=violated, unevaluable=lost)

"""Quality reports and gates over records and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SnapshotError
from ..functions.text import nfkc, strip

#: Texts that stand for a missing one without being it.
SENTINELS = ("N/A", "NA", "")
EXAMPLES = 5


def flag_counts(records: DataFrame, fields: str = "fields") -> DataFrame:
    """field, flag, count over all records; fields is an array of struct<field, value>."""
    each = records.select(F.explode(fields).alias("x")).select("x.field", F.explode("x.value.flags").alias("flag"))
    return each.groupBy("field", "flag").agg(F.count(F.lit(1)).alias("count"))


def warnings(records: DataFrame, flags: Column, rid: str, n: int = EXAMPLES) -> DataFrame:
    """flag, count and the first n record ids; each task keeps n ids a flag."""
    each = records.select(F.explode(flags).alias("flag"), F.col(rid).alias("rid"))
    counts = each.groupBy("flag").agg(F.count(F.lit(1)).alias("count"))
    from pyspark.sql import Window

    first = each.withColumn("k", F.row_number().over(Window.partitionBy("flag").orderBy("rid"))).where(F.col("k") <= n)
    return counts.join(first.groupBy("flag").agg(F.array_sort(F.collect_list("rid")).alias("examples")), "flag")


def nullness(records: DataFrame, columns: list[str], ascii_only: bool = False) -> DataFrame:
    """field, blank: values that are null or blank after stripping; one scan for all columns."""
    blank = lambda c: F.coalesce(strip(F.col(f"`{c}`") if ascii_only else nfkc(F.col(f"`{c}`"))) == "", F.lit(True))
    return _long(records.agg(*(F.count_if(blank(c)).alias(c) for c in columns)), columns, "field", "blank")


def sentinels(records: DataFrame, columns: list[str]) -> DataFrame:
    """field, sentinel, count of exact stand-ins."""
    names = {f"{c}\x1f{s}": (c, s) for c in columns for s in SENTINELS}
    wide = records.agg(*(F.count_if(F.col(f"`{c}`") == s).alias(k) for k, (c, s) in names.items()))
    out = _long(wide, list(names), "k", "count")
    return out.select(F.substring_index("k", "\x1f", 1).alias("field"), F.substring_index("k", "\x1f", -1).alias("sentinel"), "count")


def _long(wide: DataFrame, columns: list[str], key: str, value: str) -> DataFrame:
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias(key), F.col(f"`{c}`").alias(value)) for c in columns))).alias("x")).select("x.*")


def cohort_counts(trials: DataFrame) -> DataFrame:
    """One row: ties, ambiguous entities, entities without a date."""
    return trials.agg(F.count_if(F.col("cohort_count") > 1).alias("ties"), F.count_if("latest_ambiguous").alias("ambiguous"), F.count_if("date_unknown").alias("date_unknown"))


def conflict_distribution(trials: DataFrame, conflicts: str = "conflict_fields") -> DataFrame:
    """field, count over entities with a conflict."""
    return trials.select(F.explode(conflicts).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("count"))


def differing_fields(records: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by..., fields: names of columns with more than one distinct raw value in a group; none is a row less."""
    differs = [F.when((F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1)))), F.lit(c)) for c in sorted(columns)]
    return records.groupBy(*by).agg(F.concat_ws(",", *differs).alias("fields")).where("fields <> ''")


def drop_verdict(current: Column, previous: Column) -> Column:
    """zero, bootstrap, fail (over a fifth lost), warn (over a tenth) or ok, in exact integers."""
    lost = previous - current
    return F.when(current == 0, "zero").when(previous.isNull(), "bootstrap").when(lost * 5 > previous, "fail").when(lost * 10 > previous, "warn").otherwise("ok")


def check_row_count(current: int, previous: int | None) -> str:
    if current == 0:
        raise SnapshotError("ZERO_ROWS")
    if previous is None:
        return "bootstrap"
    lost = previous - current
    if 5 * lost > previous:
        raise SnapshotError("ROWCOUNT_DROP", current=current, previous=previous)
    return "warn" if 10 * lost > previous else "ok"


def size_report(sizes: DataFrame, baseline: DataFrame, ratio: float = 1.2) -> DataFrame:
    """name, bytes, base, ratio, warns: files against a recorded baseline."""
    out = sizes.join(baseline, "name", "left").withColumn("ratio", F.col("bytes") / F.col("base"))
    return out.withColumn("warns", F.coalesce(F.col("ratio") > ratio, F.lit(False)))


def quality_report(records: DataFrame, trials: DataFrame, text_columns: list[str], presentation: list[str], near: DataFrame) -> dict[str, DataFrame]:
    """All parts of the report, each a small frame."""
    raw = records.select("rid", *(F.col("raw")[c].alias(c) for c in presentation))
    return {
        "flags": flag_counts(records),
        "record_warnings": warnings(records, F.col("record_flags"), "rid"),
        "date_warnings": warnings(records.where("updated.flag is not null"), F.array("updated.flag"), "rid"),
        "cohorts": cohort_counts(trials),
        "sentinels": sentinels(raw, text_columns),
        "nullness": nullness(raw, presentation),
        "conflicts": conflict_distribution(trials.where("latest_ambiguous")),
        "near_duplicates": near,
        "non_identifiers": trials.where("protocol_non_identifier").select("tid", "protocol_raw"),
        "test_rows": trials.where("suspected_test_row").select("tid", "record_ids"),
    }

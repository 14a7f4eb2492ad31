"""Multi-term substring search: every term in some field of one record; hits name their fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SnapshotError
from ..functions.text import search_normalize_text

#: Search files by scope; the shortest scope reads what the index holds.
SCOPES = {("short", "latest"): (), ("short", "all"): ("short_all",), ("all", "latest"): ("long_latest",), ("all", "all"): ("short_all", "long_latest", "long_all")}
#: Fixed value: entities of one page.
PAGE = 50


def parse_query(q: str) -> list[str]:
    """Terms; none means browsing, not everything."""
    return [t for t in search_normalize_text(q).split(" ") if t]


def matches(fields: list[Column], terms: list[str]) -> Column:
    """All terms, each in any field; plain substrings, so % and _ mean themselves."""
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [F.coalesce(f.contains(t), F.lit(False)) for f in fields]) for t in terms], F.lit(bool(terms)))


def hit_fields(fields: dict[str, Column], terms: list[str]) -> Column:
    """Names of all fields that hold any term, in order."""
    any_ = lambda f: reduce(lambda a, b: a | b, [F.coalesce(f.contains(t), F.lit(False)) for t in terms], F.lit(False))
    return F.array_compact(F.array(*(F.when(any_(f), F.lit(n)) for n, f in fields.items())))


def search_records(entries: DataFrame, fields: dict[str, Column], terms: list[str], entity: str, record: str, day: str | None = None) -> DataFrame:
    """entity, record, day, hit_fields of the records that match; filters reach the scan, fields are read once."""
    hit = entries.where(matches(list(fields.values()), terms))
    return hit.select(F.col(entity).alias("entity"), F.col(record).alias("record"), (F.col(day) if day else F.lit(None).cast("date")).alias("day"), hit_fields(fields, terms).alias("hit_fields"))


def by_entity(hits: DataFrame) -> DataFrame:
    """entity, hits (record, day, fields), n_records."""
    entry = F.struct("record", "day", "hit_fields")
    return hits.groupBy("entity").agg(F.array_sort(F.collect_list(entry)).alias("hits"), F.count(F.lit(1)).alias("n_records"))


def merge_hits(*parts: DataFrame) -> DataFrame:
    """Hits of several searches, one row a record with all its fields."""
    whole = reduce(lambda a, b: a.unionByName(b), parts)
    return whole.groupBy("entity", "record").agg(F.max("day").alias("day"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_fields")))).alias("hit_fields"))


def require_known(hits: DataFrame, trials: DataFrame, tid: str = "tid") -> None:
    lost = hits.join(trials.select(F.col(tid).alias("entity")), "entity", "left_anti").select("entity").distinct().limit(5).collect()
    if lost:
        raise SnapshotError("INTEGRITY_DIGEST", "search entries of unknown entities", entities=[r[0] for r in lost])


def _holds(term: str):
    return lambda x: x.contains(term)


def folded(entries: DataFrame, fields: dict[str, Column], *keep: str) -> DataFrame:
    """keep and the given fields, each computed once a row however many terms and conditions ask for it.

    A generator stands between the fields and what is asked of them, so that the
    optimiser does not put the expressions into every condition.
    """
    return entries.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in fields.items())))))


def search_scope(
    tables: dict[str, DataFrame], index: DataFrame, terms: list[str], scope: tuple[str, str], cross_group: bool = False, trials: DataFrame | None = None
) -> DataFrame:
    """Hits of a scope; none without terms.  With trials (tid), hits of unknown entities raise.

    tables: search tables by name with r, t, d and f (map of field to text); index: the latest short entries in the same form.
    Each table is searched alone, so terms do not meet across field groups,
    unless cross_group joins the texts of a record first.
    """
    if scope not in SCOPES:
        raise ValueError(f"unknown scope: {scope}")
    parts = ([index] if scope[1] == "latest" else []) + [tables[k] for k in SCOPES[scope]]
    if cross_group:
        whole = reduce(lambda a, b: a.unionByName(b), parts)
        entry = F.explode(F.map_entries("f")).alias("e")
        flat = whole.select("r", "t", "d", entry).select("r", "t", "d", "e.key", "e.value").distinct()
        parts = [flat.groupBy("r", "t", "d").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("f"))]
    hits = []
    for p in parts:
        values = F.map_values("f")
        every = reduce(lambda a, b: a & b, [F.exists(values, _holds(t)) for t in terms], F.lit(bool(terms)))
        named = F.map_keys(F.map_filter("f", lambda k, x: reduce(lambda a, b: a | b, [x.contains(t) for t in terms], F.lit(False))))
        hits.append(p.where(every).select(F.col("t").alias("entity"), F.col("r").alias("record"), F.col("d").alias("day"), named.alias("hit_fields")))
    merged = merge_hits(*hits)
    if trials is not None:
        require_known(merged, trials)
    return merged


def ordered(entities: DataFrame, day: str, entity: str) -> DataFrame:
    """Unknown dates last, latest first, then by id."""
    return entities.orderBy(F.col(day).desc_nulls_last(), entity)


def page(entities: DataFrame, day: str, entity: str, n: int = PAGE) -> DataFrame:
    """The first n in order; the plan keeps n rows a task."""
    return ordered(entities, day, entity).limit(n)


def files_to_load(scope: tuple[str, str], loaded: set[str]) -> list[str]:
    return [f for f in SCOPES[scope] if f not in loaded]


def estimated_bytes(sizes: dict[str, int | None], files: list[str]) -> int | None:
    """Sum of sizes; unknown if one is."""
    found = [sizes.get(f) for f in files]
    return None if None in found else sum(found)


def format_size(n: int | None) -> str:
    if n is None:
        return "unknown size"
    kib = n / 1024
    return f"about {int(kib + 0.5)} KiB" if kib < 1024 else f"about {kib / 1024:.1f} MiB"


def wider_scopes(scope: tuple[str, str]) -> list[tuple[str, str]]:
    fields, history = scope
    return ([("all", history)] if fields == "short" else []) + ([(fields, "all")] if history == "latest" else [])


def hit_days(hits: DataFrame, cohort: DataFrame) -> DataFrame:
    """entity, fields, days: fields hit in the latest cohort, and the distinct days (ascending) of other hits; undated says one had none."""
    inside = F.col("c").isNotNull()
    joined = hits.join(cohort.select(F.col("rid").alias("record"), F.lit(1).alias("c")), "record", "left")
    return joined.groupBy("entity").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_fields")))).alias("fields"),
        F.array_sort(F.collect_set(F.when(~inside, F.col("day")))).alias("days"), F.bool_or(~inside & F.col("day").isNull()).alias("undated"))

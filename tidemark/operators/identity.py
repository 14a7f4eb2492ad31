"""Identity keys, ordinals, collisions and groups of near-equal identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SnapshotError
from ..functions.text import PY_SPACE, has_ascii_alnum, identity_normalize, loose_key, strip


def entity_id(key: Column) -> Column:
    return F.concat(F.lit("t"), F.substring(F.sha2(key.cast("binary"), 256), 1, 16))


def shard_of(tid: Column) -> Column:
    return F.substring(tid, 2, 2)


#: Copies of one row that are written out by one task.
COPIES = 65_536


def ordinals(df: DataFrame, by: list[str], name: str, order: list[str] | None = None) -> DataFrame:
    """0, 1, ... among rows equal in ``by``, in one task a group; positions.ordinals() is for groups of any size."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*(order or by))) - 1)


def numbered_copies(rows: DataFrame, same: list[str], name: str) -> DataFrame:
    """rows and their number, from 0, among rows that agree in ``same``, which must agree in everything.

    Copies are counted, which combines before the shuffle, and written out
    again in stretches of COPIES that are dealt out anew, so a row repeated any
    number of times is neither one task's work nor one array.
    """
    rest = [c for c in rows.columns if c not in same]
    once = rows.groupBy(*same).agg(F.first(F.struct(*rest)).alias("__row"), F.count(F.lit(1)).alias("__n"))
    few = once.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(COPIES).cast("long"))))
    few = few.hint("rebalance", *(F.col(c) for c in (*same, "__from")))
    end = F.least(F.col("__from") + COPIES, F.col("__n")) - 1
    return few.withColumn(name, F.explode(F.sequence(F.col("__from"), end))).select(*same, "__row.*", name)


def assign_keys(rows: DataFrame, identity: str, canon: str = "canon") -> DataFrame:
    """rows + key, tid, rid.  P:<normalised identifier>, or H:<hash of the row>#<ordinal> where there is none.

    Rows with one canonical text are copies of each other.  Copies with an
    identifier are records of one entity, numbered; without one, each copy is
    an entity of its own.
    """
    rows = numbered_copies(rows.withColumn("hash", F.sha2(F.col(canon).cast("binary"), 256)), ["hash", canon], "same")
    rows = rows.withColumn("norm", identity_normalize(F.col(f"`{identity}`")))
    named, nth = F.col("norm") != "", F.col("same").cast("string")
    rows = rows.withColumn("key", F.when(named, F.concat(F.lit("P:"), "norm")).otherwise(F.concat(F.lit("H:"), "hash", F.lit("#"), nth)))
    rows = rows.withColumn("tid", entity_id(F.col("key")))
    rid = F.concat("tid", F.lit("r"), F.substring("hash", 1, 16), F.lit("#"), F.when(named, nth).otherwise("0"))
    return rows.withColumn("rid", rid).drop("same")


def colliding(rows: DataFrame, raw: Column, norm: Column) -> DataFrame:
    """Groups of equal normalised identifiers with two or more distinct stripped spellings: norm, raws."""
    pairs = rows.select(norm.alias("norm"), strip(raw, PY_SPACE).alias("raw")).where("norm <> ''").distinct()
    return pairs.groupBy("norm").agg(F.array_sort(F.collect_list("raw")).alias("raws")).where(F.size("raws") > 1)


def whitespace_variants(rows: DataFrame, raw: Column, norm: Column) -> DataFrame:
    """Groups of equal normalised identifiers with two or more distinct raw spellings: norm, raws."""
    pairs = rows.select(norm.alias("norm"), raw.alias("raw")).where("norm <> ''").distinct()
    return pairs.groupBy("norm").agg(F.array_sort(F.collect_list("raw")).alias("raws")).where(F.size("raws") > 1)


def require_no_collision(keyed: DataFrame, identity: str) -> None:
    """All colliding groups are reported, with the hashes of their rows; only groups at fault are looked up."""
    bad = colliding(keyed, F.col(f"`{identity}`"), F.col("norm"))
    detail = bad.join(keyed.select("norm", "hash"), "norm").groupBy("norm", "raws").agg(F.array_sort(F.collect_set("hash")).alias("hashes")).orderBy("norm").collect()
    if detail:
        raise SnapshotError("IDENTITY_COLLISION", groups=[{"key": r.norm, "raws": r.raws, "fingerprints": r.hashes} for r in detail])


def truncated(df: DataFrame, short: str, full: Column) -> DataFrame:
    """Short ids that stand for more than one full key."""
    return df.groupBy(short).agg(F.min(full).alias("low"), F.max(full).alias("high")).where("low <> high").select(short)


def require_no_truncation(keyed: DataFrame) -> None:
    bad = [r[0] for r in truncated(keyed, "tid", F.col("key")).collect()] + [r[0] for r in truncated(keyed, "rid", F.col("hash")).collect()]
    if bad:
        raise SnapshotError("ID_TRUNCATION_COLLISION", ids=sorted(bad))


def _keyed(entities: DataFrame, loose: Column, name: str, key: str) -> DataFrame:
    """Keys and non-empty loose keys; behind a generator, so that the loose key is not computed again for the condition."""
    return entities.select(F.col(key).alias(name), F.inline(F.array(F.struct(loose.alias("loose"))))).where("loose <> ''")


def near_groups(entities: DataFrame, loose: Column, key: str) -> DataFrame:
    """Loose keys shared by two or more entity keys: loose, keys.  A hint; it never merges."""
    pairs = _keyed(entities, loose, "k", key).distinct()
    return pairs.groupBy("loose").agg(F.array_sort(F.collect_list("k")).alias("keys")).where(F.size("keys") > 1)


def near_members(entities: DataFrame, loose: Column, key: str) -> DataFrame:
    """key, loose, representative (the smallest key), others: entities whose loose key another one shares.

    A group of any size is its representative and its members' rows; no list is made of it.
    """
    pairs = _keyed(entities, loose, "key", key).distinct()
    groups = pairs.groupBy("loose").agg(F.min("key").alias("representative"), (F.count(F.lit(1)) - 1).alias("others")).where("others > 0")
    return pairs.join(groups, "loose").select("key", "loose", "representative", "others")


def near_partners(groups: DataFrame) -> DataFrame:
    """Each key with the others of its group."""
    each = groups.select("loose", F.explode("keys").alias("key"), "keys")
    return each.select("key", "loose", F.array_remove("keys", F.col("key")).alias("others"))


def lookup(wanted: DataFrame, trials: DataFrame) -> DataFrame:
    """wanted (raw) -> raw, outcome (match, rejected, notFound), tid.  An identifier without letters or digits is rejected, also if it matches."""
    spelled = trials.select("tid", "protocol_non_identifier", F.explode("protocol_raw").alias("p")).select("tid", "protocol_non_identifier", identity_normalize(F.col("p")).alias("norm")).distinct()
    asked = wanted.select("raw", identity_normalize(F.col("raw")).alias("norm"), has_ascii_alnum(F.col("raw")).alias("named"))
    found = asked.join(spelled, "norm", "left")
    hit = F.col("tid").isNotNull()
    outcome = F.when(hit & F.col("named") & ~F.col("protocol_non_identifier"), "match").when(hit | ~F.col("named"), "rejected").otherwise("notFound")
    return found.select("raw", outcome.alias("outcome"), F.when(outcome == "match", F.col("tid")).alias("tid"))


def loose_of(column: str) -> Column:
    return loose_key(F.col(f"`{column}`"))

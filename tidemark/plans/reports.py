"""Reports of a run as JSON values: schema, collisions and quality.

What is bounded by the columns is collected; lists of entities stay tables and
are written beside the report, with their numbers in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SnapshotError
from ..functions.text import PY_SPACE, strip
from ..operators import identity, quality
from .publish import export_json
from .spec import SnapshotSpec

#: Parts of the quality report with a row an entity or group.
LISTS = ("near_duplicates", "non_identifiers", "test_rows", "record_warnings")


def schema_report(spec: SnapshotSpec, rows: int, previous: int | None = None, **source) -> dict:
    """Columns, rows and the verdict on their number; ROWCOUNT_DROP and ZERO_ROWS raise."""
    verdict = quality.check_row_count(rows, previous)
    drop = None if previous is None else f"{previous - rows}/{previous}"
    return {"columns": list(spec.columns), "columnCount": len(spec.columns), "rowCount": rows, "prevRowCount": previous, "verdict": verdict, "drop": drop, **source}


def collisions(keyed: DataFrame, column: str) -> DataFrame:
    """norm, tid, members (stripped, raws, fingerprints) of every group of identifiers that collide.

    keyed: norm, hash and the raw identifier; only groups at fault are gathered.
    """
    bad = identity.colliding(keyed, F.col(f"`{column}`"), F.col("norm")).select("norm")
    own = keyed.join(bad, "norm", "left_semi").select("norm", "hash", F.col(f"`{column}`").alias("raw"), strip(F.col(f"`{column}`"), PY_SPACE).alias("stripped"))
    member = own.groupBy("norm", "stripped").agg(F.array_sort(F.collect_set("raw")).alias("raws"), F.array_sort(F.collect_set("hash")).alias("fingerprints"))
    entry = F.struct("stripped", "raws", "fingerprints")
    return member.groupBy("norm").agg(F.array_sort(F.collect_list(entry)).alias("members")).withColumn("tid", identity.entity_id(F.concat(F.lit("P:"), "norm")))


def collision_report(groups: DataFrame) -> dict:
    """The groups as a report that can locate each of them; one that could not is refused."""
    found = [{"identityNormalized": r.norm, "trialId": r.tid, "members": [{"strippedRaw": m.stripped, "raws": m.raws, "fingerprints": m.fingerprints} for m in r.members]} for r in groups.orderBy("norm").collect()]
    if not found:
        raise ValueError("a collision report needs a group")
    for g in found:
        spelled = [m["strippedRaw"] for m in g["members"]]
        if len(spelled) < 2 or len(set(spelled)) != len(spelled) or not all(m["raws"] and m["fingerprints"] for m in g["members"]):
            raise ValueError(f"group of {g['identityNormalized']!r} is not a collision")
    return {"groups": found, "groupCount": len(found)}


def near_duplicate_rows(trials: DataFrame) -> DataFrame:
    """loose key, representative, entity, identity key and raw spellings: a row a member, whatever the size of its group."""
    rows = trials.where("near_group is not null").select(F.col("near_group").alias("loose"), "tid", F.col("key"), "protocol_raw")
    first = rows.groupBy("loose").agg(F.min("tid").alias("representative"), F.count(F.lit(1)).alias("members"))
    return rows.join(first, "loose").select("loose", "representative", "members", "tid", F.regexp_replace("key", "^P:", "").alias("identity"), "protocol_raw")


def quality_report(tables: dict[str, DataFrame], spec: SnapshotSpec, verdict: str, target: str | None = None, **source) -> dict:
    """The whole report; with ``target``, lists of entities are written there as JSON lines."""
    records, trials = tables["records"], tables["trials"]
    parts = quality.quality_report(records, trials, list(spec.text), list(spec.presentation), near_duplicate_rows(trials))
    out: dict = {"rowCount": records.count(), "trialCount": trials.count(), "verdict": verdict, **source, "warnings": []}
    if verdict in ("warn", "bootstrap"):
        out["warnings"].append({"code": "ROWCOUNT_DROP_WARNING" if verdict == "warn" else "BOOTSTRAP"})
    for name, df in parts.items():
        if name in LISTS:
            out[name] = {"count": df.count()}
            if target:
                export_json(df, f"{target}/{name}")
                out[name]["path"] = f"{target}/{name}"
        else:
            rows = [r.asDict(True) for r in df.collect()]
            out[name] = sorted(rows, key=lambda r: (-r["count"], str(r)) if name == "conflicts" and "count" in r else (0, str(r)))
    return out


def require_total(sizes: dict[str, int], limit: int) -> dict:
    """Files read at the start, their sum and whether it is within the limit; beyond it nothing may be published."""
    total = sum(sizes.values())
    if total > limit:
        raise SnapshotError("INTEGRITY_DIGEST", "files read at the start are too large", total=total, limit=limit, files=sizes)
    return {"total": total, "limit": limit, "share": total / limit}

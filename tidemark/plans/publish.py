"""Publishing: tables under a version drawn from their content, a pointer added last, and nothing on failure.

A publication writes under a name of its own, which a journal entry with a
lease makes known, moves the tables to their version's name once they are
verified, and adds a numbered pointer that nobody can overwrite.  Whatever a
killed publication leaves behind is not in the way of the next one, and
recover() removes it when its lease is over.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import SnapshotError

SCHEMA_VERSION = 3
#: Names of pointer files; the highest number that can be read is the published version.
POINTER = re.compile(r"manifest-(\d{10})\.json")
#: Seconds after which a publication that has not ended counts as killed.
LEASE = 6 * 3600


def canonical_json(obj) -> bytes:
    """Sorted keys, no spaces, UTF-8 unescaped, nulls kept."""
    return json.dumps(obj, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def _sums(columns: list[str]) -> list[Column]:
    """Aggregates that stand for the multiset of rows: their number, and sums of four parts of their hashes."""
    text = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    h = F.sha2(text.cast("binary"), 256)
    part = lambda a: F.conv(F.substring(h, a, 15), 16, 10).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(part(a)), F.lit(0)).cast("decimal(38,0)").cast("string").alias(f"s{a}") for a in (1, 16, 31, 46))]


def _digest_of(sums: dict) -> tuple[str, int]:
    text = ",".join(str(sums[k]) for k in ("rows", "s1", "s16", "s31", "s46"))
    return hashlib.sha256(text.encode()).hexdigest(), sums["rows"]


def table_digest(df: DataFrame) -> DataFrame:
    """One row: a digest of the set of rows, whatever their order or partitions, and their number.

    Rows are hashed as JSON with nulls kept; the sums of two halves of the
    hashes stand for the multiset, so nothing is sorted or gathered.
    """
    sums = df.agg(*_sums(df.columns))
    return sums.select(F.sha2(F.concat_ws(",", F.col("rows").cast("string"), "s1", "s16", "s31", "s46").cast("binary"), 256).alias("digest"), "rows")


def dataset_version(tables: dict[str, DataFrame]) -> tuple[str, dict[str, tuple[str, int]]]:
    """(16 hex, digest and rows by table); no table holds the version, so there is no circle."""
    found = {name: tuple(table_digest(df).first()) for name, df in sorted(tables.items())}
    return version_of(found), found


def version_of(digests: dict[str, tuple[str, int]]) -> str:
    lines = "\n".join(f"{name}:{digest}" for name, (digest, _) in sorted(digests.items()))
    return hashlib.sha256(lines.encode()).hexdigest()[:16]


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _read(spark: SparkSession, path: str) -> str | None:
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, text: str) -> None:
    fs, where = _fs(spark, path)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _pointers(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, path) of the pointer files, newest first; each publication adds one and none is changed or removed."""
    fs, where = _fs(spark, root)
    if not fs.exists(where):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(where)]
    found = [(int(m[1]), f"{root}/{n}") for n in names if (m := POINTER.fullmatch(n))]
    return sorted(found, reverse=True)


def read_manifest(spark: SparkSession, root: str) -> dict | None:
    """The manifest published last; none, or only such as cannot be read, is no baseline."""
    for _, path in _pointers(spark, root):
        try:
            found = json.loads(_read(spark, path) or "null")
        except ValueError:
            continue
        if isinstance(found, dict) and found.get("datasetVersion"):
            return found
    return None


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that must not exist yet; False if it does.

    On a local disk the system call creates it exclusively; HDFS does so by
    itself.  A store without exclusive creation needs a committer of its own.
    """
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where.getParent())
    try:
        if fs.getUri().getScheme() == "file":
            option = jvm.java.nio.file.StandardOpenOption
            flags = spark.sparkContext._gateway.new_array(jvm.java.nio.file.OpenOption, 2)
            flags[0], flags[1] = option.CREATE_NEW, option.WRITE
            jvm.java.nio.file.Files.write(jvm.java.nio.file.Paths.get(where.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)), bytearray(text.encode()), flags)
            return True
        stream = fs.create(where, False)
    except Exception as e:
        if fs.exists(where):
            return False
        raise e
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def _promote(spark: SparkSession, root: str, manifest: dict, number: int) -> None:
    """Create the next pointer; a number that is taken means that another publication was first."""
    target = f"{root}/manifest-{number:010d}.json"
    if not _create(spark, target, canonical_json(manifest).decode()):
        raise SnapshotError("BASELINE_MOVED", found=target)


def _remove(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []


def _journal(spark: SparkSession, root: str) -> dict[str, dict]:
    """Entries by publication; one that cannot be read was cut short and counts as over."""
    out: dict[str, dict] = {}
    for name in _names(spark, f"{root}/.journal"):
        entry = out.setdefault(name.split(".")[0], {"until": 0})
        try:
            entry |= json.loads(_read(spark, f"{root}/.journal/{name}") or "{}")
        except ValueError:
            continue
    return out


def _forget(spark: SparkSession, root: str, own: str) -> None:
    _remove(spark, f"{root}/.staging-{own}")
    for name in _names(spark, f"{root}/.journal"):
        if name.split(".")[0] == own:
            _remove(spark, f"{root}/.journal/{name}")


def _named(spark: SparkSession, root: str) -> set[str]:
    """Versions that any pointer names."""
    out = set()
    for _, path in _pointers(spark, root):
        try:
            out.add((json.loads(_read(spark, path) or "null") or {}).get("datasetVersion"))
        except (ValueError, AttributeError):
            continue
    return out


def recover(spark: SparkSession, root: str, now: float | None = None) -> list[str]:
    """Remove what killed publications left: staged tables whose lease is over, and versions that nothing names -> their names."""
    now, gone = time.time() if now is None else now, []
    entries = _journal(spark, root)
    for own, entry in entries.items():
        if entry["until"] < now:
            gone.append(f".staging-{own}")
            _forget(spark, root, own)
    live = [e for e in entries.values() if e["until"] >= now]
    keep = _named(spark, root) | {e.get("version") for e in live}
    for name in _names(spark, root):
        version, own = name.removeprefix("version="), name.removeprefix(".staging-")
        if (name != version and version not in keep) or (name != own and own not in entries):
            gone.append(name)
            _remove(spark, f"{root}/{name}")
    return gone


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the published version; another schema version is refused."""
    manifest = read_manifest(spark, root)
    if manifest is None or manifest.get("schemaVersion") != SCHEMA_VERSION:
        raise SnapshotError("INTEGRITY_DIGEST", "no readable published version")
    return spark.read.parquet(f"{root}/version={manifest['datasetVersion']}/{name}")


def publish(
    spark: SparkSession, root: str, tables: dict[str, DataFrame], *, partitions: dict[str, str] | None = None, check=None, expect: str | None = "", facts: dict | None = None, lease: float = LEASE
) -> tuple[str, bool]:
    """Write, check, then add the pointer -> (version, whether anything changed).

    Each table is computed once: its digest is taken while it is written, and
    again from what was written.  Pointers are numbered and a number is taken
    once, so of two publications that start from one version the later is
    BASELINE_MOVED; no step removes or changes what was published before.

    expect: the version this build started from ("" for any); another one published meanwhile is BASELINE_MOVED.
    check(read) raises if the written tables, read back by name, break a rule.
    lease: seconds that this publication may take before recover() counts it as killed.
    """
    digests: dict[str, tuple[str, int]] = {}

    def write(path: str) -> tuple[str, dict]:
        digests.update({name: _stage(spark, f"{path}/{name}", df, (partitions or {}).get(name)) for name, df in tables.items()})
        return version_of(digests), {"files": {n: {"digest": d, "rows": r} for n, (d, r) in digests.items()}, **(facts or {})}

    return publish_files(spark, root, write, lambda path, _: _whole(spark, path, digests), check=check, expect=expect, lease=lease)


def publish_files(spark: SparkSession, root: str, write, whole, *, check=None, expect: str | None = "", lease: float = LEASE) -> tuple[str, bool]:
    """The steps of a publication of any files.

    write(path) puts them there and gives (version, what the manifest says of
    them); whole(path, manifest) says whether a folder left by another
    publication holds just that.
    """
    recover(spark, root)
    number = max((n for n, _ in _pointers(spark, root)), default=0) + 1
    before = read_manifest(spark, root)
    current = before["datasetVersion"] if before else None
    if expect != "" and current != expect:
        raise SnapshotError("BASELINE_MOVED", expected=expect, found=current)
    own, moved = uuid.uuid4().hex, None
    until = time.time() + lease
    staging = f"{root}/.staging-{own}"
    try:
        _create(spark, f"{root}/.journal/{own}.json", json.dumps({"until": until}))
        version, facts = write(staging)
        if current == version:
            return version, False
        if check:
            check(lambda name: spark.read.parquet(f"{staging}/{name}"))
        _create(spark, f"{root}/.journal/{own}.move.json", json.dumps({"until": until, "version": version}))
        manifest = {"schemaVersion": SCHEMA_VERSION, "datasetVersion": version, **facts}
        if _move(spark, root, own, version, lambda path: whole(path, manifest)):
            moved = version
        now = read_manifest(spark, root)
        if (now["datasetVersion"] if now else None) != current:
            raise SnapshotError("BASELINE_MOVED", expected=current)
        _promote(spark, root, manifest, number)
        moved = None
        return version, True
    except Exception as e:
        raise e if isinstance(e, SnapshotError) else SnapshotError("PROMOTION_FAILED", str(e)[:500]) from e
    finally:  # also on KeyboardInterrupt and SystemExit
        if moved and moved not in _named(spark, root):
            _remove(spark, f"{root}/version={moved}")
        _forget(spark, root, own)


def _stage(spark: SparkSession, path: str, df: DataFrame, partition: str | None) -> tuple[str, int]:
    """Write one table; the digest of its rows as they were computed must be that of the rows read back."""
    seen = Observation()
    writer = df.observe(seen, *_sums(df.columns)).write.mode("errorifexists")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    want = _digest_of(seen.get)
    if tuple(table_digest(spark.read.parquet(path).select(*df.columns)).first()) != want:
        raise SnapshotError("INTEGRITY_DIGEST", table=path.rsplit("/", 1)[-1])
    return want


def _move(spark: SparkSession, root: str, own: str, version: str, whole) -> bool:
    """Give staged tables their version's name -> whether they were moved.

    A folder of that name that a pointer names was published before; one that
    none names was left by a killed publication, or another one is about to
    publish the same content: it is adopted if it is whole and goes otherwise.
    """
    target = f"{root}/version={version}"
    fs, where = _fs(spark, target)
    if fs.exists(where):
        if version in _named(spark, root) or whole(target):
            return False
        fs.delete(where, True)
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/.staging-{own}"), where):
        raise SnapshotError("PROMOTION_FAILED", "the tables could not be moved")
    return True


def _whole(spark: SparkSession, target: str, digests: dict[str, tuple[str, int]]) -> bool:
    try:
        return all(tuple(table_digest(spark.read.parquet(f"{target}/{name}")).first()) == want for name, want in digests.items())
    except Exception:  # noqa: BLE001  a table that is missing or cannot be read
        return False


def export_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines with nulls kept and names in order."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def sparse_field(v) -> dict:
    """{raw, typed?, flags?} for export: typed goes if it is the raw text itself, empty flags go, a null typed stays."""
    t = v["typed"]
    kind = t["kind"]
    value = {None: None, "int": t["lo"], "range": {"min": t["lo"], "max": t["hi"]}, "date": str(t["dt"])}.get(kind, t["str"])
    out = {"raw": v["raw"]}
    if value != v["raw"]:
        out["typed"] = value
    if v["flags"]:
        out["flags"] = list(v["flags"])
    return out


def dense_field(v: dict) -> tuple:
    """(raw, typed, flags): only an absent typed is the raw text."""
    return v["raw"], v["typed"] if "typed" in v else v["raw"], v.get("flags", [])


def verify_published(spark: SparkSession, root: str) -> tuple[list[str], list[str]]:
    """(violated, unevaluable) of the stored version's own claims: its tables' digests and rows, and the version drawn from them."""
    manifest = read_manifest(spark, root)
    if manifest is None or manifest.get("schemaVersion") != SCHEMA_VERSION:
        return [], ["I7.artifactDigest", "I7.datasetVersion"]
    found = {}
    for name, facts in sorted(manifest["files"].items()):
        try:
            found[name] = tuple(table_digest(read_table(spark, root, name)).first())
        except Exception:  # noqa: BLE001  a table that cannot be read leaves the rules without a ground
            return [], ["I7.artifactDigest", "I7.datasetVersion"]
    violated = []
    if any(found[n] != (f["digest"], f["rows"]) for n, f in manifest["files"].items()):
        violated.append("I7.artifactDigest")
    if version_of(found) != manifest["datasetVersion"]:
        violated.append("I7.datasetVersion")
    return violated, []


def local_path(path: str) -> str:
    return "file://" + os.path.abspath(path)

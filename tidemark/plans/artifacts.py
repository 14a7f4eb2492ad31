"""JSON artifacts of a build: written by executors, named by their content, with sizes and digests that can be checked.

A file is a head, entries in order and a foot, each a line, so that no task and
no driver holds a whole file.  Entries are rows (artifact, part, key, json) that
Spark sorts and writes; Spark's commit protocol keeps what failed tasks wrote
out of sight.  The driver only gives committed files their names, a few hundred.
The version is drawn from the entries, which do not hold it.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from ..staging import Staging
from . import publish as pub
from .spec import SnapshotSpec

ENTRY = "artifact string, part int, key string, json string"
#: Names of the search artifacts by fields and history.
SEARCH_FILES = {"search-short-all": ("short", False), "search-long-latest": ("long", True), "search-long-all": ("long", False)}
TOP_LEVEL = ("trials-index", "stats", *SEARCH_FILES)
SHARDS = "records"


def text(c: Column) -> Column:
    """A JSON string; null stays the word null."""
    inside = F.to_json(F.array(c.cast("string")), {"ignoreNullFields": "false"})
    return F.when(c.isNull(), "null").otherwise(F.substring(inside, 2, F.length(inside) - 2))


def plain(c: Column) -> Column:
    """A JSON number or truth value."""
    return F.coalesce(c.cast("string"), F.lit("null"))


def array(c: Column) -> Column:
    """A JSON array of an array of JSON values."""
    return F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))


def texts(c: Column) -> Column:
    return array(F.transform(c, text))


def obj(pairs: dict[str, Column]) -> Column:
    """A JSON object, names in order; a null value leaves its name out."""
    named = [F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), v) for k, v in sorted(pairs.items())]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*named)), ","), F.lit("}"))


def typed(t: Column) -> Column:
    day = F.date_format(t["dt"], "yyyy-MM-dd")
    both = F.concat(F.lit('{"max":'), plain(t["hi"]), F.lit(',"min":'), plain(t["lo"]), F.lit("}"))
    return F.when(t["kind"].isNull(), "null").when(t["kind"] == "int", plain(t["lo"])).when(t["kind"] == "range", both).when(t["kind"] == "date", text(day)).otherwise(text(t["str"]))


def sparse(v: Column) -> Column:
    """{raw, typed, flags}: typed is left out if it is the raw text itself, flags if there are none; a null typed stays."""
    flags = F.when(F.size(v["flags"]) > 0, texts(v["flags"]))
    return obj({"raw": text(v["raw"]), "typed": F.when(typed(v["typed"]) != text(v["raw"]), typed(v["typed"])), "flags": flags})


def _day(c: Column) -> Column:
    return text(F.date_format(c, "yyyy-MM-dd"))


def _values(c: Column, names: tuple[str, ...]) -> Column:
    return array(F.array(*(text(c[n]) for n in names)))


def trial_entries(trials: DataFrame, found: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """The index: one entry a trial, with its card fields and the folded short texts of its latest records."""
    latest = found.where("in_cohort").select("t", "r", obj({"r": text(F.col("r")), "f": _values(F.col("short"), spec.short_search)}).alias("json"))
    latest = latest.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "json"))), lambda x: x.json).alias("entries"))
    rows = trials.join(latest, trials.tid == latest.t, "left")
    c, shown = F.col, {k: F.col("display_fields")[k] for k in spec.card}
    keys = F.map_entries("facet_keys")
    facet = F.when(F.size(keys) > 0, F.concat(F.lit("{"), F.array_join(F.array_sort(F.transform(keys, lambda e: F.concat(text(e.key), F.lit(":"), text(e.value)))), ","), F.lit("}")))
    entry = obj({
        "id": text(c("tid")), "protocolRaw": texts(c("protocol_raw")), "protocolNonIdentifier": plain(c("protocol_non_identifier")), "suspectedTestRow": plain(c("suspected_test_row")),
        "nearDuplicateGroup": text(c("near_group")), "latestSourceDate": _day(c("latest_date")), "dateUnknown": plain(c("date_unknown")), "latestCohortCount": plain(c("cohort_count")),
        "recordCount": plain(c("record_count")), "latestAmbiguous": plain(c("latest_ambiguous")), "conflictFields": texts(c("conflict_fields")),
        "displayFields": obj({k: F.when(v.isNotNull(), sparse(v)) for k, v in shown.items()}), "searchShortLatest": array(F.coalesce("entries", F.array().cast("array<string>"))),
        "shard": text(c("shard")), "facetKeys": facet,
    })
    return rows.select(F.lit("trials-index").alias("artifact"), F.lit(1).alias("part"), F.col("tid").alias("key"), entry.alias("json"))


def search_entries(found: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """The three search files, each in order of its records."""
    parts = []
    for name, (fields, latest) in SEARCH_FILES.items():
        columns = spec.short_search if fields == "short" else spec.long_search
        entry = obj({"r": text(F.col("r")), "t": text(F.col("t")), "d": _day(F.col("d")), "f": _values(F.col(fields), columns)})
        rows = found.where("in_cohort") if latest else found
        parts.append(rows.select(F.lit(name).alias("artifact"), F.lit(1).alias("part"), F.col("r").alias("key"), entry.alias("json")))
    return reduce(DataFrame.unionByName, parts)


def _named(column: str):
    return lambda x: x.field == column


def shard_entries(trials: DataFrame, records: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """Shards: each record with raw and typed values and flags, each trial with its records; empty shards have no entries."""
    name = F.concat(F.lit(f"{SHARDS}-"), F.col("shard"))
    value = {c: F.element_at(F.filter("fields", _named(c)), 1)["value"] for c in spec.presentation}
    raw = obj({c: text(F.col("raw")[c]) for c in spec.columns})
    kept = {c: text(F.when(F.col("raw")[c] != "", F.col("raw")[c])) for c in (spec.identity, *spec.hidden)}
    flags = {c: F.when(F.size(v["flags"]) > 0, texts(v["flags"])) for c, v in value.items()}
    late = F.when(F.col("updated.flag").isNotNull() & (F.col("updated.flag") != ""), texts(F.array(F.col("updated.flag"))))
    entry = obj({"raw": raw, "typed": obj({c: typed(v["typed"]) for c, v in value.items()} | kept | {spec.updated: _day(F.col("updated.date"))}),
                 "fieldFlags": obj(flags | {spec.updated: late}), "recordFlags": texts(F.col("record_flags"))})
    one = records.select(name.alias("artifact"), F.lit(1).alias("part"), F.col("rid").alias("key"), F.concat(text(F.col("rid")), F.lit(":"), entry).alias("json"))
    own = obj({"latestCohort": texts(F.col("latest_cohort")), "recordIds": texts(F.col("record_ids"))})
    return one.unionByName(trials.select(name.alias("artifact"), F.lit(3).alias("part"), F.col("tid").alias("key"), F.concat(text(F.col("tid")), F.lit(":"), own).alias("json")))


def stats_entries(stats: DataFrame) -> DataFrame:
    """One entry a facet: buckets by value, unprovided, conflicted."""
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("count"))), F.lit(0))
    bucket = F.when(F.col("kind") == "bucket", F.struct("value", obj({"value": text(F.col("value")), "count": plain(F.col("count"))}).alias("json")))
    found = stats.groupBy("facet").agg(F.transform(F.array_sort(F.collect_list(bucket)), lambda x: x.json).alias("buckets"), of("unprovided").alias("u"), of("conflicted").alias("c"))
    entry = obj({"denominatorKind": F.lit('"trials"'), "buckets": array(F.col("buckets")), "unprovided": plain(F.col("u")), "conflicted": plain(F.col("c"))})
    return found.select(F.lit("stats").alias("artifact"), F.lit(1).alias("part"), F.col("facet").alias("key"), F.concat(text(F.col("facet")), F.lit(":"), entry).alias("json"))


def entries(tables: dict[str, DataFrame], spec: SnapshotSpec) -> DataFrame:
    """All entries of the tables that build() gives."""
    trials, found = tables["trials"], tables["search"]
    parts = [trial_entries(trials, found, spec), search_entries(found, spec), shard_entries(trials, tables["records"], spec), stats_entries(tables["stats"])]
    return reduce(DataFrame.unionByName, parts)


def frames(name: str, version: str, spec: SnapshotSpec, counts: dict[str, int]) -> dict[int, str]:
    """What stands around the entries of an artifact, by part."""
    head = '{"datasetVersion":"' + version + '",'
    if name in SEARCH_FILES:
        columns = spec.short_search if SEARCH_FILES[name][0] == "short" else spec.long_search
        return {0: head + '"fields":' + json.dumps(list(columns), ensure_ascii=False, separators=(",", ":")) + ',"records":[', 4: "]}"}
    if name == "stats":
        return {0: head + '"denominators":' + json.dumps(counts, separators=(",", ":"), sort_keys=True) + ',"facets":{', 4: "}}"}
    if name == "trials-index":
        return {0: head + '"trials":[', 4: "]}"}
    return {0: head + '"records":{', 2: '},"trials":{', 4: "}}"}


def path_of(name: str, digest: str) -> str:
    shard = name.removeprefix(f"{SHARDS}-")
    return f"{name}.{digest[:16]}.json" if shard == name else f"{SHARDS}/{shard}.{digest[:16]}.json"


def file_facts(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """path, bytes, gzipBytes, sha256 of stored files, line by line: no task holds a file, and what is read is named."""
    lines = spark.read.option("lineSep", "\n").text([f"{root}/{p}" for p in paths])
    meta = {n: F.col(f"_metadata.{c}") for n, c in (("file", "file_path"), ("block", "file_block_start"), ("size", "file_size"))}
    lines = lines.select(*(c.alias(n) for n, c in meta.items()), F.col("value").cast("binary").alias("value")).withColumn("at", F.monotonically_increasing_id())
    ordered = lines.repartition("file").sortWithinPartitions("file", "block", "at")
    facts = ordered.mapInArrow(_facts, "file string, bytes long, gzipBytes long, sha256 string")
    # A path below the root, whatever form the store gives it.
    depth = F.when(F.element_at(F.split("file", "/"), -2) == SHARDS, 2).otherwise(1)
    return facts.select(F.array_join(F.slice(F.split("file", "/"), -depth, depth), "/").alias("path"), "bytes", "gzipBytes", "sha256")


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, out = None, []

    def done():
        out.append((now, size, packed + len(gz.flush()), sha.hexdigest()))

    for batch in batches:
        for file, size_here, value in zip(batch.column("file").to_pylist(), batch.column("size").to_pylist(), batch.column("value").to_pylist(), strict=True):
            if file != now:
                if now is not None:
                    done()
                now, size, packed, sha, gz = file, size_here, 0, hashlib.sha256(), zlib.compressobj(9, zlib.DEFLATED, 31)
            line = value + b"\n"
            sha.update(line)
            packed += len(gz.compress(line))
    if now is not None:
        done()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["file", "bytes", "gzipBytes", "sha256"])


def artifact_digest(files: dict[str, dict]) -> str:
    """The root over all published files; a file that changed is told by its own digest."""
    return hashlib.sha256("\n".join(sorted(f"{f['path']}:{f['sha256']}" for f in files.values())).encode()).hexdigest()


def write_artifacts(spark: SparkSession, rows: DataFrame, spec: SnapshotSpec, counts: dict[str, int], target: str, run: Staging) -> tuple[str, dict[str, dict]]:
    """Entries -> files under target -> (version, facts by artifact)."""
    rows = run.table(rows, "entries")
    sums = rows.groupBy("artifact").agg(*pub._sums(["part", "key", "json"])).collect()  # a row a file
    digests = {r.artifact: pub._digest_of(r.asDict()) for r in sums} | {n: ("0" * 64, 0) for n in TOP_LEVEL if n not in {r.artifact for r in sums}}
    version = pub.version_of(digests)
    around = [(name, part, "", line) for name in digests for part, line in frames(name, version, spec, counts).items()]
    first = rows.groupBy(F.col("artifact").alias("a"), F.col("part").alias("p")).agg(F.min("key").alias("first"))  # two rows a file at most
    led = rows.join(F.broadcast(first), (F.col("artifact") == F.col("a")) & (F.col("part") == F.col("p")))
    lines = led.select("artifact", "part", "key", F.when(F.col("key") == F.col("first"), F.col("json")).otherwise(F.concat(F.lit(","), "json")).alias("value"))
    lines = lines.unionByName(spark.createDataFrame(around, "artifact string, part int, key string, value string"))
    written = run.path("files")
    lines.repartition("artifact").sortWithinPartitions("artifact", "part", "key").select("artifact", "value").write.partitionBy("artifact").text(written)
    paths = {name: path_of(name, digest) for name, (digest, _) in digests.items()}
    fs, _ = pub._fs(spark, target)
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    for name, path in paths.items():
        found = [f.getPath() for f in fs.listStatus(jvm(f"{written}/artifact={name}"))]
        if len(found) != 1:
            raise pub.SnapshotError("PROMOTION_FAILED", f"{name} has {len(found)} files")
        fs.mkdirs(jvm(f"{target}/{path}").getParent())
        if not fs.rename(found[0], jvm(f"{target}/{path}")):
            raise pub.SnapshotError("PROMOTION_FAILED", f"{name} could not be named")
    facts = {r.path: r for r in file_facts(spark, target, list(paths.values())).collect()}
    return version, {name: {"path": p, "bytes": facts[p].bytes, "gzipBytes": facts[p].gzipBytes, "sha256": facts[p].sha256} for name, p in paths.items()}


def publish_artifacts(spark: SparkSession, root: str, tables: dict[str, DataFrame], spec: SnapshotSpec, *, expect: str | None = "", facts: dict | None = None, lease: float = pub.LEASE) -> tuple[str, bool]:
    """Publish the JSON artifacts of a build, whole or not at all -> (version, whether anything changed)."""
    run = Staging(spark)
    try:
        counts = {"trials": tables["trials"].count(), "records": tables["records"].count()}

        def write(path: str) -> tuple[str, dict]:
            version, files = write_artifacts(spark, entries(tables, spec), spec, counts, path, run)
            return version, {"files": files, "artifactDigest": artifact_digest(files), "counts": counts, **(facts or {})}

        def whole(path: str, manifest: dict) -> bool:
            return not changed_files(spark, path, manifest["files"])

        return pub.publish_files(spark, root, write, whole, expect=expect, lease=lease)
    finally:
        run.close()


def changed_files(spark: SparkSession, where: str, files: dict[str, dict], only: list[str] | None = None) -> list[str]:
    """Artifacts (all, or those named) whose stored file is missing or not what it was when published."""
    asked = {n: f for n, f in files.items() if only is None or n in only}
    fs, _ = pub._fs(spark, where)
    there = {n: f for n, f in asked.items() if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{where}/{f['path']}"))}
    found = {r.path: r for r in file_facts(spark, where, [f["path"] for f in there.values()]).collect()} if there else {}
    same = {n for n, f in there.items() if (r := found.get(f["path"])) and (r.sha256, r.bytes) == (f["sha256"], f["bytes"])}
    return sorted(set(asked) - same)


def verify_artifacts(spark: SparkSession, root: str) -> tuple[list[str], list[str], list[str]]:
    """(violated, unevaluable, changed files) of the published artifacts' own claims; sizes do not rest on the digests.

    brotli sizes are not computed, so their rule has no ground; shards must not claim any.
    """
    manifest = pub.read_manifest(spark, root)
    rules = ["I7.artifactDigest", "I8.bytes", "I8.gzipBytes"]
    if manifest is None or manifest.get("schemaVersion") != pub.SCHEMA_VERSION or "artifactDigest" not in manifest:
        return [], [*rules, "I8.brotliBytes"], []
    files, where = manifest["files"], f"{root}/version={manifest['datasetVersion']}"
    fs, _ = pub._fs(spark, where)
    there = {n: f for n, f in files.items() if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{where}/{f['path']}"))}
    found = {r.path: r for r in file_facts(spark, where, [f["path"] for f in there.values()]).collect()} if there else {}
    violated, unevaluable = set(), {"I8.brotliBytes"}
    changed = set(files) - set(there)
    if changed:
        unevaluable |= {"I8.bytes", "I8.gzipBytes"}
        violated.add("I7.artifactDigest")
    for name, f in there.items():
        r = found.get(f["path"])
        for key in ("bytes", "gzipBytes"):
            if r is None or r[key] != f.get(key):
                violated.add(f"I8.{key}")
        if r is None or r.sha256 != f["sha256"]:
            violated.add("I7.artifactDigest")
            changed.add(name)
        if name.startswith(f"{SHARDS}-") and "brotliBytes" in f:
            violated.add("I8.shardNoBrotli")
    if artifact_digest(files) != manifest["artifactDigest"]:
        violated.add("I7.artifactDigest")
    return sorted(violated), sorted(unevaluable), sorted(changed)


def read_artifact(spark: SparkSession, root: str, name: str) -> DataFrame:
    """key and json of one published artifact's entries, in parallel; another schema version is refused."""
    manifest = pub.read_manifest(spark, root)
    if manifest is None or manifest.get("schemaVersion") != pub.SCHEMA_VERSION:
        raise pub.SnapshotError("INTEGRITY_DIGEST", "no readable published version")
    lines = spark.read.option("lineSep", "\n").text(f"{root}/version={manifest['datasetVersion']}/{manifest['files'][name]['path']}")
    line = F.regexp_replace("value", "^,", "")
    keyed = r'^"((?:[^"\\]|\\.)*)":(\{.*)$'
    is_entry = ~F.col("value").startswith('{"datasetVersion":') & ~F.col("value").isin("]}", "}}", '},"trials":{')
    named = line.rlike(keyed)
    return lines.where(is_entry).select(F.when(named, F.regexp_extract(line, keyed, 1)).alias("key"), F.when(named, F.regexp_extract(line, keyed, 2)).otherwise(line).alias("json"))


def densify(index: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """Entries of the index -> id, field, raw, typed, flags: only an absent typed is the raw text, a null one stays null; typed is JSON."""
    shown = F.from_json(F.get_json_object("json", "$.displayFields"), "map<string,variant>")
    each = index.select(F.get_json_object("json", "$.id").alias("id"), F.explode(shown).alias("field", "v"))
    v = F.to_json(F.col("v"))
    keys = F.json_object_keys(v)
    typed_ = F.when(F.array_contains(keys, "typed"), F.to_json(F.try_variant_get("v", "$.typed", "variant"))).otherwise(text(F.get_json_object(v, "$.raw")))
    flags = F.coalesce(F.from_json(F.get_json_object(v, "$.flags"), "array<string>"), F.array().cast("array<string>"))
    return each.where(F.col("field").isin(*spec.card)).select("id", "field", F.get_json_object(v, "$.raw").alias("raw"), F.when(typed_ != "null", typed_).alias("typed"), flags.alias("flags"))


def scope_cost(manifest: dict, scope: tuple[str, str]) -> int | None:
    """Bytes to load for a search scope, by the manifest's gzip sizes."""
    return search.estimated_bytes({n.removeprefix("search-").replace("-", "_"): f.get("gzipBytes") for n, f in manifest["files"].items()}, list(search.SCOPES[scope]))

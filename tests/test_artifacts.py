"""JSON artifacts: content, names, sizes, digests and what breaks them."""

import gzip
import hashlib
import json

import pytest
from test_engine import BUILD, ROWS, TRIALS

from tidemark.errors import SnapshotError
from tidemark.plans import artifacts as art
from tidemark.plans import publish as pub
from tidemark.plans.build import build


@pytest.fixture(scope="module")
def tables(spark):
    return build(spark.createDataFrame(ROWS, TRIALS.schema), TRIALS, BUILD)


@pytest.fixture(scope="module")
def site(spark, tables, tmp_path_factory):
    where = tmp_path_factory.mktemp("site")
    root = pub.local_path(str(where))
    version, changed = art.publish_artifacts(spark, root, tables, TRIALS)
    assert changed and art.publish_artifacts(spark, root, tables, TRIALS) == (version, False)
    return where, root, version


def load(where, root, spark):
    manifest = pub.read_manifest(spark, root)
    base = where / f"version={manifest['datasetVersion']}"
    return manifest, {n: (base / f["path"]).read_bytes() for n, f in manifest["files"].items()}


def test_files_are_whole_json_with_true_sizes(spark, tables, site):
    where, root, version = site
    manifest, raw = load(where, root, spark)
    trials = {r.tid: r for r in tables["trials"].collect()}
    records = tables["records"].collect()
    assert set(raw) == {*art.TOP_LEVEL, *(f"records-{r.shard}" for r in trials.values())}
    for name, data in raw.items():
        f = manifest["files"][name]
        assert f["bytes"] == len(data) and f["gzipBytes"] == len(gzip.compress(data, mtime=0)) and f["sha256"] == hashlib.sha256(data).hexdigest()
        assert json.loads(data)["datasetVersion"] == version
    index = json.loads(raw["trials-index"])["trials"]
    assert [x["id"] for x in index] == sorted(trials)
    for x in index:
        t = trials[x["id"]]
        assert x["protocolRaw"] == t.protocol_raw and x["recordCount"] == t.record_count and x["conflictFields"] == t.conflict_fields and x["shard"] == t.shard
        assert x["displayFields"] == {k: pub.sparse_field(v.asDict(True)) for k, v in t.display_fields.items() if k in TRIALS.card}
        assert [e["r"] for e in x["searchShortLatest"]] == t.latest_cohort and x.get("facetKeys", {}) == (t.facet_keys or {})
    everything = json.loads(raw["search-short-all"])
    assert everything["fields"] == list(TRIALS.short_search) and [e["r"] for e in everything["records"]] == sorted(r.rid for r in records)
    assert len(json.loads(raw["search-long-latest"])["records"]) == sum(t.cohort_count for t in trials.values())
    stats = json.loads(raw["stats"])
    assert stats["denominators"] == {"records": len(ROWS), "trials": len(trials)}
    assert all(sum(b["count"] for b in f["buckets"]) + f["unprovided"] + f["conflicted"] == len(trials) for f in stats["facets"].values())
    shards = [json.loads(raw[n]) for n in raw if n.startswith("records-")]
    held = {k: v for s in shards for k, v in s["records"].items()}
    assert set(held) == {r.rid for r in records} and {k for s in shards for k in s["trials"]} == set(trials)
    for r in records:
        own = held[r.rid]
        assert own["raw"] == r.raw and own["recordFlags"] == r.record_flags
        assert own["typed"][TRIALS.updated] == (str(r.updated.date) if r.updated.date else None)
        assert own["fieldFlags"].get(TRIALS.updated, []) == ([r.updated.flag] if r.updated.flag else [])
        for x in r.fields:
            want = pub.dense_field(pub.sparse_field(x.value.asDict(True)))
            assert own["typed"][x.field] == want[1] and own["fieldFlags"].get(x.field, []) == want[2]


def test_reading_back(spark, tables, site):
    _, root, _ = site
    dense = {(r.id, r.field): (r.raw, r.typed, r.flags) for r in art.densify(art.read_artifact(spark, root, "trials-index"), TRIALS).collect()}
    for t in tables["trials"].collect():
        for k, v in t.display_fields.items():
            if k in TRIALS.card:
                raw, value, flags = pub.dense_field(pub.sparse_field(v.asDict(True)))
                got = dense[t.tid, k]
                assert (got[0], json.loads(got[1]) if got[1] is not None else None, got[2]) == (raw, value, flags)
    assert art.read_artifact(spark, root, f"records-{tables['trials'].first().shard}").where("key like 't%r%'").count() > 0
    manifest = pub.read_manifest(spark, root)
    assert art.scope_cost(manifest, ("short", "all")) == manifest["files"]["search-short-all"]["gzipBytes"]


def test_each_mutation_breaks_its_rule(spark, site, tmp_path):
    import shutil

    where, _, version = site
    shutil.copytree(where, tmp_path / "x")
    root = pub.local_path(str(tmp_path / "x"))
    assert art.verify_artifacts(spark, root) == ([], ["I8.brotliBytes"], [])
    pointer = tmp_path / "x" / "manifest-0000000001.json"
    plain = json.loads(pointer.read_text())
    shard = next(n for n in plain["files"] if n.startswith("records-"))

    def claimed(name, key, value):
        other = json.loads(json.dumps(plain))
        other["files"][name][key] = value
        pointer.write_text(json.dumps(other))
        (tmp_path / "x" / ".manifest-0000000001.json.crc").unlink(missing_ok=True)
        found = art.verify_artifacts(spark, root)
        pointer.write_text(json.dumps(plain))
        return found

    assert claimed("stats", "bytes", 1)[0] == ["I8.bytes"] and claimed(shard, "gzipBytes", 1)[0] == ["I8.gzipBytes"]
    assert claimed(shard, "brotliBytes", 1)[0] == ["I8.shardNoBrotli"] and claimed("stats", "sha256", "0")[0] == ["I7.artifactDigest"]
    file = tmp_path / "x" / f"version={version}" / plain["files"][shard]["path"]
    data = bytearray(file.read_bytes())
    data[-10] ^= 1
    file.write_bytes(bytes(data))
    file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    violated, _, changed = art.verify_artifacts(spark, root)
    assert "I7.artifactDigest" in violated and changed == [shard]  # one flipped byte names its shard
    base = f"{root}/version={version}"
    assert art.changed_files(spark, base, plain["files"], only=["stats"]) == [] and art.changed_files(spark, base, plain["files"], only=[shard]) == [shard]
    file.unlink()
    assert art.verify_artifacts(spark, root)[1] == ["I8.brotliBytes", "I8.bytes", "I8.gzipBytes"]


def test_a_failure_publishes_nothing(spark, tables, tmp_path, monkeypatch):
    root = pub.local_path(str(tmp_path))
    with monkeypatch.context() as m:
        m.setattr(art, "file_facts", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(SnapshotError):
            art.publish_artifacts(spark, root, tables, TRIALS)
    assert pub.read_manifest(spark, root) is None and [p.name for p in tmp_path.iterdir()] == [".journal"]
    assert art.publish_artifacts(spark, root, tables, TRIALS)[1]

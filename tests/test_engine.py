"""From a snapshot file to published tables and back."""

import csv
import datetime as dt
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.errors import CODES, LAYERS, SnapshotError, outermost
from tidemark.operators import converge, facets, filters, identity, integrity, quality, search
from tidemark.plans import publish as pub
from tidemark.plans.build import build, card, categories, detail
from tidemark.plans.spec import CONFLICTED, TRIALS, UNPROVIDED
from tidemark.plans.urlstate import QueryState, build_url, parse_url
from tidemark.sources import snapshot

BUILD = dt.date(2024, 6, 1)
BASE = dict.fromkeys(TRIALS.columns, "")
BASE |= {TRIALS.title: "Title", TRIALS.applicant: "Acme", "臨床試驗期別": "Phase Ⅰ", "本臨床試驗規模": "多國多中心", "全球預計受試者人數": "20", "台灣預計受試者人數": "5",
         TRIALS.period_start: "2024/01/01", TRIALS.period_end: "2025/01/01", "試驗目的": "Purpose", TRIALS.updated: "2024/05/01"}


def row(**kw):
    names = {"protocol": TRIALS.identity, "updated": TRIALS.updated, "applicant": TRIALS.applicant, "title": TRIALS.title, "phase": "臨床試驗期別", "scale": "本臨床試驗規模", "tw": "台灣預計受試者人數", "world": "全球預計受試者人數", "start": TRIALS.period_start, "end": TRIALS.period_end, "purpose": "試驗目的"}
    return tuple((BASE | {names[k]: v for k, v in kw.items()})[c] for c in TRIALS.columns)


ROWS = [
    row(protocol="ABC-1", updated="2024/05/01", tw="5"),
    row(protocol=" ABC-1", updated="2024/05/02", tw="6", applicant="Acme Inc"),
    row(protocol="ABC-1", updated="2024/05/02", tw="06", applicant="Acme  Inc"),
    row(protocol="ABC-1", updated="2024/05/02", tw="6", applicant="Acme Inc"),
    row(protocol="ABC 1", updated="2024/04/01", purpose="hidden word"),
    row(protocol="N/O", updated="", phase="0", applicant=""),
    row(protocol="N/O", updated="2025/01/01", phase="bogus", end="2023/01/01"),
    row(protocol="", title="T", updated="x"),
    row(protocol="", title="T", updated="x"),
    row(protocol="--", title="test", updated="2024/05/01", world="20-40"),
]


def zipped(text, name="a.csv", more=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in (*more, (name, text)):
            z.writestr(n, t)
    return out.getvalue()


def as_csv(rows, header=TRIALS.columns):
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\r\n")
    w.writerow(header)
    w.writerows(rows)
    return "﻿" + out.getvalue()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    df = snapshot.read_snapshot(spark, zipped(as_csv(ROWS).encode()), TRIALS)
    out = build(df, TRIALS, BUILD)
    base = tmp_path_factory.mktemp("tables")
    for k, v in out.items():
        v.coalesce(1).write.parquet(str(base / k))
    return {k: spark.read.parquet(str(base / k)) for k in out}


def trial(tables, protocol):
    return next(r for r in tables["trials"].collect() if protocol in r.protocol_raw)


def test_convergence(tables):
    t = trial(tables, "ABC-1")
    assert t.protocol_raw == [" ABC-1", "ABC-1"] and t.record_count == 4 and t.cohort_count == 3 and t.latest_date == dt.date(2024, 5, 2)
    assert t.conflict_fields == [] and not t.latest_ambiguous
    assert t.display_fields["台灣預計受試者人數"].typed.lo == 6 and "rawVariants" in t.display_fields["台灣預計受試者人數"].flags
    assert t.near_group == "ABC1" and trial(tables, "ABC 1").near_group == "ABC1"
    n = trial(tables, "N/O")
    assert n.date_unknown and n.cohort_count == 2 and n.latest_ambiguous and set(n.conflict_fields) == {"臨床試驗期別", TRIALS.applicant, TRIALS.period_end}
    assert "臨床試驗期別" not in n.display_fields  # a conflict has no value
    anonymous = [r for r in tables["trials"].collect() if r.protocol_raw == [""]]
    assert len(anonymous) == 2 and all(r.protocol_non_identifier and r.key.startswith("H:") for r in anonymous)
    dash = trial(tables, "--")
    assert dash.protocol_non_identifier and dash.suspected_test_row and dash.near_group is None
    flags = {f for r in tables["records"].collect() for f in r.record_flags}
    assert flags == {"periodEndBeforeStart", "suspectedTestRow"}


def test_row_order_does_not_matter(spark, tables):
    want = pub.table_digest(tables["trials"]).first()
    rows = list(ROWS)
    for seed in range(1):
        random.Random(seed).shuffle(rows)
        again = build(spark.createDataFrame(rows, TRIALS.schema).repartition(3), TRIALS, BUILD)["trials"]
        assert pub.table_digest(again).first() == want


def test_facets_cards_and_detail(tables):
    counts = {(r.facet, r.kind, r.value): r["count"] for r in tables["stats"].collect()}
    assert counts["applicant", "bucket", "Acme Inc"] == 1  # two spaces fold to one
    assert counts["phase", "conflicted", None] == 1 and counts["scale", "bucket", "多國多中心"] == 6
    assert all(r.matches for r in facets.denominator_check(tables["stats"], tables["trials"]).collect())
    conflicts = [r for r in card(tables["trials"], TRIALS).collect() if r.conflict]
    assert conflicts and all(r.raw is None for r in conflicts) and {r.field for r in conflicts} <= set(TRIALS.card)
    t = trial(tables, "ABC-1")
    days = detail(tables["records"], TRIALS, t.tid).collect()
    assert [r.day for r in days] == [dt.date(2024, 5, 2), dt.date(2024, 5, 1)]
    assert set(days[0].differing) == {TRIALS.applicant, "台灣預計受試者人數"}
    assert [r.rid for r in sorted(tables["records"].where(F.col("tid") == t.tid).collect(), key=lambda r: (-r.day.toordinal(), r.rid))] == t.record_ids


def test_identity_lookup_and_collisions(spark, tables):
    wanted = spark.createDataFrame([("abc-1 ",), ("zz-9",), ("--",), ("!!",)], "raw string")
    got = {r.raw: r.outcome for r in identity.lookup(wanted, tables["trials"]).collect()}
    assert got == {"abc-1 ": "match", "zz-9": "notFound", "--": "rejected", "!!": "rejected"}
    for pair in (("abc-1", "ABC-1"), ("ABC-1", "ＡＢＣ-1")):
        with pytest.raises(SnapshotError) as e:
            build(spark.createDataFrame([row(protocol=p) for p in pair], TRIALS.schema), TRIALS, BUILD)
        assert e.value.code.value == "IDENTITY_COLLISION" and e.value.detail["groups"][0]["raws"] == sorted(pair)
    variants = identity.whitespace_variants(tables["records"], F.col("protocol"), F.col("norm")).collect()
    assert [v.raws for v in variants] == [[" ABC-1", "ABC-1"]]


def test_search(tables):
    entries = tables["search"]
    maps = lambda c, names: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(c)[n] for n in names)))
    short = entries.select("r", "t", "d", "in_cohort", maps("short", TRIALS.short_search).alias("f"))
    long = entries.select("r", "t", "d", "in_cohort", maps("long", TRIALS.long_search).alias("f"))
    files = {"short_all": short.drop("in_cohort"), "long_all": long.drop("in_cohort"), "long_latest": long.where("in_cohort").drop("in_cohort")}
    index = short.where("in_cohort").drop("in_cohort")
    find = lambda q, scope, cross=False: {r.entity for r in search.search_scope(files, index, search.parse_query(q), scope, cross).collect()}
    t1, other = trial(tables, "ABC-1").tid, trial(tables, "ABC 1").tid
    assert find("ABC-1 acme", ("short", "latest")) == {t1} and find("％", ("short", "latest")) == set()
    assert find("hidden", ("short", "all")) == set() and find("HIDDEN word", ("all", "all")) == {other}
    assert find("hidden abc", ("all", "all")) == set() and find("hidden abc", ("all", "all"), True) == {other}
    assert search.parse_query("  ") == [] and search.wider_scopes(("short", "latest")) == [("all", "latest"), ("short", "all")]
    hits = search.search_scope(files, index, ["acme"], ("all", "all"))
    search.require_known(hits, tables["trials"])
    with pytest.raises(SnapshotError):
        search.require_known(hits, tables["trials"].limit(0))
    assert search.estimated_bytes({"a": 1, "b": None}, ["a", "b"]) is None and search.format_size(2048) == "about 2 KiB"


def test_filters(tables):
    df = tables["trials"].select("tid", "latest_date", "conflict_fields", "display_fields", F.col("display_fields")["全球預計受試者人數"]["typed"].alias("n"))
    start, end = (F.col("display_fields")[c]["typed"]["dt"].cast("string") for c in TRIALS.period)
    conflict = F.array_contains("conflict_fields", TRIALS.period_start) | F.array_contains("conflict_fields", TRIALS.period_end)
    columns = categories(TRIALS) | {"enroll": facets.buckets_of(F.col("n.lo"), F.col("n.hi")), "period_category": filters.period_category(conflict, start, end), "period_start": start, "period_end": end, "updated": F.col("latest_date").cast("string")}

    def n(**kw):
        state = filters.FilterState()
        for k, v in kw.items():
            (state.ranges if k in filters.RANGES else state.choices)[k] = v
        return filters.apply_filters(df, state, columns).count()

    total = df.count()
    assert n() == total == 6
    assert n(enroll=["11-30"]) == n(enroll=["11-30", "0"]) == 6 and n(enroll=["31-100"]) == 1  # 20-40 is in both
    assert n(phase=[CONFLICTED]) == 1 and n(phase=["Phase Ⅰ"], enroll=["31-100"]) == 1
    assert n(period="2025-01-01..2025-12-31") == 5 and n(period=CONFLICTED) == 1 and n(period="2025-02-01..2025-01-01") == 0
    assert n(updated=UNPROVIDED) == 3 and n(updated="2024-05-02..2024-05-02") == 1


def test_quality(tables):
    parts = quality.quality_report(tables["records"], tables["trials"], list(TRIALS.text), list(TRIALS.presentation), identity.near_groups(tables["trials"].select("near_group", "tid"), F.col("near_group"), "tid"))
    got = {k: v.collect() for k, v in parts.items()}
    assert {(r.field, r.flag): r["count"] for r in got["flags"]}["全球預計受試者人數", "numericRange"] == 1
    assert {r.flag: r["count"] for r in got["date_warnings"]} == {"dateMissing": 1, "dateFuture": 1, "dateUnparsed": 2}
    assert {r.field: r.blank for r in got["nullness"]}[TRIALS.applicant] == 1
    assert got["cohorts"][0].date_unknown == 3 and len(got["near_duplicates"]) == 1 and len(got["test_rows"]) == 1
    assert {r.field for r in got["conflicts"]} == {"臨床試驗期別", TRIALS.applicant, TRIALS.period_end}


@pytest.mark.parametrize("cur,prev,want", [(18736, None, "bootstrap"), (16862, 18736, "warn"), (16863, 18736, "ok"), (14988, 18736, "ROWCOUNT_DROP"), (14989, 18736, "warn"), (80, 100, "warn"), (90, 100, "ok"), (0, 9, "ZERO_ROWS")])
def test_row_counts(cur, prev, want):
    if want.isupper():
        with pytest.raises(SnapshotError) as e:
            quality.check_row_count(cur, prev)
        assert e.value.code.value == want
    else:
        assert quality.check_row_count(cur, prev) == want


def rules(tables, version="v"):
    trials, records = tables["trials"].withColumn("version", F.lit("v")), tables["records"].withColumn("version", F.lit("v"))
    return trials, records, lambda t, r, s=None: integrity.evaluate(integrity.violations(t, r, s if s is not None else tables["stats"], facets.facet_counts(t, categories(TRIALS)), version))


def test_each_mutation_breaks_its_rule(tables):
    trials, records, check = rules(tables)
    assert check(trials, records) == ([], ["I5.trials"])
    one = trials.agg(F.min("tid")).first()[0]
    many = trial(tables, "ABC-1").tid
    on = lambda tid, c, v: trials.withColumn(c, F.when(F.col("tid") == tid, v).otherwise(F.col(c)))
    assert check(on(one, "version", F.lit("w")), records)[0] == ["I2"]
    assert check(trials, records.withColumn("shard", F.when(F.col("tid") == one, "zz").otherwise(F.col("shard"))))[0] == ["I3.shard"]
    assert check(on(many, "record_count", F.lit(9)), records)[0] == ["I4.records"]
    assert check(on(many, "cohort_count", F.lit(9)), records)[0] == ["I4.cohort"]
    assert check(on(many, "record_ids", F.reverse("record_ids")), records)[0] == ["I5.records"]
    assert check(on(many, "latest_cohort", F.reverse("latest_cohort")), records)[0] == ["I5.cohort"]
    assert check(on(one, "key", F.lit("P:other")), records)[0] == ["identity"]
    assert "I3.orphan" in check(trials, records.where(F.col("tid") != one))[0]
    assert "I3.owner" in check(on(many, "record_ids", F.concat("record_ids", F.slice("record_ids", 1, 1))), records)[0]
    assert "I3.subset" in check(on(many, "latest_cohort", F.array(F.lit("x"), F.lit("y"), F.lit("z"))), records)[0]
    assert check(trials, records, tables["stats"].withColumn("count", F.col("count") + 1))[0] == ["I6"]
    assert integrity.evaluate({"I1": None}) == ([], ["I1"])
    assert {(r.k, r.side) for r in integrity.missing_or_extra(trials.sparkSession.createDataFrame([("a",), ("b",)], "k string"), trials.sparkSession.createDataFrame([("b",), ("c",)], "k string"), "k").collect()} == {("a", "missing"), ("c", "extra")}


def test_publish(spark, tables, tmp_path):
    root = pub.local_path(str(tmp_path / "site"))
    own = {"trials": tables["trials"], "stats": tables["stats"]}
    version, changed = pub.publish(spark, root, own, partitions={"trials": "shard"}, expect=None)
    assert changed and len(version) == 16 and pub.read_table(spark, root, "trials").count() == 6
    assert pub.publish(spark, root, own) == (version, False)
    fewer = {"trials": tables["trials"].limit(2), "stats": tables["stats"]}
    with pytest.raises(SnapshotError) as e:
        pub.publish(spark, root, fewer, expect="another")
    assert e.value.code.value == "BASELINE_MOVED"

    def refuse(read):
        raise SnapshotError("INTEGRITY_DIGEST", violated=["I1"])

    with pytest.raises(SnapshotError):
        pub.publish(spark, root, fewer, check=refuse)
    assert pub.read_manifest(spark, root)["datasetVersion"] == version  # nothing moved
    assert [p.name for p in (tmp_path / "site").iterdir() if p.name.startswith("version")] == [f"version={version}"]
    assert pub.canonical_json({"b": None, "a": "é"}) == '{"a":"é","b":null}'.encode()


def test_sparse_fields_round_trip(tables):
    for r in tables["trials"].collect():
        for v in r.display_fields.values():
            sparse = pub.sparse_field(v)
            raw, typed, flags = pub.dense_field(sparse)
            assert raw == v.raw and flags == v.flags and (typed is None) == (v.typed.kind is None)


BAD = [
    (lambda t: snapshot.extract_csv(b"<html>"), "ZIP_CORRUPT"), (lambda t: snapshot.extract_csv(zipped(t)[:-40]), "ZIP_CORRUPT"), (lambda t: snapshot.extract_csv(zipped(t, "a.txt")), "ZIP_NO_CSV"),
    (lambda t: snapshot.decode(b"\xff\xfe"), "CSV_DECODE"), (lambda t: snapshot.parse_csv(as_csv([], TRIALS.columns[::-1]), TRIALS), "SCHEMA_MISMATCH"), (lambda t: snapshot.parse_csv(as_csv([("a",)])[1:], TRIALS), "ROW_WIDTH"),
    (lambda t: snapshot.parse_csv(as_csv([row(title="a\x1fb")])[1:], TRIALS), "SOURCE_CONTROL_CHAR"), (lambda t: snapshot.validate_response(snapshot.Response(500, "", None, b"")), "HTTP_STATUS"),
    (lambda t: snapshot.validate_response(snapshot.Response(200, "text/html", None, b"")), "UPSTREAM_ERROR_PAGE"), (lambda t: snapshot.validate_response(snapshot.Response(200, "Application/Zip; x", 9, b"1")), "HTTP_TRUNCATED"),
]


@pytest.mark.parametrize("act,code", BAD)
def test_failures(act, code):
    with pytest.raises(SnapshotError) as e:
        act("x")
    assert e.value.code.value == code


def test_sources(spark, tmp_path):
    raw = [row(protocol="P", title="line\r\nbreak \"q\", x"), row(protocol="Q")]
    body = as_csv(raw).encode()
    got = snapshot.read_snapshot(spark, zipped(body, "b.csv", [("c.csv", "zz"), ("a.txt", "t")]), TRIALS)
    assert sorted(map(tuple, got.collect())) == sorted(raw)
    (tmp_path / "x.csv").write_bytes(body[3:])
    assert sorted(map(tuple, snapshot.read_csv_files(spark, str(tmp_path / "x.csv"), TRIALS).collect())) == sorted(raw)
    (tmp_path / "zips").mkdir()
    for k in range(3):
        (tmp_path / "zips" / f"{k}.zip").write_bytes(zipped(body))
    assert snapshot.read_zip_files(spark, str(tmp_path / "zips"), TRIALS).groupBy("path").count().count() == 3
    with pytest.raises(SnapshotError):
        snapshot.read_snapshot(spark, zipped(as_csv([]).encode()), TRIALS)


def test_errors():
    assert len({SnapshotError(c).exit_code for c in CODES}) == 17 and SnapshotError("HTTP_STATUS").exit_code == 10
    assert outermost([SnapshotError("ZERO_ROWS"), SnapshotError("ZIP_CORRUPT"), SnapshotError("INTEGRITY_DIGEST")]).layer == "archive" and list(LAYERS)[0] == "transport"


def test_urls():
    url = "?q=a%20b&phase=x&phase=%E6%97%A5&period=2024-01-01..2024-02-01&fields=all&utm=1"
    state, errors = parse_url(url)
    assert not errors and build_url(state) == url and build_url(parse_url(build_url(state))[0]) == url
    bad, errors = parse_url("?updated=2024-02-01..2024-01-01&history=never&period=__conflicted__")
    assert errors == [("updated", "2024-02-01..2024-01-01"), ("history", "never"), ("period", "__conflicted__")] and bad.filters.active("updated") and bad.history == "latest"
    assert build_url(QueryState()) == "" and QueryState().browsing() and not state.browsing()


def test_stream_of_snapshots(spark, tmp_path):
    from tidemark.streaming.snapshots import follow

    (tmp_path / "in").mkdir()
    spark.createDataFrame(ROWS, TRIALS.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TRIALS.schema).parquet(str(tmp_path / "in"))
    root = pub.local_path(str(tmp_path / "out"))
    follow(stream, TRIALS, root, str(tmp_path / "check"), lambda n: BUILD).awaitTermination()
    assert pub.read_table(spark, root, "trials").count() == 6


def test_cohort_ties_and_future(spark):
    df = spark.createDataFrame([(1, "a", dt.date(2024, 1, 1)), (2, "a", dt.date(2024, 1, 2)), (3, "a", dt.date(2024, 1, 2)), (4, "b", None), (5, "b", None), (6, None, None)], "rid int, e string, day date")
    assert sorted(r.rid for r in converge.latest_cohort(df, "e", F.col("day")).where("in_cohort").collect()) == [2, 3, 4, 5, 6]


def test_stored_order_and_claims(spark, tmp_path):
    where = str(tmp_path / "t")
    spark.createDataFrame([("a",), ("c",), ("b",), ("d",)], "tid string").coalesce(1).write.parquet(where)
    assert sorted(r.tid for r in integrity.out_of_order_in_files(spark.read.parquet(where), "tid").collect()) == ["b", "c"]
    across = str(tmp_path / "u")
    for k, tid in enumerate("badc"):  # each file is in order, the table is not
        spark.createDataFrame([(tid,)], "tid string").coalesce(1).write.parquet(f"{across}/n={k}")
    assert sorted(r.tid for r in integrity.out_of_order_in_files(spark.read.parquet(across), "tid").collect()) == ["a", "b", "c", "d"]
    spark.createDataFrame([(f"{k:03d}",) for k in range(300)], "tid string").repartitionByRange(7, "tid").sortWithinPartitions("tid").write.parquet(str(tmp_path / "v"))
    assert integrity.out_of_order_in_files(spark.read.parquet(str(tmp_path / "v")), "tid").count() == 0
    root = pub.local_path(str(tmp_path / "site"))
    assert pub.verify_published(spark, root) == ([], ["I7.artifactDigest", "I7.datasetVersion"])
    version, _ = pub.publish(spark, root, {"t": spark.range(5)})
    assert pub.verify_published(spark, root) == ([], [])
    spark.range(6).write.mode("overwrite").parquet(f"{root}/version={version}/t")
    assert pub.verify_published(spark, root)[0] == ["I7.artifactDigest", "I7.datasetVersion"]


STEPS = ["_create", "_stage", "table_digest", "_move", "_promote", "read_manifest"]


@pytest.mark.parametrize("kind", [RuntimeError, KeyboardInterrupt])
@pytest.mark.parametrize("step", STEPS)
def test_a_failure_at_any_step_keeps_what_is_published(spark, tmp_path, monkeypatch, step, kind):
    root = pub.local_path(str(tmp_path / "site"))
    version, _ = pub.publish(spark, root, {"t": spark.range(3)})
    plain, calls = getattr(pub, step), []

    def crash(*a, **k):
        calls.append(a)
        if step == "read_manifest" and len(calls) == 1:
            return plain(*a, **k)
        raise kind("crash")

    with monkeypatch.context() as m:
        m.setattr(pub, step, crash)
        with pytest.raises(SnapshotError if kind is RuntimeError else kind) as e:
            pub.publish(spark, root, {"t": spark.range(4)})
    assert kind is not RuntimeError or e.value.code.value == "PROMOTION_FAILED"
    assert pub.read_manifest(spark, root)["datasetVersion"] == version and pub.read_table(spark, root, "t").count() == 3
    assert sorted(p.name for p in (tmp_path / "site").iterdir() if not p.name.endswith(".crc")) == [".journal", "manifest-0000000001.json", f"version={version}"]
    assert pub.publish(spark, root, {"t": spark.range(4)})[1] and pub.read_table(spark, root, "t").count() == 4
    # an older version may be published again; the tables of its first publication are used
    assert pub.publish(spark, root, {"t": spark.range(3)}) == (version, True) and pub.read_table(spark, root, "t").count() == 3


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("after", [False, True])
def test_what_a_killed_publication_leaves_is_not_in_the_way(spark, tmp_path, monkeypatch, step, after):
    root = pub.local_path(str(tmp_path / "site"))
    pub.publish(spark, root, {"t": spark.range(3)})
    plain, calls = getattr(pub, step), []

    def killed(*a, **k):
        calls.append(a)
        if step == "read_manifest" and len(calls) == 1:
            return plain(*a, **k)
        if after:
            plain(*a, **k)
        raise SystemExit("killed")

    with monkeypatch.context() as m:
        m.setattr(pub, step, killed)
        m.setattr(pub, "_forget", lambda *a: None)  # a killed process tidies nothing
        m.setattr(pub, "_remove", lambda *a: None)
        with pytest.raises(SystemExit):
            pub.publish(spark, root, {"t": spark.range(4)})
    version, changed = pub.publish(spark, root, {"t": spark.range(4)})
    assert changed or (step == "_promote" and after)
    assert pub.read_table(spark, root, "t").count() == 4 and pub.verify_published(spark, root) == ([], [])
    pub.recover(spark, root, now=10**12)
    left = sorted(p.name for p in (tmp_path / "site").iterdir() if not p.name.endswith(".crc"))
    assert [x for x in left if x.startswith(".staging")] == [] and len([x for x in left if x.startswith("version")]) == 2
    assert list((tmp_path / "site" / ".journal").glob("*.json")) == []


def test_a_torn_version_is_written_anew(spark, tmp_path):
    root = pub.local_path(str(tmp_path / "site"))
    version, _ = pub.publish(spark, root, {"t": spark.range(3)})
    other = pub.local_path(str(tmp_path / "other"))
    spark.range(2).write.parquet(f"{other}/version={version}/t")  # part of what should be there
    live = {"until": 10**12, "version": version}
    assert pub._create(spark, f"{other}/.journal/x.json", __import__("json").dumps(live)) and not pub._create(spark, f"{other}/.journal/x.json", "{}")
    assert pub.publish(spark, other, {"t": spark.range(3)}) == (version, True) and pub.read_table(spark, other, "t").count() == 3
    assert pub.recover(spark, other) == []  # the other publication's lease runs


def test_of_two_publications_one_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    root = pub.local_path(str(tmp_path / "site"))
    pub.publish(spark, root, {"t": spark.range(3)})
    meet = Barrier(2, timeout=60)

    def one(n):
        try:
            return pub.publish(spark, root, {"t": spark.range(n)}, check=lambda read: meet.wait())
        except SnapshotError as e:
            return e.code.value

    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(one, (4, 5)))
    assert sorted(isinstance(x, tuple) for x in got) == [False, True] and "BASELINE_MOVED" in got
    won = next(x for x in got if isinstance(x, tuple))
    assert pub.read_manifest(spark, root)["datasetVersion"] == won[0] and pub.verify_published(spark, root) == ([], [])


def test_a_taken_pointer_is_a_moved_baseline(spark, tmp_path, monkeypatch):
    root = pub.local_path(str(tmp_path / "site"))
    pub.publish(spark, root, {"t": spark.range(3)})
    plain = pub._promote

    def late(spark, root, manifest, number):
        plain(spark, root, {**manifest, "datasetVersion": "f" * 16}, number)  # another publication takes the number
        plain(spark, root, manifest, number)

    monkeypatch.setattr(pub, "_promote", late)
    with pytest.raises(SnapshotError) as e:
        pub.publish(spark, root, {"t": spark.range(4)})
    assert e.value.code.value == "BASELINE_MOVED" and pub.read_manifest(spark, root)["datasetVersion"] == "f" * 16


def test_search_without_terms_finds_nothing(spark):
    rows = spark.createDataFrame([("r1", "t1", None, {"a": "x"})], "r string, t string, d date, f map<string,string>")
    assert search.search_scope({}, rows, [], ("short", "latest")).count() == 0
    with pytest.raises(SnapshotError):
        search.search_scope({}, rows, ["x"], ("short", "latest"), trials=spark.createDataFrame([("t2",)], "tid string"))


def test_special_enrolment(spark):
    rows = spark.createDataFrame([(1, 5, 12, False), (2, None, None, False), (3, 5, 5, True), (4, 0, 0, None)], "id int, lo int, hi int, conflict boolean")
    labels = facets.bucket_labels(F.col("conflict"), F.col("lo"), F.col("hi"))
    assert {r.id: r.l for r in rows.select("id", labels.alias("l")).collect()} == {1: ["1-10", "11-30"], 2: ["__unprovided__"], 3: ["__conflicted__"], 4: ["0"]}
    counted = {r.bucket: r["count"] for r in facets.bucket_counts(rows, F.col("lo"), F.col("hi"), conflict=F.col("conflict")).collect()}
    assert counted == {"1-10": 1, "11-30": 1, "__unprovided__": 1, "__conflicted__": 1, "0": 1}


def test_addresses_of_identifiers(tables):
    from tidemark.plans.urlstate import resolve_protocol

    state, errors = parse_url("?protocol=abc-1%20&q=x")
    found, wrong = resolve_protocol(state, tables["trials"])
    assert (found.trial, found.protocol, wrong, errors) == (trial(tables, "ABC-1").tid, None, [], []) and build_url(found).endswith(f"trial={found.trial}")
    for raw, outcome in (("zz-9", "notFound"), ("--", "rejected")):
        state, wrong = resolve_protocol(parse_url(f"?protocol={raw}")[0], tables["trials"])
        assert (state.protocol, state.trial, wrong) == (None, None, [("protocol", outcome)])
    assert resolve_protocol(QueryState(), tables["trials"]) == (QueryState(), [])


def test_hits_outside_the_cohort_name_their_days(spark):
    hits = spark.createDataFrame([("t1", "r1", dt.date(2024, 1, 2), ["b"]), ("t1", "r2", dt.date(2023, 1, 1), ["a"]), ("t1", "r3", None, ["c"]), ("t2", "r4", None, ["a"])], "entity string, record string, day date, hit_fields array<string>")
    cohort = spark.createDataFrame([("r1",), ("r4",)], "rid string")
    got = {r.entity: (r.fields, r.days, r.undated) for r in search.hit_days(hits, cohort).collect()}
    assert got == {"t1": (["a", "b", "c"], [dt.date(2023, 1, 1)], True), "t2": (["a"], [], False)}


def test_truncated_ids_that_collide_raise(spark):
    rows = spark.createDataFrame([("t1", "P:a", "r1", "h1"), ("t1", "P:a", "r2", "h2"), ("t2", "P:b", "r3", "h3")], "tid string, key string, rid string, hash string")
    identity.require_no_truncation(rows)
    for bad in (("t1", "P:other", "r9", "h9"), ("t9", "P:z", "r1", "h9")):
        with pytest.raises(SnapshotError) as e:
            identity.require_no_truncation(rows.union(spark.createDataFrame([bad], rows.schema)))
        assert e.value.code.value == "ID_TRUNCATION_COLLISION" and e.value.detail["ids"] == [bad[0] if bad[0] == "t1" else "r1"]


def test_source_date_and_copies(spark, tables, monkeypatch):
    assert converge.source_updated_at(tables["trials"]).first()[0] == max(r.latest_date for r in tables["trials"].collect() if r.latest_date)
    monkeypatch.setattr(identity, "COPIES", 3)
    rows = spark.createDataFrame([("a", 1)] * 8 + [("b", 2)], "x string, y int")
    assert sorted((r.x, r.y, r.n) for r in identity.numbered_copies(rows, ["x"], "n").collect()) == [("a", 1, k) for k in range(8)] + [("b", 2, 0)]


def test_times_of_another_zone(spark):
    from tidemark.functions import parse

    df = spark.createDataFrame([("2024-05-01T20:30:00Z", dt.date(2024, 5, 1)), ("x", None)], "at string, day date")
    got = df.select(F.date_format(parse.taipei_timestamp(F.col("at")), "yyyy-MM-dd HH:mm").alias("t"), parse.slash_date(F.col("day")).alias("d")).collect()
    assert [(r.t, r.d) for r in got] == [("2024-05-02 04:30", "2024/05/01"), (None, None)]
    assert parse.build_date_of(dt.datetime(2024, 5, 1, 20, tzinfo=dt.timezone.utc)) == dt.date(2024, 5, 2)


def test_positions_of_ties_and_hot_groups(spark):
    from tidemark.operators import positions

    rows = spark.createDataFrame([("a", k) for k in range(500)] + [("b", 1), (None, 2)], "g string, k int").repartition(5)
    placed = positions.with_positions(rows, [F.col("g").desc_nulls_last(), F.col("k")])
    assert {(r.g, r.k): r.position for r in placed.collect()} == {("b", 1): 0, (None, 2): 501} | {("a", k): k + 1 for k in range(500)}
    assert sorted(((r.g or "", r.k), r.ordinal) for r in positions.ordinals(rows, ["g"], ["k"]).collect()) == sorted([(("a", k), k) for k in range(500)] + [(("b", 1), 0), (("", 2), 0)])
    assert positions.with_positions(rows.limit(0), [F.col("k")]).count() == 0
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_fetching(monkeypatch):
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/slow":
                time.sleep(2)
            self.send_response(404 if self.path == "/none" else 200)
            self.send_header("Content-Type", "application/zip")
            self.send_header("Content-Length", "9" if self.path == "/cut" else "3")
            self.end_headers()
            self.wfile.write(b"zip")

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        got = snapshot.fetch(f"{at}/")
        assert (got.status, got.content_type, got.length, got.body) == (200, "application/zip", 3, b"zip")
        snapshot.validate_response(got)
        assert snapshot.fetch(f"{at}/none").status == 404
        for path, kw, code in (("/slow", {"read": 0.3}, "HTTP_TIMEOUT"), ("/cut", {}, "HTTP_TRUNCATED")):
            with pytest.raises(SnapshotError) as e:
                snapshot.fetch(at + path, **kw)
            assert e.value.code.value == code
        assert snapshot.fetch(f"{at}/slow", connect=0.5, read=5).status == 200  # a short bound for connecting does not bound the wait
    finally:
        server.shutdown()
    with pytest.raises(SnapshotError) as e:
        snapshot.fetch("http://127.0.0.1:9/", connect=0.5)
    assert e.value.code.value == "HTTP_TRUNCATED"


def test_parameters_of_a_column_equal_those_of_one_address(spark):
    from urllib.parse import parse_qsl

    from tidemark.plans.urlstate import parameters

    rng = random.Random(3)
    rows = ["x", "/?", "/?a", "/?a=1&a=2#b=3", "http://h/p?q=a%20b+c&&=x&phase=%E6%97%A5&k=a=b", "/?p=1?q=2"] + ["/?" + "".join(rng.choice("ab=&+%41") for _ in range(rng.randint(0, 14))).replace("%a", "a").replace("%b", "b") for _ in range(200)]
    rows = [r for r in rows if "%" not in r.replace("%41", "").replace("%20", "").replace("%E6%97%A5", "")]
    got = spark.createDataFrame([(r,) for r in rows], "u string").select("u", parameters(F.col("u")).alias("p")).collect()
    for r in got:
        query = r.u.split("#")[0].split("?", 1)[1] if "?" in r.u else ""
        assert [tuple(x) for x in r.p] == parse_qsl(query, keep_blank_values=True), r.u

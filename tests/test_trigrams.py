"""Indexed search against a scan; interval join against the plain condition."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.functions.text import search_normalize
from tidemark.operators import intervals, search, trigrams


def test_equals_a_scan(spark, tmp_path):
    rng = random.Random(4)
    alphabet = "abcＡß ﬁ\n字"
    rows = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))), rng.choice(["s1", "s2", None])) for k in range(400)]
    rows += [(900, "needle in ＴＩＯＮ", "s1"), (901, "ﬁne", None), (902, None, None)]
    folded = spark.createDataFrame(rows, "id long, text string, source string").select("id", *(search_normalize(F.col(c)).alias(c) for c in ("text", "source")))
    index = trigrams.build_index(folded, "id", ("text", "source"), str(tmp_path))
    stored = folded.collect()
    asked = [["needle"], ["tion"], ["fine"], ["ss"], ["a"], ["abc", "s1"], ["bca", "cab"], ["ss字"], ["zzz"], ["needle", "zzz"], ["needle", "tion", "s1"], ["needle", "s2"], []]
    for terms in asked:
        want = {r.id for r in stored if terms and all(any(t in (r[c] or "") for c in ("text", "source")) for t in terms)}
        assert {r.id for r in trigrams.find(spark, index, terms).collect()} == want, terms
    hits = {r.entity: r.hit_fields for r in trigrams.search_index(spark, index, ["needle", "s1"]).collect()}
    assert hits == {900: ["text", "source"]}
    assert trigrams.rarest(spark, index, ["needle", "a"])[0] in trigrams.grams_of("needle") and trigrams.rarest(spark, index, ["qqq"]) is None


def test_a_rare_term_reads_few_texts(spark, tmp_path, monkeypatch):
    rows = [(k, f"common text number {k} " + ("rare-word" if k % 500 == 3 else "")) for k in range(3000)]
    index = trigrams.build_index(spark.createDataFrame(rows, "id long, text string"), "id", ("text",), str(tmp_path))
    keys = trigrams.candidates(spark, index, trigrams.rarest(spark, index, ["rare-word"]))
    assert {r.id for r in keys.collect()} == {k for k in range(3000) if k % 500 == 3}
    plan = trigrams.find(spark, index, ["rare-word", "common"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(id" in plan or "In(id" in plan  # the scan gets the keys
    monkeypatch.setattr(trigrams, "NAMED", 2)
    assert {r.id for r in trigrams.find(spark, index, ["rare-word"]).collect()} == {k for k in range(3000) if k % 500 == 3}


def test_search_of_records_is_the_same_everywhere(spark, tmp_path):
    rows = spark.createDataFrame([(1, "alpha beta", "x"), (2, "beta", "alpha"), (3, "gamma", "x")], "id long, text string, source string")
    index = trigrams.build_index(rows, "id", ("text", "source"), str(tmp_path))
    fields = {c: F.col(c) for c in ("text", "source")}
    for terms in (["alpha"], ["alpha", "beta"], ["x"]):
        want = sorted(map(tuple, search.search_records(rows, fields, terms, "id", "id").collect()))
        assert sorted(map(tuple, trigrams.search_index(spark, index, terms).collect())) == want


def test_postings_are_rows_by_piece_not_by_record(spark, tmp_path):
    rows = [(k, f"the same words in every text and the number {k}") for k in range(2000)]
    index = trigrams.build_index(spark.createDataFrame(rows, "id long, text string").coalesce(1), "id", ("text",), str(tmp_path))
    postings = spark.read.parquet(f"{index.root}/postings")
    pairs_ = sum(len(trigrams.grams_of(t)) for _, t in rows)
    assert postings.count() * 20 < pairs_
    assert postings.agg(F.sum(F.size("keys")), F.sum("records")).first() == (pairs_, pairs_)
    plan = trigrams.candidates(spark, index, ["the"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram,the)" in plan or "In(gram" in plan  # the scan gets the trigram


def test_repeated_and_null_keys_are_found(spark, tmp_path, monkeypatch):
    rows = [(1, "needle here"), (1, "another needle"), (2, "hay"), (None, "needle without a key"), (None, "hay")] + [(k, "hay") for k in range(10, 30)]
    index = trigrams.build_index(spark.createDataFrame(rows, "id long, text string"), "id", ("text",), str(tmp_path))
    for named in (trigrams.NAMED, 1):
        monkeypatch.setattr(trigrams, "NAMED", named)
        found = [tuple(r) for r in trigrams.find(spark, index, ["needle"]).collect()]
        assert sorted(found, key=str) == sorted((r for r in rows if "needle" in r[1]), key=str)


def test_texts_cut_into_pieces_lose_no_trigram(monkeypatch):
    rng = random.Random(9)
    columns = [["".join(rng.choice("ab\U0001f600字") for _ in range(rng.choice([0, 1, 2, 3, 50]))) or None for _ in range(60)] for _ in range(2)]
    want = {(g, k) for c in columns for k, t in enumerate(c) for g in trigrams.grams_of(t or "")}
    for size in (1, 2, 7, 40, 10**6):
        monkeypatch.setattr(trigrams, "PIECE", size)
        got = []
        for of, texts in trigrams._pieces(columns):
            grams, start, records = trigrams._turned(of, texts)
            assert len(set(grams)) == len(grams)
            got += [(g, k) for g, a, b in zip(grams, start[:-1], start[1:], strict=True) for k in set(records[a:b].tolist())]
            assert len(records) == sum(len(set(records[a:b].tolist())) for a, b in zip(start[:-1], start[1:], strict=True))
        assert set(got) == want


def test_a_short_term_stores_nothing(spark, monkeypatch):
    from tidemark.plans import queries

    monkeypatch.setattr(queries, "document_index", lambda *a: (_ for _ in ()).throw(AssertionError("an index was built")))
    assert queries.nfkc_search(spark, "/root/testdata/sf0.001").count() > 0


def pairs(spark, a, b):
    left = spark.createDataFrame(a, "i long, lo long, hi long")
    right = spark.createDataFrame(b, "j long, low long, high long")
    found = intervals.overlap_join(left, right, ("lo", "hi"), ("low", "high"))
    assert found.columns == ["i", "lo", "hi", "j", "low", "high"]
    return found, sorted((r.i, r.j) for r in found.collect())


def test_overlaps_equal_the_plain_condition(spark):
    rng = random.Random(2)

    def some(n):
        out = []
        for k in range(n):
            lo = rng.randint(-500, 500)
            out.append((k, lo, lo + rng.choice([0, 1, 2, 7, 8, 9, 100, 5000, -3])))
        return out + [(n, None, 5), (n + 1, 5, None), (n + 2, -(2**40), 2**40)]

    a, b = some(120), some(90)
    ok = lambda x: x[1] is not None and x[2] is not None and x[1] <= x[2]
    want = sorted((x[0], y[0]) for x in a for y in b if ok(x) and ok(y) and x[1] <= y[2] and y[1] <= x[2])
    found, got = pairs(spark, a, b)
    assert got == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert pairs(spark, a[:0], b)[1] == [] and pairs(spark, a, b[:0])[1] == []


def test_dates_and_short_intervals_under_a_long_one(spark):
    day = dt.date(2024, 1, 1)
    many = [(k, day + dt.timedelta(k % 300), day + dt.timedelta(k % 300 + 1)) for k in range(2000)]
    left = spark.createDataFrame(many, "i long, a date, b date")
    right = spark.createDataFrame([(0, day, day + dt.timedelta(1000)), (1, day + dt.timedelta(10), day + dt.timedelta(10))], "j long, c date, d date")
    got = {r.j: r["count"] for r in intervals.overlap_join(left, right, ("a", "b"), ("c", "d")).groupBy("j").count().collect()}
    assert got == {0: 2000, 1: sum(k % 300 in (9, 10) for k in range(2000))}

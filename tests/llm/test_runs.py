import hashlib
import random
import zlib

import numpy as np
import pytest
from brute import WORD

import tidemark.llm.runs as m
from tidemark.llm.runs import find_runs, runs_of


def brute(w, least, exponent):
    """Every period in turn, from the shortest; a run inside one of a shorter period has that period."""
    found = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if i > s and n >= max(least, exponent * q) and not any(a <= s and a + b >= s + n for a, b, _ in found):
                found.append((s, n, q))
            i += i == s or i + q < len(w)
    return sorted(found, key=lambda x: (x[0], x[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def documents(rng, n):
    for _ in range(n):
        w = []
        for _ in range(rng.randint(0, 8)):
            if rng.random() < 0.5:
                w += [rng.randrange(rng.choice([2, 3, 9])) for _ in range(rng.randint(0, 12))]
            else:
                p = [rng.randrange(3) for _ in range(rng.randint(1, 6))]
                w += p * rng.randint(1, 7) + p[: rng.randrange(len(p) + 1)]
        yield w


@pytest.mark.parametrize("few", [0, 3, 40])
@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (3, 3), (9, 5)])
def test_against_all_periods(monkeypatch, few, least, exponent):
    monkeypatch.setattr(m, "FEW", few)
    rng = random.Random(few + least)
    docs = list(documents(rng, 400))
    for at in range(0, len(docs), 7):
        own = docs[at : at + 7]
        got = runs_of([np.array(d, np.uint64) for d in own], least, exponent)
        assert [[tuple(r) for r in g.tolist()] for g in got] == [brute(d, least, exponent) for d in own]


def test_long_periods_and_one_word():
    one, long = np.zeros(30_000, np.uint64), np.tile(np.arange(5_000), 4).astype(np.uint64)
    almost = np.tile(np.arange(5_000), 4)[:-1].astype(np.uint64)
    assert [x.tolist() for x in runs_of([one, long, almost, one[:0]], 6, 4)] == [[[0, 30_000, 1]], [[0, 20_000, 5_000]], [], []]


def test_rows_and_columns(spark):
    text = "a b\tc " * 5 + "d"
    rows = [(1, text, 7, "x"), (1, text, 8, None), (None, None, 9, "y"), (2, "", 1, "z"), (3, " \n ", 1, "z"), (4, "é é é é é é", 1, "z"), (5, "é" * 500_000, 2, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs int, row string")
    got = sorted(((r.row, r.n_words, r.n_runs, [tuple(x) for x in r.runs], r.collapsed_text) for r in find_runs(df).collect()), key=str)
    want = [("x", 16, 1, [(0, 15, 3)], "a b c d"), (None, 16, 1, [(0, 15, 3)], "a b c d"), ("y", 0, 0, [], ""), ("z", 0, 0, [], ""), ("z", 0, 0, [], ""), ("z", 6, 1, [(0, 6, 1)], "é"), ("w", 1, 0, [], "é" * 500_000)]
    assert got == sorted(want, key=str)
    assert find_runs(df).columns == ["doc_id", "text", "row", "n_words", "n_runs", "runs", "collapsed_text"]
    assert find_runs(df.limit(0)).count() == 0 and find_runs(df.select("text")).count() == 7


def test_words_with_one_hash_are_told_apart(spark, monkeypatch):
    plain = m.tables
    monkeypatch.setattr(m, "tables", lambda texts, lower: ((k, a, b, h * np.uint64(0)) for k, a, b, h in plain(texts, lower)))
    f = m._runs(6, 4)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([{"i": 1}]), pa.array(["a b c d e f g x y x y x y x y"])], ["row", "text"])
    out = next(f(iter([batch]))).to_pydict()
    assert out["runs"] == [[{"start": 7, "length": 8, "period": 2}]] and out["collapsed_text"] == ["a b c d e f g x y"]


def test_query_against_brute_force(spark):
    from tidemark.llm.queries import op11_runs

    d = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        w, h = WORD.findall(r.text or ""), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = brute(w, 6, 4)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[r.doc_id] = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(w, runs)))
    assert {r[0]: tuple(r[1:]) for r in op11_runs(spark, d).collect()} == want
    assert sum(x[0] > 0 for x in want.values()) > 5

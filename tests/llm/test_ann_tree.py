import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.ann_tree import search


def run(spark, rows, k=20):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {}
    for r in search(df, F.col("vec_id") % 5 == 0, k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def brute(rows, k):
    good = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    return {i: sorted(((float(sum(a * b for a, b in zip(q, v, strict=True))), j) for j, v in good.items() if j != i), key=lambda x: (-x[0], x[1]))[:k] for i, q in good.items() if i % 5 == 0}


def test_recall_and_exact_scores(spark, monkeypatch):
    import tidemark.llm.ann_tree as m

    monkeypatch.setattr(m, "CHUNK", 40)
    monkeypatch.setattr(m, "LEAF_SAMPLE", 16)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 12)) * 2
    rows = [(i, list(map(float, centres[i % 20] + rng.normal(size=12)))) for i in range(1500)]
    rows += [(2000, None), (2005, [0.0] * 12), (2010, [float("inf")] * 12), (2015, [None] * 12), (None, [1.0] * 12)]
    got, want = run(spark, rows), brute(rows, 20)
    assert set(got) == set(want)
    vectors = dict(rows)
    hits = 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s - np.dot(vectors[q], vectors[j])) < 1e-9 for _, j, s in found) and q not in {j for _, j, _ in found}
        assert [(-s, j) for _, j, s in found] == sorted((-s, j) for _, j, s in found)
        hits += len({j for _, j, _ in found} & {j for _, j in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_few_candidates_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (5, [0.0, 1.0])]
    got = run(spark, rows)
    assert got[0] == [(1, 1, 1.0), (2, 2, 1.0), (3, 5, 0.0)]
    assert [j for _, j, _ in got[5]] == [0, 1, 2]
    assert run(spark, []) == {} and run(spark, [(1, [1.0])]) == {} and run(spark, [(0, [1.0])]) == {}


def test_hot_vector(spark, monkeypatch):
    import tidemark.llm.ann_tree as m

    monkeypatch.setattr(m, "CHUNK", 50)
    rng = np.random.default_rng(2)
    rows = [(i, [1.0] * 8 if i % 3 else list(map(float, rng.normal(size=8)))) for i in range(600)]
    got, want = run(spark, rows), brute(rows, 20)
    hits = sum(len({j for _, j, _ in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)

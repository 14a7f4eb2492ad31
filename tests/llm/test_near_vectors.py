import numpy as np
from brute import roots

from tidemark.llm.near_vectors import near_vectors


def brute(rows, threshold):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float)
    ids = sorted(good)
    width = max((len(v) for v in good.values()), default=1)
    u = np.array([np.pad(good[i], (0, width - good[i].size)) for i in ids]).reshape(len(ids), width)
    u /= np.abs(u).max(axis=1, keepdims=True, initial=0)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    root = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    count = dict(zip(ids, near.sum(axis=1).tolist(), strict=True))
    return {(i, count.get(i, 0), root.get(i, i), i is not None and root.get(i, i) == i) for i, _ in rows}


def run(spark, rows, threshold=0.95):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return [tuple(r) for r in near_vectors(df, threshold).collect()]


def test_against_brute_force(spark, monkeypatch):
    import tidemark.llm.near_vectors as m

    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 24))
    near = base[rng.integers(0, 40, 400)] + rng.normal(size=(400, 24)) * rng.uniform(0.01, 0.4, (400, 1))
    rows = [(int(i * 7 % 1009), list(map(float, v))) for i, v in enumerate(np.concatenate((base, near)))]
    rows += [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] + [1.0] * 23), (2003, [None] * 24), (2004, []), (2005, [1.0, 2.0]), (2006, [2.0, 4.0]), (2007, [1e300] * 24), (2008, [1e-300] * 24), (None, [1.0] * 24)]
    for tile in (4096, 50):
        monkeypatch.setattr(m, "TILE", tile)
        got = run(spark, rows)
        assert len(got) == len(rows) and set(got) == brute(rows, 0.95)


def test_hot_group_and_repeats(spark, monkeypatch):
    import tidemark.llm.near_vectors as m

    monkeypatch.setattr(m, "TILE", 60)
    rng = np.random.default_rng(5)
    hot = rng.normal(size=16)
    rows = [(i, list(map(float, hot + rng.normal(size=16) * 0.1))) for i in range(200)]
    rows += [(500, rows[0][1]), (500, rows[0][1])]
    got = run(spark, rows)
    want = brute(rows, 0.95)
    assert len(got) == 202 and set(got) == want


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1, True)]
    assert run(spark, [(1, [1.0])]) == [(1, 0, 1, True)]


def test_vectors_with_one_id_do_not_depend_on_their_order(spark):
    from tidemark.llm.ann_tree import search
    from pyspark.sql import functions as F

    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (1, [0.0, 0.0]), (3, [0.5, 0.5])]
    found, near = [], []
    for own in (rows, rows[::-1]):
        df = spark.createDataFrame(own, "vec_id long, embedding array<double>").coalesce(1)
        found.append(sorted(map(tuple, near_vectors(df, 0.95).collect())))
        near.append(sorted(map(tuple, search(df, F.col("vec_id") == 2, k=3).collect())))
    assert found[0] == found[1] == [(1, 0, 1, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
    assert near[0] == near[1] == [(2, 1, 3, 0.5)]

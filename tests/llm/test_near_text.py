import random

from brute import near_duplicates as brute

from tidemark.llm.near_text import near_duplicates


def run(spark, rows, size=4, percent=80):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_duplicates(df, size, percent).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows, base = [], [[rng.choice(vocab) for _ in range(rng.randint(1, 160))] for _ in range(60)]
    for i, words in enumerate(base):
        rows.append((1000 - i, " ".join(words)))
    for k in range(240):  # copies with a growing number of changed words, on both sides of the threshold
        words = list(rng.choice(base[:25]))
        for _ in range(rng.randint(0, max(1, len(words) // 14))):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((2000 + k, "\n ".join(words).upper() if k % 3 else "  ".join(words)))
    rows += [(1, ""), (2, None), (3, " \t\n"), (4, "a"), (5, "A"), (6, "a b c"), (7, "c b a"), (8, "a b c d"), (9, "é É")]
    assert run(spark, rows) == brute(rows, 4, 80)


def test_hot_group_in_blocks(spark, monkeypatch):
    import tidemark.llm.near_text as m

    monkeypatch.setattr(m, "BUCKET_BLOCK", 16)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(150):
        w = list(words)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        rows.append((k, " ".join(w)))
    assert run(spark, rows) == brute(rows, 4, 80)


def test_empty_and_clashing_columns(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c d e", 3, 4), (1, "a b c d e", 3, 4), (None, "a b c d e", 1, 1)], "doc_id long, text string, id int, band int")
    rows = near_duplicates(df).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (1, 1), (1, 1)]


def test_long_text(spark):
    text = " ".join(f"w{i}" for i in range(400_000))
    out = run(spark, [(1, text), (2, text + " end"), (3, "z" * 5_000_000)])
    assert out[1][1:] == (1, True) and out[2][1:] == (1, False) and out[3] == (1, 3, True)

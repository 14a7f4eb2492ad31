import random
import re

import numpy as np
from brute import remove_repeats as brute

from tidemark.llm.fm_index import FMIndex
from tidemark.llm.repeats import remove_repeats, segments


def run(spark, rows, length):
    out = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length).collect()
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out}


def test_fm_index_counts_patterns():
    rng = np.random.default_rng(3)
    seqs = [rng.integers(1, 6, rng.integers(13, 40)) for _ in range(50)]
    text = np.concatenate([np.append(s, 0) for s in seqs]).astype(np.int32)
    at = np.flatnonzero([i + 5 <= text.size and (text[i : i + 5] > 0).all() for i in range(text.size)])
    owner = rng.integers(0, 9, text.size)
    index = FMIndex(text, 13, owner)
    low, high = index.search(text, at, 5)
    least = index.least(low, high)
    rows = [tuple(text[i : i + 5]) for i in at]
    for k, r in enumerate(rows):
        n = rows.count(r)
        assert high[k] - low[k] == n or (n == 1 and high[k] - low[k] == 1)
        if n > 1:
            assert least[k] == min(owner[a] for a, r2 in zip(at, rows, strict=True) if r2 == r)


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(30)] + ["é", "X", "x"]
    shared = [[rng.choice(vocab) for _ in range(rng.randint(8, 60))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
            if rng.random() < 0.6:
                w += rng.choice(shared)
        rows.append((i * 7 % 1000, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(5000, rows[3][1]), (5001, rows[3][1]), (5002, ""), (5003, None), (5004, "a " * 300), (5005, "a " * 400), (-3, "a " * 12)]
    for length in (13, 20, 2):
        assert run(spark, rows, length) == brute(rows, length)


def test_blocks_split_at_anchors(spark, monkeypatch):
    import tidemark.llm.repeats as m

    monkeypatch.setattr(m, "BLOCK_SYMBOLS", 60)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        w = list(base)
        w[rng.randrange(200)] = "changed"
        rows.append((i, " ".join(w[rng.randrange(50) :])))
    assert run(spark, rows, 13) == brute(rows, 13)


def test_edges(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, "x", 1), (1, text, "y", 2), (None, text, "z", 3), (2, text, None, 4)], "doc_id long, text string, tx string, n_words int")
    rows = {r.tx: (r.doc_id, r.n_words, r.n_removed) for r in remove_repeats(df, 50).collect()}
    assert rows == {"x": (1, 60, 0), "y": (1, 60, 0), "z": (None, 60, 0), None: (2, 60, 60)}


def test_wide_anchors_are_taken_apart(spark, monkeypatch):
    import tidemark.llm.repeats as m

    rng = random.Random(6)
    run_ = "in the end it was all the same to".split()
    rows = []
    for i in range(120):
        left, right = ([f"v{rng.randrange(3)}" for _ in range(5)] for _ in range(2))
        rows.append((i, " ".join([f"own{i}", *left, *run_, *right, f"own{i}"])))
    asked = []
    plain = m._shared_segments
    monkeypatch.setattr(m, "BLOCK_SYMBOLS", 100)
    monkeypatch.setattr(m, "_shared_segments", lambda length, run, bloom, hot=None: asked.append(hot) or plain(length, run, bloom, hot))
    assert run(spark, rows, 13) == brute(rows, 13)
    assert any(hot is not None for hot in asked)


def test_very_long_text(spark):
    words = [f"w{i % 70_001}" for i in range(300_000)]
    rows = [(1, " ".join(words[:100_000])), (2, " ".join(words)), (3, "x" * 2_000_000)]
    assert run(spark, rows, 13) == brute(rows, 13)


def test_query_against_brute_force(spark):
    import hashlib

    from tidemark.llm.queries import op10_repeats

    d = "/root/testdata/sf0.001"
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()], 13)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op10_repeats(spark, d).collect()}
    assert got == {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, (n, gone, kept) in want.items()}


def test_segments_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(8)
    sizes = [0, 40, 3, 13, 0, 90, 12, 14]
    texts = [rng.integers(1, 4, n).astype(np.uint64) for n in sizes]  # few words, so that hashes are equal in a window
    cut = np.cumsum([0, *sizes])
    for length, run in ((13, 8), (5, 1), (12, 12)):
        of, start, count, anchor = segments(np.concatenate(texts), cut, length, run)
        found = []
        for k, words in enumerate(texts):
            one = segments(words, np.array([0, words.size]), length, run)
            assert int(one[2].sum()) == max(0, words.size - length + 1)
            found += [(k, int(a + cut[k]), int(n), int(h)) for a, n, h in zip(*one[1:], strict=True)]
        assert list(zip(of.tolist(), start.tolist(), count.tolist(), anchor.tolist(), strict=True)) == found


def test_all_white_bytes_part_words_and_repeated_ids(spark):
    rng = random.Random(4)
    passage = [f"w{i}" for i in range(9)]
    rows = [(i // 2, rng.choice("\n ").join(["", *(x + rng.choice([" ", "\t", "  ", "\x0b\r\n"]) for x in (passage if i % 3 else passage[::-1])), rng.choice(["", "é\u00a0z"])])) for i in range(24)]
    rows += [(99, None), (100, ""), (101, " \n"), (102, "one"), (None, " ".join(passage))]
    out = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "", r.n_words, r.n_removed, r.kept_text) for r in out.collect()))
    starts = {}
    split = lambda t: [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
    for d, t in rows:
        for i in range(len(split(t)) - 3 if d is not None else 0):
            w = tuple(split(t)[i : i + 4])
            starts[w] = min(starts.get(w, d), d)
    want = []
    for d, t in rows:
        w = split(t)
        gone = {j for i in range(len(w) - 3) if d is not None and starts[tuple(w[i : i + 4])] < d for j in range(i, i + 4)}
        want.append((d is None, d or 0, t or "", len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    assert got == sorted(want)

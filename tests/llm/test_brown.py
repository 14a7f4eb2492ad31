import random
import zlib
from types import SimpleNamespace

import numpy as np
from brute import base_scores
from pyspark.sql import functions as F

from tidemark.llm.brown import exchange, score_documents


def run(spark, rows, extra=""):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    return score_documents(spark.createDataFrame(rows, "doc_id long, text string" + extra), held).collect()


def test_base_and_gain(spark):
    rng = random.Random(4)
    nouns, verbs = [f"n{i}" for i in range(40)], [f"v{i}" for i in range(40)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(1, 30)):
            words += [rng.choice(["the", "a"]), rng.choice(nouns), rng.choice(verbs)]
        rows.append((i, " \n".join(words).upper()))
    rows += [(1000, None), (1001, ""), (1002, "é É rare"), (1003, "the n1 " * 50_000)]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    want = base_scores(rows, held)
    out = {r.doc_id: r for r in run(spark, rows)}
    assert set(out) == set(want)
    for i, (n, known, total, base) in want.items():
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, i in held)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
    own = [i for i in held if i < 1000]
    assert sum(out[i].score for i in own) > sum(out[i].base_score for i in own)


def test_exchange_finds_the_two_classes():
    rng = np.random.default_rng(1)
    n, classes = 2, np.array([0, 1, 0, 1, 0, 1])
    follow = np.zeros((6, 6), int)
    for _ in range(4000):
        a = rng.integers(0, 3)
        follow[a, 3 + rng.integers(0, 3)] += 1
        follow[3 + rng.integers(0, 3), rng.integers(0, 3)] += 1
    count = follow.sum(axis=0)
    for turn in range(8):
        one = np.eye(n, dtype=int)[classes]
        classes = exchange(follow.T @ one, follow @ one, one.T @ follow @ one, classes, count, n, np.arange(6) % 2 == turn % 2)
    assert len(set(classes[:3])) == 1 and len(set(classes[3:])) == 1 and classes[0] != classes[3]


def test_edges(spark):
    assert run(spark, []) == []
    assert {(r.n_tokens, r.train_tokens) for r in run(spark, [(None, "a b", 1), (None, "a b", 1)], ", n int")} == {(3, 6)}


def test_context_decides_the_class_of_every_word_that_has_some(spark):
    # x words follow "the" and y words "a"; ten of each are frequent, and 5,000 other words come before the rest of them
    rng = random.Random(8)
    many = [f"m{i}" for i in range(5000)] * 30
    rng.shuffle(many)
    said = [f"the x{i}" for i in range(110) for _ in range(600 if i < 10 else 22)]
    said += [f"a y{i}" for i in range(110) for _ in range(500 if i < 10 else 22)]
    rng.shuffle(said)
    rows = [" ".join(part[i : i + 300]) for part in (many, said) for i in range(0, len(part), 300)]
    free = (i for i in range(100_000) if zlib.crc32(str(i).encode()) % 7 != 2)
    train = [(next(free), t) for t in rows]
    asked = [i for i in range(100_000) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    usual = " ".join(f"the x{i} a y{i}" for i in range(10, 110))
    unusual = " ".join(f"the y{i} a x{i}" for i in range(10, 110))
    out = {r.doc_id: r for r in run(spark, [*train, (asked[0], usual), (asked[1], unusual)])}
    usual, unusual = (out[i] for i in asked)
    assert abs(usual.base_score - unusual.base_score) < 1e-6
    assert usual.score > unusual.score + 10


def test_planes_give_their_numbers_back():
    from tidemark.llm.brown import _planes, _values

    for values in ([], [7], [0, 1, -1, 255, 256, 1 << 20, (1 << 31) - 1, -(1 << 31)], range(5000)):
        assert _values(_planes(np.array(list(values), np.int32))).tolist() == list(values)


def test_neighbours_are_counted_whole(monkeypatch):
    from collections import Counter

    import pyarrow as pa

    from tidemark.llm import brown

    monkeypatch.setattr(brown, "STRETCH", 50)  # several parts, and sums between them
    monkeypatch.setattr(brown, "MOST", 7)  # entries beyond it are split
    rng, size = np.random.default_rng(3), brown.FIRST + 2 * brown.RANGE + 5
    end = size - 1
    some = np.array([1, 2, brown.FIRST, brown.FIRST + 3, brown.FIRST + brown.RANGE, end - 2])
    texts = [np.append(rng.choice(some, rng.integers(0, 90)), end).astype(np.uint32) for _ in range(60)]
    want = Counter()
    for t in texts:
        want.update(zip([end, *t[:-1].tolist()], t.tolist(), strict=True))
    rows = pa.RecordBatch.from_pydict({"codes": [t.tobytes() for t in texts]})
    parts = pa.Table.from_batches(list(brown._bigrams(size, end)([rows])))
    assert parts.num_rows > 20
    after, before, ranges = Counter(), Counter(), []
    for batch in brown._merged(size)(parts.sort_by("range").to_batches(max_chunksize=3)):
        (r,) = batch.column("range").to_pylist()
        ranges.append(r)
        for side, found in ((0, before), (1, after)):
            word, near, count = brown._entries(batch.column(f"size_{side}")[0].as_py(), batch.column(f"side_{side}")[0])
            assert count.max() <= 7 and np.all(np.diff(word.astype(np.int64) * size + near) >= 0)
            for w, k, n in zip((word + brown._first(r)).tolist(), near.tolist(), count.tolist(), strict=True):
                found[(k, w) if side == 0 else (w, k)] += n
    assert len(ranges) == len(set(ranges)) and after == want and before == want


def test_rounds_read_due_words_and_count_what_moves(monkeypatch):
    import pyarrow as pa

    from tidemark.llm import brown

    monkeypatch.setattr(brown, "RANGE", 40)
    rng, n = np.random.default_rng(8), brown.CLASSES + brown.BANDS
    size = brown.FIRST + 100
    end = size - 1
    texts = [np.append(rng.choice([1, 2, *range(brown.FIRST, size)], 60), end).astype(np.uint32).tobytes() for _ in range(80)]
    parts = pa.Table.from_batches(list(brown._bigrams(size, end)([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["codes"])])))
    table = pa.Table.from_batches(list(brown._phased(brown._merged(size)(parts.sort_by("range").to_batches()))))

    def summed(f, columns):
        out = np.zeros(n * n, np.int64)
        for b in f(table.select(["range", *columns]).to_batches()):
            out[b.column("at").to_numpy()] += b.column("n").to_numpy()
        return out

    every = brown._columns(1, range(brown.FINEST))
    old = rng.integers(0, brown.CLASSES, size).astype(np.uint8)
    pair = summed(brown._pairs(old, n), every)
    assert pair.sum() == 61 * 80
    for turn, steps in ((0, 2), (3, 4), (5, 16)):
        due = brown._due(turn, steps)
        columns = [c for side in (0, 1) for c in brown._columns(side, due)]
        assert len(columns) * steps == 4 * brown.FINEST
        moved = pa.Table.from_batches(list(brown._move(old, n, pair.reshape(n, n), turn, steps)(table.select(["range", *columns]).to_batches())))
        words = moved.column("word").to_numpy()
        assert words.size and ((words + turn) % steps == 0).all()
        new = old.copy()
        new[brown.FIRST + words] = moved.column("class").to_numpy()
        change = summed(brown._changes(old, new, n, due), columns)
        assert (pair + change == summed(brown._pairs(new, n), every)).all()


def test_each_block_asks_once_for_a_word():
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from tidemark.llm import brown

    batch = pa.RecordBatch.from_arrays([pa.array([3, 1, 3, 1, 2]), pa.array(["a b a", "b", "B c", "", " "])], ["block", "text"])
    ask = brown._distinct(SimpleNamespace(value=[np.zeros(0, np.int64)]))
    (out,) = ask(iter([batch]))
    assert out.column("block").to_pylist() == [1, 3, 3, 3]
    words = out.column("word").to_pylist()
    assert words[1:] == sorted(set(words)) and words[0] in words[1:]
    (none,) = ask(iter([batch.slice(3)]))
    assert none.num_rows == 0


def test_places_are_found_whatever_the_hashes():
    from tidemark.llm.brown import _Places

    rng, edges = np.random.default_rng(6), [0, -1, -(2**63), 2**63 - 1]
    some = rng.integers(-(2**63), 2**63 - 1, 3000)
    for words in ([], [5], edges, some, [*some, *range(500)]):
        words = np.unique(np.array(words, np.int64))
        asked = rng.permutation(np.concatenate((words, edges, range(-9, 600), rng.integers(-(2**63), 2**63 - 1, 3000))))
        at, hit = _Places(words).find(asked)
        assert (hit == np.isin(asked, words)).all() and (words[at[hit]] == asked[hit]).all()


def test_texts_of_a_block_are_coded_and_scored_one_by_one(monkeypatch):
    import pyarrow as pa

    from tidemark.llm import brown
    from tidemark.llm.words import tables

    monkeypatch.setattr(brown, "STRETCH", 7)  # several groups of texts, and texts beyond one
    texts = ["a b", "", "c c c a b zz a c b a", None, " ", "b", "zz"]
    word = {t: int(w.view(np.int64)[0]) for t in "abc" for _, _, _, w in tables([t.encode()], True)}
    common = SimpleNamespace(value=[np.array([word["a"]]), np.array([9]), np.array([41])])
    known = pa.table({"word": [word["b"], word["c"]], "n": [3, 1], "code": [2, 1]})
    docs = pa.table({"doc_id": pa.array(range(7), pa.int64()), "held_out": [False] * 7, "text": texts})
    out = brown._encode(common, 20, 4, 7, 42)(docs, known)
    cost, code = {"a": 10, "b": 4, "c": 2}, {"a": 41, "b": 2, "c": 1}
    rng = np.random.default_rng(2)
    classes, gain = rng.integers(0, 5, 43).astype(np.uint8), rng.normal(size=(5, 5))
    batch = out.combine_chunks().to_batches()[0]
    (scored,) = brown._score(classes, gain)([batch.slice(1)])
    scores = [None, *scored.column("score").to_pylist()]
    for i, row in enumerate(out.to_pylist()):
        words = (texts[i] or "").split()
        codes = [*(code.get(w, 0) for w in words), 42]
        assert np.frombuffer(row["codes"], np.uint32).tolist() == codes
        assert (row["n_tokens"], row["n_known"]) == (len(codes), sum(w in cost for w in words) + 1)
        base = sum(np.log10(cost.get(w, 1)) for w in words) + np.log10(8) - len(codes) * np.log10(25)
        assert abs(row["base_score"] - base) < 1e-9
        if i:
            assert abs(scores[i] - base - sum(gain[classes[a], classes[b]] for a, b in zip([42, *codes], codes, strict=False))) < 1e-9


def test_ranges_share_files(spark, monkeypatch):
    # Each round opens every file of neighbours.
    import pytest

    from tidemark.llm import brown

    class Seen(Exception):
        pass

    files, staged = [], brown.staged

    def watched(df, name):
        out = staged(df, name)
        if name == "neighbours":
            files.append(len(out.inputFiles()))
            raise Seen
        return out

    monkeypatch.setattr(brown, "staged", watched)
    words = 8 * brown.RANGE
    with pytest.raises(Seen):
        run(spark, [(i, " ".join(f"w{(i * 331 + k) % words}" for k in range(1000))) for i in range(500)])
    assert 0 < files[0] <= 2

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import tidemark.llm.byte_repeats as m
from tidemark.llm.byte_repeats import remove_shared_bytes, shared_windows
from tidemark.llm.suffix_groups import suffix_array


def test_suffix_array_against_sorting():
    rng = random.Random(3)
    for _ in range(800):
        x = [rng.randrange(rng.choice([1, 2, 3, 10])) for _ in range(rng.randint(0, 60))]
        x = x[:7] * rng.randint(1, 8) if rng.random() < 0.4 else x
        assert suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:])
    assert suffix_array(np.ones(20_000, int)).tolist() == list(range(19_999, -1, -1))


def brute(texts, length):
    """(bytes, removed, spans, what stays) of each text."""
    texts = [(t or "").encode() for t in texts]
    n = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = {j for i in range(len(t) - length + 1) if n[t[i : i + length]] > 1 for j in range(i, i + length)}
        out.append((len(t), len(gone), sum(i - 1 not in gone for i in gone), bytes(x for i, x in enumerate(t) if i not in gone)))
    return out


def texts_of(rng, n, alphabet):
    shared = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(6)]
    for _ in range(n):
        yield "".join(rng.choice(shared) if rng.random() < 0.6 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 5)))


def run(spark, texts, length):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return [tuple(r)[1:] for r in sorted(remove_shared_bytes(df, length).select("doc_id", *m.ADDED).collect())]


def test_windows_of_different_segments():
    rng = random.Random(7)
    for symbol in (1, 3, 8):
        for _ in range(40):
            middle = bytes(rng.choice(b"abc") for _ in range(rng.randint(10, 30)))
            sides = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 20))) for _ in range(12)]
            segs = [a + middle + b for a, b in zip(sides[::2], sides[1::2], strict=True)]
            segs = [s for s in dict.fromkeys(segs) if len(s) >= 20]
            shift = np.array([s.index(middle) for s in segs], np.int64)
            n = Counter((i - k, s[i : i + 20]) for s, k in zip(segs, shift.tolist(), strict=True) for i in range(len(s) - 19))
            want = [[n[i - k, s[i : i + 20]] > 1 for i in range(len(s) - 19)] for s, k in zip(segs, shift.tolist(), strict=True)]
            got = shared_windows(segs, shift, 20, symbol) if segs else []
            for s, k, g, w in zip(segs, shift.tolist(), got, want, strict=True):
                # Windows that are equal at another distance from the common run count too, if symbols meet there.
                assert all(x or not y for x, y in zip(g.tolist(), w, strict=True)), (symbol, s, k)


@pytest.mark.parametrize("length, alphabet", [(16, "ab"), (21, "abcé€"), (32, "a"), (40, "abcdefghij")])
def test_against_counting(spark, monkeypatch, length, alphabet):
    rng = random.Random(length)
    texts = [*texts_of(rng, 60, alphabet), None, "", alphabet[0] * 200, "x" * (length - 1)]
    texts += texts[:3]
    want = brute(texts, length)
    assert [(a, b, c, bytes(d)) for a, b, c, d in run(spark, texts, length)] == want
    monkeypatch.setattr(m, "PIECE", 50)
    assert [(a, b, c, bytes(d)) for a, b, c, d in run(spark, texts, length)] == want


def test_wide_anchors_are_counted_by_window(spark, monkeypatch):
    rng = random.Random(6)
    middle = "in the end it was all the same to me"
    texts = ["".join(rng.choice("ab") for _ in range(4)) + middle + "".join(rng.choice("ab") for _ in range(4)) + f" own{k}" for k in range(150)]
    asked = []
    plain = m._shared_segments
    monkeypatch.setattr(m, "_shared_segments", lambda length, run, bloom, wide=None: asked.append(wide) or plain(length, run, bloom, wide))
    monkeypatch.setattr(m, "ARRAY_BYTES", 400)
    assert [(a, b, c, bytes(d)) for a, b, c, d in run(spark, texts, 40)] == brute(texts, 40)
    assert any(w is not None for w in asked)


def test_rows_and_columns(spark, monkeypatch):
    text = "The same words again. " * 40
    rows = [(None, text, "a", 1), (1, text, "b", 2), (1, text, "c", 3), (2, None, "d", 4), (3, "short", "e", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, seg string, n_bytes int")
    for limit in (m.BROADCAST_IDS, 0):
        monkeypatch.setattr(m, "BROADCAST_IDS", limit)
        out = remove_shared_bytes(df)
        assert out.columns == ["doc_id", "text", "seg", *m.ADDED]
        assert sorted((r.seg, r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in out.collect()) == [
            ("a", None, 880, 880, 1, b""), ("b", 1, 880, 880, 1, b""), ("c", 1, 880, 880, 1, b""), ("d", 2, 0, 0, 0, b""), ("e", 3, 5, 0, 0, b"short")]
    assert remove_shared_bytes(df.limit(0)).count() == 0


def test_very_long_text(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    texts = [" ".join(words), " ".join(words[:1000]), "x" * 300_000, " ".join(words[50_000:50_100])]
    got = run(spark, texts, 400)
    assert [x[:3] for x in got] == [(len(texts[0]), len(texts[1]) + len(texts[3]) + got[0][1] - len(texts[1]) - len(texts[3]), 2), (len(texts[1]), len(texts[1]), 1), (300_000, 300_000, 1), (len(texts[3]), len(texts[3]), 1)]
    assert len(texts[1]) + len(texts[3]) <= got[0][1] <= len(texts[1]) + len(texts[3]) + 4


def test_query_against_counting(spark):
    from tidemark.llm.queries import op12_bytes

    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    want = {r.doc_id: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for r, x in zip(rows, brute([r.text for r in rows], 400), strict=True)}
    assert {r[0]: tuple(r[1:]) for r in op12_bytes(spark, d).collect()} == want
    assert sum(x[1] > 0 for x in want.values()) > 5

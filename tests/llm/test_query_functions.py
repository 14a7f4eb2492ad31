"""The query functions that have no SQL, against plain versions on the smallest tables."""

import math
import zlib
from collections import Counter

import numpy as np
from brute import base_scores
from pyspark.sql import functions as F

from tidemark.llm import queries
from tidemark.llm.language import STRETCH, _fold, training_texts
from tidemark.llm.token_counts import _encoding

D = "/root/testdata/sf0.001"


def phrases(text, model):
    """Longest pieces of a folded text that stand in another, stretch by stretch, each taken greedily."""
    text, n = _fold(text), 0
    for a in range(0, len(text), STRETCH):
        part = text[a : a + STRETCH]
        i = 0
        while i < len(part):
            size = 1
            while i + size < len(part) and part[i : i + size + 1] in model:
                size += 1
            i, n = i + size, n + 1
    return n


def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{D}/documents.parquet").collect()}


def test_language(spark):
    docs = documents(spark)
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs}
    got = {r.doc_id: r for r in queries.op2_language(spark, D).collect()}
    assert set(got) == set(docs) and all(r.held_out == held[i] and 0 <= r.score <= 1 for i, r in got.items())
    known = [i for i, r in docs.items() if held[i] and r.lang is not None and got[i].lang_pred != "und"]
    assert sum(got[i].lang_pred == docs[i].lang for i in known) >= 0.95 * len(known) > 10
    learnt = spark.read.parquet(f"{D}/documents.parquet").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    texts = training_texts(learnt.select("doc_id", "text", "lang"))
    compared = 0
    for i in list(docs)[:25]:
        costs = sorted((phrases(docs[i].text or "", t) * math.log(max(2, len(t))), k) for k, t in texts)
        if got[i].lang_pred != "und" and costs[0][0] < 0.99 * costs[1][0]:
            assert got[i].lang_pred == costs[0][1], i
            assert abs(got[i].score - (1 - costs[0][0] / costs[1][0])) < 0.1, i  # the plain version folds and cuts a little differently
            compared += 1
    assert compared > 10


def test_language_model(spark):
    docs = documents(spark)
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    want = base_scores([(i, r.text) for i, r in docs.items()], held)
    got = {r.doc_id: r for r in queries.op4_brown(spark, D).collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        n, known, train, base = want[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, n, known, train) and abs(r.base_score - base) < 1e-6 * max(1, abs(base))
    tokens = sum(got[i].n_tokens for i in held)
    assert all(r.score < 0 for r in got.values()) and sum(got[i].score for i in held) > sum(got[i].base_score for i in held) and tokens > 100


def test_token_counts(spark):
    encoder, _ = _encoding(open(f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb").read())
    docs = documents(spark)
    got = {r.doc_id: r for r in queries.op5_token_counts(spark, D).collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        text = docs[i].text or ""
        pieces = encoder.decode_tokens_bytes(encoder.encode_ordinary(text))
        starts = np.cumsum([0] + [len(p) for p in pieces])[:-1]
        line = [0]
        for b in text.encode():
            line.append(line[-1] + (b == 10))
        owners = Counter(line[s] for s in starts.tolist())
        assert r.n_tokens == len(pieces) == sum(r.section_tokens) and r.n_sections == len(r.section_tokens)
        assert [n for n in r.section_tokens if n] == [owners[k] for k in sorted(owners)], i


def test_nearest_neighbours(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{D}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    matrix = np.stack([rows[i] for i in ids])
    got = {}
    for r in queries.op8_ann(spark, D).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in rows if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        found.sort()
        score = matrix @ rows[q]
        best = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist(), strict=True) if i != q)[:20]
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(s - rows[q] @ rows[j]) < 1e-9 for _, j, s in found)
        hits += len({j for _, j in best} & {j for _, j, _ in found})
    assert hits >= 0.9 * 20 * len(got)

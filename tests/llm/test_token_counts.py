import random

import pytest

from tidemark.llm.queries import TOKENIZERS
from tidemark.llm.token_counts import RULES, _encoding, attribute_tokens

PATH = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


def brute(text, spans, rule):
    encoder, _ = _encoding(open(PATH, "rb").read())
    owner = []  # token of each byte
    sizes = []
    for k, piece in enumerate(encoder.decode_tokens_bytes(encoder.encode_ordinary(text))):
        owner += [k] * len(piece)
        sizes.append(len(piece))
    first = [sum(sizes[:k]) for k in range(len(sizes))]
    byte = [len(text[:i].encode()) for i in range(len(text) + 1)]
    out, crossing = [], set()
    for a, b in spans:
        a, b = byte[min(max(a, 0), len(text))], byte[min(max(b, 0), len(text))]
        inside = set(range(a, b))
        point = {"start": 0, "end": 1, "middle": 0.5}
        n = 0.0
        for k, s in enumerate(sizes):
            own = set(range(first[k], first[k] + s))
            if rule == "split":
                n += len(own & inside) / s
            else:
                at = {"start": first[k], "end": first[k] + s - 1, "middle": (2 * first[k] + s - 1) // 2}[rule]
                n += at in inside
            if any(first[k] < x < first[k] + s for x in (a, b)):
                crossing.add(k)
        out.append(n)
    return len(sizes), len(crossing), out


@pytest.mark.parametrize("rule", RULES)
def test_rules_against_brute_force(spark, rule):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        text = "".join(rng.choice(["the ", "Tion", "é", "日本", "\n", "\n\n", " ", "1234", "!?", "\U0001f600", "ing"]) for _ in range(rng.randint(0, 40)))
        spans = []
        for _ in range(rng.randint(0, 5)):
            a = rng.randint(-2, 60)
            spans.append((a, a + rng.randint(0, 40)))
        rows.append((i, text, spans, 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<start:int,end:int>>, n_tokens int")
    for r in attribute_tokens(df, PATH, rule, "parts").collect():
        n, crossing, counts = brute(r.text, [tuple(x) for x in r.parts], rule)
        assert (r.n_tokens, r.n_crossing) == (n, crossing)
        assert all(abs(a - b) < 1e-9 for a, b in zip(r.section_tokens, counts, strict=True))


def test_lines_and_edges(spark):
    rows = [(1, "one line"), (2, None), (3, ""), (4, "a b\n\nc d\n"), (5, "x" * 200_000 + "\nend"), (None, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rule in RULES:
        got = {r.doc_id: r for r in attribute_tokens(df, PATH, rule).collect()}
        assert got[2].n_tokens is None and got[2].section_tokens is None
        assert got[3].n_tokens == 0 and got[3].section_tokens == [0.0]
        assert len(got[4].section_tokens) == 3 and len(got[5].section_tokens) == 2
        for i in (1, 4, 5, None):
            assert abs(sum(got[i].section_tokens) - got[i].n_tokens) < 1e-6
    assert attribute_tokens(df.limit(0), PATH).count() == 0
    none = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    assert attribute_tokens(none, PATH, sections="parts").first().section_tokens == []

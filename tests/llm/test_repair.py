import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest

import tidemark.llm.repair as m
from tidemark.llm.repair import joined, parse, repair

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAME = {"u": "user", "a": "assistant"}


def plain(rows):
    """Cheapest edits by trying all, turn by turn: (cost, audit, repaired) of (role, text, fault) rows."""
    best = {"": (0, "", ())}

    def inserted(best):
        out = dict(best)
        for _ in range(3):
            for state, (cost, audit, said) in list(out.items()):
                for x in "ua":
                    to = NEXT.get((state, x))
                    value = cost + 5, audit + "I", (*said, (NAME[x], ""))
                    if to and (to not in out or value[:2] < out[to][:2]):
                        out[to] = value
        return out

    for role, text, fault in rows:
        new = {}
        for state, (cost, audit, said) in inserted(best).items():
            ways = [(state, cost + 2, audit + "D", said)]
            if fault not in "bd":
                more = 5 * (fault == "t")
                if (state, role[:1]) in NEXT:
                    ways.append((role[:1], cost + more, audit + "K", (*said, (role, text))))
                ways += [(x, cost + more + 1, audit + "R", (*said, (NAME[x], text))) for x in "ua" if (state, x) in NEXT]
            for to, *value in ways:
                if to not in new or tuple(value[:2]) < new[to][:2]:
                    new[to] = tuple(value)
        best = new
    return min((v for s, v in inserted(best).items() if s in ("", "a")), key=lambda v: v[:2])


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else " ")
        seen.add((role, text))
    return out


def expected(rows):
    """rows (turn, role, text) of one conversation after damage -> the result row and the repaired text."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    fault = faults([x[1:] for x in rows])
    known = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, said = plain([(r, x, f) for (_, r, x), f in zip(rows, fault, strict=True)])
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(fault.count(k) for k in "bdt"), illegal, cost, audit, "\n".join(f"{r}:{x}" for r, x in said))


def results(spark, rows):
    found, turns = repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    text = defaultdict(list)
    for r in turns.orderBy("conv_id", "part", "block", "at", "k").collect():
        text[r.conv_id].append(f"{r.role}:{r.text}")
    return {r[0]: (*r[1:], "\n".join(text[r[0]])) for r in found.collect()}


def test_every_short_conversation():
    kinds = [("s", " "), ("u", " "), ("a", " "), ("u", "t"), ("a", "b"), ("x", " ")]
    for n in range(5):
        for rows in product(kinds, repeat=n):
            ways = [(0, leave, cost, audit) for leave, cost, audit, _ in parse(tuple((r, f, 1) for r, f in rows), 0)]
            cost, audit, _, _ = joined([ways])
            assert (cost, audit) == plain([(r, "", f) for r, f in rows])[:2], rows


@pytest.mark.parametrize("stretch, partitions", [(512, 1), (3, 4), (1, 3)])
def test_against_plain(spark, monkeypatch, stretch, partitions):
    monkeypatch.setattr(m, "STRETCH", stretch)
    rng = random.Random(stretch)
    rows = []
    for conv in [None, *range(40)]:
        for _ in range(rng.choice([1, 3, 8, 25]) if conv != 7 else 150):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            rows.append((conv, rng.choice([None, *range(12)]), role, rng.choice(["Yes.", "No", " ", "", "Why? \n", "So!", None, f"Text {rng.randrange(30)}."])))
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = results(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    by = defaultdict(list)
    for c, *x in rows:
        by[c].append(tuple(x))
    assert got == {c: expected(x) for c, x in by.items()}


def test_one_large_conversation_is_many_stretches(spark):
    rng = random.Random(5)
    rows = [(1, k, rng.choice(["user", "assistant"]), f"Said {rng.randrange(10**9)}.") for k in range(4000)]
    got = results(spark, rows)
    assert got == {1: expected([r[1:] for r in rows])}


def test_copies_and_no_rows(spark):
    rows = [(1, 0, "user", "Hi.")] * 3 + [(1, 1, "assistant", "Yes.")] + [(2, None, "user", " ")] * 2
    assert results(spark, rows) == {1: expected([r[1:] for r in rows[:4]]), 2: expected([r[1:] for r in rows[4:]])}
    assert results(spark, []) == {}
    extra = spark.createDataFrame([(1, 0, "user", "Hi.", "z", 3)], "conv_id long, turn long, role string, text string, fault string, copies int")
    assert repair(extra)[0].first()["audit"] == "D"
    assert results(spark, [(1, 0, "user", "x" * 1_000_000), (1, 1, "assistant", "y" * 1_000_000 + ".")])[1][:7] == (0, 0, 0, 1, 0, 4, "DD")


def test_query_against_plain(spark):
    from tidemark.llm.queries import op13_repair

    d = "/root/testdata/sf0.001"
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{d}/conversations.parquet").collect():
        h = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        role, text = "user" if h == 4 else r.role, "" if h == 1 else re.sub("[.!?]", "", r.text) if h == 2 else r.text
        rows[r.conv_id] += [(r.turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    want = {c: expected(x) if x else (0,) * 6 + ("", "") for c, x in rows.items()}
    want = {c: (*x[:7], hashlib.sha256(x[7].encode()).hexdigest()) for c, x in want.items()}
    assert {r[0]: tuple(r[1:]) for r in op13_repair(spark, d).collect()} == want

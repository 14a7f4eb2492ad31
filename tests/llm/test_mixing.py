import math
import random
from collections import Counter, defaultdict

from tidemark.llm.mixing import entropy, exponent_for_entropy, exponent_for_repeats, mix_sources, weights

SCHEMA = "doc_id long, text string, source string, n_chars long, pass string, s string"


def rows():
    rng = random.Random(8)
    out = []
    for i in range(900):
        src = rng.choice(["a"] * 6 + ["b"] * 2 + ["c", None])
        out.append((i, " ".join(["w"] * rng.randint(0, 60)), src, 1, "p", "s"))
    return out + [(1000, None, "a", 0, "", ""), (1001, " \n", "empty", 2, "", ""), (1002, None, "null only", 0, "", "")]


def uses(df):
    return Counter(r.doc_id for r in df.collect())


def check_budget(got, all_rows, repeats, blocks=None):
    tokens, used, size = Counter(), Counter(), defaultdict(int)
    for i, t, s, *_ in all_rows:
        n = len((t or "").split())
        tokens[s] += n
        used[s] += n * got[i]
        size[s] = max(size[s], n)
    w = weights(tokens, exponent_for_repeats(tokens, repeats))
    total = max(v / w[k] for k, v in tokens.items() if v)
    for k, v in tokens.items():
        assert abs(used[k] - w[k] * total) <= size[k] + 1, k


def test_budgets_and_whole_passes(spark, monkeypatch):
    import tidemark.llm.mixing as m

    for block in (200_000, 300):
        monkeypatch.setattr(m, "BLOCK_TOKENS", block)
        df = mix_sources(spark.createDataFrame(rows(), SCHEMA).repartition(3), repeats=2.5)
        got = uses(df)
        assert df.columns == ["doc_id", "text", "source", "n_chars", "s", "pass", "block", "place"]
        assert set(got) == {r[0] for r in rows()} and max(got.values()) == 3
        check_budget(got, rows(), 2.5)
        assert uses(mix_sources(spark.createDataFrame(rows()[::-1], SCHEMA), repeats=2.5)) == got


def test_budget_below_a_pass(spark):
    got = uses(mix_sources(spark.createDataFrame(rows(), SCHEMA), entropy_share=0.95, budget=3000))
    n = sum(len((t or "").split()) * got[i] for i, t, *_ in rows())
    assert abs(n - 3000) <= 5 * 61


def test_exponents():
    tokens = {"a": 9000, "b": 500, "c": 100, "d": 0}
    x = exponent_for_entropy(tokens, 0.9)
    assert 0 < x < 1 and abs(entropy(weights(tokens, x)) - 0.9 * math.log(3)) < 1e-9
    assert exponent_for_entropy({"a": 1, "b": 1}, 0.9) == 1.0
    y = exponent_for_repeats(tokens, 4)
    w = weights(tokens, y)
    assert abs((w["c"] / 100) / (w["a"] / 9000) - 4) < 1e-6
    assert exponent_for_repeats(tokens, 1e9) == 0 and exponent_for_repeats({}, 2) == 1


def test_edges(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mix_sources(spark.createDataFrame([(1, None, "a", 0, "", ""), (1, "", None, 0, "", "")], SCHEMA)).count() == 2
    assert uses(mix_sources(spark.createDataFrame([(1, "a b", None, 0, "", "")] * 2 + [(None, "x", "q", 1, "", "")], SCHEMA), repeats=1)) == {1: 2, None: 1}


def test_a_repetition_limit_goes_before_the_entropy():
    import math

    from tidemark.llm.mixing import exponent_for_entropy, exponent_for_repeats, weights

    tokens = {"a": 10**9, "b": 8 * 10**8, "c": 50}
    alone = weights(tokens, exponent_for_entropy(tokens, 0.97))
    assert (alone["c"] / 50) / (alone["a"] / 10**9) > 10**6
    both = weights(tokens, max(exponent_for_entropy(tokens, 0.97), exponent_for_repeats(tokens, 16.0)))
    assert math.isclose((both["c"] / 50) / (both["a"] / 10**9), 16.0, rel_tol=1e-6)


def test_places_follow_passes_and_permute_blocks(spark):
    rows = [(i, "w " * 50, "big" if i % 4 else "small") for i in range(800)]
    import tidemark.llm.mixing as m

    held, m.BLOCK_TOKENS = m.BLOCK_TOKENS, 500
    try:
        out = m.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), repeats=2.5).collect()
    finally:
        m.BLOCK_TOKENS = held
    assert all(0 <= r.place <= 1 for r in out)
    ends = {}
    for r in out:
        ends.setdefault((r.source, r["pass"]), []).append((r.place, r.block))
    assert max(ends["small", 0])[0] <= min(ends["small", 1])[0]
    order = lambda p: [b for _, b in sorted(set(ends["small", p]))]
    assert sorted(order(0)) == sorted(order(1)) and order(0) != order(1) and order(0) != sorted(order(0))


def plain(rows, epochs, blocks, budget, hash_of, turn_of):
    """(doc_id, pass) of every use, document by document: whole passes, then the blocks of a permutation up to the budget, cut by hashes."""
    out = Counter()
    for src, own in rows.items():
        whole = math.floor(epochs[src] + 1e-9)
        for i, _ in own:
            for k in range(whole):
                out[i, k] += 1
        by = defaultdict(list)
        for i, n in own:
            by[hash_of[i, "block"] % blocks[src]].append((hash_of[i, "h"], i, n))
        before = 0
        for block in sorted(by, key=lambda b: (turn_of[b], b)):
            for _, i, n in sorted(by[block]):
                if before < budget[src]:
                    out[i, whole] += 1
                before += n
    return out


def test_uses_equal_a_plain_version(spark, monkeypatch):
    import tidemark.llm.mixing as m
    from pyspark.sql import functions as F

    monkeypatch.setattr(m, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(m, "STRETCH_BITS", 2)
    own = [(i, " ".join(["w"] * (1 + i * 7 % 50)), "abc"[i % 6 % 3] if i % 4 else "a", 1, "p", "s") for i in range(600)]
    df = spark.createDataFrame(own, SCHEMA)
    h = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit(17))
    hash_of = {}
    for r in df.select("doc_id", h.alias("h"), F.xxhash64(h, F.lit(1)).alias("b")).collect():
        hash_of |= {(r.doc_id, "h"): r.h, (r.doc_id, "block"): r.b}
    turn_of = {r.id: r.t for r in spark.range(1000).select("id", F.xxhash64("id", F.lit(17)).alias("t")).collect()}
    by, tokens = defaultdict(list), Counter()
    for i, t, s, *_ in own:
        by[s].append((i, len(t.split())))
        tokens[s] += len(t.split())
    x = max(exponent_for_entropy(tokens, 0.99999), exponent_for_repeats(tokens, 4.0))
    w = weights(tokens, x)
    total = max(v / w[k] for k, v in tokens.items())
    epochs = {k: w[k] * total / tokens[k] for k in tokens}
    budget = {k: round((epochs[k] - math.floor(epochs[k] + 1e-9)) * tokens[k]) for k in tokens}
    got = mix_sources(df, entropy_share=0.99999, most_repeats=4.0).collect()
    want = plain(by, epochs, {k: max(1, v // 300) for k, v in tokens.items()}, budget, hash_of, turn_of)
    assert x < 1 and Counter((r.doc_id, r["pass"]) for r in got) == want
    assert all(r.block == hash_of[r.doc_id, "block"] % max(1, tokens[r.source] // 300) for r in got)
    ends = defaultdict(set)
    for r in got:
        ends[r.source, r["pass"], r.block].add(r.place)
    assert all(len(v) == 1 for v in ends.values())  # a block of a pass stands in one place
    for (s, k, _), v in ends.items():
        assert k / max(epochs[s], k + 1) - 1e-9 <= min(v) <= 1


def test_query_mixes_at_every_size(spark):
    from tidemark.llm.queries import op7_mixing

    for sf in ("sf0.001", "sf0.01"):
        rows = op7_mixing(spark, f"/root/testdata/{sf}").collect()
        times = Counter(r.doc_id for r in rows)
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        assert set(times) == {r.doc_id for r in docs.select("doc_id").collect()} and max(times.values()) > 1
        tokens = Counter()
        for r in docs.select("source", "text").collect():
            tokens[r.source] += len((r.text or "").split())
        assert max(exponent_for_entropy(tokens, 0.99999), exponent_for_repeats(tokens, 4.0)) < 0.9

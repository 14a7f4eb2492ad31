import hashlib
import random
import re

from tidemark.llm.chat import CLOSE, MARKS, STRETCH, TOKEN, format_windows, read_back

SCHEMA = "conv_id long, turn long, role string, text string"


def rows():
    rng = random.Random(6)
    bits = ["</s>", "[INST]", "<s>", "[/INST]", "~", "~1", "~0s>", "<<SYS>>", "<</SYS>>", " ok ", "é", "\n", "<", "[", "word " * 30, "\U0001f600"]
    out = []
    for c in range(40):
        for t in range(rng.randint(1, 30)):
            role = "system" if t == 0 and c % 3 else rng.choice(["user", "assistant", "tool [INST]", None])
            out.append((c, t if c % 5 else t // 2, role, rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))])))
    out += [(90, t, "user" if t % 2 == 0 else "assistant", f"turn {t} " * 5) for t in range(400)]
    out += [(91, 0, "system", "only")] + [(None, None, "assistant", "x"), (None, None, "assistant", "x"), (None, 1, "assistant", "y" * 100_000)]
    return out


def ordered(all_rows):
    conv = {}
    for c, t, r, x in all_rows:
        conv.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(own)] for c, own in conv.items()}


def test_round_trip_masks_and_budget(spark):
    want = ordered(rows())
    windows = format_windows(spark.createDataFrame(rows(), SCHEMA), budget=256, history_turns=2, history_tokens=64).cache()
    back = {r.conv_id: r for r in read_back(windows).collect()}
    assert set(back) == set(want)
    for c, turns in want.items():
        assert back[c].n_turns == len(turns)
        assert back[c].turns == "".join(f"{r}\n{x}\n" for r, x in turns)
        assert back[c].loss == "".join(x for r, x in turns if r == "assistant")
    by = {}
    for w in windows.collect():
        by.setdefault(w.conv_id, []).append(w)
        parts = w.formatted.split(CLOSE)[:-1]
        assert len(parts) == w.n_repeated + w.n_new and w.n_repeated <= 3
        assert all(0 <= s.start and s.start + s.length <= len(w.formatted) for s in w.loss_spans)
        if want[w.conv_id][0][0] == "system":
            assert parts[0].startswith("<s>[INST] system [/INST] ")
        assert not w.over_budget or w.conv_id is None or w.conv_id < 90
    long = sorted(by[90], key=lambda w: w.window)
    assert len(long) > 20 and all(w.n_repeated == 2 for w in long[1:]) and not any(w.over_budget for w in long)


def plain(sizes, system, budget, turns, most):
    """Sizes of one conversation's turns -> (first new turn, first repeated turn, last turn), counted from 1, turn by turn."""
    at = [0]
    for n in sizes:
        at.append(at[-1] + n)
    lead = 1 if system else 0
    shift = at[lead]
    out, first = [], 1
    while first <= len(sizes):
        start = 0 if first <= lead else at[first - 1] - shift
        low = first
        while first > lead and low - 1 > lead and first - low < turns and at[first - 1] - at[low - 2] <= most and at[first] - at[low - 2] + system <= budget:
            low -= 1
        used = system + (0 if first <= lead else sizes[first - 1]) + (at[first - 1] - at[low - 1])
        last = first
        while last < len(sizes) and used + sizes[last] <= budget and (at[last] - shift) // (STRETCH * budget) == start // (STRETCH * budget):
            used += sizes[last]
            last += 1
        out.append((first, low, last))
        first = last + 1
    return out


def test_windows_are_filled_up_to_the_budget(spark):
    rng = random.Random(66)
    more = [(1000 + c, t, "system" if t == 0 and c % 2 else "user", "w " * rng.randint(0, 90 if c % 7 else 9)) for c in range(30) for t in range(rng.randint(1, 60))]
    more += [(2000, t, "assistant", "w " * (t % 40)) for t in range(900)]
    given = rows() + more
    for budget, turns, most in ((256, 2, 64), (64, 1, 64), (100, 0, 0), (40, 5, 1000)):
        got = {}
        for w in format_windows(spark.createDataFrame(given, SCHEMA), budget, turns, most).collect():
            got.setdefault(w.conv_id, []).append((w.window, w.n_repeated, w.n_new, w.tokens, w.over_budget))
        for c, own in ordered(given).items():
            sizes = [len(re.findall(TOKEN, x)) + MARKS for _, x in own]
            system = sizes[0] if own[0][0] == "system" else 0
            want = []
            for first, low, last in plain(sizes, system, budget, turns, most):
                again = system > 0 and first > 1
                total = sum(sizes[low - 1 : last]) + (system if again else 0)
                want.append((first, first - low + again, last - first + 1, total, total > budget))
                assert total <= budget or last == first == low
            assert sorted(got[c]) == want


def test_given_token_counts_and_clashing_columns(spark):
    given = [(1, t, "user", "x", n, "c", 7) for t, n in enumerate((10, None, -5, 50, 50))]
    df = spark.createDataFrame(given, SCHEMA + ", tokens int, c string, window int")
    got = sorted((w.window, w.n_repeated, w.n_new, w.tokens) for w in format_windows(df, 64, 0, 0, tokens="tokens").collect())
    assert got == [(1, 0, 3, 22), (4, 0, 1, 54), (5, 0, 1, 54)]
    assert {r.n_turns for r in read_back(format_windows(df)).collect()} == {5}


def test_empty(spark):
    assert read_back(format_windows(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query_equals_sql(spark):
    import duckdb

    from tidemark.llm.queries import ORACLE_SQL, QUERIES

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{d}/conversations.parquet'")
    want = {tuple(r) for r in con.execute(ORACLE_SQL["op6_chat"]).fetchall()}
    got = {tuple(r) for r in QUERIES["op6_chat"](spark, d).collect()}
    assert got == want
    assert hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest() in {r[4] for r in got if r[0] == -7}

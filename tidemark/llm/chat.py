"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens choose turn-aligned windows: a window takes turns
until the next one would pass what the budget leaves after the leading system
turn and the window's history.  Each window repeats the system turn and a
limited history, and its loss mask covers the texts of assistant turns that
are new in it, so every assistant text is a target once.

Prefix sums are taken in two levels (inside blocks of turn numbers, then over
blocks), and windows are chosen inside stretches of STRETCH budgets of tokens,
from positions and sums without texts.  A window ends where its stretch ends;
conversations of fewer tokens than a stretch are one stretch.  So one very
long conversation is many tasks' work; what meets in one row is the numbers of
one stretch (every turn has MARKS tokens or more) or the texts of one window.

A turn is written ``<s>[INST] role [/INST] text</s>``.  Inside roles and texts
``~`` becomes ``~0``, and the first character of a control string becomes
``~1`` (for ``<``) or ``~2`` (for ``[``), which unescape() reverses.

Defined results: null text and null role are empty; turns of one conversation
are ordered by turn (nulls first), then role, then text, and equal rows are
separate turns; a null conv_id is a conversation of its own; history is left
out, oldest turn first, where a window's first new turn would not fit beside
it; a turn that does not fit beside the system turn is a window of its own,
whose over_budget is then true, and no other window's is; null or negative
token counts of a given column count 0; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import staged

BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 1024, 2, 256
#: Turn numbers of one block of prefix sums, and budgets of tokens of one stretch.
BLOCK, STRETCH = 64, 16
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"
#: Control strings of the template, as a pattern by their first character.
CONTROL = {"<": r"<(?=/?s>|</?SYS>>)", "[": r"\[(?=/?INST\])"}
TOKEN = r"[0-9A-Za-z_]+|[^0-9A-Za-z_\x00-\x20]"
#: Tokens of the marks around a turn.
MARKS = 4


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("~"), F.lit("~0"))
    return F.regexp_replace(F.regexp_replace(text, CONTROL["<"], "~1"), CONTROL["["], "~2")


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("~1"), F.lit("<")), F.lit("~2"), F.lit("["))
    return F.replace(text, F.lit("~0"), F.lit("~"))


def format_windows(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS, tokens: str | None = None) -> DataFrame:
    """turns (conv_id, turn, role, text) -> conv_id, window, formatted, loss_spans, n_repeated, n_new, tokens, over_budget.

    loss_spans holds (start, length) in characters of formatted.  The first
    n_repeated turns of a window are the system turn and history it repeats;
    window is the place of its first new turn.  tokens names a column with the
    tokens of each text; without it, words and marks (TOKEN) are counted.
    """
    counted = F.regexp_count("text", F.lit(TOKEN)) if tokens is None else F.greatest(F.coalesce(F.col("given").cast("long"), F.lit(0)), F.lit(0))
    rows = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("c"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).alias("block"),
        (F.lit(0) if tokens is None else F.col(tokens)).alias("given"),
    ).withColumn("tokens", counted + MARKS).drop("given")
    order = [F.col("turn").asc_nulls_first(), "role", "text", "tokens"]
    rows = rows.withColumn("in_block", F.row_number().over(Window.partitionBy("c", "block").orderBy(*order)))
    rows = rows.withColumn("sum_block", F.sum("tokens").over(Window.partitionBy("c", "block").orderBy("in_block")))
    totals = rows.groupBy("c", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("c", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"))
    placed = rows.join(totals, ["c", "block"]).withColumn("pos", F.col("n0") + F.col("in_block")).withColumn("start", F.col("t0") + F.col("sum_block") - F.col("tokens"))

    # Written once: windows read its numbers, only the last joins read its texts.
    placed = staged(placed.select("c", "conv_id", "pos", "role", "text", "tokens", "start"), "turns")

    leads = (F.col("pos") == 1) & (F.col("role") == "system")
    system = placed.where(leads).select("c", F.col("tokens").alias("system_tokens"))
    placed = placed.join(system, "c", "left").withColumn("system_tokens", F.coalesce("system_tokens", F.lit(0)))
    placed = placed.withColumn("start", F.when(leads, 0).otherwise(F.col("start") - F.col("system_tokens")))
    placed = placed.select("c", "conv_id", "pos", "role", "text", "tokens", "start", leads.alias("leads"), (F.lit(budget) - F.col("system_tokens")).alias("room"))

    firsts = _windows(placed, budget, history_turns, history_tokens)
    members = firsts.select("c", "window", F.explode(F.sequence("from", "last")).alias("pos"))
    whole = members.join(placed, ["c", "pos"]).select("c", "conv_id", "window", "pos", "role", "text", "tokens", (F.col("pos") >= F.col("window")).alias("new"))
    again = firsts.where("window > 1").join(placed.where("leads"), "c").select("c", "conv_id", "window", F.lit(0).cast("long").alias("pos"), "role", "text", "tokens", F.lit(False).alias("new"))
    whole = whole.unionByName(again)

    whole = whole.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))).withColumn("body", escape(F.col("text")))
    inside = Window.partitionBy("c", "window").orderBy("pos")
    length = F.char_length("head") + F.char_length("body") + len(CLOSE)
    whole = whole.withColumn("at", F.sum(length).over(inside) - length)
    target = F.col("new") & (F.col("role") == "assistant")
    span = F.when(target, F.struct((F.col("at") + F.char_length("head")).cast("int").alias("start"), F.char_length("body").cast("int").alias("length")))
    segment = F.struct("pos", F.concat("head", "body", F.lit(CLOSE)).alias("text"), span.alias("span"))
    out = whole.groupBy("c", "window").agg(
        F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(segment)).alias("s"),
        F.count_if(~F.col("new")).cast("int").alias("n_repeated"), F.count_if("new").cast("int").alias("n_new"), F.sum("tokens").alias("tokens"))
    spans = F.filter(F.transform("s", lambda x: x["span"]), lambda x: x.isNotNull())
    return out.select("conv_id", "window", F.array_join(F.transform("s", lambda x: x["text"]), "").alias("formatted"), spans.alias("loss_spans"),
                      "n_repeated", "n_new", "tokens", (F.col("tokens") > budget).alias("over_budget"))


def _windows(placed: DataFrame, budget: int, history_turns: int, history_tokens: int) -> DataFrame:
    """Placed turns -> c, window (place of the first new turn), from (place of the first turn of its history), last."""
    size = STRETCH * budget
    stretch = F.floor(F.col("start") / size)
    # What a later stretch may repeat starts this near to the end of its own.
    near = F.col("start") - stretch * size >= size - history_tokens
    seen = F.when(near & ~F.col("leads"), F.array(stretch, stretch + 1)).otherwise(F.array(stretch))
    end = F.when(F.col("leads"), 0).otherwise(F.col("start") + F.col("tokens"))
    turn = F.struct("pos", "start", end.alias("end"), "leads", "room", (F.col("stretch") == stretch).alias("own"))
    held = placed.select("c", "pos", "start", "tokens", "leads", "room", F.explode(seen).alias("stretch"))
    held = held.groupBy("c", "stretch").agg(F.array_sort(F.collect_list(turn)).alias("s"))

    def with_history(x: Column, i: Column) -> Column:
        last = F.slice("s", F.greatest(i + 1 - history_turns, F.lit(1)), F.least(i, F.lit(history_turns)))
        most = F.least(F.lit(history_tokens).cast("long"), x["room"] - (x["end"] - x["start"]))
        kept = F.filter(last, lambda y: ~y["leads"] & (x["start"] - y["start"] <= most))
        base = F.when(F.size(kept) > 0, kept[0]["start"]).otherwise(x["start"])
        return F.struct(x["pos"].alias("pos"), x["end"].alias("end"), x["own"].alias("own"), (x["pos"] - F.size(kept)).alias("from"), (base + x["room"]).alias("limit"))

    def step(acc: Column, x: Column) -> Column:
        opened = F.concat(acc["w"], F.array(F.struct(x["pos"].alias("window"), x["from"].alias("from"))))
        fresh = F.struct(x["limit"].alias("limit"), opened.alias("w"))
        return F.when(x["end"] <= acc["limit"], acc).otherwise(fresh)

    none = F.struct(F.lit(-(1 << 62)).cast("long").alias("limit"), F.lit([]).cast("array<struct<window:bigint,from:bigint>>").alias("w"))
    turns = F.filter(F.transform("s", with_history), lambda x: x["own"])
    chosen = held.select("c", turns.alias("t")).where(F.size("t") > 0)
    chosen = chosen.select("c", F.element_at("t", -1)["pos"].alias("end"), F.aggregate("t", none, step)["w"].alias("w"))
    ends = F.transform("w", lambda x, i: F.struct(x["window"].alias("window"), x["from"].alias("from"), F.coalesce(F.get("w", i + 1)["window"] - 1, F.col("end")).alias("last")))
    return chosen.select("c", F.inline(ends))


def read_back(windows: DataFrame) -> DataFrame:
    """Windows -> conv_id, n_turns, turns (role, \\n, text, \\n for each new turn, in order), loss (text under the masks), formatted_chars."""
    segments = F.split("formatted", CLOSE, -1)
    segments = F.slice(segments, F.col("n_repeated") + 1, F.size(segments) - 1 - F.col("n_repeated"))
    middle = MIDDLE.replace("[", r"\[").replace("]", r"\]")
    pair = F.transform(segments, lambda x: F.split(F.substring(x, len(OPEN) + 1, 1 << 30), middle, 2))
    plain = F.transform(pair, lambda x: F.concat(unescape(x[0]), F.lit("\n"), unescape(x[1]), F.lit("\n")))
    loss = F.transform("loss_spans", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["length"])))
    parts = windows.select("conv_id", "window", F.size(segments).alias("n"), F.array_join(plain, "").alias("turns"), F.array_join(loss, "").alias("loss"), F.char_length("formatted").alias("chars"))
    joined = parts.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    text = lambda k: F.array_join(F.transform("w", lambda x: x[k]), "")
    return joined.select("conv_id", "n_turns", text("turns").alias("turns"), text("loss").alias("loss"), "formatted_chars")

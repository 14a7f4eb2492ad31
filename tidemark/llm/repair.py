"""Repair of conversation structure by error-correcting Earley parsing.

The grammar of roles is S -> nothing | B, B -> U A | H U A | B U A, where H is a
system turn, U a user's and A an assistant's.  A turn can be kept where its
role's initial fits, given the role of user or assistant (rerole), or deleted; a
user or assistant turn without text can be inserted anywhere.  Chart items hold
the smallest (cost, audit) that reaches them, the audit being the initials of
the edits so far: two audits of one cost over the same turns never begin one
another, since inserts come before the turn that follows them, so the smaller
of two stays the smaller whatever comes after.  The completed chart gives the
repair.

Conversations may have any number of turns.  Turns are range-partitioned by
conversation and turn, so a large one is many tasks' work.  Each stretch of at
most STRETCH rows is parsed on its own from every state in which the parser can
enter it; the few results of the stretches are put together by conversation, and
each stretch's turns take up the edits that were chosen for it.  Only the audit
of a conversation, which is one value of its row, is put together in one task.

Defined results: a null role or text is one space; a null conv_id is one
conversation; turns with one number, or none, stand in the order of role and
text; equal rows of one turn number are one group of copies; roles whose first
letter is not s, u or a fit nowhere; other columns are left out; no turns, no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import staged
from .words import trimmed

#: Costs of edits; an undeleted truncated turn adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a stretch that is parsed on its own.
STRETCH = 512
#: Stretches up to so many rows are remembered by their roles and faults.
REMEMBERED = 16
RULES = (("S",), ("S", "B"), ("B", "U", "A"), ("B", "H", "U", "A"), ("B", "B", "U", "A"))
INITIAL = {"H": "s", "U": "u", "A": "a"}
#: Items by the state in which a stretch is entered: (rule, dot); nothing said yet, after system, after user, after assistant.
ENTRIES = (((0, 1), (2, 1), (3, 1)), ((3, 2),), ((2, 2),), ((1, 2), (4, 2)))
#: The state that an item stands for at the end of a stretch.
STATE = {(0, 1): 0, (3, 2): 1, (2, 2): 2, (3, 3): 2, (4, 3): 2, (4, 2): 3}
#: What an end of the conversation in each state adds: tokens of inserts.
ENDINGS = ((), ("Iu", "Ia"), ("Ia",), ())


def _closed(column: dict, inserts: bool) -> dict:
    """Completions and, if asked for, inserts of a column; items with the smallest (cost, audit) first."""
    tie = count()
    heap = [(cost, audit, next(tie), item, link) for item, (cost, audit, link) in column.items()]
    heapify(heap)
    done: dict = {}
    while heap:
        cost, audit, _, item, link = heappop(heap)
        if item in done:
            continue
        done[item] = cost, audit, link
        rule, dot = item
        if dot == len(RULES[rule]):
            if RULES[rule][0] == "B":  # what waits for B does so where the stretch began
                for waiting in ((1, 2), (4, 2)):
                    heappush(heap, (cost, audit, next(tie), waiting, link))
        elif inserts and RULES[rule][dot] in "UA":
            token = "I" + INITIAL[RULES[rule][dot]]
            heappush(heap, (cost + INSERT, audit + "I", next(tie), (rule, dot + 1), (link, token)))
    return done


def _scanned(column: dict, initial: str, fault: str, copies: int) -> dict:
    """The next column: each item deletes the turn, keeps it or gives it another role."""
    out: dict = {}

    def put(item, cost, audit, link, token, letter):
        cost, audit = cost + DELETE * (copies - 1), audit + letter + "D" * (copies - 1)
        if item not in out or (cost, audit) < out[item][:2]:
            out[item] = cost, audit, (link, token + ",|")

    for item, (cost, audit, link) in column.items():
        rule, dot = item
        if dot < len(RULES[rule]) or rule < 2:
            put(item, cost + DELETE, audit, link, "D", "D")
        if fault in "bd" or dot == len(RULES[rule]):
            continue
        wanted, more = RULES[rule][dot], TRUNCATED * (fault == "t")
        if initial == INITIAL[wanted]:
            put((rule, dot + 1), cost + more, audit, link, "K", "K")
        if wanted in "UA":
            put((rule, dot + 1), cost + REROLE + more, audit, link, "R" + INITIAL[wanted], "R")
    return out


def parse(rows: tuple[tuple[str, str, int], ...], enter: int) -> list[tuple[int, int, str, list[str]]]:
    """(initial, fault, copies) of each row, the state before them -> (state, cost, audit, tokens by row) after them.

    Faults are b (blank), d (duplicate), t (truncated) or a space.
    """
    column = {item: (0, "", None) for item in ENTRIES[enter]}
    for initial, fault, copies in rows:
        column = _scanned(_closed(column, True), initial, fault, copies)
    best: dict[int, tuple] = {}
    for item, value in _closed(column, False).items():
        state = STATE.get(item)
        if state is not None and (state not in best or value[:2] < best[state][:2]):
            best[state] = value
    out = []
    for state, (cost, audit, link) in sorted(best.items()):
        tokens: list[str] = []
        while link:
            link, token = link
            tokens.append(token)
        script = ",".join(reversed(tokens)).split(",|")
        out.append((state, cost, audit, [x.strip(",") for x in script[: len(rows)]]))
    return out


@lru_cache(1 << 14)
def _remembered(rows: tuple[tuple[str, str, int], ...], enter: int) -> list[tuple[int, int, str, list[str]]]:
    return parse(rows, enter)


def joined(stretches: list[list[tuple[int, int, int, str]]]) -> tuple[int, str, list[tuple[int, int]], tuple[str, ...]]:
    """(enter, leave, cost, audit) of each stretch in turn -> cost, audit, (enter, leave) by stretch, closing inserts."""
    best: dict[int, tuple] = {0: (0, "", None)}
    for ways in stretches:
        reached: dict[int, tuple] = {}
        for enter, leave, cost, audit in ways:
            if enter in best:
                before = best[enter]
                value = before[0] + cost, before[1] + audit
                if leave not in reached or value < reached[leave][:2]:
                    reached[leave] = *value, (before[2], (enter, leave))
        best = reached
    cost, audit, state, path = min((c + INSERT * len(ENDINGS[s]), a + "I" * len(ENDINGS[s]), s, p) for s, (c, a, p) in best.items())
    chosen = []
    while path:
        path, step = path
        chosen.append(step)
    return cost, audit, chosen[::-1], ENDINGS[state]


WAY = "struct<enter:int,leave:int,cost:long,audit:string>"
PARSED = ("conv_id {id}, part int, block int, at int, role string, text string, first string, last string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, "
          f"ways array<{WAY}>, scripts array<array<string>>")  # fmt: skip
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _parsed(kind: pa.DataType):
    """Sorted turns -> the same turns by stretch, and a row for each stretch with what was counted and every way through it."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks, fresh = TaskContext.get().partitionId(), 0, False
        here, held, conv, rows_held = [], [], object(), 0
        way = pa.list_(pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        types = [kind, pa.int32(), pa.int32(), pa.int32(), *[pa.string()] * 4, *[pa.int64()] * 7, way, pa.list_(pa.list_(pa.string()))]
        names = [c.split()[0] for c in PARSED.format(id="long").split(", ")]

        def closed_block():
            nonlocal blocks, here, fresh
            rows = tuple((x[0], x[1], x[2]) for x in here)
            own = _remembered if len(rows) <= REMEMBERED else parse
            ways, scripts = [], []
            # Only the first stretch of a conversation that begins in this task is sure to begin it.
            for enter in (0,) if fresh else (0, 1, 2, 3):
                for leave, cost, audit, script in own(rows, enter):
                    ways.append({"enter": enter, "leave": leave, "cost": cost, "audit": audit})
                    scripts.append(script)
            known = [x[3] for x in here if x[3] is not None]
            seen = {k: 0 for k in COUNTS}
            last = None
            for initial, fault, copies, _, _, _ in here:
                for name, c in (("blank", "b"), ("duplicate", "d"), ("truncated", "t")):
                    seen[name] += fault == c
                seen["blank" if fault == "b" else "duplicate"] += copies - 1
                seen["illegal"] += (last is not None and f"{last}{initial}" not in ("su", "ua", "au")) + copies - 1
                last = initial
            for at, x in enumerate(here):
                held.append((conv, part, blocks, at, x[4], x[5], *[None] * 11))
            held.append((conv, part, blocks, -1, None, None, here[0][0], here[-1][0], min(known, default=None), max(known, default=None), len(set(known)), *seen.values(), ways, scripts))
            blocks, here, fresh = blocks + 1, [], False

        def out():
            nonlocal held, rows_held
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, rows_held = [], 0
            return batch

        begun = False
        for batch in batches:
            for c, turn, role, text, fault, copies in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text", "fault", "copies")), strict=True):
                if here and (c != conv or len(here) >= STRETCH):
                    closed_block()
                if not begun or c != conv:
                    fresh, begun, conv = begun, True, c
                here.append((role[:1], fault, copies, turn, role, text))
                rows_held += len(text) + 100
            if held and rows_held > 4_000_000:
                yield out()
        if here:
            closed_block()
        if held:
            yield out()

    return f


SUMMARY = f"conv_id {{id}}, {', '.join(f'{c} long' for c in ('gaps', *COUNTS, 'cost'))}, audit string, chosen array<struct<part:int,block:int,way:int,ending:string>>"


def _joined(kind: pa.DataType):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = pa.list_(pa.struct([("part", pa.int32()), ("block", pa.int32()), ("way", pa.int32()), ("ending", pa.string())]))
        types = [kind, *[pa.int64()] * 6, pa.string(), step]
        for batch in batches:
            rows = []
            for conv, found in zip(batch.column("conv_id").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
                cost, audit, path, ending = joined([[tuple(w.values()) for w in x["ways"]] for x in found])
                chosen = []
                for x, (enter, leave) in zip(found, path, strict=True):
                    way = next(k for k, w in enumerate(x["ways"]) if (w["enter"], w["leave"]) == (enter, leave))
                    chosen.append({"part": x["part"], "block": x["block"], "way": way, "ending": None})
                chosen[-1]["ending"] = ",".join(ending)
                seen = {k: sum(x[k] for x in found) for k in COUNTS}
                known = [x for x in found if x["low"] is not None]
                turns = sum(x["turns"] for x in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:], strict=False))
                gaps = known[-1]["high"] - known[0]["low"] + 1 - turns if known else 0
                seen["illegal"] += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
                rows.append((conv, gaps, *seen.values(), cost, audit, chosen))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in SUMMARY.split(", ")])

    return f


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns (conv_id, turn, role, text) -> (conversations, repaired turns).

    conversations: conv_id, gaps (missing turn numbers), blank, duplicate,
    truncated (turns by their first fault), illegal (neighbours whose roles may
    not follow each other), cost and audit of the cheapest repair, the smallest
    audit of equal ones; one row for each conversation that has turns.
    repaired turns: conv_id, part, block, at, k (their order), role, text, edit.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *said).groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumns({f"k{k}": F.xxhash64(F.lit(k), "role", "text") for k in (1, 2)})
    stand = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("k1").alias("a"), F.col("k2").alias("b")).agg(F.min(stand).alias("first"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("k1") == F.col("a")) & (F.col("k2") == F.col("b")))
    late = (F.col("turn").isNotNull() & ~F.col("first.known")) | (F.col("turn") > F.col("first.turn"))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "b").when(F.coalesce(late, F.lit(False)), "d").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "t").otherwise(" ")
    rows = rows.select("conv_id", "turn", "role", "text", fault.alias("fault"), F.col("copies").cast("long").alias("copies"))
    order = ("conv_id", "turn", "role", "text")
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    parsed = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(trimmed(_parsed(arrow)), PARSED.format(id=kind))
    parsed = staged(parsed, "parsed")
    stretches = parsed.where("at < 0").select("conv_id", F.struct("part", "block", "first", "last", "low", "high", "turns", *COUNTS, "ways").alias("x"))
    stretches = stretches.groupBy("conv_id").agg(F.collect_list("x").alias("blocks"))
    stretches = stretches.withColumn("blocks", F.array_sort("blocks", lambda a, b: F.when(a.part < b.part, -1).when(a.part > b.part, 1).otherwise(a.block - b.block)))
    found = staged(stretches.mapInArrow(trimmed(_joined(arrow)), SUMMARY.format(id=kind)), "repairs")
    chosen = found.select(F.explode("chosen").alias("x")).select("x.*")
    chosen = chosen.join(parsed.where("at < 0").select("part", "block", "scripts"), ["part", "block"])
    chosen = chosen.select("part", "block", "ending", F.element_at("scripts", F.col("way") + 1).alias("script"))
    turns = parsed.where("at >= 0").select("conv_id", "part", "block", "at", "role", "text").join(chosen, ["part", "block"])
    ending = F.when(F.col("at") + 1 == F.size("script"), F.col("ending"))
    edits = F.split(F.concat_ws(",", F.element_at("script", F.col("at") + 1), F.when(ending != "", ending)), ",")
    turns = turns.select("conv_id", "part", "block", "at", "role", "text", F.posexplode(edits).alias("k", "edit")).where("edit <> 'D'")
    own, to = F.col("edit") == "K", F.when(F.col("edit").endswith("u"), "user").otherwise("assistant")
    text = F.when(F.col("edit").startswith("I"), "").otherwise(F.col("text"))
    turns = turns.select("conv_id", "part", "block", "at", "k", F.when(own, F.col("role")).otherwise(to).alias("role"), text.alias("text"), F.substring("edit", 1, 1).alias("edit"))
    return found.drop("chosen"), turns

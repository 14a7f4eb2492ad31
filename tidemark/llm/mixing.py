"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

Weights are token shares to the power of an exponent, normalised.  The
exponent is found by bisection: the largest one (nearest to the natural mix)
that meets a target entropy, or the smallest that keeps every source within a
number of repetitions.  The budget is then filled source by source: whole
passes over the source, and for the rest a prefix of a random order of its
blocks, cut inside one block by a random order of its documents.

Only sums by source reach the driver (one row a source).  Running sums are
taken over blocks and then inside the one block a source's budget ends in, so
a source with a third of all rows is never one task's group.

Defined results: null source -> a source of its own; null or blank text has no
tokens and is kept in every whole pass; no rows, or no tokens at all -> every
row once; repeated rows are documents of their own, but those of one doc_id,
text and source share a place in the permutation and enter the last pass
together; other columns are kept, input columns called pass, block or place
are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import staged
from .words import SPACE

ADDED = ("pass", "block", "place")

#: Tokens of one block of the permutation, about.
BLOCK_TOKENS = 200_000
#: A source's permutation is summed in 2 ** STRETCH_BITS stretches first.
STRETCH_BITS = 12
#: How much oftener than another source one may be used where an entropy is the target.
MOST_REPEATS = 16.0
#: Sources up to this count are broadcast (about 100 bytes each); the driver holds a row a source, MOST_SOURCES at most.
BROADCAST_SOURCES, MOST_SOURCES = 50_000, 1_000_000


def weights(tokens: dict, exponent: float) -> dict:
    """Shares to the power of exponent, normalised; a source without tokens has weight 0."""
    live = {k: exponent * math.log(v) for k, v in tokens.items() if v > 0}
    top = max(live.values(), default=0.0)
    power = {k: math.exp(x - top) for k, x in live.items()}
    total = sum(power.values())
    return {k: power.get(k, 0.0) / total if total else 0.0 for k in tokens}


def entropy(w: dict) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def bisect(meets, low: float = 0.0, high: float = 1.0, steps: int = 60) -> float:
    """The end of [low, high] where meets() turns: meets(low) holds; the largest exponent found that still meets."""
    if meets(high):
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if meets(middle) else (low, middle)
    return low


def exponent_for_entropy(tokens: dict, share: float) -> float:
    """Largest exponent up to 1 whose entropy is at least ``share`` of the logarithm of the number of sources."""
    target = share * math.log(max(1, sum(v > 0 for v in tokens.values())))
    return bisect(lambda x: entropy(weights(tokens, x)) >= target - 1e-12)


def exponent_for_repeats(tokens: dict, repeats: float) -> float:
    """Smallest exponent from 0 at which no source is repeated over ``repeats`` times as often as another."""
    live = [v for v in tokens.values() if v > 0]
    if not live:
        return 1.0
    spread = lambda x: (max(live) / min(live)) ** (1 - x)
    # from 1 (all equally often) downwards
    return 1 - bisect(lambda y: spread(1 - y) <= repeats * (1 + 1e-12))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column("text").cast(pa.binary()).fill_null(b"")
        n = []
        for value in raw:
            space = SPACE[np.frombuffer(value.as_buffer(), np.uint8)]
            n.append(int(np.count_nonzero(space[:-1] & ~space[1:])) + int(space.size > 0 and not space[0]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*batch.schema.names[:-1], "tokens"])


def _before(sums: DataFrame, turn: F.Column) -> DataFrame:
    """s, block, left, t and the tokens of the blocks before each in its source's permutation.

    A source's blocks are summed in stretches of the permutation first, so no
    task sees all blocks of a source.
    """
    sums = sums.withColumn("turn", turn).withColumn("stretch", F.shiftright("turn", 64 - STRETCH_BITS))
    earlier = lambda *by: Window.partitionBy("s", *by[:-1]).orderBy(*by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.groupBy("s", "stretch").agg(F.sum("t").alias("t")).withColumn("base", F.coalesce(F.sum("t").over(earlier(["stretch"])), F.lit(0))).drop("t")
    inside = sums.withColumn("inside", F.coalesce(F.sum("t").over(earlier("stretch", ["turn", "block"])), F.lit(0)))
    return inside.join(base, ["s", "stretch"]).withColumn("before", F.col("base") + F.col("inside"))


def mix_sources(docs: DataFrame, repeats: float = 1.5, entropy_share: float | None = None, budget: int | None = None, seed: int = 17, most_repeats: float = MOST_REPEATS) -> DataFrame:
    """docs (doc_id, text, source, ...) -> the same columns, pass (0, 1, ...), block and place, a row for each use of a document.

    The exponent meets ``entropy_share`` if given, unless a source would then be
    used over ``most_repeats`` times as often as another: that limit goes
    first.  Without an entropy it meets the ``repeats`` limit.
    block numbers the source's blocks; place (0 to 1) is where in the mix the
    use stands: each pass of a source has a permutation of its blocks of its
    own, and passes follow each other.  In order of place and block, any part
    of the mix has about the target weights.
    Without a budget (in tokens) the scarcest use is one whole pass: every
    document is used at least once, and at most ``repeats`` times as often.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ADDED]
    src = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(src.alias("s"), F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit(seed)).alias("h"), F.struct(*own).alias("row"))
    # The words are counted on (key, text) alone, before whole rows are used again.
    light = docs.select(src.alias("s"), F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit(seed)).alias("h"), F.col("text").cast("string").alias("text"))
    counted = light.mapInArrow(_count, "s string, h long, tokens long")
    counted = staged(counted, "tokens")
    totals = counted.groupBy("s").agg(F.sum("tokens").alias("t")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    tokens = {r.s: int(r.t) for r in totals}
    if not sum(tokens.values()):
        return docs.select(*own, F.lit(0).alias("pass"), F.lit(0).cast("long").alias("block"), F.lit(0.0).alias("place"))
    exponent = exponent_for_repeats(tokens, repeats) if entropy_share is None else max(exponent_for_entropy(tokens, entropy_share), exponent_for_repeats(tokens, most_repeats))
    w = weights(tokens, exponent)
    live = {k: v for k, v in tokens.items() if v > 0}
    total = max(v / w[k] for k, v in live.items()) if budget is None else float(budget)
    epochs = {k: w[k] * total / v if v else 1.0 for k, v in tokens.items()}
    whole = {k: math.floor(e + 1e-9) for k, e in epochs.items()}
    left = {k: int(round((epochs[k] - whole[k]) * tokens[k])) if tokens[k] else 0 for k in tokens}
    blocks = {k: max(1, v // BLOCK_TOKENS) for k, v in tokens.items()}
    kinds = pa.schema([("s", pa.string()), ("whole", pa.int32()), ("left", pa.int64()), ("blocks", pa.int64()), ("epochs", pa.float64())])
    columns = [list(tokens), [whole[k] for k in tokens], [max(0, left[k]) for k in tokens], [blocks[k] for k in tokens], [float(epochs[k]) for k in tokens]]
    # As an Arrow table: rows would go through Python workers of their own, which stay in the executors' memory for a while.
    plan = spark.createDataFrame(pa.table(columns, schema=kinds))
    plan = F.broadcast(plan) if len(tokens) <= BROADCAST_SOURCES else plan

    # Blocks in hash order are the permutation; their running sums find the block where a source's budget ends.
    placed = counted.join(plan, "s").where("left > 0").withColumn("block", F.pmod(F.xxhash64("h", F.lit(1)), F.col("blocks")))
    sums = placed.groupBy("s", "block", "left").agg(F.sum("tokens").alias("t"))
    sums = _before(sums, F.xxhash64("block", F.lit(seed))).where("before < left").select("s", "block", "before", (F.col("before") + F.col("t") <= F.col("left")).alias("full"))
    near = placed.join(sums, ["s", "block"])
    inner = Window.partitionBy("s", "block").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    cut = near.where("not full").withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(inner), F.lit(0))).where("at < left").select("s", "h")
    # A document is used more often if its block lies before the budget's end, or it does inside the last block.
    ends = sums.select("s", "block", "full")
    last = cut.select("s", "h", F.lit(1).alias("extra")).distinct()
    sized = rows.join(plan, "s").withColumn("block", F.pmod(F.xxhash64("h", F.lit(1)), F.col("blocks")))
    sized = sized.join(F.broadcast(ends) if sum(blocks.values()) <= 200_000 else ends, ["s", "block"], "left")
    few = last.count()
    used = sized.join(F.broadcast(last) if few <= 500_000 else last, ["s", "h"], "left")
    times = F.col("whole") + F.when(F.coalesce("full", F.lit(False)) | F.col("extra").isNotNull(), 1).otherwise(0)
    used = used.where(times > 0).withColumn("pass", F.explode(F.sequence(F.lit(0), times - 1)))
    # The order of blocks in a pass, as a number from 0 to 1; the last pass may be a part of one.
    turn = F.shiftrightunsigned(F.xxhash64("s", "block", "pass", F.lit(seed)), 11) / F.lit(float(1 << 53))
    share = F.least(F.lit(1.0), F.greatest(F.col("epochs") - F.col("pass"), F.lit(0.0)))
    place = (F.col("pass") + turn * share) / F.greatest(F.col("epochs"), F.col("pass") + share)
    return used.select("row.*", "pass", "block", place.alias("place"))

"""MinHash near-dedup by SetSketch registers (Ertl, "SetSketch: Filling the Gap between MinHash and HyperLogLog").

A document's set holds its distinct word shingles.  Every shingle is a Poisson
process of marked points; a register keeps the first point with its mark, on
an exponential scale, truncated.  Sketches of parts merge by their maximum
and agree register by register with a probability that grows with the Jaccard
similarity.  Bands of registers propose pairs, the joint likelihood of the
register order drops hopeless ones, and full shingle sets decide.

Defined results: null or blank text -> an empty set, linked with nothing;
repeated rows of one doc_id are separate rows with equal results; other
columns are ignored; a null doc_id stays a row, linked with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import staged
from .words import as_bytes, mix64, sequence_hashes, slices, tables, trimmed

REGISTERS, ROWS = 128, 4
BASE = 1.02
LEVELS = 4095
#: Members of one bucket that one task compares with each other; larger buckets are dealt out by pairs of blocks.
BUCKET_BLOCK = 1024
#: Doc ids of candidates up to this count are broadcast (8 bytes each) to keep other texts out of the shuffle.
BROADCAST_IDS = 500_000
#: A pair is dropped unverified if the threshold is e**-LIKELY as likely as the best fit (about six standard deviations).
LIKELY = 18.0


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of word shingles; a shorter text is one shingle of its own kind."""
    if not words.size:
        return words
    if words.size < size:
        return sequence_hashes(words, words.size, salt=words.size)
    h = np.sort(sequence_hashes(words, size, salt=size))
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if h.size > 1 else h


def sketch(items: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """SetSketch registers (uint16) of a non-empty set of 64-bit hashes."""
    first = np.full(registers, np.inf)
    cut = registers * (math.log(registers) + 4.0) / items.size
    columns = int(cut + 4 * math.sqrt(cut) + 4)
    while True:
        h = mix64(items ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        t = -np.log(((h >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53)
        live = t <= cut
        mark, time = [h[live] % np.uint64(registers)], [t[live]]
        if live.any():
            seed, base = items[live], t[live]
            salt = (np.arange(1, columns + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))[None, :]
            h = mix64(seed[:, None] + salt)
            t = base[:, None] + np.cumsum(-np.log(((h >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53), axis=1)
            reach = min(cut, float(t[:, -1].min()))
            near = t <= reach
            mark.append(h[near] % np.uint64(registers))
            time.append(t[near])
        else:
            reach = cut
        mark, time = np.concatenate(mark).astype(np.int64), np.concatenate(time)
        first.fill(np.inf)
        np.minimum.at(first, mark, time)
        if first.max() <= reach:
            break
        cut, columns = cut * 1.5, columns * 2
    # Times are near m/n; level 0 begins at 64 m, which a set of one shingle hardly reaches.
    level = np.floor(1 - np.log(first / registers / 64.0) / math.log(BASE))
    return np.clip(level, 0, LEVELS).astype(np.uint16)


def similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """True where the threshold or more stays possible, by the joint likelihood of register order.

    a, b: registers by row; na, nb: set sizes, which are known exactly.
    """
    up, down = (a > b).sum(axis=-1), (a < b).sum(axis=-1)
    same = a.shape[-1] - up - down
    u = na / (na + nb)
    v = 1 - u
    most = np.minimum(u / v, v / u)

    def fit(j):
        p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)
        pu, pd = p(u - v * j), p(v - u * j)
        return up * np.log(pu) + down * np.log(pd) + same * np.log(np.clip(1 - pu - pd, 1e-12, 1))

    grid = np.linspace(0, 1, 41)
    best = np.full(up.shape, -np.inf)
    for g in grid:
        best = np.maximum(best, fit(np.minimum(g, 1) * most))
    at = np.full(up.shape, -np.inf)
    for g in np.linspace(threshold, 1, 9):
        at = np.maximum(at, np.where(g <= most + 1e-9, fit(np.minimum(g, most)), -np.inf))
    return at >= best - LIKELY


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, f1, f2, sk = [], [], [], []
            for _, _, _, words in tables(as_bytes(batch.column("text")), True):
                s = shingle_set(words, size)
                n.append(s.size)
                f1.append(int(np.add.reduce(mix64(s ^ np.uint64(0x1234567)), dtype=np.uint64).view(np.int64)) if s.size else 0)
                f2.append(int(np.add.reduce(mix64(s + np.uint64(0xABCDEF01)), dtype=np.uint64).view(np.int64)) if s.size else 0)
                sk.append(sketch(s).tobytes() if s.size else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sk, pa.binary())],
                ["doc_id", "n_shingles", "f1", "f2", "sketch"],
            )

    return run


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = REGISTERS // ROWS
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = _registers(batch.column("sketch")).astype(np.uint64).reshape(-1, count, ROWS)
        key = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64), regs.shape[:2]).copy()
        for k in range(ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, k])
        key = key.view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.ravel()), *(pa.array(np.repeat(batch.column(c).to_numpy(), count)) for c in ("id", "n")), pa.array(np.tile(np.arange(count, dtype=np.int32), batch.num_rows))],
            ["band", "id", "n", "number"],
        )


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
                keep = similarity(_registers(batch.column("sa")), _registers(batch.column("sb")), na, nb, threshold)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    return run


def _within(size: int, percent: int):
    """Links between members of one bucket (or of two of its blocks) that are not yet in one component."""
    threshold = percent / 100
    # Equal registers that a pair at the threshold has but for six standard deviations.
    least = REGISTERS * threshold - 6 * math.sqrt(REGISTERS * threshold * (1 - threshold))

    def bucket(rows) -> list[tuple[int, int]]:
        ids, roots, n, block, number, regs, texts = rows
        order = np.argsort(n, kind="stable")
        ids, roots, n, block, regs = ids[order], roots[order], n[order], block[order], regs[order]
        number = int(number[0])
        two = bool(block.min() != block.max())
        sets: dict[int, np.ndarray] = {}
        up = {r: r for r in roots.tolist()}

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def items(i):
            if i not in sets:
                sets[i] = shingle_set(next(tables([texts[order[i]]], True))[3], size)
            return sets[i]

        out = []
        for i in range(ids.size - 1):
            end = int(np.searchsorted(n, n[i] / threshold * (1 + 1e-9), "right"))
            j = np.arange(i + 1, end)
            j = j[(roots[j] != roots[i]) & ((block[j] != block[i]) | (not two))]
            if not j.size:
                continue
            equal = regs[j] == regs[i]
            # A pair that shares several buckets is looked at in the first of them only.
            first = equal.reshape(j.size, -1, ROWS).all(axis=2).argmax(axis=1) == number
            j = j[first & (equal.sum(axis=1) >= least)]
            if j.size:
                j = j[similarity(regs[i][None, :], regs[j], float(n[i]), n[j].astype(float), threshold)]
            for k in j.tolist():
                a, b = find(int(roots[i])), find(int(roots[k]))
                if a == b:
                    continue
                x, y = items(i), items(k)
                both = np.intersect1d(x, y, assume_unique=True).size
                if 100 * both >= percent * (x.size + y.size - both):
                    up[max(a, b)] = min(a, b)
                    out.append((int(min(ids[i], ids[k])), int(max(ids[i], ids[k]))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(parts):
            arrays = [np.concatenate(x) for x in list(zip(*parts, strict=True))[:-1]]
            found = bucket([*arrays, [t for x in parts for t in x[-1]]])
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(c).to_numpy() for c in ("band", "lo", "hi")], axis=1)
            rows = [*(batch.column(c).to_numpy() for c in ("id", "root", "n", "block", "number")), _registers(batch.column("sketch")), as_bytes(batch.column("text"))]
            edge = np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, [k.shape[0]])).tolist()
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if held and tuple(k[a].tolist()) != key:
                    yield solved(held)
                    held = []
                key = tuple(k[a].tolist())
                held.append([x[a:b] for x in rows])
        if held:
            yield solved(held)

    return run


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (
                [shingle_set(w, size) for _, _, _, w in tables(as_bytes(batch.column(c)), True)] for c in ("ta", "tb")
            )
            keep = []
            for x, y in zip(left, right, strict=True):
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(both > 0 and 100 * both >= percent * (x.size + y.size - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _texts_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of the given documents; few ids are broadcast, many are joined."""
    few = ids.count() <= BROADCAST_IDS
    return texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the similarity."""
    sides = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"), "a", "b")
    texts = _texts_of(sides.select("doc_id").distinct(), texts)
    both = sides.join(texts, "doc_id").groupBy("a", "b").agg(
        F.min(F.struct("doc_id", "text")).alias("x"), F.max(F.struct("doc_id", "text")).alias("y"))
    return both.select("a", "b", F.col("x.text").alias("ta"), F.col("y.text").alias("tb")).mapInArrow(
        trimmed(_verify(size, percent)), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept.

    Links: 100 * intersection >= percent * union.  component_id is the smallest
    doc_id reachable.  A link is found unless all 32 bands of four registers
    differ (5e-8 at 0.8) or its likelihood is below e**-18 of the best fit.

    Round one tests each document against the smallest member of its buckets
    only, so a group of copies costs one pair a member.  Round two goes through
    each bucket whose members are not yet one component: pairs from different
    components are compared by their registers and then by their full sets,
    and a link found makes the two components one, so a dense group costs
    about one link a member.  No bucket is cut off: one with more than 1,024
    members is dealt out by pairs of blocks.
    """
    threshold = percent / 100
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = staged(docs.mapInArrow(trimmed(_sketches(shingle)), "doc_id long, n_shingles long, f1 long, f2 long, sketch binary"), "sketches")
    sets = base.where("n_shingles > 0 and doc_id is not null")
    classes = sets.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("id"))
    own = staged(classes, "classes")
    reps = own.join(sets, (sets.doc_id == own.id)).select("id", own.n_shingles.alias("n"), "sketch").dropDuplicates(["id"])
    reps = staged(reps, "representatives")

    bands = reps.mapInArrow(trimmed(_bands), "band long, id long, n long, number int")
    shared = bands.groupBy("band").agg(F.min(F.struct("id", "n")).alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("members")).where("low.id < high")
    members = staged(bands.join(shared.select("band", F.col("low.id").alias("low"), F.col("low.n").alias("low_n"), "members"), "band"), "members")

    near = (F.col("low") < F.col("id")) & (F.col("low_n") >= threshold * F.col("n") - 1e-6) & (F.col("n") >= threshold * F.col("low_n") - 1e-6)
    star = members.where(near).groupBy(F.col("id").alias("b")).agg(F.min("low").alias("a"))
    side = lambda c: reps.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    star = staged(star.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(trimmed(_likely(threshold)), "a long, b long"), "star")
    links = staged(_confirmed(star, docs, shingle, percent), "confirmed")
    roots = components(links)

    named = members.join(roots, "id", "left").select("band", "id", "n", "number", "members", F.coalesce("root", "id").alias("root"))
    open_ = named.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("band")
    left = named.join(open_, "band", "left_semi")
    blocks = F.ceil(F.col("members") / BUCKET_BLOCK).cast("int")
    left = left.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = staged(left, "open")
    texts = _texts_of(left.select(F.col("id").alias("doc_id")).distinct(), docs)
    carried = reps.select("id", "sketch").join(texts.select(F.col("doc_id").alias("id"), "text").dropDuplicates(["id"]), "id")
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "id", "root", "n", "block", "number")
    left = left.join(carried, "id").repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
    more = staged(left.mapInArrow(trimmed(_within(shingle, percent)), "a long, b long").distinct(), "more")
    roots = components(links.union(more))

    classes = own.join(roots, "id", "left").select("f1", "f2", F.col("n_shingles"), F.coalesce("root", "id").alias("class_root"))
    found = base.drop("sketch").join(classes, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("class_root")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return found.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))

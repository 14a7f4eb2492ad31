"""Periodic runs of words, found by refining classes of equal factors.

Two positions are in one class of level l if the l words that start there are
equal.  Level l + 1 follows from level l: positions stay together if their
successors do.  Only the smaller parts of what was split at the last level are
looked at (Crochemore's smaller half), so a position is handled at most about
log2(n) times whatever the periods are.  A position whose neighbour in its
class stands exactly l further on starts a square of period l, and squares of
one period at consecutive positions are one run.  Neighbours are kept in linked
lists; a link holds for a range of levels and is judged once, when it breaks.
All documents of a batch are refined together, in vectorised steps.

Every square of a run of four periods starts in a class of three or more, so
smaller classes are left as they are when four periods or more are asked for,
and no level beyond the longest period that a document can hold is made.

Defined results: null text has no words and no runs and collapses to the empty
text; repeated rows are judged one by one, and equal rows get equal results;
input columns called n_words, n_runs, runs or collapsed_text are replaced, all
others are kept as they are, in any order and of any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import as_bytes, mix64, slices, tables, trimmed

#: Words that are refined together; one document is never split.
BATCH_WORDS = 1 << 20
#: Up to so many positions a level are moved one by one, which then is faster.
FEW = 40
ADDED = ("n_words", "n_runs", "runs", "collapsed_text")


class _Classes:
    """Positions in classes: each class is a stretch of ``order`` and is named by where it begins."""

    def __init__(self, codes: np.ndarray, smallest: int) -> None:
        n = codes.size
        self.smallest = smallest
        self.order = np.argsort(codes, kind="stable").astype(np.int32)
        ranked = codes[self.order]
        start = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        count = np.diff(np.concatenate((start, [n])))
        self.size = np.zeros(n, np.int32)
        self.size[start] = count
        self.of = np.empty(n, np.int32)
        self.of[self.order] = np.repeat(start, count)
        self.at = np.empty(n, np.int32)
        self.at[self.order] = np.arange(n, dtype=np.int32)
        self.next = np.full(n, -1, np.int32)
        self.before = np.full(n, -1, np.int32)
        live = np.repeat(count >= smallest, count)
        joined = np.flatnonzero((ranked[1:] == ranked[:-1]) & live[1:])
        self.next[self.order[joined]] = self.order[joined + 1]
        self.before[self.order[joined + 1]] = self.order[joined]
        self.since = np.ones(n, np.int32)
        self.moving = np.zeros(n, bool)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.single: list[tuple[int, int]] = []
        self.views = [memoryview(x) for x in (self.of, self.size, self.order, self.at, self.next, self.before, self.since)]

    def judge(self, x: np.ndarray, last: int | np.ndarray) -> None:
        """Links of x end at level ``last``: squares are those that held at the level of their own distance."""
        far = self.next[x]
        gap = far - x
        square = (far >= 0) & (self.since[x] <= gap) & (gap <= last)
        if square.any():
            self.found.append((x[square], gap[square]))

    def refine(self, small: np.ndarray, level: int, limit: np.ndarray) -> np.ndarray:
        """From ``level`` to the next one by what was split off last; returns the smaller parts of this split."""
        i = small[small > 0] - 1
        i = i[(self.size[self.of[i]] >= self.smallest) & (limit[i] > level)]
        if not i.size:
            return i
        own, key = self.of[i], self.of[i + 1]
        by = np.argsort(own.astype(np.int64) * self.of.size + key, kind="stable")
        i, own, key = i[by], own[by], key[by]
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])))
        first = np.flatnonzero(new)
        part = np.diff(np.concatenate((first, [i.size])))
        whole = part == self.size[own[first]]
        if whole.any():  # one part that is all of its class splits nothing
            stay = ~np.repeat(whole, part)
            i, own, new = i[stay], own[stay], new[stay]
            if not i.size:
                return i
            first = np.flatnonzero(new)
            part = np.diff(np.concatenate((first, [i.size])))
        head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        moved = np.diff(np.concatenate((head, [i.size])))
        name = own[head]
        rest = self.size[name] - moved
        self._unlink(i, own, level)
        little = np.flatnonzero((rest > 0) & (rest < self.smallest))
        self._arrange(i, name, moved, rest)
        tail = np.repeat(name + rest - head, moved) + np.arange(i.size)  # where each moved position stands now
        self.of[i] = np.repeat(tail[first], part)
        self.size[name] = rest
        self.size[tail[first]] = part
        live = part >= self.smallest
        self._link(i, first, np.repeat(live, part), level + 1)
        if little.size:
            self._forget(self._members(name[little], rest[little]), level)
        # The largest part of each class is left out; what stayed behind counts as a part.
        group = np.repeat(np.arange(head.size), np.diff(np.concatenate((np.searchsorted(first, head), [first.size]))))
        edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        most = np.maximum.reduceat(part, edge)
        left_out = np.zeros(part.size, bool)
        beaten = most > rest
        best = np.flatnonzero(part == most[group])
        best = best[np.concatenate(([True], group[best][1:] != group[best][:-1]))]
        left_out[best[beaten[group[best]]]] = True
        out = i[~np.repeat(left_out, part)]
        behind = beaten & (rest > 0)
        if behind.any():
            out = np.concatenate((out, self._members(name[behind], rest[behind])))
        out.sort()
        return out

    def refine_few(self, small: list[int], level: int, limit: memoryview) -> list[int]:
        """The same for a few positions, without a vectorised step."""
        of, size, order, at, after, before, since = self.views
        classes: dict[int, dict[int, list[int]]] = {}
        for p in small:
            own = of[p - 1] if p else 0
            if p and size[own] >= self.smallest and limit[p - 1] > level:
                classes.setdefault(own, {}).setdefault(of[p], []).append(p - 1)
        out = []
        for own, groups in classes.items():
            parts = list(groups.values())
            if len(parts[0]) == size[own]:
                continue
            end = own + size[own]
            starts = []
            for part in parts:
                for i in part:
                    low, high = before[i], after[i]
                    self._judge_one(i, level)
                    if low >= 0:
                        self._judge_one(low, level)
                        since[low], after[low] = level + 1, high
                    if high >= 0:
                        before[high] = low
                    end -= 1
                    other, free = order[end], at[i]
                    order[free], at[other] = other, free
                    order[end], at[i] = i, end
                starts.append(end)
            rest = end - own
            size[own] = rest
            for start, part in zip(starts, parts, strict=True):
                size[start] = len(part)
                live = len(part) >= self.smallest
                last = -1
                for i in part:
                    of[i], since[i], after[i], before[i] = start, level + 1, -1, last if live else -1
                    if live and last >= 0:
                        after[last] = i
                    last = i
            behind = order[own:end].tolist() if rest < self.smallest or rest < max(map(len, parts)) else []
            if rest < self.smallest:
                for i in behind:
                    self._judge_one(i, level)
                    after[i] = before[i] = -1
            big = max(parts, key=len)
            if len(big) > rest:
                out += behind
            else:
                big = None
            for part in parts:
                if part is not big:
                    out += part
        out.sort()
        return out

    def _judge_one(self, x: int, level: int) -> None:
        far = self.views[4][x]
        if far >= 0 and self.views[6][x] <= far - x <= level:
            self.single.append((x, far - x))

    def _members(self, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.order[np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]

    def _unlink(self, i: np.ndarray, own: np.ndarray, level: int) -> None:
        """Take positions out of the lists of their classes."""
        self.judge(i, level)
        by = np.argsort(own.astype(np.int64) * self.of.size + i)
        x = i[by]
        joined = self.next[x[:-1]] == x[1:]
        low = self.before[x[np.concatenate(([True], ~joined))]]
        high = self.next[x[np.concatenate((~joined, [True]))]]
        has = low >= 0
        self.judge(low[has], level)
        self.since[low[has]] = level + 1
        self.next[low[has]] = high[has]
        has = high >= 0
        self.before[high[has]] = low[has]

    def _arrange(self, i: np.ndarray, name: np.ndarray, moved: np.ndarray, rest: np.ndarray) -> None:
        """Moved positions go to the end of their class, in the order given."""
        edge = np.repeat(name + rest, moved)
        tail = edge + np.arange(i.size) - np.repeat(np.cumsum(moved) - moved, moved)
        self.moving[i] = True
        there = self.order[tail]
        there = there[~self.moving[there]]
        free = self.at[i]
        free = free[free < edge]
        self.order[free] = there
        self.at[there] = free
        self.order[tail] = i
        self.at[i] = tail
        self.moving[i] = False

    def _link(self, i: np.ndarray, first: np.ndarray, live: np.ndarray, level: int) -> None:
        """Lists of new parts; positions of a part stand in ascending order."""
        self.since[i] = level
        after = np.concatenate((i[1:], [-1])).astype(np.int32)
        after[np.concatenate((first[1:] - 1, [i.size - 1]))] = -1
        ahead = np.concatenate(([-1], i[:-1])).astype(np.int32)
        ahead[first] = -1
        self.next[i] = np.where(live, after, -1)
        self.before[i] = np.where(live, ahead, -1)

    def _forget(self, x: np.ndarray, level: int) -> None:
        """Classes that became too small to matter."""
        late = x[self.since[x] <= level]
        self.judge(late, level)
        self.next[x] = -1
        self.before[x] = -1


def squares(codes: np.ndarray, limit: np.ndarray, smallest: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of squares with a primitive root, as far as classes of ``smallest`` or more show them.

    ``limit`` is the longest period asked for at each position; separate texts
    end in a code of their own, at which limit is 0.
    """
    classes = _Classes(codes, smallest)
    small, level = np.arange(codes.size, dtype=np.int32), 1
    asked = memoryview(limit)
    while len(small):
        small = classes.refine(np.asarray(small, np.int32), level, limit) if len(small) > FEW else classes.refine_few(small if isinstance(small, list) else small.tolist(), level, asked)
        level += 1
    rest = np.flatnonzero(classes.next >= 0).astype(np.int32)
    classes.judge(rest, limit[rest])
    if classes.single:
        classes.found.append(tuple(np.array(classes.single, np.int32).T))
    if not classes.found:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return tuple(np.concatenate(x) for x in zip(*classes.found, strict=True))  # type: ignore[return-value]


def runs_of(texts: list[np.ndarray], least: int, exponent: int) -> list[np.ndarray]:
    """For each sequence of word hashes its runs, rows (start, length, period) by start, then period."""
    size = np.array([t.size for t in texts])
    base = np.cumsum(size + 1) - size - 1
    total = int(size.sum()) + size.size
    of = np.repeat(np.arange(size.size), size + 1)
    key = np.empty(total, np.uint64)
    inside = np.ones(total, bool)
    inside[base + size] = False
    key[inside] = np.concatenate(texts)
    key[~inside] = 0
    key = mix64(key ^ mix64((of + 1).astype(np.uint64)))  # words of different documents differ
    key[~inside] = mix64(key[~inside] + np.uint64(0x5851F42D4C957F2D))
    limit = np.where(inside, (size // exponent)[of], 0).astype(np.int32)
    at, period = squares(key, limit, 3 if exponent >= 4 else 2)
    by = np.lexsort((at, period))
    at, period = at[by].astype(np.int64), period[by].astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)))[: at.size])
    start, period = at[new], period[new]
    length = np.diff(np.concatenate((new, [at.size]))) - 1 + 2 * period
    long = length >= np.maximum(least, exponent * period)
    start, length, period = start[long], length[long], period[long]
    by = np.lexsort((period, start))
    found = np.stack((start[by], length[by], period[by]), 1)
    cut = np.searchsorted(found[:, 0], np.concatenate((base, [total])))
    return [found[a:b] - [o, 0, 0] for a, b, o in zip(cut[:-1], cut[1:], base, strict=True)]


def _holds(words: list[bytes], found: np.ndarray) -> bool:
    return all(words[a : a + n - q] == words[a + q : a + n] for a, n, q in found.tolist())


def _runs(least: int, exponent: int):
    def whole(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
        own, hashes, n = [], [], 0

        def solve():
            for k, found in zip(own, runs_of(hashes, least, exponent), strict=True):
                words = (texts[k] or b"").split()
                if not _holds(words, found):  # two words with one hash
                    code: dict[bytes, int] = {}
                    ids = np.array([code.setdefault(w, len(code)) for w in words], np.uint64)
                    found = runs_of([ids], least, exponent)[0]
                yield k, words, found

        for k, _, _, h in tables(texts, False):
            own.append(k)
            hashes.append(h)
            n += h.size
            if n >= BATCH_WORDS:
                yield from solve()
                own, hashes, n = [], [], 0
        if own:
            yield from solve()

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            count, found, size, kept = [], [], [], []
            for _, words, runs in whole(as_bytes(batch.column("text"))):
                size.append(len(words))
                count.append(len(runs))
                found.append(runs)
                kept.append(b" ".join(words if not len(runs) else _collapsed(words, runs)))
            rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            item = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), item)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(size, pa.int64()), pa.array(count, pa.int64()), lists, pa.array(kept, pa.binary()).cast(pa.string())], ["row", "text", *ADDED])

    return f


def _collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words outside what follows the first period of any run."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]


def find_runs(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """docs (text, ...) -> the same columns, n_words, n_runs, runs, collapsed_text.

    A run is a stretch of words with smallest period q (words q apart are
    equal) that no neighbouring word extends, at least ``least`` words and
    ``exponent`` periods long.  runs holds (start, length, period) by start,
    then period, words numbered from 0; collapsed_text joins by one space the
    words that no run has after its first q words.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    own = [c for c in docs.columns if c not in (*ADDED, "text")]
    row = F.struct(*own) if own else F.struct(F.lit(0).alias("none"))
    rows = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"))
    kind = f"row {rows.schema['row'].dataType.simpleString()}, text string, n_words long, n_runs long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string"
    out = rows.mapInArrow(trimmed(_runs(least, exponent)), kind)
    back = [F.col("text").cast(docs.schema["text"].dataType).alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ADDED]
    return out.select(*back, *ADDED)

"""Language-model scores by a class-based bigram model (Brown et al.).

P(word | previous) = P(class | previous class) * P(word | class).  Words are
put into classes by exchange: every word with at least LEAST occurrences moves
to the class that raises the likelihood of the class bigrams most, until it
stops rising; rarer words share classes by frequency (1, 2-3, 4-7, ...
occurrences), and an unknown word belongs to the class of words seen once, from
whose use its own is estimated.
Emissions are proportional to (count + 1); transitions are smoothed with the
class shares.  All probabilities of a context sum to one.

Counts cover all training documents.  Texts are shuffled once, by blocks of
documents: the words of a block are looked up together, the COMMON most
frequent ones in a table that every task holds, so what moves is one row per
block and other distinct word, not one per token.  What is kept of a text
afterwards is one 32-bit code a token.

What stands beside each word is counted once, as distinct neighbours with their
counts by ranges of words, in columns by phase, the number of a word modulo
FINEST; rounds of exchange read the columns of the words that are due and
shuffle nothing but class counts, and of those what the moved words change.  A
round moves a part of the words: those of a range one after another, ranges at
the same time.  A round that lowers the likelihood
is taken back and the parts are halved.  The driver holds a count and a class
for each word that moves.

Defined results: null or empty text is one end token; a null doc_id counts
as training text and is scored like any other; repeated rows are separate
documents; other columns are ignored; with no training text every score is
that of an unknown word or end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import staged
from .words import as_bytes, groups, trimmed

#: Occurrences from which exchange moves a word; rarer ones have too few contexts to tell classes apart.
LEAST = 20
#: Classes that exchange fills.
CLASSES = 64
#: Exchange ends when no part of the words raises the log likelihood by this much a token, or parts of 1 / FINEST of the words lower it.
RISE = 1e-3
FINEST = 16
#: Words of one range.
RANGE = 2048
#: Ranges of one file, and partitions in which counts by pair of classes are summed.
RANGES, SUMS = 8, 4
#: Words that move at the same time within a range, the part of all tokens that they may be, and classes whose gain is computed in full besides a word's own.
STEP, SHARE, NEAREST = 64, 1024, 7
#: Bound of the most frequent words that every task knows (24 bytes each); blocks ask for their other words.
COMMON = 100_000
#: Pseudo-count of the class shares in each transition.
SMOOTH = 1.0
#: Text of one block, about.
BLOCK_BYTES = 16_000_000
#: Codes or entries counted at a time, in some multiple.
STRETCH = 1 << 20
#: Largest count of an entry.
MOST = (1 << 31) - 1
#: Hash that stands for the end of a text; words are hashed to 64 bits.
END = np.int64(-0x5EED5EED5EED5EED)
BANDS = 40
UNSEEN = 0  # code of unknown words; 1 + b is a rare word of frequency band b
FIRST = BANDS  # code of the first word that exchange moves
#: Parts by hash in which these words are numbered.
PARTS = 256


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by word of each batch of training texts."""
    for batch in batches:
        parts = [w for *_, w in groups(as_bytes(batch.column("text")), True)]
        words = np.concatenate([*parts, np.full(batch.num_rows, END).view(np.uint64)]).view(np.int64)
        word, n = np.unique(words, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], ["word", "n"])


class _Places:
    """Sorted hashes, found by their first bits: those of a slot, about one in two, stand together."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.shift = words, np.int64(63 - words.size.bit_length())
        self.half = 1 << int(63 - self.shift)
        held = np.bincount((words >> self.shift) + self.half, minlength=2 * self.half)
        self.start = np.concatenate(([0], np.cumsum(held)))

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each word, whether it is there)."""
        if not self.words.size:
            return np.zeros(words.size, np.int64), np.zeros(words.size, bool)
        slot = (words >> self.shift) + self.half
        at = self.start[slot]
        hit = self.words[np.minimum(at, self.words.size - 1)] == words
        left = np.flatnonzero(~hit)
        while left.size:
            at[left] += 1
            left = left[at[left] < self.start[slot[left] + 1]]
            same = self.words[at[left]] == words[left]
            hit[left[same]] = True
            left = left[~same]
        return at, hit


def _distinct(common):
    """Words of each block that are not common, once a batch."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Places(common.value[0])
        for batch in batches:
            block = batch.column("block").to_numpy()
            words, of = [], []
            for k, _, cut, _, _, w in groups(as_bytes(batch.column("text")), True):
                w = w.view(np.int64)
                asks = np.flatnonzero(~known.find(w)[1])
                words.append(w[asks])
                of.append(np.repeat(block[k : k + cut.size - 1], np.diff(cut))[asks])
            words, of = np.concatenate([*words, np.zeros(0, np.int64)]), np.concatenate([*of, np.zeros(0, block.dtype)])
            # A task has few blocks, and sorting numbers is faster than finding their order.
            parts = [(k, np.sort(words[of == k])) for k in np.unique(of)]
            parts = [(k, w[np.concatenate(([True], w[1:] != w[:-1]))]) for k, w in parts]
            words = np.concatenate([w for _, w in parts] or [words])
            of = np.repeat(np.array([k for k, _ in parts], block.dtype), [w.size for _, w in parts])
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(words)], ["block", "word"])

    return f


def _encode(common, total: int, distinct: int, end_count: int, end_code: int):
    """One block: its texts and the counts and codes of its words that are not common -> codes by document."""
    floor = np.log10(total + distinct + 1)

    def f(docs: pa.Table, known: pa.Table) -> pa.Table:
        word, n, code = (np.concatenate((x, known.column(c).to_numpy())) for x, c in zip(common.value, ("word", "n", "code"), strict=True))
        order = np.argsort(word)
        cost, code, places = np.log10(n[order] + 1.0), code[order].astype(np.uint32), _Places(word[order])
        end_cost = np.log10(end_count + 1.0)
        out = []
        for batch in docs.to_batches(max_chunksize=2000):
            for k, _, cut, _, _, w in groups(as_bytes(batch.column("text")), True):
                at, hit = places.find(w.view(np.int64))
                at, texts = at[hit], cut.size - 1
                # A text's words and then its end.
                own, base, seen = np.full(w.size + texts, UNSEEN, np.uint32), np.zeros(w.size + texts), np.zeros(w.size + texts, np.int64)
                first = cut[:-1] + np.arange(texts)
                end = cut[1:] + np.arange(texts)
                place = (np.arange(w.size) + np.repeat(np.arange(texts), np.diff(cut)))[hit]
                own[place], base[place], seen[place] = code[at], cost[at], 1
                own[end], base[end], seen[end] = end_code, end_cost, end_count > 0
                tokens = end - first + 1
                codes = pa.Array.from_buffers(pa.binary(), texts, [None, pa.py_buffer(np.append(4 * first, own.nbytes).astype(np.int32)), pa.py_buffer(own)])
                out.append(pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(k, texts), batch.column("held_out").slice(k, texts), pa.array(tokens, pa.int64()), pa.array(np.add.reduceat(seen, first), pa.int64()), pa.array(np.add.reduceat(base, first) - tokens * floor, pa.float64()), codes],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "codes"],
                ))
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "codes"]
        kinds = [docs.schema.field("doc_id").type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]
        return pa.Table.from_batches(out, pa.schema(list(zip(names, kinds, strict=True))))

    return f


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers as all lowest bytes, then all second ones, and so on: small numbers leave runs of zeros, which Spark compresses."""
    return np.ascontiguousarray(values, np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _values(planes: bytes) -> np.ndarray:
    """What _planes() was given."""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def _packed(word: np.ndarray, near: np.ndarray, count: np.ndarray) -> bytes:
    """Entries in order of word and neighbour, compressed."""
    step = lambda x: np.diff(x.astype(np.int32), prepend=np.int32(0))
    return pa.compress(_planes(step(word)) + _planes(step(near)) + _planes(count), codec="zstd", asbytes=True)


def _entries(size: int, packed: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, neighbour, count) of what _packed() was given."""
    planes = memoryview(pa.decompress(packed.as_buffer(), decompressed_size=12 * size, codec="zstd"))
    word, near, count = (_values(planes[4 * size * k : 4 * size * (k + 1)]) for k in range(3))
    return np.cumsum(word, dtype=np.int32), np.cumsum(near, dtype=np.int32), count


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and the sum of their counts."""
    key, count = (np.concatenate([p[k] for p in parts]) for k in range(2))
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: key.size])
    return key[start], np.add.reduceat(count[order], start) if start.size else count


def _bigrams(size: int, end_code: int):
    """Codes of whole texts -> counts of neighbours, packed by range of the word on either side.

    Side 0 holds the codes before the words of a range, side 1 those after
    them.  A rare word's band is a range of its own, numbered below zero.
    """

    def packed(codes: list[bytes]) -> pa.RecordBatch:
        code = np.frombuffer(b"".join(codes), np.uint32)
        codes.clear()
        # Each text ends with the end code, so the code before a first word is right also across texts.
        pair = np.concatenate((np.array([end_code], np.uint32), code[:-1])).astype(np.int64) * size + code
        key, count = np.unique(pair, return_counts=True)
        del pair, code
        rows = []
        for side in (1, 0):
            word, near = key // size, key % size
            if side == 0:
                order = np.argsort(near * size + word)
                word, near, count = near[order], word[order], count[order]
            of = np.where(word < FIRST, word - FIRST, (word - FIRST) // RANGE)
            cut = [*np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))).tolist(), of.size]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                r = int(of[a])
                rows.append((r, side, b - a, _packed(word[a:b] - _first(r), near[a:b], count[a:b])))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["range", "side", "size", "packed"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held = [], 0
        for batch in batches:
            for own in batch.column("codes").to_pylist():
                codes.append(own)
                held += len(own) // 4
                if held > 4 * STRETCH:
                    yield packed(codes)
                    held = 0
        if held:
            yield packed(codes)

    return f


def _first(r: int) -> int:
    """Code of the first word of a range."""
    return FIRST + (r if r < 0 else r * RANGE)


def _columns(side: int, phases) -> list[str]:
    """Columns of a side: how many entries each phase has, and the entries."""
    return [c for k in phases for c in (f"size_{side}_{k}", f"side_{side}_{k}")]


def _side(batch: pa.RecordBatch, i: int, side: int, phases) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word, neighbour, count) of one range, by phase."""
    for k in phases:
        size = batch.column(f"size_{side}_{k}")[i].as_py()
        if size:
            yield _entries(size, batch.column(f"side_{side}_{k}")[i])


def _merged(size: int):
    """Counts of neighbours in order of range -> one row a range; what is held at a time is about the distinct neighbours of one range."""

    def row(r: int, held: list[list]) -> pa.RecordBatch:
        out = [pa.array([r], pa.int32())]
        for side in held:
            key, count = _summed(side) if side else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            # A count beyond 32 bits is written as several entries; they are summed when used.
            times = -(-count // MOST)
            if times.size and times.max() > 1:
                key = np.repeat(key, times)
                last = np.cumsum(times) - 1
                rest, count = count - (times - 1) * MOST, np.full(key.size, MOST)
                count[last] = rest
            out += [pa.array([key.size], pa.int64()), pa.array([_packed(key // size, key % size, count)], pa.binary())]
        return pa.RecordBatch.from_arrays(out, ["range", "size_0", "side_0", "size_1", "side_1"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, more = None, [[], []], [0, 0]
        for batch in batches:
            for r, side, n, packed in zip(*(batch.column(c).to_pylist() for c in ("range", "side", "size")), batch.column("packed"), strict=True):
                if r != now:
                    if now is not None:
                        yield row(now, held)
                    now, held, more = r, [[], []], [0, 0]
                word, near, count = _entries(n, packed)
                held[side].append((word.astype(np.int64) * size + near, count.astype(np.int64)))
                more[side] += n
                if more[side] > max(2 * STRETCH, held[side][0][0].size):
                    held[side], more[side] = [_summed(held[side])], 0
        if now is not None:
            yield row(now, held)

    return f


def _phased(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a range -> the same with columns by phase."""
    for batch in batches:
        for i, r in enumerate(batch.column("range").to_pylist()):
            out = [pa.array([r], pa.int32())]
            for side in ("0", "1"):
                word, near, count = _entries(batch.column("size_" + side)[i].as_py(), batch.column("side_" + side)[i])
                phase = (max(r, 0) * RANGE + word) % FINEST
                for k in range(FINEST):
                    at = np.flatnonzero(phase == k)
                    out += [pa.array([at.size], pa.int64()), pa.array([_packed(word[at], near[at], count[at]) if at.size else None], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["range", *_columns(0, range(FINEST)), *_columns(1, range(FINEST))])


def _pairs(classes: np.ndarray, n: int):
    """Bigram counts of classes with classes."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = np.zeros(n * n)
        for batch in batches:
            for i, r in enumerate(batch.column("range").to_pylist()):
                for word, near, count in _side(batch, i, 1, range(FINEST)):
                    key = classes[_first(r) :][word].astype(np.int32) * n + classes[near]
                    pair += np.bincount(key, weights=count, minlength=n * n)
        pair = pair.astype(np.int64)
        at = np.flatnonzero(pair)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(pair[at])], ["at", "n"])

    return f


def _changes(old: np.ndarray, new: np.ndarray, n: int, phases: list[int]):
    """What moved words change in the bigram counts of classes, from the columns of their phases alone."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = np.zeros(n * n)

        def add(sign: int, first: np.ndarray, second: np.ndarray, count: np.ndarray) -> None:
            nonlocal change
            change += sign * np.bincount(first.astype(np.int32) * n + second, weights=count, minlength=n * n)

        for batch in batches:
            for i, r in enumerate(batch.column("range").to_pylist()):
                was, now = (x[_first(r) : _first(r + 1)] for x in (old, new))
                moves = was != now
                if r < 0 or not moves.any():
                    continue
                for side in (0, 1):
                    for word, near, count in _side(batch, i, side, phases):
                        # Pairs of two moved words are counted where the second one stands.
                        at = np.flatnonzero(moves[word] if side == 0 else moves[word] & (old[near] == new[near]))
                        word, near, count = word[at], near[at], count[at]
                        for sign, own, all_ in ((-1, was, old), (1, now, new)):
                            add(sign, *((all_[near], own[word]) if side == 0 else (own[word], all_[near])), count)
        change = change.astype(np.int64)
        at = np.flatnonzero(change)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(change[at])], ["at", "n"])

    return f


def _due(turn: int, parts: int) -> list[int]:
    """Phases of the words that are due; parts divide FINEST."""
    return [k for k in range(FINEST) if (k + turn) % parts == 0]


def _move(classes: np.ndarray, n: int, pair: np.ndarray, turn: int, parts: int):
    """Ranges of words with the neighbours of those that are due -> the words of this turn's part that move, and where."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, r in enumerate(batch.column("range").to_pylist()):
                if r < 0:
                    continue  # rare words stay in the classes of their bands
                own = classes[_first(r) : _first(r + 1)].astype(np.int64)
                due = np.arange(-(r * RANGE + turn) % parts, own.size, parts)
                sides = []
                for side in (0, 1):
                    counts = np.zeros(n * due.size)
                    for word, near, count in _side(batch, i, side, _due(turn, parts)):
                        counts += np.bincount((word - due[0]) // parts * n + classes[near], weights=count, minlength=n * due.size)
                    sides.append(counts.reshape(due.size, n))
                own = own[due]
                used = sides[0].sum(axis=1)
                new = exchange(*sides, pair, own, used, CLASSES, used > 0)
                moved = np.flatnonzero(new != own)
                yield pa.RecordBatch.from_arrays([pa.array(due[moved] + r * RANGE, pa.int64()), pa.array(new[moved], pa.int32())], ["word", "class"])

    return f


def likelihood(pair: np.ndarray) -> float:
    """Log likelihood of class bigrams, but for what the words alone decide."""
    xlx = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return xlx(pair) - xlx(pair.sum(axis=0)) - xlx(pair.sum(axis=1))


def exchange(left: np.ndarray, right: np.ndarray, pair: np.ndarray, classes: np.ndarray, count: np.ndarray, targets: int, movable: np.ndarray) -> np.ndarray:
    """New classes of the given words: each movable word goes where the log likelihood of class bigrams grows most.

    left[w, c], right[w, c]: how often class c stands before, after w;
    pair[c, d]: class bigrams; the gain of a move keeps all other words in place.
    A word's classes are ranked by the gain to first order, which is one matrix
    product for a step of words; the full gain decides among its own and the
    NEAREST.  The words of a step move at the same time: STEP of them or fewer,
    with a SHARE-th of all tokens at most if there are two or more.
    """
    xlx = lambda x: x * np.log(np.maximum(x, 1))
    rough = lambda x: np.log(np.maximum(x, 0.5))
    classes, n = classes.copy(), pair.shape[0]
    pair, marginal = pair.astype(float), pair.sum(axis=1).astype(float)
    every = np.flatnonzero(movable)
    used, share, at = np.cumsum(count[every]), marginal.sum() / SHARE, 0
    while at < every.size:
        w = every[at : max(at + 1, min(at + STEP, int(np.searchsorted(used, share + (used[at - 1] if at else 0), "right"))))]
        at += w.size
        k, a, b, m = classes[w], left[w].astype(float), right[w].astype(float), count[w].astype(float)
        row = np.arange(w.size)
        first = a @ rough(pair[:, :targets]) + b @ rough(pair[:targets]).T - 2 * m[:, None] * rough(marginal[:targets])
        first[row, k] = np.inf
        near = np.argpartition(-first, min(NEAREST, targets - 1), axis=1)[:, : NEAREST + 1] if targets > NEAREST + 1 else np.tile(np.arange(targets), (w.size, 1))
        own = near == k[:, None]
        mine = own.argmax(axis=1)
        rest = np.maximum(marginal[near] - np.where(own, m[:, None], 0), 0)
        gain = -2 * (xlx(rest + m[:, None]) - xlx(rest))
        table = xlx(pair)
        for x, other, before in ((a, b, True), (b, a, False)):
            r, i = np.nonzero(x)  # other classes add nothing
            if not r.size:
                continue
            v, to = x[r, i], near[r]
            place = i[:, None] * n + to if before else to * n + i[:, None]
            held, less = pair.ravel().take(place), table.take(place)
            # Counts of the other words only: without the word itself in the column and the row of its class.
            every_row, in_own = np.arange(r.size), mine[r]
            held[every_row, in_own] -= v
            loop = np.flatnonzero(i == k[r])
            held[loop] -= other[r[loop, None], to[loop]]
            for touched in ((every_row, in_own), (loop,)):
                held[touched] = np.maximum(held[touched], 0)
                less[touched] = xlx(held[touched])
            start = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            gain[r[start]] += np.add.reduceat(xlx(held + v[:, None]) - less, start)
        stay = gain[own]
        best = gain.argmax(axis=1)
        moves = np.flatnonzero(gain[row, best] > stay + 1e-9)
        if not moves.size:
            continue
        new = near[moves, best[moves]]
        classes[w[moves]] = new
        change = np.zeros((moves.size, n))
        change[np.arange(moves.size), new] += 1
        change[np.arange(moves.size), k[moves]] -= 1
        pair += a[moves].T @ change + change.T @ b[moves]
        np.maximum(pair, 0, out=pair)
        marginal += m[moves] @ change
    return classes


def _held(codes: pa.BinaryArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes of some texts, where each begins) for groups of consecutive texts."""
    offset = np.frombuffer(codes.buffers()[1], np.int32 if codes.type == pa.binary() else np.int64)[codes.offset : codes.offset + len(codes) + 1] // 4
    every, at = np.frombuffer(codes.buffers()[2] or b"", np.uint32, int(offset[-1]) if len(codes) else 0), 0
    while at < len(codes):
        end = max(at + 1, int(np.searchsorted(offset, offset[at] + STRETCH, "right")) - 1)
        yield every[offset[at] : offset[end]], offset[at:end] - offset[at]
        at = end


def _score(classes: np.ndarray, gain: np.ndarray):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = []
            for own, first in _held(batch.column("codes")):
                c = classes[own].astype(np.int32)
                # Each text ends with the end code, so the class before a first word is right also across texts.
                more.append(np.add.reduceat(gain.take(np.concatenate((c[-1:], c[:-1])) * gain.shape[0] + c), first))
            score = pa.compute.add(batch.column("base_score"), pa.array(np.concatenate([*more, np.zeros(0)]), pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "codes"), score], [*(c for c in batch.schema.names if c != "codes"), "score"])

    return f


def score_documents(docs: DataFrame, held_out: F.Column) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = docs.where(~F.col("held_out")).select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = staged(counts, "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    band = lambda n: F.floor(F.log2(n.cast("double"))).cast("int")
    often = counts.where(F.col("n") >= LEAST).withColumn("part", F.pmod(F.xxhash64("word"), F.lit(PARTS)).cast("int"))
    sizes = {r.part: r["count"] for r in often.groupBy("part").count().collect()}  # at most PARTS rows
    before = np.cumsum([0] + [sizes.get(k, 0) for k in range(PARTS)]).tolist()
    places = spark.createDataFrame(list(enumerate(before[:-1])), "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy("word"))
    often = often.withColumn("place", place).join(F.broadcast(places), "part")
    often = staged(often.select("word", "n", (F.col("before") + F.col("place") + (FIRST - 1)).alias("code")), "often")
    coded = often.unionByName(counts.where(F.col("n") < LEAST).select("word", "n", (UNSEEN + 1 + band(F.col("n"))).cast("long").alias("code")))
    end = coded.where(F.col("word") == int(END)).collect()
    end_count, end_code = (end[0].n, end[0].code) if end else (0, UNSEEN)

    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = int(max(1, size // BLOCK_BYTES))
    # Repeated rows are dealt out by the part of the input that they stand in.
    placed = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.spark_partition_id()), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    bands = {r.band: r["count"] for r in counts.groupBy(band(F.col("n")).alias("band")).count().collect()}  # at most 63 rows
    edge, held = 63, 0
    while edge > 0 and held + bands.get(edge - 1, 0) <= COMMON:
        edge -= 1
        held += bands.get(edge, 0)
    often_rows = coded.where(F.col("n") >= 1 << edge).select("word", "n", "code").toArrow()
    order = np.argsort(often_rows.column("word").to_numpy())
    common = spark.sparkContext.broadcast([often_rows.column(c).to_numpy()[order] for c in ("word", "n", "code")])
    # All columns of placed are asked for, so that both uses share one exchange.
    asked = placed.mapInArrow(_distinct(common), "block int, word long")
    answers = asked.join(coded.where(F.col("n") < 1 << edge), "word").select("block", "word", "n", "code")
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, codes binary"
    kind = kind.replace("doc_id long", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    encoded = placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_encode(common, int(total), int(distinct), int(end_count), end_code), kind)
    encoded = staged(encoded, "codes")

    # Classes: those of exchange, then unknown-or-once, then frequency bands from two occurrences up.
    n, movable = CLASSES + BANDS, before[-1]
    rows = often.select("code", "n").toArrow()
    count = np.zeros(movable, np.int64)
    count[rows.column("code").to_numpy() - FIRST] = rows.column("n").to_numpy()
    filled = np.cumsum(np.sort(count)[::-1])
    order = np.argsort(-count, kind="stable")
    classes = np.zeros(FIRST + movable, np.uint8)
    classes[UNSEEN] = CLASSES
    classes[UNSEEN + 1 : FIRST] = CLASSES + np.arange(FIRST - 1)
    if movable:
        classes[FIRST + order] = np.minimum(filled * CLASSES // (int(filled[-1]) + 1), CLASSES - 1)
    size, ranges = FIRST + movable, -(-movable // RANGE)
    near = encoded.where(~F.col("held_out")).select("codes").mapInArrow(trimmed(_bigrams(size, int(end_code))), "range int, side int, size long, packed binary")
    # Each file is opened in each round, so that a task writes some ranges in one.
    near = near.repartition(-(-(ranges + int(LEAST).bit_length()) // RANGES), "range").sortWithinPartitions("range")
    kinds = [f"{c} {'long' if c.startswith('size') else 'binary'}" for side in (0, 1) for c in _columns(side, range(FINEST))]
    near = staged(near.mapInArrow(trimmed(lambda batches: _phased(_merged(size)(batches))), ", ".join(["range int", *kinds])), "neighbours")

    def summed(f, columns):
        rows = near.select("range", *columns).mapInArrow(trimmed(f), "at long, n long")
        # A task has a row a pair of classes at most: a few partitions take them, where Spark's usual number is mostly files without rows.
        rows = rows.repartition(SUMS, "at").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(n * n, np.int64)
        out[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
        return out.reshape(n, n)

    def due_columns(turn, parts):
        return [c for side in (0, 1) for c in _columns(side, _due(turn, parts))]

    def moved(c, pair, turn, parts):
        rows = near.select("range", *due_columns(turn, parts)).mapInArrow(trimmed(_move(c, n, pair, turn, parts)), "word long, class int").toArrow()
        c = c.copy()
        c[FIRST + rows.column("word").to_numpy()] = rows.column("class").to_numpy()
        return c

    pair = summed(_pairs(classes, n), _columns(1, range(FINEST)))
    best, turn, still, parts = likelihood(pair), 0, 0, 2
    while movable and still < parts and parts <= FINEST:
        new = moved(classes, pair, turn, parts)
        new_pair = pair + summed(_changes(classes, new, n, _due(turn, parts)), due_columns(turn, parts))
        now = likelihood(new_pair)
        turn += 1
        if now < best:
            parts, still = 2 * parts, 0
            continue
        still = still + 1 if now - best < RISE * total else 0
        classes, pair, best = new, new_pair, now

    # Share of each class under the base model, with one place for the unknown word.
    share = np.zeros(n)
    np.add.at(share, classes[FIRST:], count + 1)
    bands = coded.where(F.col("code") < FIRST).groupBy("code").agg(F.sum(F.col("n") + 1).alias("n")).collect() if total else []
    for r in bands:
        share[classes[r.code]] += r.n
    share[CLASSES] += 1
    share /= share.sum()
    smooth = SMOOTH * CLASSES
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.log10((pair + smooth * share[None, :]) / (pair.sum(axis=1, keepdims=True) + smooth) / share[None, :])
    gain = np.where(share[None, :] > 0, gain, 0.0)
    out = encoded.mapInArrow(trimmed(_score(classes, gain)), kind.replace("codes binary", "score double"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")

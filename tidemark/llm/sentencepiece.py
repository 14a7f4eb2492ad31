"""SentencePiece encoding and decoding with forward states shared along a trie of marked words.

Texts are cut into marked words (a run of the space mark and what follows it);
no piece crosses such a cut.  The distinct words of a stretch of text are
sorted, which lists them as a depth-first walk of their trie, and the forward
state of every prefix is computed once and reused by all words below it.

For a unigram model the forward state is the Viterbi score and the last piece.
For a BPE model a sum of scores would not give the library's result.  There
the state is the last piece alone: the encoding of a prefix ends in the one
piece that is compatible with the encoding of what is before it, compatible
meaning that merging the two pieces' characters gives back these two pieces
(van Antwerpen and Neubeck, "So many tokens, so little time").

Defined results: null text -> null ids; empty text -> no ids; characters
outside the vocabulary become byte pieces, or the unknown id if the model has
none; other columns are kept, input columns called ids, decoded or round_trip
are replaced; repeated rows are coded each.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import CACHES, slices, trimmed

MARK = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6
#: Bytes of text encoded at a time, ids decoded at a time, and words remembered between these stretches.
STRETCH_BYTES, STRETCH_IDS = 1_000_000, 200_000
REMEMBERED = 60_000
#: Compatible pairs and automaton steps remembered.
PAIRS, STEPS = 200_000, 100_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, raw[at : at + size]
        at += size


class Vocabulary:
    """Pieces, scores and byte pieces of a model file's content."""

    def __init__(self, raw: bytes) -> None:
        self.pieces: list[str] = []
        self.types: list[int] = []
        self.scores: list[float] = []
        self.bpe, dummy, squeeze, charsmap = False, 1, 1, b""
        for number, value in _fields(raw):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.types.append(own.get(3, NORMAL))
            elif number == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                own = dict(_fields(value))
                dummy, squeeze, charsmap = own.get(3, 1), own.get(4, 1), own.get(2, b"")
        if squeeze or charsmap or 4 in self.types:
            raise ValueError("only models with the identity normaliser, kept white space and no user-defined symbols")
        self.dummy = bool(dummy)
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        self.byte = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)] if BYTE in self.types else None
        self.unknown = self.types.index(UNKNOWN)
        self.prefixes = {p[:k] for p in self.ids for k in range(len(p) + 1)}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses a word mark")
        self.output = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == 3 else p.replace(MARK, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]
        alone = "" if any("\n" in p for p in self.ids) else "\n"
        self.words = re.compile(f"{alone}|{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.least = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10
        self.width = [len(p) for p in self.pieces] + [1]  # the last one is that of piece -1
        self._pairs: dict[int, bool] = {}
        self._flat: tuple[np.ndarray, np.ndarray] | None = None
        self._nodes: dict[str, tuple] = {"": ({}, (), "")}
        self._held = 0
        self._spines: tuple[dict[int, tuple], dict[int, tuple]] = ({}, {})

    def merge(self, word: str) -> list[int]:
        """Byte-pair merging by the definition: best score first, then leftmost; -1 is a character outside the vocabulary.

        Leaves the merges in self._last, in their order: (start, middle, end).
        """
        part, self._last = list(word), []
        n = len(part)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str, int]] = []

        def offer(i: int) -> None:
            j = nxt[i] if i >= 0 else n
            if i >= 0 and j < n and (k := self.ids.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, part[i] + part[j], j))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, both, j = heapq.heappop(heap)
            if not part[i] or nxt[i] != j or part[i] + part[j] != both:
                continue
            part[i], part[j] = both, ""
            self._last.append((i, j, i + len(both)))
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            offer(prev[i])
            offer(i)
        return [self.ids.get(p, -1) for p in part if p]

    def spine(self, piece: int, side: int) -> tuple:
        """What stands at one end of a piece while it is merged: (text, cost of the merge that ends it) from a character up to the piece.

        side 0 is the left end, 1 the right one.  Empty if merging does not give the piece, or not in the order of costs.
        """
        found = self._spines[side].get(piece)
        if found is None:
            text, found, top = self.pieces[piece], (), math.inf
            own, ends = self.merge(text), []
            if own == [piece]:
                at = self._last  # the merges, in order: (start, middle, end)
                ends = [m for m in at if (m[0] == 0 if side == 0 else m[2] == len(text))]
                costs = [-self.scores[self.ids[text[m[0] : m[2]]]] for m in at]
                if all(x <= y for x, y in zip(costs[:-1], costs[1:], strict=True)):
                    for m in reversed(ends):
                        found = (text[m[0] : m[2]], top, *found)
                        top = -self.scores[self.ids[text[m[0] : m[2]]]]
                    found = (text[0] if side == 0 else text[-1], top, *found)
            self._spines[side][piece] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves the two pieces as they are; left is -1 at the start and after a character outside the vocabulary.

        As long as costs only grow, the two pieces are merged inside unless the
        two texts that meet at the border merge first: before both of the merges
        that would end them, the left one of equal merges first.
        """
        if len(self._pairs) > PAIRS:
            self._pairs.clear()
        a, b = self.spine(left, 1) if left >= 0 else (), self.spine(right, 0)
        if left < 0 or not a or not b:
            found = self.merge((self.pieces[left] if left >= 0 else "") + self.pieces[right]) == [left, right][left < 0 :]
        else:
            i = j = 0
            while found := not ((k := self.ids.get(a[i] + b[j])) is not None and (cost := -self.scores[k]) < a[i + 1] and cost <= b[j + 1]):
                if a[i + 1] <= b[j + 1]:
                    if a[i + 1] == math.inf:
                        break
                    i += 2
                else:
                    j += 2
        self._pairs[left << 20 | right] = found
        return found

    def step(self, node: tuple, ch: str) -> tuple:
        """The automaton's node after one more character: (known steps, pieces (id, length) that end here, longest first, text).

        The text of a node is the longest suffix of what was read that begins a piece.
        """
        state = node[2] + ch
        while state not in self.prefixes:
            state = state[1:]
        found = self._nodes.get(state)
        if found is None:
            ends = tuple((self.ids[state[k:]], len(state) - k) for k in range(len(state)) if state[k:] in self.ids)
            found = self._nodes[state] = ({}, ends, state)
        self._held += 1
        if self._held > STEPS:
            self._held = 0
            for other in self._nodes.values():
                other[0].clear()
        node[0][ch] = found
        return found

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """Piece ids of sorted words; -1 stands for a character outside the vocabulary."""
        bpe, scores, pairs, width, step = self.bpe, self.scores, self._pairs, self.width, self.step
        most = max(map(len, words), default=0) + 1
        # By length of the prefix: automaton node, last piece, and the Viterbi score of a unigram model.
        nodes, last, best = [self._nodes[""]] * most, [-1] * most, [0.0] * most
        before, depth, out = "", 0, []
        for word in words:
            if bpe and MARK * 2 in word:  # equal scores of runs of marks
                out.append(self.merge(word))
                continue
            shared, size = 0, len(word)
            if before == word[:depth]:
                shared = depth
            else:
                for x, y in zip(word, before):  # noqa: B905  the shorter one ends it
                    if x != y:
                        break
                    shared += 1
            node = nodes[shared]
            for end in range(shared + 1, size + 1):
                ch = word[end - 1]
                node = node[0].get(ch) or step(node, ch)
                piece = -1
                if bpe:
                    for k, n in node[1]:
                        left = last[end - n]
                        ok = pairs.get(left << 20 | k)
                        if ok is None:
                            ok = self.fits(left, k)
                        if ok:
                            piece = k
                            break
                else:
                    score = best[end - 1] + self.least
                    for k, n in node[1]:
                        if (value := best[end - n] + scores[k]) > score:
                            piece, score = k, value
                    best[end] = score
                nodes[end] = node
                last[end] = piece
            before, depth = word, size
            own, at = [], size
            while at:
                own.append(last[at])
                at -= width[last[at]]
            own.reverse()
            out.append(own)
        return out

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all pieces end to end, and where each begins."""
        if self._flat is None:
            first = np.concatenate(([0], np.cumsum([len(x) for x in self.output])))
            self._flat = np.frombuffer(b"".join(self.output), np.uint8), first
        return self._flat

    def spelled(self, word: str, found: list[int]) -> list[int]:
        """Byte pieces in place of characters outside the vocabulary."""
        if -1 not in found:
            return found
        out, at = [], 0
        for k in found:
            if k >= 0:
                out.append(k)
                at += len(self.pieces[k])
            else:
                out += [self.byte[b] for b in word[at].encode()] if self.byte else [self.unknown]
                at += 1
        return out


class Encoder:
    """Encodes texts, remembering words between calls; at most REMEMBERED words are held."""

    _cache: dict[int, Encoder] = {}

    def __init__(self, raw: bytes) -> None:
        self.vocabulary = Vocabulary(raw)
        self.clear()

    @classmethod
    def cached(cls, raw: bytes) -> Encoder:
        if hash(raw) not in cls._cache:
            cls._cache.clear()
            cls._cache[hash(raw)] = cls(raw)
        return cls._cache[hash(raw)]

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.pool, self.offset = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def words(self, text: str) -> list[str]:
        text = text.replace(" ", MARK)
        return self.vocabulary.words.findall(MARK + text if self.vocabulary.dummy else text) if text else []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids by text, all ids)."""
        words = [self.words(t or "") for t in texts]
        distinct = set().union(*words)
        new = [w for w in distinct if w not in self.at]
        if len(self.at) + len(new) > REMEMBERED and self.at:
            self.keep([w for w in distinct if w in self.at])
        if new:
            new.sort()
            v = self.vocabulary
            found = [v.spelled(w, p) for w, p in zip(new, v.encode_sorted(new), strict=True)]
            size = np.fromiter(map(len, found), np.int64, len(found))
            self.pool = np.concatenate((self.pool, np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))))
            self.offset = np.concatenate((self.offset, self.offset[-1] + np.cumsum(size)))
            base = len(self.at)
            self.at.update(zip(new, range(base, base + len(new)), strict=True))
        index = np.fromiter(map(self.at.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        start, size = self.offset[index], self.offset[index + 1] - self.offset[index]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[np.arange(total[-1]) + np.repeat(start - total[:-1], size)]
        edge = total[np.concatenate(([0], np.cumsum([len(w) for w in words])))]
        return np.diff(edge), ids

    def keep(self, words: list[str]) -> None:
        """Forget all but the given words, which were met again."""
        index = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        start, size = self.offset[index], self.offset[index + 1] - self.offset[index]
        total = np.concatenate(([0], np.cumsum(size)))
        self.pool = self.pool[np.arange(total[-1]) + np.repeat(start - total[:-1], size)]
        self.offset = total
        self.at = dict(zip(words, range(len(words)), strict=True))

    def decode_all(self, ids: np.ndarray, edge: np.ndarray) -> list[str]:
        """Texts of ids[edge[k] : edge[k + 1]], joined as bytes all at once."""
        flat, first = self.vocabulary.flat()
        size = first[ids + 1] - first[ids]
        total = np.concatenate(([0], np.cumsum(size)))
        raw = flat[np.arange(total[-1]) + np.repeat(first[ids] - total[:-1], size)].tobytes()
        out = []
        cut = total[edge].tolist()
        drop = self.vocabulary.dummy
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            out.append(raw[a + 1 if drop and a < b and raw[a] == 32 else a : b].decode(errors="replace"))
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.vocabulary.output.__getitem__, ids)).decode(errors="replace")
        return text[1:] if self.vocabulary.dummy and text.startswith(" ") else text


CACHES["pieces"] = Encoder._cache


def _encoded(encoder: Encoder, texts: list[str | None]) -> pa.ListArray:
    counts, ids = encoder.encode(texts)
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), mask=np.array([t is None for t in texts] + [False]))
    return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))


def _decoded(encoder: Encoder, column: pa.ListArray) -> Iterator[list[str | None]]:
    """Texts of a column of ids, about STRETCH_IDS ids at a time and at least one row."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    null, k = column.is_null().to_pylist(), 0
    while k < len(column):
        end = k + 1
        while end < len(column) and at[end + 1] - at[k] <= STRETCH_IDS:
            end += 1
        found = encoder.decode_all(values[at[k] : at[end]], at[k : end + 1] - at[k])
        yield [None if n else t for n, t in zip(null[k:end], found, strict=True)]
        k = end


def _encode(model):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.cached(model.value)
        for batch in slices(batches, most=STRETCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), _encoded(encoder, batch.column("text").to_pylist())], ["row", "text", "ids"])

    return f


def _decode(model):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.cached(model.value)
        for batch in batches:
            at = 0
            for out in _decoded(encoder, batch.column("row").field("ids")):
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, len(out)), pa.array(out, pa.string())], ["row", "decoded"])
                at += len(out)

    return f


def _both(model):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.cached(model.value)
        for batch in slices(batches, most=STRETCH_BYTES):
            texts = batch.column("text").to_pylist()
            ids = _encoded(encoder, texts)
            back = [t for part in _decoded(encoder, ids) for t in part]
            same = [x == y for x, y in zip(texts, back, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), ids, pa.array(same, pa.bool_())], ["row", "ids", "round_trip"])

    return f


def _model(df: DataFrame, path: str):
    with open(path, "rb") as f:  # a file of the driver; half a megabyte goes to the executors
        return df.sparkSession.sparkContext.broadcast(f.read())


def _rows(docs: DataFrame, *added: str) -> DataFrame:
    """row (all columns but text and the added ones) and text; a place is held where no column is left."""
    own = [c for c in docs.columns if c not in ("text", *added)]
    return docs.select(F.struct(*own) if own else F.struct(F.lit(0).alias("none")), F.col("text").cast("string")).toDF("row", "text")


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """docs (text, ...) -> the same columns and ids array<int>."""
    rows = _rows(docs, "ids")
    out = rows.mapInArrow(trimmed(_encode(_model(docs, model_path)), "pieces"), f"row {rows.schema['row'].dataType.simpleString()}, text string, ids array<int>")
    return out.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "ids"), "ids")


def decode(pieces: DataFrame, model_path: str) -> DataFrame:
    """pieces (ids array<int>, ...) -> the same columns and decoded string."""
    own = [c for c in pieces.columns if c not in ("ids", "decoded")]
    rows = pieces.select(F.struct(*own, F.col("ids")).alias("row"))
    out = rows.mapInArrow(trimmed(_decode(_model(pieces, model_path)), "pieces"), f"row {rows.schema['row'].dataType.simpleString()}, decoded string")
    return out.select("row.*", "decoded")


def encode_and_check(docs: DataFrame, model_path: str) -> DataFrame:
    """docs (text, ...) -> the other columns, ids array<int>, and round_trip: whether the decoded ids are the text.

    One worker encodes and decodes, and no text goes back to the JVM.  A null
    text has null ids, which decode to null: its round trip is true.
    """
    rows = _rows(docs, "ids", "round_trip")
    kind = f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>, round_trip boolean"
    out = rows.mapInArrow(trimmed(_both(_model(docs, model_path)), "pieces"), kind)
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("text", "ids", "round_trip")), "ids", "round_trip")

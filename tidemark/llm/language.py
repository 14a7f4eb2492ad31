"""Language identification by cross-parsing (Ziv and Merhav): the fewest longest-match phrases win.

For each language a suffix automaton holds all substrings of its labelled
text.  A document is parsed greedily into the longest pieces an automaton
contains; a language whose text resembles it needs few pieces.  A match grows
with the logarithm of the text it is looked for in, so phrase counts are
normalised by that of each language's text (the estimate of the cross entropy
is phrases * log(labelled text) / length).  Automata are
flattened to transition tables, and many stretches of text walk them in lock
step, one symbol of each at a time, so the loop is over positions and not
over characters.

Defined results: null text, or one without any letter -> ``und`` with score
0; no labelled text at all -> ``und``; equal normalised counts -> the language
first in code-point order; other columns are kept, an input column called
lang_pred or score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import staged
from .words import CACHES, trimmed

UNKNOWN = "und"
#: Bound of the labelled text behind one automaton, in characters, and of the documents it is drawn from.
TRAIN_CHARS = 24_000
TRAIN_DOCS = 64
#: Bound of the labelled text behind all automata; with more than 64 languages each gets its part of it.
ALL_CHARS = 64 * TRAIN_CHARS
#: A document is parsed in stretches of this many characters; all count.
STRETCH = 512
#: Stretches that walk together.
LANES = 16_384
_LETTER = regex.compile(r"\p{L}")


def _fold(text: str) -> str:
    """Letters in lower case; each run of anything else is one space."""
    return regex.sub(r"[^\p{L}\p{M}]+", " ", text.lower())


def automaton(text: str, code: dict[str, int], width: int) -> np.ndarray:
    """Transition table of the suffix automaton of text, flat, by state * width + code.

    Column 0 stands for characters outside the alphabet, the last one pads.
    A missing transition starts a new phrase: its entry is the complement of
    the state that the symbol leads to from the root.
    """
    nxt, link, length, last = [{}], [-1], [0], 0
    for ch in text:
        c = code.get(ch, 0)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    root = np.zeros(width, np.int32)
    for c, s in nxt[0].items():
        root[c] = s * width
    root[0] = 0
    table = np.broadcast_to(~root, (len(nxt), width)).copy()
    for s, edges in enumerate(nxt):
        for c, t in edges.items():
            if c:
                table[s, c] = t * width
    table[:, width - 1] = np.arange(len(nxt)) * width
    return table.ravel()


class Model:
    """Automata by language over one alphabet; built from (lang, text) pairs on first use in a process."""

    _cache: dict[int, Model] = {}

    def __init__(self, texts: list[tuple[str, str]]) -> None:
        self.langs = [k for k, _ in texts]
        chars = sorted({c for _, t in texts for c in t})
        code = {c: i + 1 for i, c in enumerate(chars)}
        self.width = len(chars) + 2
        self.kind = np.uint8 if self.width <= 256 else np.uint16
        self.pad = self.width - 1
        space = code.get(" ", 0)
        # Code points without a letter fold to a space, others to their lower case.
        self.map = np.full(0x10000, space, self.kind)
        for cp in range(0x10000):
            ch = chr(cp)
            low = ch.lower()
            if low in code:
                self.map[cp] = code[low]
            elif 0xD800 <= cp < 0xE000 or _LETTER.match(ch):
                self.map[cp] = 0
        self.tables = [automaton(t, code, self.width) for _, t in texts]
        self.weight = np.array([np.log(max(2, len(t))) for _, t in texts])
        self.space = space

    @classmethod
    def cached(cls, texts: list[tuple[str, str]]) -> Model:
        key = hash(tuple(texts))
        if key not in cls._cache:
            cls._cache.clear()
            cls._cache[key] = cls(texts)
        return cls._cache[key]

    def codes(self, text: str) -> np.ndarray:
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.map[np.where(cp < 0x10000, cp, 0xD800)]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by text and language, parsed symbols by text)."""
        codes = []
        for t in texts:
            c = self.codes(t)
            if c.size > 1:  # runs of spaces are one
                c = c[np.concatenate(([True], (c[1:] != self.space) | (c[:-1] != self.space)))]
            codes.append(c)
        size = np.array([c.size for c in codes], np.int64)
        parts = -(-size // STRETCH)
        total = np.zeros((len(texts), len(self.tables)), np.int64)
        if not parts.sum():
            return total, size
        lanes = np.full((int(parts.sum()), STRETCH), self.pad, self.kind)
        of = np.repeat(np.arange(len(texts)), parts)
        first = np.cumsum(parts) - parts
        for k, c in enumerate(codes):
            lanes[first[k] : first[k] + parts[k]].reshape(-1)[: c.size] = c
        left = np.minimum(STRETCH, np.repeat(size, parts) - (np.arange(of.size) - first[of]) * STRETCH)
        order = np.argsort(-left, kind="stable")
        for a in range(0, order.size, LANES):
            own = order[a : a + LANES]
            block = np.ascontiguousarray(lanes[own].T)
            live = np.searchsorted(-left[own], -np.arange(STRETCH), "left")  # lanes with a symbol at each position
            for k, table in enumerate(self.tables):
                state = np.zeros(own.size, np.int32)
                count = np.ones(own.size, np.int32)
                for i in range(STRETCH):
                    n = live[i]
                    if not n:
                        break
                    to = table.take(state[:n] + block[i, :n])
                    sign = to >> 31
                    count[:n] -= sign
                    np.bitwise_xor(to, sign, out=state[:n])
                np.add.at(total[:, k], of[own], count)
        return total, size


CACHES["language"] = Model._cache


def _predict(texts: list[tuple[str, str]]):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.cached(texts) if texts else None
        for batch in batches:
            column = batch.column("row").field("text")
            lang, score = [], []
            at, chars = 0, pa.compute.fill_null(pa.compute.utf8_length(column), 0).to_numpy(zero_copy_only=False)
            while at < batch.num_rows:  # by about 2 million characters
                end = at + max(1, int(np.searchsorted(np.cumsum(chars[at:]), 2_000_000, "right")))
                part = [x or "" for x in column.slice(at, end - at).to_pylist()]
                at = end
                if model is None:
                    lang += [UNKNOWN] * len(part)
                    score += [0.0] * len(part)
                    continue
                counts, _ = model.phrases(part)
                counts = counts * model.weight
                best = counts.argmin(axis=1)
                rest = counts.copy()
                rest[np.arange(len(part)), best] = np.inf
                second = rest.min(axis=1)
                low = counts[np.arange(len(part)), best]
                sure = np.where(np.isfinite(second), 1 - low / np.maximum(second, 1), 1.0)
                for k, t in enumerate(part):
                    known = _LETTER.search(t) is not None
                    lang.append(model.langs[best[k]] if known else UNKNOWN)
                    score.append(float(min(1.0, max(0.0, sure[k]))) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["row", "lang_pred", "score"])

    return f


def _level(sizes: list[int], chars: int) -> int:
    """The characters each document may give so that all of them, with a space after each, give at most ``chars``."""
    left, level = max(0, chars - len(sizes)), 0
    for k, size in enumerate(sorted(sizes)):
        level = left // (len(sizes) - k)
        if size > level:
            break
        left -= size
        level = size
    return max(1, level)


def _spread(text: F.Column, size: F.Column, n: F.Column) -> F.Column:
    """n of the size characters of text, in pieces of about STRETCH that lie evenly over it; all of it where n is no less."""
    pieces = F.greatest(F.lit(1), F.ceil(n / STRETCH)).cast("int")
    own = F.greatest(F.lit(1), F.floor(n / pieces) - 1).cast("int")
    start = lambda k: F.floor(k * (size - own) / F.greatest(F.lit(1), pieces - 1)).cast("int") + 1
    found = F.transform(F.sequence(F.lit(0), pieces - 1), lambda k: F.substring(text, start(k), own))
    return F.when(size <= n, text).otherwise(F.array_join(found, " "))


def training_texts(labelled: DataFrame, chars: int = TRAIN_CHARS, docs: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """A bounded sample of labelled text by language: at most ``docs`` documents in hash order, ``chars`` characters in all.

    labelled: doc_id, text, lang.  Only ids and sizes are compared to choose;
    the chosen texts alone reach the driver.  The bound is shared: what short
    documents leave goes to the longer ones, each of which gives pieces from
    all over its text.  Every language with a labelled text is learnt; of rows
    with one doc_id and language the smallest text counts, and rows without a
    doc_id are not learnt from.
    """
    rows = labelled.where("lang is not null and text is not null and doc_id is not null")
    draw = rows.select("lang", "doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)).alias("h"))
    drawn = draw.groupBy("lang", F.pmod("h", F.lit(docs)).alias("slot")).agg(F.min_by("doc_id", "h").alias("doc_id"))
    ids = sorted({r.doc_id for r in drawn.select("doc_id").collect()})
    if not ids:
        return []
    chosen = rows.where(F.col("doc_id").isin(ids)).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).withColumn("size", F.char_length("text"))
    chosen = staged(chosen, "labelled")  # at most ``docs`` rows a language
    sizes: dict[str, list[int]] = {}
    for r in chosen.select("lang", "size").collect():
        sizes.setdefault(r.lang, []).append(r.size)
    chars = max(1, min(chars, ALL_CHARS // len(sizes)))
    levels = {k: _level(v, chars) for k, v in sizes.items()}
    level = F.create_map(*(F.lit(x) for pair in levels.items() for x in pair))[F.col("lang")]
    picked = chosen.select("lang", "doc_id", _spread(F.col("text"), F.col("size"), level).alias("text")).collect()
    texts: dict[str, str] = {}
    for r in sorted(picked, key=lambda r: (r.lang, r.doc_id)):
        texts[r.lang] = (texts.get(r.lang, "") + " " + _fold(r.text)[: levels[r.lang]])[:chars]
    return sorted((k, t) for k, t in texts.items() if t.strip())


def predict_language(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """docs (text, ...) -> the same columns, lang_pred and score (0 to 1: one less the ratio of the best to the next normalised count)."""
    texts = training_texts(labelled)
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.withColumn("text", F.col("text").cast("string")).select(F.struct(*own).alias("row"))
    kind = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double"
    return rows.mapInArrow(trimmed(_predict(texts), "language"), kind).select("row.*", "lang_pred", "score")


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))

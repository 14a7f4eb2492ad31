"""Token counts by section: whole documents are encoded once and token spans joined to section spans.

Byte-level tokens of a text lie end to end, so their spans are running sums of
token lengths.  Sections are half-open character spans; both are put on bytes
and joined by binary search.  A token that crosses a section border is given
out by an explicit rule: ``start``, ``middle`` or ``end`` give it to the
section that holds its first, middle or last byte; ``split`` gives each
section the share of its bytes.

Defined results: null text -> null counts; empty text -> no tokens and, by
lines, one empty section; a null section list -> no sections; spans are
clipped to the text; overlapping sections each count their tokens; characters
outside all sections count in n_tokens only; other columns are kept, those
called n_tokens, n_crossing or section_tokens are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import CACHES, trimmed

#: Fixed value: how byte-level vocabularies of this family cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "middle", "end", "split")
ADDED = ("n_tokens", "n_crossing", "section_tokens")
_cache: dict[int, tuple] = {}
CACHES["tokens"] = _cache


def _encoding(raw: bytes):
    """(encoder, bytes of each token id) from the lines of a rank file, once in a process."""
    key = hash(raw)
    if key not in _cache:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, k in ranks.items():
            size[k] = len(piece)
        _cache.clear()
        _cache[key] = tiktoken.Encoding("tidemark", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size
    return _cache[key]


def line_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of lines, each with its line feed."""
    end = np.flatnonzero(raw == 10) + 1
    if not end.size or end[-1] != raw.size:
        end = np.append(end, raw.size)
    return np.concatenate(([0], end[:-1])), end


def allocate(size: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """(tokens of each byte span, tokens that cross a border) for tokens of the given sizes."""
    edge = np.concatenate(([0], np.cumsum(size)))
    start, end = edge[:-1], edge[1:]
    if rule == "split":
        def upto(x):
            k = np.clip(np.searchsorted(end, x, "right"), 0, max(size.size - 1, 0))
            return k + (x - start[k]) / size[k] if size.size else np.zeros(x.size)
        count = upto(high) - upto(low)
    else:
        point = {"start": start, "middle": (start + end - 1) // 2, "end": end - 1}[rule]
        count = (np.searchsorted(point, high) - np.searchsorted(point, low)).astype(float)
    border = np.concatenate((low, high))
    k = np.searchsorted(start, border) - 1
    k, border = k[k >= 0], border[k >= 0]
    return np.maximum(count, 0), int(np.unique(k[border < end[k]]).size)


def _attribute(model, rule: str, by_lines: bool):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sizes = _encoding(model.value)
        for batch in batches:
            total, crossing, counts = [], [], []
            spans = None if by_lines else batch.column("sections").to_pylist()
            for k, text in enumerate(batch.column("row").field("text")):
                text = text.as_py()
                if text is None:
                    total.append(None)
                    crossing.append(None)
                    counts.append(None)
                    continue
                size = sizes[np.array(encoder.encode_ordinary(text), np.int64)]
                raw = np.frombuffer(text.encode(), np.uint8)
                if by_lines:
                    low, high = line_spans(raw)
                else:
                    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), raw.size)  # byte of each character
                    own = np.array([(x["start"] or 0, x["end"] if x["end"] is not None else at.size - 1) for x in spans[k] or []], np.int64).reshape(-1, 2)
                    low, high = at[np.clip(own, 0, at.size - 1)].T
                    high = np.maximum(low, high)
                n, cross = allocate(size, low, high, rule)
                total.append(size.size)
                crossing.append(cross)
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(total, pa.int64()), pa.array(crossing, pa.int64()), pa.array(counts, pa.list_(pa.float64()))], ["row", *ADDED])

    return f


def attribute_tokens(docs: DataFrame, ranks_path: str, rule: str = "start", sections: str | None = None) -> DataFrame:
    """docs (text, ...) -> the same columns, n_tokens, n_crossing, section_tokens array<double>.

    sections names a column array<struct<start: int, end: int>>; without one
    each line is a section.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(ranks_path, "rb") as f:  # a file of the driver; under a megabyte goes to the executors
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    own = [c for c in docs.columns if c not in ADDED]
    docs = docs.withColumn("text", F.col("text").cast("string"))
    columns = [F.struct(*own).alias("row")]
    if sections:
        columns.append(F.col(sections).cast("array<struct<start:int,end:int>>").alias("sections"))
    rows = docs.select(*columns)
    kind = f"row {rows.schema['row'].dataType.simpleString()}, n_tokens long, n_crossing long, section_tokens array<double>"
    return rows.mapInArrow(trimmed(_attribute(model, rule, sections is None), "tokens"), kind).select("row.*", *ADDED)

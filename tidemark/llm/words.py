"""Vectorised word tables over raw UTF-8 bytes.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D``.  Every byte of a text is
looked at once; nothing here makes a Python object per word.
"""

from __future__ import annotations

import numpy as np

#: Texts are tokenised in blocks of about this many bytes, cut at white space.
BLOCK_BYTES = 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (two multiply-xorshift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]


class _Powers:
    def __init__(self) -> None:
        self.table = np.cumprod(np.full(256, _ODD, np.uint64))

    def upto(self, n: int) -> np.ndarray:
        if n > self.table.size:
            self.table = np.cumprod(np.full(max(n, 2 * self.table.size), _ODD, np.uint64))
        return self.table


_POWERS = _Powers()


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the starts and ends of words."""
    if not buf.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    into = ~space[edge]
    starts, ends = edge[into], edge[~into]
    if not space[0]:
        starts = np.concatenate(([0], starts))
    if not space[-1]:
        ends = np.concatenate((ends, [buf.size]))
    return starts, ends


def _hash_block(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    size = ends - starts
    off = np.cumsum(size) - size
    body = buf[~SPACE[buf]]
    place = np.arange(body.size)
    place -= np.repeat(off, size)
    value = table[body]
    value *= _POWERS.upto(int(size.max()))[place]
    return mix64(np.add.reduceat(value, off))


def word_table(raw: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of all words of one buffer; ``lower`` folds A-Z only."""
    buf = np.frombuffer(raw, np.uint8)
    table = _LOWER if lower else _BYTE
    if buf.size <= BLOCK_BYTES:
        starts, ends = spans(buf)
        return starts, ends, _hash_block(buf, starts, ends, table) if starts.size else np.zeros(0, np.uint64)
    parts, at = [], 0
    while at < buf.size:
        end = min(at + BLOCK_BYTES, buf.size)
        while end < buf.size and not SPACE[buf[end]]:
            step = np.flatnonzero(SPACE[buf[end : end + 4096]])
            end = end + int(step[0]) if step.size else min(end + 4096, buf.size)
        piece = buf[at:end]
        starts, ends = spans(piece)
        if starts.size:
            parts.append((starts + at, ends + at, _hash_block(piece, starts, ends, table)))
        at = end
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def joined(texts: list[bytes | None]):
    """Yield (index of the first text, texts joined by line ends, where each begins and the last one ends) for groups of many short texts."""
    at = 0
    while at < len(texts):
        group, size, end = [], 0, at
        while end < len(texts) and (end == at or size + len(texts[end] or b"") < BLOCK_BYTES // 4):
            group.append(texts[end] or b"")
            size += len(group[-1]) + 1
            end += 1
        yield at, b"\n".join(group), np.cumsum([0] + [len(x) + 1 for x in group])
        at = end


def groups(texts: list[bytes | None], lower: bool):
    """Yield (index of the first text, where texts begin in bytes, in words, starts, ends, hashes) for groups of texts.

    Offsets are relative to the group; text k has the words cut[k] to cut[k + 1].
    """
    for at, raw, base in joined(texts):
        starts, ends, hashes = word_table(raw, lower)
        yield at, base, np.searchsorted(starts, base), starts, ends, hashes


def tables(texts: list[bytes | None], lower: bool):
    """Yield (index, starts, ends, hashes) for every text, tokenising many short texts together.

    Offsets are relative to the text.  A null text has no words.
    """
    for at, base, cut, starts, ends, hashes in groups(texts, lower):
        for k in range(base.size - 1):
            a, b = cut[k], cut[k + 1]
            yield at + k, starts[a:b] - base[k], ends[a:b] - base[k], hashes[a:b]


def sequence_hashes(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of n consecutive words."""
    m = words.size - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, np.uint64(salt & 0xFFFFFFFFFFFFFFFF), np.uint64)
    for k in range(n):
        out *= _ODD
        out += words[k : k + m]
    return mix64(out)


def slices(batches, column: str = "text", most: int = 16_000_000):
    """Parts of record batches with about ``most`` bytes of text, and at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        end = np.cumsum(pa_lengths(batch.column(column)))
        at = 0
        while at < batch.num_rows:
            done = int(end[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(end, done + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def pa_lengths(column) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


#: What operators keep between the tasks of a worker, by operator.
CACHES: dict[str, dict] = {}


def trimmed(f, keeps: str = ""):
    """f over batches, with memory given back before and after it.

    A Python worker lives on with the next stage: what other operators keep in
    it is dropped when f starts, all but the cache named by ``keeps``.
    """

    def run(batches):
        drop_others(keeps)
        give_back()
        yield from f(batches)
        give_back()

    return run


def drop_others(keeps: str) -> None:
    for name, cache in CACHES.items():
        if name != keeps:
            cache.clear()


def give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def as_bytes(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes, without decoding."""
    import pyarrow as pa

    return column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()

"""Substring dedup over bytes: what is covered by a long string that also starts anywhere else.

Each string of ``length`` bytes (window) is routed by content: of the hashes of
its runs of half the length the smallest, the leftmost of equal ones, is its
anchor.  Neighbouring windows with one anchor travel as one segment.  Equal
windows have equal anchors at equal distances, so they meet; segments whose
anchor occurs once in the corpus stay behind (a Bloom filter of fixed size
finds them; its false positives only cost time).  Equal segments travel once,
with their count.

Where different segments share an anchor, a suffix array decides.  Segments are
cut, from the anchor on both ways, into symbols of SYMBOL bytes, the suffixes of
whole anchors' segments are sorted by the linear grouping construction
(``suffix_groups``), and the common prefixes of neighbours in the array are
measured in bytes.  Suffixes not parted by a common prefix shorter than
``length`` share a window; windows that begin inside a symbol are compared by
the bytes up to the next symbol and the suffix there.  Windows of an anchor with
more segments than one array takes are counted one by one by their 128-bit
hashes instead.

Defined results: null text has no bytes; an empty or short text loses nothing;
equal rows are other rows, so each loses what it has in common with the other;
doc_id plays no part and may be null; a multibyte character may lose some of its
bytes, so kept_bytes is binary; input columns called n_bytes, n_removed, n_spans
or kept_bytes are replaced, all others are kept as they are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import _bloom, _first, _probes
from .store import staged
from .suffix_groups import suffix_array
from .words import as_bytes, mix64, slices, trimmed

#: Windows of one text that are hashed together.
PIECE = 1 << 20
#: Bytes of a symbol of the suffix arrays.
SYMBOL = 8
#: Bytes of segments in one suffix array; a task makes several, each of whole anchors.
ARRAY_BYTES = 1 << 21
#: Anchors whose windows are counted one by one, those with the most segments first (8 bytes each are broadcast); any others stay whole.
MOST_WIDE = 1_000_000
#: Texts that lose bytes up to this count are broadcast (16 bytes each); beyond it all texts are joined.
BROADCAST_IDS = 300_000
ADDED = ("n_bytes", "n_removed", "n_spans", "kept_bytes")
TEXT_KEY = "t1 long, t2 long"

_ODD = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_BYTE = mix64(np.arange(77, 333, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACE = np.uint64((1 << 24) - 1)


class _Powers:
    """Powers of the base and of its inverse, as far as they have been needed."""

    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.up.size < n:
            cls.up, cls.down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, x, np.uint64)))) for x in (_ODD, _BACK))
        return cls.up, cls.down


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    up, _ = _Powers.to(buf.size + 1)
    out = np.zeros(buf.size + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: buf.size], out=out[1:])
    return out


def hashes(sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice, at: np.ndarray | slice) -> np.ndarray:
    """Hashes of byte strings by their ends: equal strings have equal hashes wherever they stand."""
    return (sums[end] - sums[start]) * _Powers.to(sums.size)[1][at]


def segments(texts: list[bytes | None], length: int, run: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per buffer: text, offset of its piece, first window, windows, anchor's place, anchor, key, and the buffer with its sums.

    Arrays are by segment; texts that are too short have none.  Short texts share a buffer.
    """
    group: list[tuple[int, int, bytes]] = []
    total = 0
    for k, text in enumerate(texts):
        for at in range(0, max(0, len(text or b"") - length + 1), PIECE):
            piece = text[at : at + PIECE + length - 1]
            if group and total + len(piece) > PIECE + length:
                yield _segments(group, length, run)
                group, total = [], 0
            group.append((k, at, piece))
            total += len(piece)
    if group:
        yield _segments(group, length, run)


def _segments(group, length: int, run: int):
    size = np.array([len(p) for _, _, p in group])
    base = np.cumsum(size) - size
    buf = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
    sums = prefix_sums(buf)
    m = buf.size - run + 1
    g = mix64(hashes(sums, slice(0, m), slice(run, run + m), slice(0, m)))
    low = (g & ~_PLACE) | np.arange(m, dtype=np.uint64)
    wide, have = length - run + 1, 1
    while have < wide:  # smallest of ``have`` neighbours, doubled; equal hashes are told by place
        step = min(have, wide - have)
        low = np.minimum(low[: low.size - step], low[step:])
        have += step
    at = (low & _PLACE).astype(np.int64)
    edge = np.zeros(at.size + 1, bool)
    edge[1:-1] = at[1:] != at[:-1]
    edge[base] = True
    valid = np.zeros(at.size + 1, np.int8)
    valid[base] += 1
    stop = base + size - length + 1
    valid[stop] -= 1
    edge[stop] = True
    inside = np.cumsum(valid)[:-1] > 0
    start = np.flatnonzero(edge[:-1] & inside)
    count = np.diff(np.append(np.flatnonzero(edge), at.size))[np.searchsorted(np.flatnonzero(edge), start)]
    of = np.searchsorted(base, start, "right") - 1
    key = mix64(hashes(sums, start, start + count + length - 1, start) ^ mix64(count.astype(np.uint64)))
    own = np.array([k for k, _, _ in group])[of]
    offset = np.array([a for _, a, _ in group])[of] - base[of]
    return own, offset, start, count, at[start], g[at[start]].view(np.int64), key.view(np.int64), buf, sums


def _anchors(length: int, run: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [x[5] for x in segments(as_bytes(batch.column("text")), length, run)]
            if found:
                anchor, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], ["anchor", "n"])

    return f


SEGMENT = f"anchor long, key long, {TEXT_KEY}, start long, count long, shift int, n long, seg binary"


def _shared_segments(length: int, run: int, bloom, wide=None):
    """Segments whose anchor passes the filter; with ``wide``, the single windows of these anchors, without their bytes."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bloom.value
        for batch in slices(batches):
            t1, t2 = batch.column("t1").to_numpy(), batch.column("t2").to_numpy()
            parts, texts = [], []
            for own, offset, start, count, at, anchor, key, buf, sums in segments(as_bytes(batch.column("text")), length, run):
                keep = np.ones(start.size, bool) if wide is None else np.isin(anchor, wide.value)
                for p in _probes(anchor.view(np.uint64)):
                    keep &= (bits[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) != 0
                if not keep.any():
                    continue
                own, offset, start, count, at, anchor, key = (x[keep] for x in (own, offset, start, count, at, anchor, key))
                if wide is not None:
                    own, offset = np.repeat(own, count), np.repeat(offset, count)
                    start = np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
                    whole = hashes(sums, start, start + length, start)
                    anchor, key = mix64(whole).view(np.int64), mix64(hashes(sums, start, start + length // 2, start) ^ mix64(whole + _ODD)).view(np.int64)
                    count, at = np.ones(start.size, np.int64), start
                else:
                    raw = buf.tobytes()
                    texts += [raw[a:b] for a, b in zip(start.tolist(), (start + count + length - 1).tolist(), strict=True)]
                parts.append((anchor, key, t1[own], t2[own], offset + start, count, (at - start).astype(np.int32)))
            if not parts:
                continue
            anchor, key, t1, t2, start, count, shift = (np.concatenate(x) for x in zip(*parts, strict=True))
            # One row of a batch stands for each distinct segment, with its count in the batch and its bytes.
            order = np.lexsort((key, anchor))
            first = np.flatnonzero(_first(anchor[order], key[order]))
            n = np.zeros(start.size, np.int64)
            n[order[first]] = np.diff(np.append(first, order.size))
            seg = pa.array([t if c else None for t, c in zip(texts, n.tolist(), strict=True)], pa.binary()) if texts else pa.nulls(start.size, pa.binary())
            n = pa.array(n, mask=n == 0)
            yield pa.RecordBatch.from_arrays([*map(pa.array, (anchor, key, t1, t2, start, count, shift)), n, seg], [c.split()[0] for c in SEGMENT.split(", ")])

    return f


def shared_windows(segs: list[bytes], shift: np.ndarray, length: int, symbol: int = SYMBOL) -> list[np.ndarray]:
    """For each segment whether each of its windows also stands in another one; ``shift`` is where the common run begins."""
    size = np.array([len(s) for s in segs])
    pad = -np.asarray(shift) % symbol
    blocks = -(-(pad + size) // symbol)
    text = b"".join(b"\0" * p + s + b"\0" * (b * symbol - p - z) for s, p, b, z in zip(segs, pad.tolist(), blocks.tolist(), size.tolist(), strict=True))
    wide = np.zeros((int(blocks.sum()), 8), np.uint8)
    wide[:, 8 - symbol :] = np.frombuffer(text, np.uint8).reshape(-1, symbol)
    value = wide.view(">u8").ravel().astype(np.uint64)
    first = np.cumsum(blocks + 1) - blocks - 1  # a separator behind each segment
    of = np.repeat(np.arange(size.size), blocks + 1)
    place = np.arange(of.size) - first[of]
    real = place < blocks[of]
    codes = np.zeros(of.size, np.int64)
    codes[real] = np.unique(value, return_inverse=True)[1] + 1
    whole = np.zeros(of.size + 1, np.uint64)
    whole[:-1][real] = value
    array = suffix_array(codes)
    left = np.where(real, pad[of] + size[of] - place * symbol, 0)  # bytes to the end of the segment
    common = _common(array, codes, whole, symbol, length)
    common = np.minimum(common, np.minimum(left[array[1:]], left[array[:-1]]))
    hit = np.zeros(int(size.sum()), bool)
    offset = np.cumsum(size) - size
    begin = place * symbol - pad[of]  # of each symbol in its segment
    before = np.concatenate(([np.uint64(0)], whole[:-2]))
    for r in range(symbol):
        near = common >= length - r
        member = np.zeros(array.size, bool)
        member[1:] |= near
        member[:-1] |= near
        own = np.concatenate(([0], np.cumsum(~near)))[member]
        x = array[member]
        at = begin[x] - r
        good = (at >= 0) & (at + length <= size[of[x]])
        x, own, at = x[good], own[good], at[good]
        if not x.size:
            continue
        tail = before[x] & np.uint64((1 << 8 * r) - 1)
        by = np.lexsort((tail, own))
        same = (own[by][1:] == own[by][:-1]) & (tail[by][1:] == tail[by][:-1])
        both = np.zeros(x.size, bool)
        both[by[1:][same]] = True
        both[by[:-1][same]] = True
        hit[offset[of[x[both]]] + at[both]] = True
    return [hit[a : a + n - length + 1] for a, n in zip(offset.tolist(), size.tolist(), strict=True)]


def _common(array: np.ndarray, codes: np.ndarray, whole: np.ndarray, symbol: int, most: int) -> np.ndarray:
    """Bytes that neighbours in the array have in common, counted up to ``most`` or a little more."""
    out = np.zeros(array.size - 1, np.int64)
    a, b, live = array[:-1], array[1:], np.arange(array.size - 1)
    for k in range(-(-most // symbol) + 1):
        a2, b2 = np.minimum(a[live] + k, codes.size - 1), np.minimum(b[live] + k, codes.size - 1)
        same = (codes[a2] == codes[b2]) & (codes[a2] > 0)
        differ = live[~same]
        xor = whole[a2[~same]] ^ whole[b2[~same]]
        part = np.zeros(differ.size, np.int64)
        for byte in range(symbol - 1):  # leading equal bytes
            part += xor >> np.uint64(8 * (symbol - 1 - byte)) == 0
        out[differ] = k * symbol + part
        live = live[same]
        if not live.size:
            break
        out[live] = (k + 1) * symbol
    return out


def _indexed(length: int):
    """Segments in order of anchor and key -> whether a segment occurs again as a whole, else which of its windows do."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(anchor, key, n, shift, seg):
            again = np.array(n) > 1
            hits: list = [None] * len(seg)
            own = np.array(anchor)
            mixed = np.flatnonzero(np.bincount(np.cumsum(np.concatenate(([False], own[1:] != own[:-1]))))[np.cumsum(np.concatenate(([False], own[1:] != own[:-1])))] > 1)
            mixed = [k for k in mixed.tolist() if seg[k] is not None]
            if mixed:
                for k, w in zip(mixed, shared_windows([seg[k] for k in mixed], np.array(shift)[mixed], length), strict=True):
                    if not again[k] and w.any():
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], w.view(np.int8), [0]))))
                        hits[k] = edge.tolist()  # where shared windows begin and end, in turn
            out = [k for k in range(len(seg)) if again[k] or hits[k]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(own[out]), pa.array(np.array(key)[out]), pa.array([hits[k] for k in out], pa.list_(pa.int64()))], ["anchor", "key", "edges"])

        anchor, key, n, shift, seg = [], [], [], [], []
        held, most = 0, ARRAY_BYTES
        for whole in batches:
            for batch in slices([whole], "seg", ARRAY_BYTES):
                a, k, c, s = (batch.column(x).to_numpy() for x in ("anchor", "key", "n", "shift"))
                new = np.flatnonzero(_first(a, k))
                total, texts = np.add.reduceat(c, new).tolist(), batch.column("seg").take(pa.array(new)).to_pylist()
                a, k, s = a[new].tolist(), k[new].tolist(), s[new].tolist()
                if key and (anchor[-1], key[-1]) == (a[0], k[0]):
                    n[-1] += total[0]
                    a, k, total, s, texts = a[1:], k[1:], total[1:], s[1:], texts[1:]
                for x, y in ((anchor, a), (key, k), (n, total), (shift, s), (seg, texts)):
                    x.extend(y)
                held += sum(len(x or b"") for x in texts)
                if held >= most:
                    cut = bisect_left(anchor, anchor[-1])
                    if cut:
                        yield from solve(anchor[:cut], key[:cut], n[:cut], shift[:cut], seg[:cut])
                        anchor, key, n, shift, seg = anchor[cut:], key[cut:], n[cut:], shift[cut:], seg[cut:]
                        held = sum(len(x or b"") for x in seg)
                    most = max(ARRAY_BYTES, 2 * held)  # an anchor beyond an array is looked at again when it has doubled
        if key:
            yield from solve(anchor, key, n, shift, seg)

    return f


def _cut(length: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, spans, kept = [], [], [], []
            for raw, found in zip(as_bytes(batch.column("text")), batch.column("found").to_pylist(), strict=True):
                raw = raw or b""
                size.append(len(raw))
                if not found:
                    gone.append(0)
                    spans.append(0)
                    kept.append(raw)
                    continue
                edge = np.zeros(len(raw) + 1, np.int64)
                for x in found:
                    ends = x["edges"] or [0, x["count"]]
                    for a, b in zip(ends[::2], ends[1::2], strict=True):
                        edge[x["start"] + a] += 1
                        edge[x["start"] + b + length - 1] -= 1
                stay = np.cumsum(edge)[:-1] == 0
                gone.append(int(stay.size - np.count_nonzero(stay)))
                spans.append(int(np.count_nonzero(stay[:-1] & ~stay[1:])) + int(not stay[0]))
                kept.append(np.frombuffer(raw, np.uint8)[stay].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), *(pa.array(x, pa.int64()) for x in (size, gone, spans)), pa.array(kept, pa.binary())], ["row", "text", *ADDED])

    return f


def remove_shared_bytes(docs: DataFrame, length: int = 400) -> DataFrame:
    """docs (text, ...) -> the same columns, n_bytes, n_removed, n_spans, kept_bytes.

    Every byte covered by a string of ``length`` bytes that also starts anywhere
    else, in the same text or another, goes; strings are judged on the input.
    n_spans counts the maximal stretches that go; kept_bytes is what stays.
    """
    if not 16 <= length <= 4096:
        raise ValueError("length must be 16 to 4096 bytes")
    run = length // 2
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    keys = [F.xxhash64(F.lit(k), F.col("text")).alias(f"t{k}") for k in (1, 2)]
    plain = docs.select(text.alias("text")).where(F.octet_length("text") >= length)
    anchors = plain.mapInArrow(trimmed(_anchors(length, run)), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    shared = staged(anchors.where("n > 1"), "anchors")
    bloom = spark.sparkContext.broadcast(_bloom(shared.select("anchor")))
    keyed = plain.select("text", *keys)
    found = staged(keyed.mapInArrow(trimmed(_shared_segments(length, run, bloom)), SEGMENT), "segments")
    # An anchor has no more distinct segments than occurrences; only the few with very many are counted out.
    most = 2 * ARRAY_BYTES // length
    often = shared.where(F.col("n") > most).select("anchor")
    n, wide = often.count(), []
    if n:
        own = found.where("seg is not null").join(F.broadcast(often) if n <= MOST_WIDE else often, "anchor", "left_semi")
        counted = own.select("anchor", "key").distinct().groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
        wide = sorted(r.anchor for r in counted.orderBy(F.desc("n"), "anchor").limit(MOST_WIDE).collect())
    extra = None
    if wide:
        single = staged(keyed.mapInArrow(trimmed(_shared_segments(length, run, bloom, spark.sparkContext.broadcast(np.array(wide)))), SEGMENT), "windows")
        few = F.broadcast(spark.createDataFrame([(x,) for x in wide], "anchor long"))
        found = found.join(few, "anchor", "left_anti")
        again = single.groupBy("anchor", "key").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "key", F.lit(None).cast("array<long>").alias("edges"))
        extra = single.select("anchor", "key", "t1", "t2", "start", "count").join(again, ["anchor", "key"])
    carriers = found.where("n is not null").select("anchor", "key", "n", "shift", "seg")
    edges = carriers.repartition("anchor").sortWithinPartitions("anchor", "key").mapInArrow(trimmed(_indexed(length)), "anchor long, key long, edges array<long>")
    hits = found.select("anchor", "key", "t1", "t2", "start", "count").join(edges, ["anchor", "key"])
    hits = hits if extra is None else hits.unionByName(extra)
    hits = staged(hits.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "count", "edges")).alias("found")), "hits")
    own = [c for c in docs.columns if c not in (*ADDED, "text")]
    row = F.struct(*own) if own else F.struct(F.lit(0).alias("none"))
    rows = docs.select(row.alias("row"), text.alias("text")).withColumns({"t1": keys[0], "t2": keys[1]})
    kind = f"row {rows.schema['row'].dataType.simpleString()}, text string, n_bytes long, n_removed long, n_spans long, kept_bytes binary"
    ids = hits.select("t1", "t2")
    if ids.count() <= BROADCAST_IDS:  # then only texts that lose bytes are shuffled
        few = F.broadcast(ids)
        clean = rows.join(few, ["t1", "t2"], "left_anti").withColumn("found", F.lit(None).cast(hits.schema["found"].dataType))
        rows = rows.join(few, ["t1", "t2"], "left_semi")
    else:
        clean = None
    joined = rows.join(hits, ["t1", "t2"], "left")
    cut = [x.select("row", "text", "found").mapInArrow(trimmed(_cut(length)), kind) for x in (joined, clean) if x is not None]
    out = cut[0] if len(cut) == 1 else cut[0].unionByName(cut[1])
    back = [F.col("text").cast(docs.schema["text"].dataType).alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ADDED]
    return out.select(*back, *ADDED)

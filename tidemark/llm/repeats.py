"""Substring dedup: words under a long passage that an earlier document has too.

Windows of ``length`` words are compared through compressed FM-indexes, one
per shard.  So that no shard has to see all documents, text is routed by
content: the smallest hash of a shorter word run inside a window (its anchor)
names the shard, and neighbouring windows with one anchor travel as one
segment.  Equal windows have equal anchors, so they meet in one shard; there
each distinct segment is indexed and streamed once: backward search over the
wavelet matrix gives each of its windows an interval of suffixes, and the
smallest document in that interval is the window's home.  A document loses the
windows whose home is a smaller document, which is looked up by segment.
Anchors that only one document has are left out by a Bloom filter of fixed
size; its false positives only cost time, since the index decides.  An anchor
with more segments than one index holds is taken apart: its windows become
segments of their own, each routed by its own hash.

Defined results: null text has no words; fewer words than a window lose
nothing; a null doc_id neither removes nor loses words; repeated rows of one
doc_id do not remove each other; input columns called n_words, n_removed or
kept_text are replaced, all others are kept as they are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .store import staged
from .words import as_bytes, groups, joined, mix64, sequence_hashes, slices, spans, trimmed

#: Bits of the Bloom filter of shared anchors (8 MB), whatever the size of the corpus.
BLOOM_BITS = 1 << 26
#: Symbols of one FM-index; a shard makes several, each of whole anchors.
BLOCK_SYMBOLS = 1 << 20
#: Anchors that are taken apart, those with the most segments first (8 bytes each are broadcast); any others stay whole.
MOST_WIDE = 1_000_000
#: Ids of documents that lose words up to this count are broadcast (8 bytes each); beyond it all texts are joined.
BROADCAST_IDS = 500_000
ADDED = ("n_words", "n_removed", "kept_text")


def segments(words: np.ndarray, cut: np.ndarray, length: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, number of windows, anchor) of each stretch of windows with one anchor position.

    ``words`` are those of several texts, text k from cut[k] to cut[k + 1]; no window crosses texts.
    """
    m = words.size - length + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best = sequence_hashes(words, run)
    at = np.arange(best.size, dtype=np.int32 if best.size < 1 << 31 else np.int64)
    wide, have = length - run + 1, 1
    while have < wide:  # smallest of ``have`` neighbours, doubled; the leftmost of equal ones
        step = min(have, wide - have)
        less = best[step:] < best[:-step]
        best = np.minimum(best[step:], best[:-step])
        at = np.where(less, at[step:], at[:-step])
        have += step
    of = np.repeat(np.arange(cut.size - 1, dtype=np.int32), np.diff(cut))
    window = np.flatnonzero(of[:m] == of[length - 1 :])
    at = at[window]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))[: at.size])
    start = window[first]
    return of[start], start, np.diff(np.concatenate((first, [at.size]))), best[start]


def _anchors(length: int, run: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, out, own = batch.column("doc_id").to_numpy(), [], []
            for k, _, cut, _, _, words in groups(as_bytes(batch.column("text")), False):
                of, _, _, anchor = segments(words, cut, length, run)
                if of.size:
                    out.append(anchor)
                    own.append(ids[k + of])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(own))], ["anchor", "doc"])

    return f


def _probes(anchor: np.ndarray) -> list[np.ndarray]:
    h = mix64(anchor)
    return [((h >> np.uint64(s)) & np.uint64(BLOOM_BITS - 1)).astype(np.int64) for s in (0, 18, 37)]


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.unique(np.concatenate(_probes(batch.column("anchor").to_numpy().view(np.uint64))))
        yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.uint64(1) << (at & 63).astype(np.uint64)).cast(pa.uint64()).view(pa.int64())], ["word", "bits"])


def _bloom(anchors: DataFrame) -> np.ndarray:
    """At most BLOOM_BITS / 64 rows come to the driver."""
    rows = anchors.mapInArrow(_positions, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(BLOOM_BITS // 64, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return words


def _shared_segments(length: int, run: int, bloom, hot=None):
    """Segments whose anchor passes the filter; with ``hot``, only the windows of these anchors, each as a segment of its own."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bloom.value
        for batch in slices(batches):
            ids, tx = batch.column("doc_id").to_numpy(), batch.column("tx").to_numpy()
            raw = as_bytes(batch.column("text"))
            parts = []
            for k, base, cut, starts, ends, words in groups(raw, False):
                of, start, count, anchor = segments(words, cut, length, run)
                if not start.size:
                    continue
                keep = np.ones(start.size, bool) if hot is None else np.isin(anchor.view(np.int64), hot.value)
                for p in _probes(anchor):
                    keep &= (bits[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) != 0
                if not keep.any():
                    continue
                of, start, count, anchor = of[keep], start[keep], count[keep], anchor[keep]
                if hot is not None:
                    of = np.repeat(of, count)
                    start = np.repeat(start, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                    count, anchor = np.ones(start.size, np.int64), sequence_hashes(words, length)[start]
                mixed = mix64(words)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * np.arange(1, words.size + 1, dtype=np.uint64))))
                plain = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed)))
                end = start + count + length - 1
                # Position-weighted sum of the segment's words: equal for equal segments wherever they stand.
                key = mix64(total[end] - total[start] - start.astype(np.uint64) * (plain[end] - plain[start]))
                parts.append((anchor.view(np.int64), key.view(np.int64), ids[k + of], tx[k + of], start - cut[of], count, k + of, starts[start] - base[of], ends[end - 1] - base[of]))
            if not parts:
                continue
            anchor, key, doc, text_key, start, count, row, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True))
            # One row of a batch carries the words of each distinct segment, with the smallest document of the batch.
            order = np.lexsort((doc, key, anchor))
            carrier = order[_first(anchor[order], key[order])]
            texts: list[bytes | None] = [None] * doc.size
            for i, r, x, y in zip(carrier.tolist(), row[carrier].tolist(), begin[carrier].tolist(), end[carrier].tolist(), strict=True):
                texts[i] = b" ".join(raw[r][x:y].split())
            seg = pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(key), pa.array(doc), pa.array(text_key), pa.array(start), pa.array(count), seg], ["anchor", "key", "doc", "tx", "start", "count", "seg"])

    return f


def _first(anchor: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a new (anchor, key) begins in sorted rows."""
    return np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1])))[: anchor.size]


def first_homes(segs: list[bytes], doc: np.ndarray, length: int) -> list[np.ndarray | None]:
    """For each segment the smallest document of each of its windows; None if all are the segment's own document."""
    parts = [(words, np.diff(cut)) for _, _, cut, _, _, words in groups(segs, False)]
    words, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    ids = np.unique(words, return_inverse=True)[1] + 1
    text = np.zeros(int(size.sum()) + size.size, np.int32)
    offset = np.cumsum(size + 1) - size - 1
    of = np.repeat(np.arange(size.size), size)
    text[np.arange(ids.size) + of] = ids
    docs, rank = np.unique(doc, return_inverse=True)
    index = FMIndex(text, length, np.repeat(rank.astype(np.int32), size + 1))
    windows = size - length + 1
    seg = np.repeat(np.arange(size.size), windows)
    start = np.cumsum(windows) - windows
    low, high = index.search(text, offset[seg] + np.arange(seg.size) - start[seg], length)
    found = np.flatnonzero(high - low > 1)
    home = rank[seg].astype(np.int32)
    home[found] = index.least(low[found], high[found])
    other = np.zeros(size.size, bool)
    other[seg[home != rank[seg]]] = True
    return [docs[home[a : a + n]] if o else None for a, n, o in zip(start.tolist(), windows.tolist(), other.tolist(), strict=True)]


def _indexed(length: int):
    """Carriers in order of anchor and key -> the homes of each distinct segment, by indexes of whole anchors."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(anchor, key, low, seg):
            homes = first_homes(seg, low, length)
            return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(key), pa.array(low), pa.array(homes, pa.list_(pa.int64()))], ["anchor", "key", "low", "homes"])

        anchor, key, low, seg = [], [], [], []
        symbols, most = 0, BLOCK_SYMBOLS
        for whole in batches:
            for batch in slices([whole], "seg", BLOCK_SYMBOLS):
                a, k, d = (batch.column(c).to_numpy() for c in ("anchor", "key", "doc"))
                new = np.flatnonzero(_first(a, k))
                least, text = np.minimum.reduceat(d, new).tolist(), batch.column("seg").take(pa.array(new)).to_pylist()
                a, k = a[new].tolist(), k[new].tolist()
                if key and (anchor[-1], key[-1]) == (a[0], k[0]):
                    low[-1] = min(low[-1], least[0])
                    a, k, least, text = a[1:], k[1:], least[1:], text[1:]
                for x, y in ((anchor, a), (key, k), (low, least), (seg, text)):
                    x.extend(y)
                symbols += sum(x.count(b" ") + 2 for x in text)
                if symbols >= most:
                    cut = bisect_left(anchor, anchor[-1])
                    if cut:
                        yield solve(anchor[:cut], key[:cut], np.array(low[:cut]), seg[:cut])
                        anchor, key, low, seg = anchor[cut:], key[cut:], low[cut:], seg[cut:]
                        symbols = sum(x.count(b" ") + 2 for x in seg)
                    most = max(BLOCK_SYMBOLS, 2 * symbols)  # an anchor beyond a block is looked at again when it has doubled
        if key:
            yield solve(anchor, key, np.array(low), seg)

    return f


def _covered(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, word after the last) of each stretch that goes, in order of rows."""
    found = batch.column("found")
    row, found = pc.list_parent_indices(found).to_numpy(), found.flatten()
    start, count, homes = (found.field(c) for c in ("start", "count", "homes"))
    start, count = start.to_numpy(), count.to_numpy()
    whole = homes.is_null().to_numpy(zero_copy_only=False)  # every window
    of, home = pc.list_parent_indices(homes).to_numpy(), homes.flatten().to_numpy()
    number = np.arange(of.size) - np.searchsorted(of, of)
    doc = pc.fill_null(batch.column("__doc"), 0).to_numpy()
    less = home < doc[row[of]]
    of, number = of[less], number[less]
    rows, first = np.concatenate((row[whole], row[of])), np.concatenate((start[whole], start[of] + number))
    after = np.concatenate(((start + count)[whole] + length - 1, start[of] + number + length))
    order = np.argsort(rows, kind="stable")
    return rows[order], first[order], after[order]


def _cut(length: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, first, after = _covered(batch, length)
            total, gone, kept = [], [], []
            for k, raw, base in joined(as_bytes(batch.column("text"))):
                buf = np.frombuffer(raw + b"\n", np.uint8)
                starts, ends = spans(buf)
                cut = np.searchsorted(starts, base)
                here = slice(*np.searchsorted(rows, (k, k + base.size - 1)))
                at = cut[rows[here] - k]
                edge = np.bincount(at + first[here], minlength=starts.size + 1) - np.bincount(at + after[here], minlength=starts.size + 1)
                stay = np.cumsum(edge)[:-1] == 0
                left = np.concatenate(([0], np.cumsum(stay)))[cut]
                # Each word that stays is taken with the white byte after it, which becomes one space.
                starts, ends = starts[stay], ends[stay] + 1
                taken = np.zeros(buf.size + 1, np.int8)
                taken[starts] = 1
                taken[ends] -= 1
                out = buf[np.cumsum(taken[:-1], dtype=np.int8).view(bool)]
                end = np.concatenate(([0], np.cumsum(ends - starts)))
                out[end[1:] - 1] = 32
                out, end = out.tobytes(), end[left].tolist()
                kept += [out[a : max(a, b - 1)] for a, b in zip(end[:-1], end[1:], strict=True)]
                total.append(np.diff(cut))
                gone.append(np.diff(cut) - np.diff(left))
            total, gone = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (total, gone))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["row", "text", *ADDED])

    return f


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """docs (doc_id, text, ...) -> the same columns, n_words, n_removed, kept_text.

    Every word covered by a window of ``length`` consecutive words that also
    starts in a document with a smaller doc_id goes; windows are judged on the
    input.  kept_text joins the other words by one space.
    """
    if not 2 <= length <= 120:
        raise ValueError("length must be 2 to 120 words")
    run = max(1, length - min(48, max(1, length // 2)) + 1)
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    anchors = plain.mapInArrow(trimmed(_anchors(length, run)), "anchor long, doc long").groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count(F.lit(1)).alias("n"))
    shared = staged(anchors.where("low < high").select("anchor", "n"), "anchors")
    bloom = spark.sparkContext.broadcast(_bloom(shared.select("anchor")))
    found = plain.withColumn("tx", _text_key()).mapInArrow(
        trimmed(_shared_segments(length, run, bloom)), "anchor long, key long, doc long, tx long, start long, count long, seg binary")
    found = staged(found, "segments")
    # An anchor has no more distinct segments than occurrences; only the few with very many are counted out.
    most = BLOCK_SYMBOLS // (2 * length)
    often = shared.where(F.col("n") > most).select("anchor")
    n, wide = often.count(), []
    if n:
        own = found.where("seg is not null").join(F.broadcast(often) if n <= MOST_WIDE else often, "anchor", "left_semi")
        counted = own.select("anchor", "key").distinct().groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
        wide = sorted(r.anchor for r in counted.orderBy(F.desc("n"), "anchor").limit(MOST_WIDE).collect())
    if wide:
        apart = plain.withColumn("tx", _text_key()).mapInArrow(trimmed(_shared_segments(length, run, bloom, spark.sparkContext.broadcast(np.array(wide)))), found.schema.simpleString()[7:-1].replace(":", " "))
        few = F.broadcast(spark.createDataFrame([(x,) for x in wide], "anchor long"))
        found = found.join(few, "anchor", "left_anti").unionByName(staged(apart, "windows"))
    carriers = found.where("seg is not null").select("anchor", "key", "doc", "seg")
    homes = carriers.repartition("anchor").sortWithinPartitions("anchor", "key").mapInArrow(trimmed(_indexed(length)), "anchor long, key long, low long, homes array<long>")
    hits = found.select("anchor", "key", "doc", "tx", "start", "count").join(homes, ["anchor", "key"])
    # Without homes, all windows of the segment have the segment's smallest document.
    hits = hits.where((F.col("homes").isNull() & (F.col("low") < F.col("doc"))) | F.exists("homes", lambda h: h < F.col("doc")))
    hits = hits.groupBy(F.col("doc").alias("__doc"), F.col("tx").alias("__tx")).agg(F.collect_list(F.struct("start", "count", "homes")).alias("found"))
    hits = staged(hits, "hits")
    own = [c for c in docs.columns if c not in (*ADDED, "text")]
    rows = docs.select(F.struct(*own).alias("row"), F.col("doc_id").cast("long").alias("__doc"), F.col("text").cast("string").alias("text"))
    kind = f"row {rows.schema['row'].dataType.simpleString()}, text string, n_words long, n_removed long, kept_text string"
    ids = hits.select("__doc").distinct()
    if ids.count() <= BROADCAST_IDS:  # then only texts that lose words are shuffled
        few = F.broadcast(ids)
        clean = rows.join(few, "__doc", "left_anti").withColumn("found", F.lit(None).cast(hits.schema["found"].dataType))
        rows = rows.join(few, "__doc", "left_semi")
    else:
        clean = None
    joined = rows.withColumn("__tx", _text_key()).join(hits, ["__doc", "__tx"], "left")
    cut = [x.select("row", "__doc", "text", "found").mapInArrow(trimmed(_cut(length)), kind) for x in (joined, clean) if x is not None]
    out = cut[0] if len(cut) == 1 else cut[0].unionByName(cut[1])
    back = {c: F.col("text").cast(docs.schema["text"].dataType).alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ADDED}
    return out.select(*back.values(), *ADDED)


def _text_key() -> F.Column:
    return F.xxhash64("text").bitwiseAND(0x7FFFFFFF)

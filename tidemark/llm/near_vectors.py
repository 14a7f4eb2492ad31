"""Embedding near-dedup: exact cosine links by PCA-ordered tiles.

Unit vectors are rotated to their principal axes, so that the leading
coordinates carry most of the length.  Two tiles of vectors are compared in
stages: the inner product over the leading coordinates plus the product of
the norms of what is left bounds the cosine from above; pairs whose bound
stays below the threshold stop there, the others go on to further
coordinates.  The pairs left are decided in double precision on the original
vectors.  Whole tile pairs whose boxes in the leading coordinates are too far
apart are never formed.

Defined results: a vector that is null, empty, all zero, or holds a null or a
non-finite component links with nothing; a shorter vector counts as padded
with zeros; repeated rows of one vec_id keep a row each and count each other
only as one vector, the smallest of them, compared element by element; other columns are ignored; a null vec_id links with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import staged

#: Cells of the leading principal coordinates: about one for each tile, 2 ** SPLITS at most; their boxes are all the driver holds.
SPLITS = 8
#: Vectors of one tile side, and rows of it multiplied at a time.
TILE, STRIP = 4096, 512
#: Coordinates of the stages after the first, as shares of the dimension.
STAGES = (0.25, 0.5)
#: Slack of the bounds, far above their rounding in single precision.
SLACK = 1e-4


def matrix(column, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows as doubles padded with zeros, which rows are valid)."""
    offsets = np.asarray(column.offsets)
    size = np.diff(offsets)
    width = int(size.max(initial=0)) if width is None else width
    values = column.values
    ok = ~np.asarray(column.is_null())
    flat = np.asarray(values.fill_null(np.nan), dtype=np.float64)
    out = np.zeros((len(column), max(width, 1)))
    if flat.size and size.min() == size.max() == width and offsets[0] == 0 and flat.size == out.size:
        out[:] = flat.reshape(out.shape)
    else:
        for i in np.flatnonzero(ok).tolist():
            out[i, : size[i]] = flat[offsets[i] : offsets[i + 1]]
    ok &= np.isfinite(out).all(axis=1)
    out[~ok] = 0
    ok &= (out != 0).any(axis=1)
    return out, ok


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, first scaled so that neither huge nor tiny ones overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _moments(width: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x, ok = matrix(batch.column("embedding"), width)
            if ok.any():
                u = unit(x[ok])
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["at", "v"])

    return f


def _rotated(axes: np.ndarray, centre: np.ndarray, dtype: str):
    """Each valid vector in its own precision, and its cell by the signs of the leading coordinates less their medians."""
    width = axes.shape[0]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ok = matrix(batch.column("embedding"), width)
            if not ok.any():
                continue
            u = unit(x[ok])
            lead = u @ axes[:, : centre.size]
            cell = ((lead > centre) << np.arange(centre.size)).sum(axis=1)
            own = np.ascontiguousarray(x[ok].astype(dtype))
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(own.itemsize * width), len(own), [None, pa.py_buffer(own)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").filter(pa.array(ok)), pa.array(cell.astype(np.int32)), data, *(pa.array(lead[:, k]) for k in range(centre.size))],
                ["id", "cell", "u", *(f"p{k}" for k in range(centre.size))],
            )

    return f


def pairs_of(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of unit rows of a and b with cosine at or above the threshold, strip by strip; i < j in one tile."""
    width = axes.shape[0]
    cuts = sorted({max(1, min(width, int(np.ceil(width * s)))) for s in STAGES})
    ra, rb = (a @ axes).astype(np.float32), (b @ axes).astype(np.float32)
    rest = lambda r, k: np.sqrt(np.einsum("ij,ij->i", r[:, k:], r[:, k:]))
    lead = cuts[0]
    # The bound over the leading coordinates is one product: the residual norms are one more coordinate.
    la = np.concatenate((ra[:, :lead], rest(ra, lead)[:, None]), axis=1)
    lb = np.concatenate((rb[:, :lead], rest(rb, lead)[:, None]), axis=1)
    later = [(k, rest(ra, k), rest(rb, k)) for k in cuts[1:]]
    for s in range(0, a.shape[0], STRIP):
        from_ = s if same else 0
        p, q = np.divmod(np.flatnonzero(la[s : s + STRIP] @ lb[from_:].T >= threshold - SLACK), b.shape[0] - from_)
        p, q = p + s, q + from_
        if same:
            p, q = p[p < q], q[p < q]
        for t in range(0, p.size, 1 << 17):
            i, j = p[t : t + (1 << 17)], q[t : t + (1 << 17)]
            for k, xa, xb in later:
                more = np.einsum("ij,ij->i", ra[i, :k], rb[j, :k]) + xa[i] * xb[j] >= threshold - SLACK
                i, j = i[more], j[more]
            ok = np.einsum("ij,ij->i", a[i], b[j]) >= threshold
            if ok.any():
                yield i[ok], j[ok]


def absorb(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the sets of i and j; parent[x] is the smallest member of the set of x, before and after."""
    while i.size:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while ((up := parent[parent]) != parent).any():
            parent[:] = up


def _compare(axes: np.ndarray, kind: str, threshold: float):
    """One pair of tiles -> link counts by vector, and a link from each to the smallest of its component in the tiles."""
    width = axes.shape[0]

    def f(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        ids, side = (table.column(c).to_numpy()[order] for c in ("id", "side"))
        u = unit(np.frombuffer(b"".join(table.column("u").to_pylist()), kind).reshape(-1, width)[order].astype(np.float64))
        same = bool((side == 2).all())
        x, y = (np.arange(ids.size),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        n, parent = np.zeros(ids.size, np.int64), np.arange(ids.size)
        if x.size and y.size:
            for i, j in pairs_of(u[x], u[y], axes, threshold, same):
                i, j = x[i], y[j]
                n += np.bincount(i, minlength=ids.size) + np.bincount(j, minlength=ids.size)
                absorb(parent, i, j)
        at = np.flatnonzero(n)
        return pa.table({"id": ids[at], "n": n[at], "root": ids[parent[at]]})

    return f


def near_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, n_links, component_id, kept.

    Every pair with cosine >= threshold is counted.  The work is quadratic in
    the vectors of cells that are not far apart; tiles bound what a task holds.
    """
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    dtype, item = ("<f4", "float") if single else ("<f8", "double")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{item}>").alias("embedding"))
    live = rows.where("vec_id is not null and embedding is not null and size(embedding) > 0").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))  # of several vectors with one id the smallest, element by element
    width, total = rows.agg(F.max(F.size("embedding")), F.count(F.lit(1))).first()
    width = width or 0
    if width <= 0:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    sums = rows.where("embedding is not null").mapInArrow(_moments(width), "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    second = np.zeros(width * width)  # width ** 2 numbers
    second[sums.column("at").to_numpy()] = sums.column("v").to_numpy()
    values, axes = np.linalg.eigh(second.reshape(width, width))
    axes = np.ascontiguousarray(axes[:, ::-1])
    lead = min(SPLITS, width, max(1, int(np.ceil(np.log2(max(1, total) / TILE)))))
    names = [f"p{k}" for k in range(lead)]
    kind = "id long, cell int, u binary, " + ", ".join(f"{c} double" for c in names)
    first = live.mapInArrow(_rotated(axes, np.zeros(lead), dtype), kind)
    middle = first.agg(*(F.percentile_approx(c, 0.5, 1000).alias(c) for c in names)).first()
    centre = np.array([middle[c] or 0.0 for c in names])
    units = staged(live.mapInArrow(_rotated(axes, centre, dtype), kind), "units")

    boxes = units.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{k}{c}") for c in names for k, f in (("low", F.min), ("high", F.max)))).collect()
    tiles = {r.cell: -(-r.n // TILE) for r in boxes}  # at most 2 ** SPLITS cells
    reach = 2 - 2 * threshold + SLACK  # squared distance of unit vectors with that cosine
    low, high = (np.array([[r[f"{k}{c}"] for c in names] for r in boxes]).reshape(len(boxes), lead) for k in ("low", "high"))
    near = []
    for x in range(len(boxes)):
        gap = np.maximum(0, np.maximum(low[x] - high, low - high[x]))
        for y in np.flatnonzero((gap**2).sum(axis=1) <= reach).tolist():
            if y >= x:
                near.append((boxes[x].cell, boxes[y].cell))
    plan = []  # (cell, its partner, their tile counts, side)
    for c, d in near:
        if c == d:
            plan.append((c, d, tiles[d], 2))
        else:
            plan += [(c, d, tiles[d], 0), (d, c, tiles[c], 1)]
    plan = spark.createDataFrame(plan or [(0, 0, 0, 0)], "cell int, partner int, partner_tiles int, role int")
    own = spark.createDataFrame(list(tiles.items()) or [(0, 1)], "cell int, tiles int")
    dealt = units.select("id", "cell", "u").join(F.broadcast(own), "cell").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    dealt = dealt.join(F.broadcast(plan), "cell").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("partner_tiles") - 1)))
    first_ = F.col("role") == 0
    within = F.col("role") == 2
    dealt = dealt.select(
        F.when(F.col("role") == 1, F.col("partner")).otherwise(F.col("cell")).alias("ca"),
        F.when(F.col("role") == 1, F.col("cell")).otherwise(F.col("partner")).alias("cb"),
        F.when(within, F.least("tile", "other")).when(first_, F.col("tile")).otherwise(F.col("other")).alias("ta"),
        F.when(within, F.greatest("tile", "other")).when(first_, F.col("other")).otherwise(F.col("tile")).alias("tb"),
        F.when(within & (F.col("tile") == F.col("other")), 2).when(within, (F.col("tile") > F.col("other")).cast("int")).otherwise(F.col("role")).alias("side"),
        "id", "u",
    )
    found = dealt.groupBy("ca", "cb", "ta", "tb").applyInArrow(_compare(axes, dtype, threshold), "id long, n long, root long")
    found = staged(found, "links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    out = rows.select("vec_id").join(counts, F.col("vec_id") == F.col("id"), "left").drop("id").join(roots, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id").isNotNull() & (F.col("vec_id") == component)).alias("kept"))

"""Approximate nearest neighbours by inner product: a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample; every vector is then put into a leaf.
A query walks the tree with a priority queue ordered by an upper bound of the
inner product below a node (its centre's product plus the query's length times
the node's radius) and opens leaves until it has its number of visits.  That
number is calibrated: a bounded set of queries is answered exactly over all
vectors, and visits are widened until their mean recall reaches the target.

Defined results: a vector that is null, empty, all zero, or holds a null or a
non-finite component takes no part; of several vectors with one vec_id the
smallest counts, compared element by element; a shorter vector counts as
padded with zeros; a query meets every row but those with its own vec_id; fewer candidates
than k give fewer rows; ties go to the smaller vec_id; repeated rows of one
vec_id are one; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_vectors import matrix
from .store import staged

#: Bound of the sample that the tree is fitted on, and of the calibration queries.
SAMPLE, CALIBRATION = 32_768, 128
#: Children of a node; leaves are split down to this share of the sample.
BRANCH, LEAF_SAMPLE = 8, 64
#: Vectors of one leaf that one task compares with its queries.
CHUNK = 4096
TARGET = 0.97


class Tree:
    """Nodes by level order: centre, radius over all vectors below, children; leaves are numbered."""

    def __init__(self, sample: np.ndarray, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.centre, self.children, self.leaf = [sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])], [[]], [-1]
        self.leaves = 0
        stack = [(0, sample)]
        while stack:
            node, own = stack.pop()
            parts = self._split(own, rng) if len(own) > 2 * LEAF_SAMPLE else []
            if len(parts) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for centre, part in parts:
                self.centre.append(centre)
                self.children.append([])
                self.leaf.append(-1)
                self.children[node].append(len(self.centre) - 1)
                stack.append((len(self.centre) - 1, part))
        self.centre = np.array(self.centre)
        self.leaf = np.array(self.leaf)
        self.node = np.flatnonzero(self.leaf >= 0)[np.argsort(self.leaf[self.leaf >= 0])]
        self.radius = np.zeros(len(self.leaf))

    @staticmethod
    def _split(x: np.ndarray, rng) -> list[tuple[np.ndarray, np.ndarray]]:
        centres = x[rng.choice(len(x), BRANCH, replace=False)]
        for _ in range(8):
            near = (x @ centres.T * 2 - (centres**2).sum(axis=1)).argmax(axis=1)
            used = np.unique(near)
            centres = np.stack([x[near == k].mean(axis=0) for k in used])
        near = (x @ centres.T * 2 - (centres**2).sum(axis=1)).argmax(axis=1)
        return [(centres[k], x[near == k]) for k in np.unique(near)]

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: down the tree to the nearest centre."""
        out = np.zeros(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, own = stack.pop()
            if self.leaf[node] >= 0:
                out[own] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            c = self.centre[kids]
            near = (x[own] @ c.T * 2 - (c**2).sum(axis=1)).argmax(axis=1)
            stack += [(int(kids[k]), own[near == k]) for k in np.unique(near)]
        return out

    def widen(self, leaf: np.ndarray, distance: np.ndarray, count: np.ndarray) -> None:
        """Radii and counts of leaves from all vectors, carried up to their ancestors."""
        self.radius[self.node[leaf]] = distance
        self.count = np.zeros(len(self.leaf), np.int64)
        self.count[self.node[leaf]] = count
        for node in range(len(self.leaf) - 1, -1, -1):
            for kid in self.children[node]:
                self.count[node] += self.count[kid]
                if self.count[kid]:
                    gap = float(np.sqrt(((self.centre[node] - self.centre[kid]) ** 2).sum()))
                    self.radius[node] = max(self.radius[node], gap + self.radius[kid])

    def visit(self, q: np.ndarray, most: int, least: int) -> list[int]:
        """Leaves in best-bin-first order: ``most`` of them, or more until ``least`` vectors are in reach."""
        product = self.centre @ q
        bound = product + np.sqrt((q**2).sum()) * self.radius
        # Between leaves the centre's product tells more than the loose bound of a wide ball; the bound leads to them.
        heap, out, reach = [(-bound[0], 0)], [], 0
        while heap and (len(out) < most or reach < least):
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                out.append(int(self.leaf[node]))
                reach += int(self.count[node])
                continue
            for kid in self.children[node]:
                if self.count[kid]:
                    heapq.heappush(heap, (-product[kid] if self.leaf[kid] >= 0 else -bound[kid], kid))
        return out


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller id."""
    if k > 0 and scores.size > 4 * k:
        edge = np.partition(scores, scores.size - k)[scores.size - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(scores.size)
    return near[np.lexsort((ids[near], -scores[near]))[: max(k, 0)]]


def products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed the same way whatever block it stands in."""
    return np.einsum("ij,j->i", v, q)


def _vectors(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64)


def _packed(width: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ok = matrix(batch.column("embedding"), width)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(keep), pa.array([r.tobytes() for r in x[ok]], pa.binary())], ["id", "v"])

    return f


def _placed(tree, width: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column("v")).reshape(-1, width)
                leaf = t.place(x)
                far = np.sqrt(((x - t.centre[t.node[leaf]]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32)), pa.array(far)], ["id", "v", "leaf", "far"])

    return f


def _routed(tree, width: int, visits: int, k: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column("v")).reshape(-1, width)
            leaves = [t.visit(q, visits, k + 1) for q in x]
            n = [len(v) for v in leaves]
            at = np.repeat(np.arange(len(x)), n)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), batch.column("v").take(pa.array(at)), pa.array(np.concatenate(leaves).astype(np.int32))], ["id", "v", "leaf"])

    return f


def _best(width: int, k: int):
    """The queries and one chunk of the vectors of a leaf -> the k best of each query in it."""

    def f(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        ids = rows.column("id").to_numpy()
        v = _vectors(rows.column("v")).reshape(-1, width)
        for q, x in zip(queries.column("id").to_pylist(), _vectors(queries.column("v")).reshape(-1, width), strict=True):
            own = ids != q
            s = products(v, x)
            s[~own] = -np.inf
            best = top(s, ids, min(k, int(own.sum())))
            out.append((np.full(best.size, q, np.int64), ids[best], s[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": cols[0], "vec_id": cols[1].astype(np.int64), "score": cols[2]})

    return f


def _exact(queries, width: int, k: int):
    """The k best of the calibration queries in each batch, with their leaves."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = queries.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, leaf = batch.column("id").to_numpy(), batch.column("leaf").to_numpy()
            s = q @ _vectors(batch.column("v")).reshape(-1, width).T
            for i in range(len(qid)):
                own = np.where(ids == qid[i], -np.inf, s[i])
                best = top(own, ids, k)
                best = best[np.isfinite(own[best])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(best.size, i)), pa.array(own[best]), pa.array(ids[best]), pa.array(leaf[best])], ["q", "score", "id", "leaf"])

    return f


def ranked(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k best rows of each key, with their rank; each query has a bounded number of rows."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "vec_id"))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: F.Column, k: int = 20, target: float = TARGET) -> DataFrame:
    """vectors (vec_id, embedding); queries: which rows ask -> query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id is not null and embedding is not null and size(embedding) > 0").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))  # of several vectors with one id the smallest, element by element
    width = rows.agg(F.max(F.size("embedding"))).first()[0]
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    packed = rows.mapInArrow(_packed(width), "id long, v binary")
    total = packed.count()
    drawn = packed.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(SAMPLE) if total > SAMPLE else packed
    sample = _vectors(drawn.select("v").toArrow().column("v")).reshape(-1, width)
    tree = Tree(sample)
    placed = staged(packed.mapInArrow(_placed(spark.sparkContext.broadcast(tree), width), "id long, v binary, leaf int, far double"), "placed")
    leaves = placed.groupBy("leaf").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).toArrow()  # one row a leaf
    tree.widen(leaves.column("leaf").to_numpy(), leaves.column("far").to_numpy(), leaves.column("n").to_numpy())
    asking = placed.withColumnRenamed("id", "vec_id").where(queries).select(F.col("vec_id").alias("id"), "v")

    few = asking.orderBy(F.xxhash64("id", F.lit(9)), "id").limit(CALIBRATION).toArrow()
    if not few.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    q = _vectors(few.column("v")).reshape(-1, width)
    shared = spark.sparkContext.broadcast((few.column("id").to_numpy(), q))
    exact = placed.mapInArrow(_exact(shared, width, k), "q long, score double, vec_id long, leaf int")
    truth = ranked(exact, "q", k).select("q", "leaf").toArrow()  # CALIBRATION * k rows
    of, home = truth.column("q").to_numpy(), truth.column("leaf").to_numpy()
    place = np.zeros((len(q), tree.leaves), np.int64)
    for i, x in enumerate(q):
        place[i, tree.visit(x, tree.leaves, 0)] = np.arange((tree.count[tree.node] > 0).sum())
    order = np.sort(place[of, home])
    visits = int(order[min(order.size - 1, int(np.ceil(target * order.size)))]) + 1 if order.size else 1

    tree = spark.sparkContext.broadcast(tree)
    sizes = dict(zip(leaves.column("leaf").to_pylist(), leaves.column("n").to_pylist(), strict=True))
    chunks = lambda: F.broadcast(spark.createDataFrame([(x, -(-n // CHUNK)) for x, n in sizes.items()], "leaf int, chunks int"))  # noqa: E731  one row a leaf
    routed = asking.mapInArrow(_routed(tree, width, visits, k), "id long, v binary, leaf int").join(chunks(), "leaf")
    routed = routed.select("id", "v", "leaf", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    held = placed.select("id", "v", "leaf").join(chunks(), "leaf").select("id", "v", "leaf", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"))
    found = routed.groupBy("leaf", "chunk").cogroup(held.groupBy("leaf", "chunk")).applyInArrow(_best(width, k), "query_id long, vec_id long, score double")
    return ranked(found, "query_id", k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

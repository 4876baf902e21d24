"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample and shared; every vector is filed under
a leaf. A query visits leaves best-bin-first through a priority queue over the
tree. How many it visits is widened until sampled queries reach the asked
recall against brute force over all vectors.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm import store

#: Vectors that the tree is fitted on, at most about; the children of a node;
#: sampled vectors that a leaf stands for, at least.
SAMPLE, BRANCHES, LEAF = 20_000, 16, 40
#: Queries that calibrate, about, and the recall they must reach.
CALIBRATION, RECALL = 200, 0.97
#: Vectors of a leaf beyond which it is searched in several cells.
CELL = 20_000
#: Scores of a tile: queries x vectors.
TILE = 4_000_000


@dataclass
class Tree:
    """Nodes in breadth-first order; node 0 is the root."""

    centres: np.ndarray  # nodes x dimensions
    first: np.ndarray  # first child of each node, -1 for a leaf
    many: np.ndarray  # number of children

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.first < 0)

    def file(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest centre at every level."""
        at = np.zeros(len(vectors), np.int64)
        while True:
            open_ = np.flatnonzero(self.first[at] >= 0)
            if not len(open_):
                return at
            for node in np.unique(at[open_]):
                rows = open_[at[open_] == node]
                low, n = self.first[node], self.many[node]
                at[rows] = low + _nearest(vectors[rows], self.centres[low:low + n])

    def order(self, query: np.ndarray, most: int, held: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """``most`` leaves, best bin first, and more while those found hold fewer than ``least`` vectors.

        The queue holds the siblings that the descent passed by, keyed by the
        inner product of the query with their centres.
        """
        scores = self.centres @ query
        queue, found, have = [(-math.inf, 0)], [], 0
        while queue and (len(found) < most or held is not None and have < least):
            node = heapq.heappop(queue)[1]
            while self.first[node] >= 0:
                low, n = int(self.first[node]), int(self.many[node])
                best = low + int(scores[low:low + n].argmax())
                for child in range(low, low + n):
                    if child != best:
                        heapq.heappush(queue, (-scores[child], child))
                node = best
            found.append(node)
            have += held.get(node, 0) if held is not None else 0
        return found


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (vectors @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)


def _kmeans(vectors: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """The cluster of each vector, by Lloyd's rounds from distinct random rows."""
    distinct = np.unique(vectors, axis=0)
    k = min(k, len(distinct))
    centres = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        of = _nearest(vectors, centres)
        for c in range(k):
            if (mine := vectors[of == c]).size:
                centres[c] = mine.mean(axis=0)
    return _nearest(vectors, centres)


def fit(sample: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 7) -> Tree:
    """A tree over the sampled vectors (float64 rows)."""
    rng = np.random.default_rng(seed)
    centres, first, many = [sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])], [-1], [0]
    queue = [(0, sample)]
    while queue:
        node, rows = queue.pop(0)
        if len(rows) < 2 * leaf:
            continue
        of = _kmeans(rows, min(branches, len(rows) // leaf), rng)
        groups = [rows[of == c] for c in np.unique(of)]
        if len(groups) < 2:  # all rows are equal
            continue
        first[node], many[node] = len(centres), len(groups)
        for group in groups:
            queue.append((len(centres), group))
            centres.append(group.mean(axis=0))
            first.append(-1)
            many.append(0)
    return Tree(np.array(centres), np.array(first), np.array(many))


def usable(points: DataFrame) -> DataFrame:
    """(vec_id, v) of vectors that take part: neither null nor empty nor zero, all components finite."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return points.select("vec_id", v.alias("v")).where(v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """(query_id, vec_id, score) columns of each query's k best of these vectors, itself apart.

    The matrix product only says which vectors are near enough; their scores
    are then summed vector by vector, so equal vectors have equal scores.
    """
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    if not len(ids) or not len(query_ids):
        return [c[0] for c in out]
    step = max(1, TILE // len(ids)) if len(ids) < TILE else 1
    blur = 4 * vectors.shape[1] * np.finfo(float).eps * np.linalg.norm(vectors, axis=1).max()
    for at in range(0, len(queries), step):
        scores = queries[at:at + step] @ vectors.T
        for row, q, query in zip(scores, query_ids[at:at + step], queries[at:at + step]):
            other = np.flatnonzero(ids != q)
            if len(other) > k:
                near = row[other]
                other = other[near >= np.partition(near, len(near) - k)[len(near) - k] - blur * np.linalg.norm(query)]
            exact = (vectors[other] * query).sum(axis=1)
            best = np.lexsort((ids[other], -exact))[:k]
            out[0].append(np.full(len(best), q))
            out[1].append(ids[other[best]])
            out[2].append(exact[best])
    return [np.concatenate(c) for c in out]


_HITS = ["query_id", "vec_id", "score"]
_DDL = "query_id long, vec_id long, score double"


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query; every task passes on k rows a query at most."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def calibrate(points: DataFrame, tree: Tree, queries: list[tuple[int, np.ndarray]], k: int, recall: float) -> int:
    """The fewest leaf visits at which sampled queries find ``recall`` of their k best.

    The true neighbours come from brute force over all vectors, in tasks that
    keep k for each of the sampled queries; each neighbour's leaf has its
    place in the query's best-bin-first order.
    """
    leaves = len(tree.leaves)
    if not queries:
        return leaves
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast((np.array([q for q, _ in queries]), np.array([v for _, v in queries]), tree))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix, own = shared.value
        for batch in batches:
            ids, vectors = batch.column("vec_id").to_numpy(zero_copy_only=False), _matrix(batch.column("v"))
            for at in range(0, len(ids), 10_000):
                part = vectors[at:at + 10_000]
                found = _search(ids[at:at + 10_000], part, query_ids, matrix, k)
                where = dict(zip(ids[at:at + 10_000].tolist(), own.file(part).tolist()))
                leaf = [where[i] for i in found[1].tolist()]
                yield pa.RecordBatch.from_arrays([*map(pa.array, found), pa.array(leaf, pa.int64())], names=[*_HITS, "leaf"])

    true = _ranked(points.mapInArrow(run, _DDL + ", leaf long"), k).select("query_id", "leaf").collect()  # sampled queries x k
    visits = {q: {leaf: i for i, leaf in enumerate(tree.order(v, leaves))} for q, v in queries}
    needed = sorted(visits[r["query_id"]][r["leaf"]] + 1 for r in true)
    return needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)] if needed else leaves


def search(points: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found.

    ``points`` has ``vec_id`` and ``embedding``; rows where ``is_query`` holds
    are the queries, and all rows but the query's own id are candidates.
    Vectors that are null, zero or hold null or non-finite components take no
    part, on either side, nor do those of another length than most (the
    shorter, if two lengths are as common). A query goes on to further leaves
    until those it visits hold ``k`` candidates. Ties go to the smaller vec_id; a repeated row is a
    candidate as often as it occurs. No vector, no row.
    """
    spark = points.sparkSession
    points = store.stash(usable(points).withColumn("q", F.coalesce(is_query, F.lit(False))), "vectors")
    lengths = points.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").head()
    points = points.where(F.size("v") == (lengths["d"] if lengths else 0))
    total, asked = points.agg(F.count(F.lit(1)), F.count_if("q")).head()
    drawn = lambda salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(1_000_000))
    sample = points.where(drawn(1) < math.ceil(1e6 * min(1.0, SAMPLE / max(1, total)))).select("v").limit(2 * SAMPLE)
    rows = [r["v"] for r in sample.toLocalIterator()]
    if not rows:  # tiny or empty tables
        rows = [r["v"] for r in points.select("v").limit(SAMPLE).collect()]
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = fit(np.array(rows, np.float64))
    few = points.where("q").where(drawn(2) < math.ceil(1e6 * min(1.0, CALIBRATION / max(1, asked)))).limit(2 * CALIBRATION)
    visits = calibrate(points, tree, [(r["vec_id"], np.array(r["v"], np.float64)) for r in few.collect()], k, recall)
    shared = spark.sparkContext.broadcast(tree)  # bounded by the sample

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.file(_matrix(batch.column("v"))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64())], names=[*batch.schema.names, "leaf"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.order(q, visits, held.value, k + 1) for q in _matrix(batch.column("v"))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(found, pa.list_(pa.int64()))],
                                             names=["vec_id", "v", "leaves"])

    kind = points.schema["v"].dataType.simpleString()
    filed = store.stash(points.select("vec_id", "v").mapInArrow(file, f"vec_id long, v {kind}, leaf long"), "filed-vectors")
    # a leaf that holds very many vectors is searched in several cells; one row a leaf, so bounded by the tree
    counts = {r["leaf"]: r["n"] for r in filed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    held, cells = spark.sparkContext.broadcast(counts), {leaf: -(-n // CELL) for leaf, n in counts.items()}
    parts = spark.createDataFrame(sorted(cells.items()), "leaf long, cells long")
    left = filed.join(F.broadcast(parts), "leaf").select(
        "leaf", F.pmod(F.xxhash64("vec_id"), F.col("cells")).alias("cell"), "vec_id", "v")
    right = (points.where("q").select("vec_id", "v").mapInArrow(visit, f"vec_id long, v {kind}, leaves array<long>")
             .select("vec_id", "v", F.explode("leaves").alias("leaf")).join(F.broadcast(parts), "leaf")
             .select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell"), "vec_id", "v"))

    def score(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids = [t.column("vec_id").combine_chunks().to_numpy(zero_copy_only=False) for t in (vectors, queries)]
        if not len(ids[0]) or not len(ids[1]):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=_HITS)
        return pa.table(list(map(pa.array, _search(ids[0], _matrix(vectors.column("v")), ids[1], _matrix(queries.column("v")), k))), names=_HITS)

    hits = left.groupBy("leaf", "cell").cogroup(right.groupBy("leaf", "cell")).applyInArrow(score, _DDL)
    return _ranked(hits, k).select("query_id", "rank", "vec_id", "score")

"""Vector search for a table of queries, rank fusion, diversity, confidence."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import lexicon as lx
from gristmill.functions import text as tx
from gristmill.operators import filters as flt
from gristmill.operators import vectors as vec

#: Largest block of query vectors sent to every task.
QUERY_BLOCK_BYTES = 64 * 1024 * 1024
#: Scores computed at a time, and queries whose hits a task passes on at a time.
TILE, DRAIN = 2_000_000, 1000
#: Scores are rounded so that the order does not depend on how rows are batched.
SCORE_PLACES = 6


def _scores(queries: np.ndarray, points: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        def unit(m: np.ndarray) -> np.ndarray:
            size = np.linalg.norm(m, axis=1, keepdims=True)
            return m / np.where(size == 0, 1e-12, size)
        raw = unit(queries) @ unit(points).T
    elif metric == "dot":
        raw = queries @ points.T
    elif metric == "euclid":
        squares = (queries ** 2).sum(axis=1)[:, None] + (points ** 2).sum(axis=1)[None, :] - 2 * queries @ points.T
        raw = -np.sqrt(np.maximum(squares, 0.0))
    elif metric == "manhattan":
        raw = -np.stack([np.abs(points - q).sum(axis=1) for q in queries])
    else:
        raise ValueError(f"unknown metric {metric}")
    return np.round(raw, SCORE_PLACES)


class _Best:
    """Best hits per query seen so far by one task (all of them if k is None)."""

    def __init__(self, count: int, k: int | None, threshold: float | None):
        self.k = k
        self.floor = np.full(count, -np.inf if threshold is None else threshold)
        self.hits: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(count)]

    def add(self, scores: np.ndarray, ids: np.ndarray, first: int = 0) -> None:
        """Scores of the queries from ``first`` on, a row each."""
        floor = self.floor[first:first + len(scores)]
        if self.k is not None and scores.shape[1] > self.k:
            edge = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k]
            floor = np.maximum(floor, edge)
        for q in range(scores.shape[0]):
            at = np.flatnonzero(scores[q] >= floor[q])
            if len(at):
                self.hits[first + q].append((scores[q][at], ids[at]))
                if self.k is not None:
                    self._trim(first + q)

    def _trim(self, q: int) -> None:
        scores = np.concatenate([s for s, _ in self.hits[q]])
        ids = np.concatenate([i for _, i in self.hits[q]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.hits[q] = [(scores[order], ids[order])]
        if len(order) == self.k:
            self.floor[q] = max(self.floor[q], scores[order[-1]])

    def drain(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for q, parts in enumerate(self.hits):
            for scores, ids in parts:
                yield q, scores, ids
            self.hits[q] = []


def _search_block(points: DataFrame, block: pd.DataFrame, query_id: str, point_id: str, vector: str,
                  k: int | None, threshold: float | None, metric: str) -> DataFrame:
    spark = points.sparkSession
    matrix = np.stack(block["__vector"].to_numpy()).astype(np.float64)
    shared = spark.sparkContext.broadcast(matrix)
    kind = points.schema[point_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = _Best(len(queries), k, threshold)

        def rows() -> Iterator[pa.RecordBatch]:
            found = best.drain()
            while part := list(islice(found, DRAIN)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([q for q, _, _ in part], [len(i) for _, _, i in part]).astype(np.int32)), pa.array(np.concatenate([i for _, _, i in part])),
                     pa.array(np.concatenate([s for _, s, _ in part]))], names=["__q", "point_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, matrix = batch.column(0).to_numpy(zero_copy_only=False), vec.as_matrix(batch.column(1))
            step = max(1, TILE // len(ids))
            for first in range(0, len(queries), step):
                best.add(_scores(queries[first:first + step], matrix, metric), ids, first)
                if k is None:
                    yield from rows()
        yield from rows()

    usable = points.filter(F.size(vector) == matrix.shape[1]).select(point_id, vector)
    hits = usable.mapInArrow(scan, f"__q int, point_id {kind}, score double")
    names = spark.createDataFrame(block[[query_id]].assign(__q=np.arange(len(block), dtype=np.int32)))
    return hits.join(F.broadcast(names), "__q").select(F.col(query_id), "point_id", "score")


def hits(points: DataFrame, queries: DataFrame, k: int | None = 50, threshold: float | None = None,
         filters: dict[str, Any] | None = None, query_id: str = "query_id", query_vector: str = "vector",
         point_id: str = "point_id", vector: str = "vector", metric: str = "cosine") -> DataFrame:
    """Exact search: ``query_id, point_id, score`` with at most k hits per
    query and task (see ``top_k``), or every hit at or above the threshold.

    The payload filter runs before scoring. Query vectors travel to the tasks
    in blocks of a checked size; each block is one pass over the points.
    """
    if k is None and threshold is None:
        raise ValueError("an exhaustive search needs a threshold")
    if filters:
        points = points.filter(flt.tree(points, filters))
    named = queries.select(F.col(query_id), F.col(query_vector).cast("array<double>").alias("__vector")).filter(
        F.col("__vector").isNotNull())
    size = named.agg(F.count("*").alias("n"), F.max(F.size("__vector")).alias("d")).first()
    blocks = 1 + (size["n"] or 0) * (size["d"] or 1) * 8 // QUERY_BLOCK_BYTES
    found = None
    for b in range(blocks):
        part = named if blocks == 1 else named.filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b)
        block = part.toPandas().sort_values(query_id, ignore_index=True)
        if block.empty:
            continue
        here = _search_block(points, block, query_id, point_id, vector, k, threshold, metric)
        found = here if found is None else found.unionByName(here)
    if found is None:
        kind = points.schema[point_id].dataType.simpleString()
        q_kind = queries.schema[query_id].dataType.simpleString()
        return points.sparkSession.createDataFrame([], f"{query_id} {q_kind}, point_id {kind}, score double")
    return found


def ranked(found: DataFrame, query_id: str = "query_id") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), "point_id"))
    return found.withColumn("rank", place.cast("long"))


def top_k(points: DataFrame, queries: DataFrame, k: int = 50, threshold: float | None = None, **options: Any) -> DataFrame:
    """Best k hits per query, ties by id.

    Each task keeps k rows per query, so the final ranking sees k rows per
    query and task.
    """
    query_id = options.get("query_id", "query_id")
    return ranked(hits(points, queries, k, threshold, **options), query_id).filter(F.col("rank") <= k)


def above(points: DataFrame, queries: DataFrame, threshold: float, limit: int | None = None, **options: Any) -> DataFrame:
    """All hits from the threshold on, or the best ``limit`` of them per query."""
    if limit is not None:
        return top_k(points, queries, limit, threshold, **options)
    return hits(points, queries, None, threshold, **options)


def approximate(points: DataFrame, queries: DataFrame, k: int, distance: float = 1.0, tables: int = 8,
                bucket: float = 0.75, query_id: str = "query_id", point_id: str = "point_id",
                vector: str = "vector") -> DataFrame:
    """Random-projection candidates on unit vectors, then exact cosine."""

    def unit(df: DataFrame, column: str) -> DataFrame:
        v = F.col(column).cast("array<double>")
        return df.withColumn("__unit", F.transform(v, lambda x: x / vec.norm(v))).withColumn("__v", array_to_vector("__unit"))

    left = unit(points.select(F.col(point_id).alias("point_id"), F.col(vector)), vector).select("point_id", "__unit", "__v")
    right = unit(queries.select(query_id, "vector"), "vector").select(query_id, "__unit", "__v")
    model = BucketedRandomProjectionLSH(inputCol="__v", outputCol="__h", bucketLength=bucket, numHashTables=tables, seed=7).fit(left)
    pairs = model.approxSimilarityJoin(left, right, distance, distCol="__d")
    scored = pairs.select(F.col(f"datasetB.{query_id}").alias(query_id), F.col("datasetA.point_id").alias("point_id"),
                          F.round(vec.dot(F.col("datasetA.__unit"), F.col("datasetB.__unit")), SCORE_PLACES).alias("score"))
    return ranked(scored, query_id).filter(F.col("rank") <= k)


def recall(exact: DataFrame, guess: DataFrame, query_id: str = "query_id") -> DataFrame:
    kept = exact.join(guess.select(query_id, "point_id").withColumn("__hit", F.lit(1)), [query_id, "point_id"], "left")
    return kept.agg(F.count("*").alias("wanted"), F.count("__hit").alias("found"), (F.count("__hit") / F.count("*")).alias("recall"))


# --- fusion -----------------------------------------------------------------------


def fuse(lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ``query_id, variant, rank, point_id, score``:
    summed 1/(k+rank), number of lists that hold the point, best score."""
    return lists.groupBy("query_id", "point_id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"), F.count_distinct("variant").alias("lists"),
        F.max("score").alias("score"))


def best_per_id(found: DataFrame, ids: list[str], payload: list[str]) -> DataFrame:
    """Best-scored hit per query and first filled id; rows without id are dropped."""
    keyed = found.withColumn("__id", F.coalesce(*[F.col(c).cast("string") for c in ids])).filter(F.col("__id").isNotNull())
    best = keyed.groupBy("query_id", "__id").agg(
        F.max_by(F.struct("score", *payload), F.struct(F.col("score"), *[F.col(p) for p in payload])).alias("__hit"))
    return best.select("query_id", F.col("__id").alias("id"), "__hit.*")


def mmr(candidates: DataFrame, top: int, weight: float = 0.5, vector: str = "vector") -> DataFrame:
    """Maximal marginal relevance: ``query_id, point_id, relevance, position``.

    All candidates of a query compete, whatever their number; those without a
    vector follow by relevance. A candidate that even full novelty could not
    lift above the ``top`` most relevant ones is left out beforehand, which
    changes no pick: its value is at most w*r + (1-w), theirs at least w*r - (1-w).
    """
    filled = F.col(vector).isNotNull()
    place = F.row_number().over(Window.partitionBy("query_id", filled).orderBy(F.desc("relevance"), "point_id"))
    ranked = candidates.withColumn("__n", place)
    least = ranked.filter(filled & (F.col("__n") == top)).select("query_id", (F.col("relevance") - 2 * (1 - weight) / max(weight, 1e-12)).alias("__least"))
    bounded = ranked.join(least, "query_id", "left").filter(
        F.when(filled, F.coalesce(F.col("relevance") >= F.col("__least"), F.lit(True))).otherwise(F.col("__n") <= top)).drop("__least")
    schema = bounded.select("query_id", "point_id", "relevance").withColumn("position", F.lit(1).cast("long")).schema

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__n", ignore_index=True)
        with_vector = frame[frame[vector].notna()]
        order: list[int] = []
        if len(with_vector):
            m = np.stack(with_vector[vector].to_numpy()).astype(np.float64)
            size = np.linalg.norm(m, axis=1, keepdims=True)
            m = m / np.where(size == 0, 1e-12, size)
            gain = with_vector["relevance"].to_numpy(dtype=np.float64)
            closest = np.full(len(m), -np.inf)
            free = np.ones(len(m), dtype=bool)
            while free.any() and len(order) < top:
                value = weight * gain - (1 - weight) * closest if order else gain
                chosen = int(np.argmax(np.where(free, np.round(value, 12), -np.inf)))
                order.append(chosen)
                free[chosen] = False
                closest = np.maximum(closest, m @ m[chosen])
        chosen_rows = with_vector.iloc[order]
        rest = frame[frame[vector].isna()]
        picked = pd.concat([chosen_rows, rest]).head(top)[["query_id", "point_id", "relevance"]].copy()
        picked["position"] = np.arange(1, len(picked) + 1)
        return picked

    parts = int(bounded.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows, much work: not coalesced by size
    return bounded.repartition(parts, "query_id").groupBy("query_id").applyInPandas(pick, schema)


# --- query-dependent depth and confidence --------------------------------------------


def adaptive_depth(df: DataFrame, text: str, k: int = 20, low: int = 5, high: int = 100, threshold: float = 0.3,
                   planner: str | None = None) -> DataFrame:
    """Adds query_type, top_k and score_threshold of each query row."""
    kinds = F.create_map(*[x for name, (m, d, _) in lx.QUERY_STRATEGY.items() for x in (
        F.lit(name), F.struct(F.lit(m).alias("m"), F.lit(d).alias("d")))])
    out = df.withColumn("query_type", tx.query_type(F.col(text))).withColumn("__s", F.try_element_at(kinds, F.col("query_type")))
    wide = F.greatest(F.bround(F.lit(k) * F.col("__s.m")), F.lit(1.0))
    wide = F.when(tx.word_count(F.col(text)) > 25, F.bround(wide * 1.2)).otherwise(wide)
    if planner:
        wide = wide + F.when((F.col(planner) >= 0) & (F.col(planner) < 0.65), 4).otherwise(0)
    bounded = F.greatest(F.lit(low), F.least(F.lit(high), wide)).cast("int")
    return (out.withColumn("top_k", bounded)
            .withColumn("score_threshold", F.round(vec.clamp(F.lit(threshold) + F.col("__s.d")), 4)).drop("__s"))


def coverage(fused: DataFrame, variants: int) -> DataFrame:
    """Mean share of the query variants that found each hit, per query."""
    if variants <= 1:
        return fused.groupBy("query_id").agg(F.lit(1.0).alias("coverage"))
    share = F.avg("lists") / variants
    return fused.groupBy("query_id").agg(F.round(F.least(F.lit(1.0), share), 4).alias("coverage"))


def confidence(found: DataFrame, score: Column, has_metadata: Column, coverage_by_query: DataFrame | None = None) -> DataFrame:
    """Per query: 0.40 top + 0.20 mean + 0.15 closeness + 0.15 metadata + 0.10 coverage."""
    parts = found.groupBy("query_id").agg(
        F.min_by(score, F.col("rank")).alias("top"), F.avg(score).alias("mean"),
        (1.0 - (F.max(score) - F.min(score))).alias("close"), F.avg(has_metadata.cast("double")).alias("meta"))
    if coverage_by_query is None:
        parts = parts.withColumn("coverage", F.lit(1.0))
    else:
        parts = parts.join(coverage_by_query, "query_id", "left").fillna(1.0, ["coverage"])
    total = (0.40 * F.col("top") + 0.20 * F.col("mean") + 0.15 * vec.clamp(F.col("close"))
             + 0.15 * F.col("meta") + 0.10 * vec.clamp(F.col("coverage")))
    return parts.select("query_id", F.round(vec.clamp(total), 4).alias("confidence"))

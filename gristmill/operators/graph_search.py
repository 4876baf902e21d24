"""Approximate search on navigable small-world graphs, one for each shard of the points.

A task links every vector of its shard to near vectors in different directions
and to a few far ones. A query enters at the nearest of some spread-out vectors
and follows links best first, keeping the ``ef`` best seen; shards' hits are
merged. What a query touches grows with ``ef`` and the number of shards, not
with the number of vectors in a shard.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from gristmill.operators import vectors as vec
from gristmill.session import cut_lineage

#: Near links of a vector (as many may lead back to it), far links, and vectors of a shard.
NEAR, FAR, SHARD_ROWS = 12, 2, 20_000
#: Queries that one task holds beside its shard.
QUERIES = 20_000
#: Similarities computed at a time while linking.
TILE = 4_000_000


def link(units: np.ndarray, near: int = NEAR, far: int = FAR, seed: int = 11) -> np.ndarray:
    """Links of each unit vector (rows padded with -1).

    Of a vector's nearest, one is linked if it is closer to the vector than to
    those linked before it, so links lead in different directions; links are
    also followed backwards.
    """
    n = len(units)
    rng, width = np.random.default_rng(seed), min(n - 1, 3 * near)
    out = [set() for _ in range(n)]
    step = max(1, TILE // max(n, 1))
    for at in range(0, n if width > 0 else 0, step):
        scores = units[at:at + step] @ units.T
        scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -np.inf
        best = np.argpartition(-scores, width - 1, axis=1)[:, :width]
        for k, row in enumerate(best):
            row = row[np.argsort(-scores[k, row], kind="stable")]
            among, kept = units[row] @ units[row].T, []
            for j in range(len(row)):
                if len(kept) < near and all(among[j, i] < scores[k, row[j]] for i in kept):
                    kept.append(j)
            kept += [j for j in range(len(row)) if j not in kept][:max(0, near // 2 - len(kept))]
            out[at + k].update(row[kept].tolist())
    back = [[] for _ in range(n)]
    for i, links in enumerate(out):
        for j in links:
            if len(back[j]) < near:
                back[j].append(i)
    for i in range(n):
        out[i].update(back[i])
        out[i].update(rng.integers(0, n, far).tolist())
        out[i].discard(i)
    table = np.full((n, max(map(len, out), default=0)), -1, np.int32)
    for i, links in enumerate(out):
        table[i, :len(links)] = sorted(links)
    return table


def walk(units: np.ndarray, links: np.ndarray, query: np.ndarray, ef: int) -> tuple[list[int], int]:
    """The best ``ef`` vectors met, and how many were touched."""
    n = len(units)
    doors = np.arange(0, n, max(1, int(n ** 0.5)))
    seen = np.zeros(n, bool)
    seen[doors] = True
    scores = units[doors] @ query
    order = np.argsort(-scores)[:ef]
    open_ = [(-float(scores[i]), int(doors[i])) for i in order[:4]]
    best = [(float(scores[i]), int(doors[i])) for i in order]
    heapq.heapify(open_)
    heapq.heapify(best)
    touched = len(doors)
    while open_:
        score, at = heapq.heappop(open_)
        if len(best) >= ef and -score < best[0][0]:
            break
        near = links[at]
        near = near[near >= 0]
        near = near[~seen[near]]
        seen[near] = True
        touched += len(near)
        for value, node in zip((units[near] @ query).tolist(), near.tolist()):
            if len(best) < ef:
                heapq.heappush(best, (value, node))
            elif value > best[0][0]:
                heapq.heapreplace(best, (value, node))
            else:
                continue
            heapq.heappush(open_, (-value, node))
    return [node for _, node in best], touched


def build(points: DataFrame, point_id: str = "point_id", vector: str = "vector", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: shard, ids, size, units and links (binary). Null, empty and zero vectors are left out."""
    size = F.size(vector)
    rows = points.select(F.col(point_id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("v").isNotNull() & (F.size("v") > 0) & F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").head()
    rows = rows.where(F.size("v") == (common["d"] if common else 0))
    shards = -(-(common["count"] if common else 0) // shard_rows) or 1
    kind = rows.schema["id"].dataType

    def run(table: pa.Table) -> pa.Table:
        matrix = vec.as_matrix(table.column("v").combine_chunks())
        units = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "ids": pa.array([table.column("id").to_pylist()], pa.list_(table.column("id").type)),
                         "size": pa.array([matrix.shape[1]], pa.int32()), "units": pa.array([units.tobytes()]), "links": pa.array([link(units).tobytes()])})

    schema = StructType([StructField("shard", IntegerType()), StructField("ids", ArrayType(kind)), StructField("size", IntegerType()),
                         StructField("units", BinaryType()), StructField("links", BinaryType())])
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))
    return cut_lineage(dealt.groupBy("shard").applyInArrow(run, schema))


def search(index: DataFrame, queries: DataFrame, k: int, ef: int = 128, query_id: str = "query_id", vector: str = "vector") -> DataFrame:
    """query_id, point_id, score, rank, touched: the ``k`` best by cosine that walks of width ``ef`` find.

    ``touched`` counts the vectors compared with the query over all shards.
    Ties go to the smaller id; equal vectors have equal scores.
    """
    kinds = index.schema["ids"].dataType.elementType, queries.schema[query_id].dataType
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("v")).where(F.exists("v", lambda x: x != 0))
    spread = index.select("shard").distinct().withColumn("one", F.lit(1)).groupBy("one").agg(F.collect_list("shard").alias("shards")).head()
    shards = spread["shards"] if spread else [0]
    slices = asked.count() // QUERIES + 1
    every = asked.withColumns({"slice": F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int"), "shard": F.explode(F.lit(sorted(shards)).cast("array<int>"))})
    index = index.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def run(key: tuple, shard: pa.Table, wanted: pa.Table) -> pa.Table:
        found, names, scores, touched = [], [], [], []
        if len(shard) and len(wanted):
            ids, size = shard.column("ids")[0].as_py(), shard.column("size")[0].as_py()
            units = np.frombuffer(shard.column("units")[0].as_py(), np.float64).reshape(-1, size)
            links = np.frombuffer(shard.column("links")[0].as_py(), np.int32).reshape(len(units), -1)
            asked = wanted.column("v").combine_chunks()
            ends, flat = asked.offsets.to_numpy(), asked.values.to_numpy(zero_copy_only=False)
            for name, low, high in zip(wanted.column("query_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                if high - low != size:
                    continue
                query = flat[low:high] / np.linalg.norm(flat[low:high])
                nodes, n = walk(units, links, query, max(ef, k))
                exact = (units[nodes] * query).sum(axis=1)
                for at in sorted(range(len(nodes)), key=lambda i: (-exact[i], ids[nodes[i]]))[:k]:
                    names.append(name)
                    found.append(ids[nodes[at]])
                    scores.append(float(exact[at]))
                    touched.append(n)
                    n = 0  # counted once for the query and shard
        return pa.table({"query_id": pa.array(names, wanted.column("query_id").type), "point_id": pa.array(found, shard.column("ids").type.value_type),
                         "score": pa.array(scores, pa.float64()), "here": pa.array(touched, pa.int64())})

    schema = StructType([StructField("query_id", kinds[1]), StructField("point_id", kinds[0])]).add("score", "double").add("here", "long")
    hits = index.groupBy("shard", "slice").cogroup(every.groupBy("shard", "slice")).applyInArrow(run, schema)
    of = Window.partitionBy("query_id")
    hits = hits.withColumn("touched", F.sum("here").over(of)).withColumn("rank", F.row_number().over(of.orderBy(F.desc("score"), "point_id")).cast("long"))
    return hits.where(F.col("rank") <= k).select("query_id", "point_id", "score", "rank", "touched")

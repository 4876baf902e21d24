"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gristmill.llm import store


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v) with the least of u and its v's as ``m``. The join can be split at hot u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _with_least(down).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), F.col("m")))).alias("e"))
    return found.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (long u, long v) that is not a
    root itself; the root is the least node of its component.

    Each round writes its edges to the shared folder. The number of rounds
    grows with the logarithm of the longest path.
    """
    edges = store.stash(edges.where("u != v").distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).head()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        edges = store.stash(_small_star(store.stash(_large_star(edges), "stars")), "edges")


def first_rows(docs: DataFrame, mark: Callable[[str | None], int], marked: DataFrame, roots: DataFrame) -> DataFrame:
    """The first row of each component by doc_id (null last), text and the other columns.

    ``mark`` gives the node of a text, ``marked`` has (doc_id, node) of every
    row and ``roots`` (node, root) of nodes that are no root. Only ids and
    nodes are compared first; of a component only rows with its least doc_id
    bring their text.
    """
    spare = store.unused(docs.columns)
    pairs = marked.select("doc_id", "node").distinct().join(roots, "node", "left").select(
        "doc_id", "node", F.coalesce("root", "node").alias("root"))
    pairs = store.stash(pairs, "document-roots")
    least = pairs.groupBy("root").agg(F.min("doc_id").alias("least"))
    chosen = pairs.join(least, "root").where(F.col("doc_id").eqNullSafe(F.col("least"))).select(
        *(F.col(c).alias(spare(c)) for c in ("doc_id", "node", "root")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column(spare("mark"), pa.array([mark(t.as_py()) for t in batch.column("text")], pa.int64()))

    every = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(spare("mark"), LongType())]))
    order = Window.partitionBy(spare("root")).orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    return (every.join(chosen, F.col("doc_id").eqNullSafe(F.col(spare("doc_id"))) & (F.col(spare("mark")) == F.col(spare("node"))))
            .withColumn(spare("place"), F.row_number().over(order)).where(F.col(spare("place")) == 1).select(*docs.columns))

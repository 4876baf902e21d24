"""Exact and near duplicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import hashing as hs
from gristmill.functions import text as tx
from gristmill.operators import setjoin
from gristmill.session import bound_batches, cut_lineage

STRATEGIES = ("primary_key", "text_hash", "composite_payload_hash", "primary_key_or_hash")


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row of each key by a unique order column; a null key is no key,
    so such rows all stay. Only (key, order) is aggregated, so a key with very
    many copies costs one row per task."""
    return df.join(_firsts(df, key, order), order, "left_semi")


def _firsts(df: DataFrame, key: str, order: str) -> DataFrame:
    """Orders of the first row of each key, and of all rows without a key."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order)).select(order)
    return first.unionByName(df.where(F.col(key).isNull()).select(order))


def keep_first(df: DataFrame, strategy: str, order: str, composite: list[str] | None = None,
               point_id: str = "point_id", text_hash: str = "text_hash") -> DataFrame:
    """Rows that repeat nothing kept before them in ``order``."""
    if strategy == "primary_key":
        return first_per_key(df, point_id, order)
    if strategy == "text_hash":
        return first_per_key(df, text_hash, order)
    if strategy == "composite_payload_hash":
        parts = [F.col(c) for c in (composite or sorted(c for c in df.columns if c != order))]
        return first_per_key(df.withColumn("__hash", hs.composite_hash(*parts)), "__hash", order).drop("__hash")
    if strategy == "primary_key_or_hash":
        kept = independent_rows(df.select(order, point_id, text_hash), [point_id, text_hash], order)
        return df.join(kept, order, "left_semi")
    raise ValueError(f"strategy must be one of {STRATEGIES}")


def independent_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Orders of the rows that share no key value with an earlier kept row.

    Rounds: a row that comes first among the undecided ones in all its key
    groups is kept, everything that shares a value with it is dropped. The
    result equals the sequential scan; each round only aggregates and joins.
    A null key is no key: it is shared with no row.
    """
    keyless = F.coalesce(*[F.col(k).cast("string") for k in keys]).isNull()
    kept = df.where(keyless).select(order)
    # Rows equal in all keys follow the first of them, whatever its fate.
    undecided = cut_lineage(df.where(~keyless).groupBy(*keys).agg(F.min(order).alias(order)))
    while True:
        chosen = undecided.select(order)
        for key in keys:
            chosen = chosen.join(_firsts(undecided, key, order), order, "left_semi")
        winners = cut_lineage(undecided.join(chosen, order, "left_semi"))
        kept = kept.unionByName(winners.select(order))
        rest = undecided
        for key in keys:
            rest = rest.join(winners.select(key).distinct(), key, "left_anti")
        undecided = cut_lineage(rest)
        if undecided.isEmpty():
            return kept


def best_per_text(df: DataFrame, text: str = "chunk_text", score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """Best-scored row per query and normalised text."""
    form = df.withColumn("__form", F.sha2(tx.compare_form(F.col(text)), 256))
    place = F.row_number().over(Window.partitionBy("query_id", "__form").orderBy(F.desc(score), tie))
    return form.withColumn("__n", place).filter(F.col("__n") == 1).drop("__n", "__form")


# --- near duplicates inside one query's result set -----------------------------------------


def _sets(rows: DataFrame, marks: list[str] | None = None) -> DataFrame:
    named = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in marks or []]).cast("array<string>")
    return rows.select("query_id", "at", named.alias("marks"), F.col("__print.set").alias("set"))


def _without_losers(rows: DataFrame, same: list[str], lost: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """First row of each class of ``same`` columns, less what ``lost`` finds; rows without text stay.

    Rows equal in ``same`` share the fate of the first of them or repeat it.
    """
    empty = F.size("__print.set") == 0
    place = F.row_number().over(Window.partitionBy("query_id", *same).orderBy("at"))
    first = cut_lineage(rows.withColumn("__n", F.when(empty, 1).otherwise(place)).where("__n = 1").drop("__n"))
    return first.join(lost(first.where(~empty)), ["query_id", "at"], "left_anti")


def drop_near_duplicates(df: DataFrame, text: str = "text", rank: str = "rank", threshold: float = 0.85) -> DataFrame:
    """Greedy by rank: a text goes if its 5-word shingles reach ``threshold``
    Jaccard with a kept one, or its normal form is equal. Empty texts stay."""
    bound_batches(df.sparkSession)
    rows = df.withColumns({"__print": tx.shingle_print(tx.dedup_form(F.col(text))), "at": F.struct(rank)})
    kept = _without_losers(rows, ["__print.digest"], lambda first: setjoin.losers(_sets(first), threshold))
    return kept.select(*df.columns)


METADATA_KEYS = ("topic", "document_type", "source_type", "product_id", "parent_asin")


def drop_similar(df: DataFrame, text: str = "chunk_text", score: str = "score", tie: str = "chunk_id", threshold: float = 0.92) -> DataFrame:
    """Greedy by score: a text goes if its shingles are ``threshold`` alike to
    those of a kept one and their metadata agree in two fields, or more than
    0.97 alike."""
    keys = [k for k in METADATA_KEYS if k in df.columns]
    at = F.struct((-F.coalesce(F.col(score), F.lit(float("-inf")))).alias("down"), F.col(tie).alias("tie"))
    bound_batches(df.sparkSession)
    rows = df.withColumns({"__print": tx.shingle_print(tx.compare_form(F.col(text))), "at": at})

    def linked(similarity: float, one: list, two: list) -> bool:
        return similarity > 0.97 or sum(a == b != "" for a, b in zip(one, two)) >= 2

    return _without_losers(rows, ["__print.digest", *keys], lambda first: setjoin.losers(_sets(first, keys), threshold, linked)).select(*df.columns)


def similar_pairs(df: DataFrame, text: str = "chunk_text", key: str = "chunk_id", threshold: float = 0.92) -> DataFrame:
    """Report of alike texts of each query: (query_id, left, right, similarity).

    Texts of one form are represented by their first key: each other one is
    paired with it alone (similarity 1), and pairs of different forms are
    reported between representatives.
    """
    bound_batches(df.sparkSession)
    rows = df.select("query_id", F.struct(F.col(key).alias("key")).alias("at"), tx.shingle_print(tx.compare_form(F.col(text))).alias("__print"))
    rows = cut_lineage(rows).where(F.size("__print.set") > 0)
    digest = F.col("__print.digest").alias("digest")
    firsts = rows.groupBy("query_id", digest).agg(F.min("at").alias("first"))
    placed = cut_lineage(rows.select("query_id", "at", digest).join(firsts, ["query_id", "digest"]).select("query_id", "first", "at"))
    copies = placed.where("at != first").select("query_id", "first.key", "at", F.lit(1.0).alias("similarity")).distinct()
    sets = rows.join(placed.where("at = first").select("query_id", "at").distinct(), ["query_id", "at"], "left_semi").dropDuplicates(["query_id", "at"])
    links = setjoin.links(cut_lineage(_sets(sets)), threshold)
    return links.select("query_id", F.col("earlier.key").alias("left"), F.col("later.key").alias("right"), "similarity").union(
        copies.select("query_id", F.col("key").alias("left"), F.col("at.key").alias("right"), "similarity"))

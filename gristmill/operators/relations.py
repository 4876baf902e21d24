"""Foreign keys between tables, join keys, and merging of sources."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import lexicon as lx
from gristmill.functions import text as tx
from gristmill.operators import profile as pf
from gristmill.operators.ordered import dense_index
from gristmill.session import cut_lineage

#: Lookup sides up to this many rows are broadcast.
BROADCAST_ROWS = 200_000


def name_similarity(left: Column, right: Column, table: Column) -> Column:
    """Best of token overlap, close spelling and shared meaning."""
    ratio = tx.sequence_ratio()
    own, other = tx.identifier_tokens(left), tx.identifier_tokens(right)
    full = F.concat_ws("_", table, right)

    def fuzzy(a: Column, b: Column) -> Column:
        x, y = tx.identifier_tokens(a), tx.identifier_tokens(b)
        meaning = tx.overlap(tx.expand_synonyms(x, lx.COLUMN_SYNONYMS), tx.expand_synonyms(y, lx.COLUMN_SYNONYMS))
        return F.greatest(ratio(F.array_join(x, ""), F.array_join(y, "")), meaning)

    def meant(parts: Column) -> Column:
        return tx.expand_synonyms(parts, lx.COLUMN_SYNONYMS)

    overlap = tx.overlap(meant(own), F.array_union(meant(other), meant(tx.identifier_tokens(table))))
    return F.greatest(overlap, fuzzy(left, right), fuzzy(left, full))


def value_similarity() -> Column:
    """Half for overlapping ranges, half for shared frequent values."""
    lo, hi, lo2, hi2 = [F.col(c).try_cast("double") for c in ("min_value", "max_value", "key_min", "key_max")]
    ranges = F.when((hi >= lo2) & (lo <= hi2), 0.5).otherwise(0.0)
    shared = F.size(F.array_intersect("top", "key_top")) / F.greatest(F.size("top"), F.lit(1))
    return F.least(F.coalesce(ranges, F.lit(0.0)) + 0.5 * F.coalesce(shared, F.lit(0.0)), F.lit(1.0))


def describe(tables: dict[str, DataFrame]) -> DataFrame:
    """Kinds of all columns with their five most frequent values."""
    parts = []
    for name, df in tables.items():
        top = pf.top_values(df).groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("top"))
        parts.append(pf.with_kind(pf.value_profile(df, name)).join(top, "column", "left"))
    none = F.array().cast("array<string>")
    return reduce(DataFrame.unionByName, parts).withColumn("top", F.coalesce("top", none))


def discover(described: DataFrame, least: float = 0.2) -> DataFrame:
    """Candidate foreign keys, best key per (from_table, from_column, to_table).

    Works on column descriptions only. Pairs meet on the family of their type
    (a temporal key fits any), never as a product of all columns.
    """
    key_rows = pf.keys(described).join(described, ["table", "column"])
    fits = F.when(F.col("family") == "temporal", F.array(*[F.lit(x) for x in ("numeric", "textual", "nested")]))
    right = key_rows.select(
        F.col("table").alias("to_table"), F.col("column").alias("to_column"), F.col("min_value").alias("key_min"),
        F.col("max_value").alias("key_max"), F.col("top").alias("key_top"), F.col("distinct_count").alias("key_distinct"),
        (F.col("kind") == "identifier").alias("key_is_id"), F.explode(F.coalesce(fits, F.array("family"))).alias("family"))
    left = described.filter(F.col("kind").isin("identifier", "numeric", "categorical", "textual"))
    pairs = left.join(right, "family").filter(F.col("table") != F.col("to_table"))
    scored = pairs.withColumns({
        "name_score": name_similarity(F.col("column"), F.col("to_column"), F.col("to_table")),
        "value_score": value_similarity()})
    cardinality = (F.when(F.col("is_unique"), "one_to_one")
                   .when(F.col("distinct_count") <= F.col("key_distinct"), "many_to_one").otherwise("one_to_many"))
    sure = F.round(F.least(F.lit(1.0), 0.6 * F.col("name_score") + 0.4 * F.col("value_score")
                           + F.when(F.col("key_is_id"), 0.15).otherwise(0.0)), 3)
    kept = scored.filter(F.greatest("name_score", "value_score") >= least).select(
        F.col("table").alias("from_table"), F.col("column").alias("from_column"), "to_table", "to_column",
        F.greatest(sure, F.lit(0.2)).alias("confidence"), cardinality.alias("cardinality"), "name_score", "value_score")
    best = F.max_by(F.struct("to_column", "confidence", "cardinality", "name_score", "value_score"),
                    F.struct("confidence", "to_column"))
    return kept.groupBy("from_table", "from_column", "to_table").agg(best.alias("b")).select(
        "from_table", "from_column", "to_table", "b.*")


def inclusion(left: DataFrame, column: str, right: DataFrame, key: str) -> DataFrame:
    """Share of the distinct values of a column found among the key's values."""
    values = left.select(F.col(column).alias("v")).filter(F.col("v").isNotNull()).distinct()
    known = right.select(F.col(key).alias("v")).distinct().withColumn("hit", F.lit(1))
    return values.join(known, "v", "left").agg(
        F.count("*").alias("distinct_values"), F.count("hit").alias("included"),
        F.coalesce(F.try_divide(F.count("hit"), F.count("*")), F.lit(0.0)).alias("ratio"))


def verify(tables: dict[str, DataFrame], candidates: DataFrame, least: float = 0.5) -> DataFrame:
    """Candidates with their measured inclusion; only those from ``least`` on
    and of one type are measured. Candidates are column metadata."""
    rows = [r for r in candidates.filter(F.col("confidence") >= least).collect()
            if pf.family(tables[r["from_table"]].schema[r["from_column"]].dataType)
            == pf.family(tables[r["to_table"]].schema[r["to_column"]].dataType)]
    parts = [
        inclusion(tables[r["from_table"]], r["from_column"], tables[r["to_table"]], r["to_column"]).select(
            *[F.lit(r[c]).alias(c) for c in ("from_table", "from_column", "to_table", "to_column", "confidence", "cardinality")],
            F.col("ratio").alias("inclusion"))
        for r in rows]
    if not parts:
        return candidates.withColumn("inclusion", F.lit(None).cast("double")).limit(0)
    return reduce(DataFrame.unionByName, parts)


def column_values(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, family, value, n): how often each column holds each value, of columns that can be keys.

    Every table is read once and all its columns at once; whole numbers, texts
    and dates can be keys.
    """
    parts = []
    for name, df in tables.items():
        kinds = {c: "number" if isinstance(k, T.IntegralType) else "text" if isinstance(k, T.StringType) else "date" if isinstance(k, T.DateType) else None
                 for c, k in ((f.name, f.dataType) for f in df.schema)}
        cells = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("family"), F.col(c).cast("string").alias("value")) for c, k in kinds.items() if k]
        if cells:
            parts.append(df.select(F.lit(name).alias("table"), F.explode(F.array(*cells)).alias("c")).select("table", "c.*"))
    held = reduce(DataFrame.unionByName, parts).filter(F.col("value").isNotNull())
    return held.groupBy("table", "column", "family", "value").agg(F.count("*").alias("n"))


def inclusions(tables: dict[str, DataFrame]) -> DataFrame:
    """from_table, from_column, to_table, to_column, distinct_values, included, ratio, to_unique.

    All pairs of columns of different tables and one type family that share a
    value, from one pass: each value is listed with the columns that hold it,
    equal lists are counted, and only these counted lists become pairs. So the
    rows that are compared number lists of columns, not values.
    """
    held = cut_lineage(column_values(tables))
    of_column = held.groupBy("table", "column").agg(F.count("*").alias("distinct_values"), F.sum("n").alias("rows"))
    lists = held.groupBy("family", "value").agg(F.array_sort(F.collect_set(F.struct("table", "column"))).alias("columns"))
    counted = lists.groupBy("columns").agg(F.count("*").alias("shared"))
    pairs = counted.select(F.explode("columns").alias("a"), "columns", "shared").select("a", F.explode("columns").alias("b"), "shared").where("a.table != b.table")
    met = pairs.groupBy("a", "b").agg(F.sum("shared").alias("included")).select(
        F.col("a.table").alias("from_table"), F.col("a.column").alias("from_column"), F.col("b.table").alias("to_table"), F.col("b.column").alias("to_column"), "included")
    own = of_column.select(F.col("table").alias("from_table"), F.col("column").alias("from_column"), "distinct_values")
    key = of_column.select(F.col("table").alias("to_table"), F.col("column").alias("to_column"), (F.col("distinct_values") == F.col("rows")).alias("to_unique"))
    return met.join(own, ["from_table", "from_column"]).join(key, ["to_table", "to_column"]).select(
        "from_table", "from_column", "to_table", "to_column", "distinct_values", "included", (F.col("included") / F.col("distinct_values")).alias("ratio"), "to_unique")


def foreign_keys(found: DataFrame, least: float = 1.0) -> DataFrame:
    """Of ``inclusions`` those that reach ``least`` in a unique column, each column's best by name
    (ties: more values in common, then by name), with ``confidence``."""
    name = name_similarity(F.col("from_column"), F.col("to_column"), F.col("to_table"))
    fit = found.filter(F.col("to_unique") & (F.col("ratio") >= least)).withColumn("confidence", F.round(0.6 * name + 0.4 * F.col("ratio"), 3))
    best = F.max_by(F.struct("to_table", "to_column", "confidence"), F.struct("confidence", "included", "to_table", "to_column"))
    return fit.groupBy("from_table", "from_column").agg(best.alias("b")).select("from_table", "from_column", "b.*")


def join_path(keys: DataFrame, start: str, wanted: Iterable[str]) -> list[tuple[str, str, str, str]]:
    """Edges for ``analyse.join_edges`` from ``start`` to all ``wanted`` tables along ``keys`` (from_table,
    from_column, to_table, to_column, confidence): nearest first, then the surest. Keys are column metadata."""
    edges = sorted(((r["from_table"], r["from_column"], r["to_table"], r["to_column"]), -r["confidence"]) for r in keys.collect())
    edges = [e for e, _ in sorted(edges, key=lambda e: (e[1], e[0]))]
    reached, path, todo = {start: None}, [], [start]
    while todo:
        here = todo.pop(0)
        for edge in edges:
            other = edge[2] if edge[0] == here else edge[0] if edge[2] == here else None
            if other is not None and other not in reached:
                reached[other] = (here, edge)
                todo.append(other)
    for name in wanted:
        if name not in reached:
            raise ValueError(f"no key leads from {start} to {name}")
        steps = []
        while reached[name]:
            name, edge = reached[name]
            steps.append(edge)
        path += [e for e in reversed(steps) if e not in path]
    return path


# --- merging --------------------------------------------------------------------------------


def maybe_broadcast(df: DataFrame, rows: int | None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side whose row count is known to be small."""
    return F.broadcast(df) if rows is not None and rows <= limit else df


def join_key(base_columns: list[str], frame: DataFrame, threshold: float = 0.98) -> str | None:
    """Best shared id-like column that is unique within ``frame``."""
    shared = [c for c in frame.columns if c in base_columns]
    names = {c: max(pf.name_score(c), 0.5 if c in pf.MERGE_KEYS else 0.0) for c in shared}
    names = {c: s for c, s in names.items() if s > 0}
    if not names:
        return None
    best = pf.identifier_columns(frame, threshold, names).orderBy(F.desc("score"), "column").first()
    return best["column"] if best else None


def merge_sources(frames: dict[str, DataFrame], threshold: float = 0.98, order: str | None = None) -> DataFrame:
    """Left-joins every source to the largest one.

    Columns the base already has are dropped. A key that is only nearly unique
    fans out, as a left join does. Without a key two sources of one length can
    be aligned by position, which needs a column ``order`` in both.
    """
    sizes = {name: df.count() for name, df in frames.items()}
    filled = sorted((n for n in frames if sizes[n]), key=lambda n: -sizes[n])
    if not filled:
        raise ValueError("all sources are empty")
    merged = frames[filled[0]]
    for name in filled[1:]:
        frame = frames[name]
        key = join_key(merged.columns, frame, threshold)
        if key:
            extra = [c for c in frame.columns if c not in merged.columns]
            merged = merged.join(maybe_broadcast(frame.select(key, *extra), sizes[name]), key, "left")
        elif order and sizes[name] == sizes[filled[0]]:
            merged = align(merged, frame, order)
        else:
            raise ValueError(f"no unique shared key joins source {name}")
    return merged


def align(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """Pairs rows by their position in an explicit order of each side."""
    extra = [c for c in right.columns if c not in left.columns]
    numbered = dense_index(right, [order], "__at").select("__at", *extra)
    return dense_index(left, [order], "__at").join(numbered, "__at").drop("__at")


def merge_intelligence(meta: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals joined to metadata by chunk, else by record; metadata wins."""
    key = next((k for k in ("chunk_id", "record_id") if k in meta.columns and k in signals.columns), None)
    if key is None:
        return meta
    return meta.join(signals.drop(*[c for c in signals.columns if c in meta.columns and c != key]), key, "left")


def lookup(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is in the one-column table of ids."""
    wanted = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    return df.join(wanted, key, "left_semi")


def hits_with_metadata(hits: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Metadata of the hits; a hit without score counts as zero."""
    scored = hits.withColumn("score", F.coalesce("score", F.lit(0.0)))
    return scored.join(meta, key)


def retrieve(hits: DataFrame, meta: DataFrame, key: str, cap: int | None = None) -> DataFrame:
    """Hits once per id in hit order with metadata, of each query all or the first ``cap``."""
    best = hits.groupBy("query_id", key).agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    return (best if cap is None else best.filter(F.col("rank") <= cap)).join(meta, key)


def not_stored(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose id, and whose hash, is not in the store yet (each on its own)."""
    for key in keys:
        rows = rows.join(stored.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return rows

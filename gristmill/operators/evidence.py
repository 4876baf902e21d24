"""Evidence: scoring, diversity, document reconstruction, linking, rendering.

Everything is keyed by ``query_id``. Lists are only gathered after the rows of
a query were capped, so no group that is collected grows with the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import text as tx
from gristmill.operators import dedup
from gristmill.operators.vectors import clamp

# Identifier and date fields of a record.
IDENTIFIERS = ["product_id", "asin", "movie_id", "sku", "document_id", "id", "title", "name"]
DATE_FIELDS = ["created_at", "updated_at", "timestamp", "date", "review_date"]
HIDDEN_FIELDS = ["embedding", "vector", "raw", "_id", "_qdrant_id"]


def _has(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


def _place(df: DataFrame, partition: list[str], order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).cast("long"))


# --- scores ---------------------------------------------------------------------------


def quality(df: DataFrame, text: str = "chunk_text") -> Column:
    """0..0.75 for length, clear sentiment, topic, keywords and a good rating."""
    count = tx.word_count(F.col(text))
    filled = {c: F.coalesce(_has(df, c).cast("string") != "", F.lit(False)) for c in ("topic", "keywords")}
    score = F.when(count >= 40, 0.25).when(count >= 20, 0.15).otherwise(0.0)
    for test, gain in ((F.lower(_has(df, "sentiment_label").cast("string")).isin("positive", "negative"), 0.15),
                       (filled["topic"], 0.15), (filled["keywords"], 0.10),
                       (_has(df, "rating").cast("string").try_cast("double") >= 4, 0.10)):
        score = score + F.when(test, gain).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def recency(date: Column, as_of: Column) -> Column:
    """1.0 within 30 days, 0.8 within 180, 0.5 within a year, else 0.2; 0 if missing."""
    seconds = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(date.cast("timestamp"))
    days = F.floor(seconds / 86400)
    return (F.when(date.isNull(), 0.0).when(days < 30, 1.0).when(days < 180, 0.8).when(days < 365, 0.5).otherwise(0.2))


def with_hybrid_score(df: DataFrame, as_of: Column, date: str = "review_date", score: str = "score") -> DataFrame:
    fresh = recency(_has(df, date), as_of) if date in df.columns else F.lit(0.0)
    total = F.col(score) * 0.70 + quality(df) * 0.20 + fresh * 0.10
    return df.withColumn("hybrid_score", F.round(total, 5))


def rerank(df: DataFrame, score: str, tie: str) -> DataFrame:
    return _place(df, ["query_id"], [F.desc(score), F.col(tie)], "rank")


def limit_per_query(df: DataFrame, score: str, tie: str, most: int) -> DataFrame:
    return rerank(df, score, tie).filter(F.col("rank") <= most)


def one_per(df: DataFrame, key: Column, score: str, tie: str) -> DataFrame:
    """Best row per query and key; rows without a key all stay, each being a
    key of its own."""
    filled = F.nullif(key.cast("string"), F.lit(""))
    keyed = df.withColumn("__key", F.struct(filled.alias("key"), F.when(filled.isNull(), F.col(tie)).alias("own")))
    best = _place(keyed, ["query_id", "__key"], [F.desc(score), F.col(tie)], "__n")
    return best.filter(F.col("__n") == 1).drop("__n", "__key")


def compress(df: DataFrame, as_of: Column, tie: str = "chunk_id", most: int | None = None) -> tuple[DataFrame, dict[str, Observation]]:
    """Exact dedup, similar dedup, one per document and topic, rerank; the best ``most`` if given.

    The stage counts fill in when the result runs.
    """
    counts: dict[str, Observation] = {}

    def seen(rows: DataFrame, stage: str) -> DataFrame:
        counts[stage] = Observation(f"compress_{stage}")
        return rows.observe(counts[stage], F.count("*").alias("rows"))

    rows = seen(df, "input")
    rows = seen(dedup.best_per_text(rows, tie=tie), "after_exact_duplicate")
    rows = seen(dedup.drop_similar(rows, tie=tie), "after_similarity")
    rows = with_hybrid_score(rows, as_of)
    rows = one_per(rows, F.coalesce(_has(rows, "parent_asin").cast("string"), _has(rows, "record_id").cast("string")), "hybrid_score", tie)
    rows = one_per(rows, _has(rows, "topic").cast("string"), "hybrid_score", tie)
    rows = rerank(rows, "hybrid_score", tie)
    return seen(rows if most is None else rows.filter(F.col("rank") <= most), "final"), counts


def checked_compressor(df: DataFrame, custom: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Applies a user's compressor unless it returns more rows than it got."""
    out = df.transform(custom)
    return out if out.count() <= df.count() else df


# --- documents --------------------------------------------------------------------------


def flat_documents(hits: DataFrame, text: Column, document: Column) -> DataFrame:
    """One document per hit with rounded scores."""
    normal = F.col("normalized_score")
    again = F.coalesce(_has(hits, "relevance").cast("double"), normal)
    return hits.select(
        "query_id", document.alias("document_id"), text.alias("text"), F.round("score", 4).alias("score"),
        F.round(normal, 4).alias("normalized_score"), F.round(again, 4).alias("rerank_score"),
        F.round(0.6 * normal + 0.4 * again, 4).alias("retrieval_confidence"), F.lit(1).cast("long").alias("chunk_count"),
        F.col("point_id").alias("chunk_id"))


def chunked_documents(hits: DataFrame, document: str, order: str | None, text: str) -> DataFrame:
    """Hits of one document in order, repeats removed, texts joined by " ... ".

    A repeat has the same position, or without positions the same normal form.
    """
    at = F.col(order).cast("long") if order else F.lit(None).cast("long")
    again = F.coalesce(_has(hits, "relevance").cast("double"), F.col("normalized_score"))
    rows = hits.select("query_id", F.col(document).alias("document_id"), at.alias("at"), "rank", F.col(text).alias("text"),
                       tx.dedup_form(F.col(text)).alias("form"), "score", "normalized_score", again.alias("again"), "point_id")
    rows = rows.withColumn("mark", F.coalesce(F.col("at").cast("string"), F.col("form")))
    first = _place(rows, ["query_id", "document_id", "mark"], [F.col("rank")], "__n").filter(F.col("__n") == 1)
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce("at", F.lit(0)).alias("at"), "rank", "form", "text")))
    best = F.max_by(F.struct("normalized_score", "again", "point_id"), F.struct(F.col("normalized_score"), -F.col("rank")))
    grouped = first.groupBy("query_id", "document_id").agg(
        listed.alias("parts"), F.max("score").alias("score"), best.alias("best"), F.count("*").alias("chunk_count"),
        F.array_sort(F.collect_set("at")).alias("document_location"))
    forms = F.col("parts.form")
    kept = F.filter("parts", lambda p, i: (p["text"] != "") & (F.array_position(forms, p["form"]) == i + 1))
    return grouped.select(
        "query_id", "document_id", F.array_join(F.transform(kept, lambda p: p["text"]), " ... ").alias("text"),
        F.round("score", 4).alias("score"), F.round("best.normalized_score", 4).alias("normalized_score"),
        F.round("best.again", 4).alias("rerank_score"),
        F.round(0.6 * F.col("best.normalized_score") + 0.4 * F.col("best.again"), 4).alias("retrieval_confidence"),
        "chunk_count", F.col("best.point_id").alias("chunk_id"), "document_location")


# --- evidence ---------------------------------------------------------------------------


def record(df: DataFrame, columns: list[str]) -> Column:
    """The columns as a map of texts; absent values stay as null."""
    return F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast("string") for c in columns]))


def as_evidence(df: DataFrame, source: str, columns: list[str], confidence: Column, order: str) -> DataFrame:
    """query_id, source, evidence_id, record, confidence."""
    return df.select("query_id", F.lit(source).alias("source"), F.concat_ws(":", F.lit(source), F.col(order).cast("string")).alias("evidence_id"),
                     record(df, columns).alias("record"), clamp(confidence).alias("confidence"))


def merge(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _filled(name: str = "record") -> Column:
    return F.size(F.filter(F.map_values(name), lambda v: v.isNotNull() & (v != "") & ~v.isin("[]", "{}")))


def drop_repeated(evidence: DataFrame) -> DataFrame:
    """Richest row per query, source and content (metadata aside)."""
    pairs = F.array_sort(F.filter(F.map_entries("record"), lambda e: e["key"] != "metadata"))
    marked = evidence.withColumn("__print", F.sha2(F.to_json(pairs), 256))
    order = [_filled().desc(), F.col("evidence_id")]
    return _place(marked, ["query_id", "source", "__print"], order, "__n").filter(F.col("__n") == 1).drop("__n", "__print")


def link(evidence: DataFrame) -> DataFrame:
    """Adds linked_sources: all sources that share an identifier value with the row."""
    ids = F.filter(F.map_entries("record"), lambda e: e["key"].isin(IDENTIFIERS) & e["value"].isNotNull() & (e["value"] != ""))
    marks = evidence.select("query_id", "evidence_id", "source", F.explode(ids).alias("e")).select(
        "query_id", "evidence_id", "source", F.col("e.key").alias("field"), F.col("e.value").alias("value"))
    shared = marks.groupBy("query_id", "field", "value").agg(F.collect_set("source").alias("sources")).filter(F.size("sources") > 1)
    linked = marks.join(shared, ["query_id", "field", "value"]).groupBy("query_id", "evidence_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("linked_sources"))
    return evidence.join(linked, ["query_id", "evidence_id"], "left").withColumn(
        "linked_sources", F.coalesce("linked_sources", F.array().cast("array<string>")))


def fresh(name: str = "record") -> Column:
    """Whether any date field is filled."""
    return F.exists(F.array(*[F.try_element_at(F.col(name), F.lit(f)) for f in DATE_FIELDS]), lambda v: F.coalesce(v != "", F.lit(False)))


def rank_evidence(evidence: DataFrame, most: int | None = None) -> DataFrame:
    """0.55 confidence + 0.30 richness + 0.05 freshness + 0.10 if linked."""
    richness = F.coalesce(F.try_divide(_filled(), F.size(F.map_keys("record"))), F.lit(0.0))
    total = (0.55 * F.col("confidence") + 0.30 * richness + F.when(fresh(), 0.05).otherwise(0.0)
             + F.when(F.size("linked_sources") > 1, 0.10).otherwise(0.0))
    scored = evidence.withColumn("richness_score", richness).withColumn("rank_score", F.round(total, 9))
    out = _place(scored, ["query_id"], [F.desc("rank_score"), F.col("evidence_id")], "rank")
    return out if most is None else out.filter(F.col("rank") <= most)


def combined_confidence(structured: Column, semantic: Column, answer: Column) -> Column:
    """Weighted mean (.35, .30, .35) of the parts that are present."""
    parts = ((0.35, structured), (0.30, semantic), (0.35, answer))
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for w, c in parts), F.lit(0.0))
    total = sum((F.when(c.isNotNull(), w * clamp(c)).otherwise(0.0) for w, c in parts), F.lit(0.0))
    return F.when(weight > 0, clamp(total / weight)).otherwise(0.0)


def harvest_entities(df: DataFrame, columns: list[str], rank: str = "rank", rows: int | None = None) -> DataFrame:
    """Distinct texts per field of each query, or of its first ``rows``, in order.

    Only the first place of each text is listed.
    """
    head = _head(df, rank, rows)
    cells = head.select("query_id", rank, F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("c"))
    filled = cells.filter(F.coalesce(F.col("c.value") != "", F.lit(False)))
    firsts = filled.groupBy("query_id", "c.field", "c.value").agg(F.min(rank).alias("first"))
    listed = F.array_sort(F.collect_list(F.struct("first", "value")))
    return firsts.groupBy("query_id", "field").agg(F.transform(listed, lambda x: x["value"]).alias("values"))


def _head(df: DataFrame, rank: str, rows: int | None) -> DataFrame:
    return df if rows is None else df.filter(F.col(rank) <= rows)


# --- context for an answer ------------------------------------------------------------------


def clean_context(df: DataFrame, text: str, score: str, order: str, items: int | None = None, sources: int | None = None,
                  chars: int | None = None) -> DataFrame:
    """Best-scored rows first (no score last), without texts whose whole normal
    form repeats one before. ``chars`` cuts only the text shown; ``items`` and
    ``sources``, where given, are flagged and bound the rows."""
    whole = tx.strip(F.coalesce(F.col(text), F.lit("")))
    form = F.sha2(tx.collapse_punctuation(tx.squeeze(F.lower(whole))), 256)
    key = F.struct(F.when(whole != "", form).alias("form"), F.when(whole == "", F.col(order)).alias("own"))
    rows = df.withColumn("context_text", whole if chars is None else tx.truncate(whole, chars)).withColumn("__key", key)
    by_score = [F.col(score).isNull(), F.desc(score), F.col(order)]
    kept = _place(rows, ["query_id", "__key"], by_score, "__n").filter(F.col("__n") == 1).drop("__n", "__key")
    placed = _place(kept, ["query_id"], by_score, "position")
    if items is not None and sources is not None:
        placed = placed.filter(F.col("position") <= max(items, sources))
    return placed.withColumns({name: F.lit(True) if most is None else F.col("position") <= most
                               for name, most in (("is_item", items), ("is_source", sources))})


def context_confidence(context: DataFrame, score: str) -> DataFrame:
    """Mean of the three best clamped scores per query, 0 without scores."""
    best = context.filter((F.col("position") <= 3) & F.col(score).isNotNull())
    mean = best.groupBy("query_id").agg(F.round(F.avg(clamp(F.col(score))), 3).alias("confidence"))
    return context.select("query_id").distinct().join(mean, "query_id", "left").fillna(0.0, ["confidence"])


def records_from_rows(df: DataFrame, columns: str, rows: str) -> DataFrame:
    """``columns array<string>, rows array<array<string>>`` to one record map per row."""
    exploded = df.select("*", F.posexplode(rows).alias("row_number", "__row")).drop(rows)
    return exploded.withColumn("record", F.map_from_arrays(columns, "__row")).drop("__row", columns)


def records_from_json(df: DataFrame, cell: str) -> DataFrame:
    """Any JSON context to records: a table, a list, an object or a scalar.

    Scalars become ``{"value": ...}``; null gives no record.
    """
    table = F.from_json(cell, "struct<columns array<string>, rows array<array<string>>>")
    items = F.from_json(cell, "array<string>")
    is_table = table["columns"].isNotNull() & table["rows"].isNotNull()
    zipped = F.transform(table["rows"], lambda r: F.to_json(F.map_from_arrays(table["columns"], r)))
    parts = (F.when(F.col(cell).isNull(), F.array().cast("array<string>"))
             .when(F.trim(cell).startswith("{") & is_table, zipped)
             .when(F.trim(cell).startswith("["), items).otherwise(F.array(F.col(cell))))
    out = df.withColumn("__p", parts).select("*", F.posexplode("__p").alias("row_number", "item")).drop("__p")
    wrapped = F.when(F.trim("item").startswith("{"), F.from_json("item", T.MapType(T.StringType(), T.StringType())))
    return out.withColumn("record", F.coalesce(wrapped, F.create_map(F.lit("value"), F.col("item")))).drop("item")


# --- rendering ----------------------------------------------------------------------------------


def render_table(df: DataFrame, columns: list[str], rank: str = "rank", rows: int | None = None) -> DataFrame:
    """Markdown table of each query's rows, or of its first ``rows``."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns]), F.lit(" |\n"))
    head = "## Structured Facts\n| " + " | ".join(columns) + " |\n| " + " | ".join(["---"] * len(columns)) + " |\n"
    listed = F.array_sort(F.collect_list(F.struct(F.col(rank), line.alias("line"))))
    return _head(df, rank, rows).groupBy("query_id").agg(
        F.concat(F.lit(head), F.array_join(F.transform(listed, lambda x: x["line"]), "")).alias("facts"))


def render_snippets(df: DataFrame, text: str, score: str, rank: str = "rank", rows: int | None = None, chars: int | None = None) -> DataFrame:
    """Numbered snippets with score of each query's rows, or of its first ``rows``; texts whole or cut to ``chars``."""
    shown = F.col(text) if chars is None else F.substring(text, 1, chars)
    line = F.concat(F.col(rank).cast("string"), F.lit(". ★"), F.round(score, 4).cast("string"), F.lit(" — "), shown, F.lit("\n"))
    listed = F.array_sort(F.collect_list(F.struct(F.col(rank), line.alias("line"))))
    return _head(df, rank, rows).groupBy("query_id").agg(
        F.concat(F.lit("## Key Evidence Snippets\n"), F.array_join(F.transform(listed, lambda x: x["line"]), "")).alias("snippets"))


def render_context(queries: DataFrame, question: str, facts: DataFrame, snippets: DataFrame, system: str, chars: int = 6000) -> DataFrame:
    """One text per query from the rendered parts, cut to ``chars``. A cut
    keeps 3000 characters before a table and ``chars`` of the table on."""
    joined = queries.join(facts, "query_id", "left").join(snippets, "query_id", "left")
    whole = F.concat_ws("\n\n", F.lit(system), F.concat(F.lit("\n## Question\n"), F.col(question), F.lit("\n")), F.col("facts"), F.col("snippets"))
    mark = "## Structured Facts"
    at = F.instr(F.col("context"), mark)
    before = F.substr(F.col("context"), F.lit(1), at - 1)
    after = F.substr(F.col("context"), at + len(mark))
    around = F.concat(F.substring(before, 1, 3000), F.lit("\n\n" + mark), F.substring(after, 1, chars))
    cut = F.concat(F.substring("context", 1, chars), F.lit("\n... (truncated)"))
    out = joined.withColumn("context", whole)
    return out.select("query_id", F.when(F.length("context") <= chars, F.col("context")).when(at > 0, around).otherwise(cut).alias("context"))


def source_list(df: DataFrame, columns: list[str], rank: str = "position", rows: int | None = None) -> DataFrame:
    """Ordered list of the visible fields of each query's rows, or of its first ``rows``."""
    shown = [c for c in columns if c not in HIDDEN_FIELDS]
    listed = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("n"), F.to_json(F.struct(*shown)).alias("source"))))
    return _head(df, rank, rows).groupBy("query_id").agg(F.transform(listed, lambda x: x["source"]).alias("sources"))

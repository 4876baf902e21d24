"""Column statistics, roles, keys and validation.

A profile is a table with one row per column. Distinct counts come from one
(column, value) frequency table instead of one expansion per column, so a
value that fills a third of a column is added up on the map side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import lexicon as lx
from gristmill.functions import text as tx
from gristmill.functions.hashing import is_missing

#: Longer values are represented by their hash when only counted.
DIGEST_OVER = 64

ID_SUFFIXES = ("_id", "_uuid", "_guid", "_key", "_code", "_sku", "_asin")
ID_NAMES = {"id", "uuid", "guid", "asin", "sku", "key"}
MERGE_KEYS = {"record_id", "chunk_id", "document_id", "doc_id", "id"}


def family(kind: T.DataType) -> str:
    """numeric, boolean, temporal, textual or nested."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)):
        return "temporal"
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return "nested"
    return "textual"


def _cell(field: T.StructField) -> Column:
    col = F.col(f"`{field.name}`")
    return F.to_json(col) if family(field.dataType) == "nested" else col.cast("string")


def _columns(df: DataFrame) -> DataFrame:
    """position, column, dtype, family: driver-small."""
    rows = [(i, f.name, f.dataType.simpleString(), family(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string, family string")


def cells(df: DataFrame) -> DataFrame:
    """One row per cell: column, value as text."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("column"), _cell(f).alias("value")) for f in df.schema.fields])).alias("c")).select("c.*")


def _distinct(df: DataFrame, *extra: Column) -> DataFrame:
    short = F.when(F.length("value") > DIGEST_OVER, F.sha2("value", 256)).otherwise(F.col("value"))
    return cells(df).groupBy("column", short.alias("key"), *extra).agg(F.count("*").alias("freq"))


def text_statistics(df: DataFrame) -> DataFrame:
    """Nulls, distinct values and, for text columns, lengths and word counts."""
    length, count = F.length("value").alias("chars"), tx.word_count(F.col("value")).alias("words")
    freq, filled = _distinct(df, length, count), F.col("key").isNotNull()

    def each(column: str) -> list[Column]:
        weighted = F.sum(F.when(filled, F.col(column) * F.col("freq"))) / F.sum(F.when(filled, F.col("freq")))
        # The buffer of these holds distinct lengths, not values.
        return [weighted.alias(f"avg_{column}"),
                F.percentile(F.when(filled, F.col(column)), F.lit(0.5), F.col("freq").cast("int")).alias(f"median_{column}"),
                F.percentile(F.when(filled, F.col(column)), F.lit(0.75), F.col("freq").cast("int")).alias(f"p75_{column}")]

    lengths = freq.groupBy("column", "chars", "words").agg(
        F.sum("freq").alias("freq"), F.count("key").alias("kinds"), F.max("key").alias("key"))
    stats = lengths.groupBy("column").agg(
        F.sum("freq").alias("total_rows"), F.coalesce(F.sum(F.when(~filled, F.col("freq"))), F.lit(0)).alias("null_count"),
        F.sum("kinds").alias("unique_count"), *each("chars"), F.max("chars").alias("max_chars"), *each("words"))
    out = _columns(df).join(stats, "column")
    text = F.col("family") == "textual"
    blank = {c: F.when(text & F.col(c).isNotNull(), F.col(c)).otherwise(0).cast("double")
             for c in ("avg_chars", "median_chars", "p75_chars", "max_chars", "avg_words", "median_words", "p75_words")}
    ratio = F.coalesce(F.try_divide(F.col("unique_count"), F.col("total_rows") - F.col("null_count")), F.lit(0.0))
    return out.withColumns(blank).withColumn("unique_ratio", ratio)


def with_bucket(stats: DataFrame, chars: int = 80, words: int = 10) -> DataFrame:
    """structured, unstructured or metadata."""
    bucket = (F.when(F.col("family").isin("numeric", "boolean", "temporal"), "structured")
              .when((F.col("p75_chars") >= chars) & (F.col("p75_words") >= words), "unstructured")
              .otherwise("metadata"))
    return stats.withColumn("bucket", bucket)


def with_role(stats: DataFrame, unique: float = 0.95) -> DataFrame:
    identifier = (F.col("unique_ratio") >= unique) & (F.col("p75_chars") <= 40)
    role = (F.when(F.col("bucket") == "structured", F.col("family")).when(F.col("bucket") == "unstructured", "textual")
            .when(identifier, "identifier").otherwise("categorical"))
    return stats.withColumn("role", role)


def registry(tables: dict[str, DataFrame]) -> DataFrame:
    """Roles of all columns of all tables, with what each may be used for."""
    parts = [with_role(with_bucket(text_statistics(df))).withColumn("table", F.lit(name)) for name, df in tables.items()]
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumns({"searchable": F.col("role") == "textual", "aggregatable": F.col("role") == "numeric"})


def both_directions(edges: DataFrame) -> DataFrame:
    """Relationship edges as undirected: each also reversed."""
    flipped = edges.select(F.col("to_table").alias("from_table"), F.col("to_column").alias("from_column"),
                           F.col("from_table").alias("to_table"), F.col("from_column").alias("to_column"),
                           *[c for c in edges.columns if c not in ("from_table", "from_column", "to_table", "to_column")])
    return edges.unionByName(flipped).distinct()


def fingerprint(roles: DataFrame) -> DataFrame:
    """Sixteen hex digits per table over its name and (column, role) pairs."""
    pairs = F.array_sort(F.collect_list(F.struct("position", F.concat_ws(":", "column", "role").alias("pair"))))
    listed = roles.groupBy("table").agg(F.array_join(pairs["pair"], "|").alias("pairs"))
    return listed.select("table", F.substring(F.sha2(F.concat_ws("|", "table", "pairs"), 256), 1, 16).alias("fingerprint"))


def schema_version(prints: DataFrame, relationships: int = 0, collections: int = 0) -> DataFrame:
    joined = F.array_join(F.array_sort(F.collect_list("fingerprint")), "|")
    whole = F.concat(joined, F.lit(f"|rel={relationships}|vec={collections}"))
    return prints.agg(F.substring(F.sha2(whole, 256), 1, 16).alias("version"))


def key_by_uniqueness(roles: DataFrame) -> DataFrame:
    """Identifier column with the highest unique ratio, the first on ties."""
    ids = roles.filter(F.col("role") == "identifier")
    best = F.max_by("column", F.struct("unique_ratio", (-F.col("position")).alias("p")))
    return ids.groupBy("table").agg(best.alias("primary_key"))


# --- kinds from value statistics -------------------------------------------------------


def value_profile(df: DataFrame, table: str) -> DataFrame:
    """Rows, nulls, distinct, min, max, deviation, mean, variance, text length."""
    fields = df.schema.fields
    parts = []
    for i, f in enumerate(fields):
        col, group = F.col(f"`{f.name}`"), family(f.dataType)
        cell = _cell(f)
        parts.append(F.count(cell).alias(f"n{i}"))
        ranged = group != "nested"
        parts.append((F.min(col).cast("string") if ranged else F.lit(None).cast("string")).alias(f"lo{i}"))
        parts.append((F.max(col).cast("string") if ranged else F.lit(None).cast("string")).alias(f"hi{i}"))
        if group == "numeric":
            parts += [F.stddev_samp(col).alias(f"sd{i}"), F.avg(col).cast("double").alias(f"avg{i}"),
                      F.var_samp(col).alias(f"var{i}"), F.lit(None).cast("double").alias(f"len{i}")]
        else:
            parts += [*[F.lit(None).cast("double").alias(f"{n}{i}") for n in ("sd", "avg", "var")],
                      F.avg(F.length(cell)).alias(f"len{i}")]
    wide = df.agg(F.count("*").alias("row_count"), *parts)
    names = {"n": "filled", "lo": "min_value", "hi": "max_value", "sd": "stddev", "avg": "avg", "var": "variance", "len": "avg_length"}
    long = wide.select("row_count", F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("column"), *[F.col(f"{k}{i}").alias(v) for k, v in names.items()])
        for i, f in enumerate(fields)])).alias("c")).select("row_count", "c.*")
    distinct = _distinct(df).groupBy("column").agg(F.count("key").alias("distinct_count"))
    out = _columns(df).join(long, "column").join(distinct, "column", "left").fillna(0, ["distinct_count"])
    return (
        out.withColumn("table", F.lit(table)).withColumn("null_count", F.col("row_count") - F.col("filled"))
        .withColumn("is_unique", (F.col("row_count") > 1) & (F.col("distinct_count") == F.col("row_count"))).drop("filled")
    )


def top_values(df: DataFrame, top: int = 5) -> DataFrame:
    """Most frequent filled values per column: column, value, freq, rank."""
    counts = cells(df).filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("freq"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("freq"), "value"))
    return counts.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top)


def categorical_threshold(rows: Column) -> Column:
    scale = 1.0 / (1.0 + F.log10(F.greatest(rows, F.lit(10)) / 10))
    return F.greatest(F.lit(0.02), F.least(F.lit(0.5), scale))


def with_kind(profile: DataFrame) -> DataFrame:
    """identifier, boolean, temporal, numeric, categorical or textual."""
    rows, distinct = F.col("row_count"), F.col("distinct_count")
    span = F.col("max_value").try_cast("double") - F.col("min_value").try_cast("double")
    whole = F.col("dtype").isin("tinyint", "smallint", "int", "bigint")
    dense = whole & (span > 0) & (distinct / (span + 1) >= 0.9)
    text, number = F.col("family").isin("textual", "nested"), F.col("family") == "numeric"
    key = F.col("is_unique") & (F.col("null_count") == 0)
    short = F.col("avg_length").isNull() | (F.col("avg_length") <= 40)
    dated = F.size(F.array_intersect(tx.identifier_tokens(F.col("column")),
                                     F.array(*[F.lit(w) for w in ("date", "time", "timestamp", "period")]))) > 0
    threshold = F.when(rows >= 20, categorical_threshold(rows)).otherwise(0.5)
    few = (distinct / rows <= threshold) & (distinct <= F.greatest(F.lit(500), F.floor(rows * threshold)))
    kind = (
        F.when(F.col("family") == "boolean", "boolean").when(F.col("family") == "temporal", "temporal")
        .when(key & ((text & short) | (number & dense)), "identifier").when(text & dated, "temporal")
        .when(few, "categorical").when(number, "numeric").otherwise("textual")
    )
    return profile.withColumns({"kind": F.coalesce(kind, F.lit("textual")), "is_dense": F.coalesce(dense, F.lit(False))})


def keys(kinds: DataFrame) -> DataFrame:
    """table, column, is_primary: the shortest identifier is primary, every
    other unique column a candidate."""
    unique = kinds.filter(F.col("is_unique") & (F.col("null_count") == 0))
    order = F.struct((F.col("kind") != "identifier").alias("a"), F.coalesce(F.col("avg_length"), F.lit(0.0)).alias("b"), F.col("position").alias("c"))
    first = unique.groupBy("table").agg(F.min_by("column", order).alias("__first"))
    return unique.join(first, "table").select("table", "column", (F.col("column") == F.col("__first")).alias("is_primary"))


def understanding(kinds: DataFrame) -> DataFrame:
    """0.7 of the share of columns with a known kind + 0.3 of the filled tables."""
    out = kinds.groupBy("table").agg(F.count("*").alias("n"), F.count_if(F.col("kind") != "unknown").alias("known"), F.max("row_count").alias("rows"))
    return out.agg(F.round(0.7 * F.sum("known") / F.sum("n") + 0.3 * F.avg((F.col("rows") > 0).cast("double")), 3).alias("score"))


def registry_view(kinds: DataFrame) -> DataFrame:
    """Per table one sorted list of column names for each kind."""
    order = ["numeric", "textual", "categorical", "boolean", "temporal", "identifier"]
    wide = kinds.groupBy("table").pivot("kind", order).agg(F.array_sort(F.collect_list("column")))
    return wide.select("table", *[F.coalesce(F.col(k), F.array().cast("array<string>")).alias(f"{k}_columns") for k in order])


# --- identifier columns ------------------------------------------------------------------


def name_score(name: str) -> float:
    """How much a column name looks like an identifier's."""
    low = name.lower()
    if low in ID_NAMES:
        return 1.0
    if low.endswith(ID_SUFFIXES):
        return 0.9
    return 0.6 if "id" in low.split("_") else 0.0


def identifier_columns(df: DataFrame, threshold: float = 0.98, names: dict[str, float] | None = None) -> DataFrame:
    """column, uniqueness, score: id-named columns that are unique enough,
    measured on all rows."""
    named = names if names is not None else {c: s for c in df.columns if (s := name_score(c)) > 0}
    empty = df.sparkSession.createDataFrame([], "column string, uniqueness double, score double")
    if not named:
        return empty
    scores = df.sparkSession.createDataFrame(list(named.items()), "column string, name_score double")
    counts = _distinct(df.select(*named)).filter(F.col("key").isNotNull()).groupBy("column").agg(
        (F.count("*") / F.sum("freq")).alias("uniqueness"))
    return (counts.join(scores, "column").filter(F.col("uniqueness") >= threshold)
            .select("column", "uniqueness", (F.col("name_score") * 0.4 + F.col("uniqueness") * 0.6).alias("score")))


def primary_key(df: DataFrame, threshold: float = 0.98) -> tuple[list[str] | None, str]:
    """Single best identifier, else all id-named columns together, else none."""
    best = identifier_columns(df, threshold).orderBy(F.desc("score"), "column").first()
    if best:
        return [best["column"]], "single_column"
    named = [c for c in df.columns if name_score(c) > 0]
    if len(named) >= 2 and uniqueness(df, named).first()["ratio"] >= threshold:
        return named, "composite"
    return None, "none"


def uniqueness(df: DataFrame, columns: list[str]) -> DataFrame:
    groups = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return groups.agg((F.count("*") / F.sum("n")).alias("ratio"))


# --- validation ---------------------------------------------------------------------------


def duplicate_ids(df: DataFrame, columns: list[str]) -> DataFrame:
    groups = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_ids"))


def json_like(name: str) -> bool:
    return "json" in name.lower() or name.lower().endswith(("_obj", "_data", "_meta"))


def unparsable(cell: Column) -> Column:
    """Text that starts like JSON and does not parse."""
    return F.trim(cell).rlike(r"^[{\[]") & F.try_parse_json(cell).isNull()


def structure_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, filled, unparsable for the columns that should hold JSON."""
    repeated = [c for c in df.columns if df.columns.count(c) > 1]
    if repeated:
        raise ValueError(f"duplicate column names: {sorted(set(repeated))}")
    names = columns if columns is not None else [c for c in df.columns if json_like(c)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, filled long, unparsable long")
    long = cells(df.select(*names))
    return long.groupBy("column").agg(F.count("value").alias("filled"), F.count_if(unparsable(F.col("value"))).alias("unparsable"))


def ingestion_report(df: DataFrame, key: list[str], vector: str | None = None, expected: int | None = None) -> DataFrame:
    """One row: size of the table, duplicate ids, vector defects."""
    from gristmill.operators.vectors import check_vectors

    one = {"__one": F.lit(1)}
    out = df.agg(F.count("*").alias("row_count")).withColumn("column_count", F.lit(len(df.columns)).cast("long")).withColumns(one)
    out = out.join(duplicate_ids(df, key).withColumns(one), "__one")
    if vector:
        missing = df.agg(F.count_if(F.col(vector).isNull()).alias("missing_vectors"))
        out = out.join(missing.withColumns(one), "__one").join(check_vectors(df, vector, expected).withColumns(one), "__one")
    return out.drop("__one")


def value_tag(value: Column) -> Column:
    """Tag of a variant: bool, integer, float, object, array, datetime, keyword."""
    kind = F.schema_of_variant(value)
    text = value.cast("string")
    return (
        F.when(kind == "BOOLEAN", "bool").when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer")
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float").when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "STRING", F.when(text.rlike(lx.DATE_TIME), "datetime").otherwise("keyword")).otherwise("unknown")
    )


def payload_fields(payloads: DataFrame, variant: str) -> DataFrame:
    """One row per top-level field of every payload: key, tag, text length."""
    exploded = payloads.select(F.col(variant).alias("__v")).lateralJoin(
        payloads.sparkSession.tvf.variant_explode(F.col("__v").outer()))
    value = F.col("value")
    tag = value_tag(value)
    return exploded.filter(~F.is_variant_null(value)).select(
        "key", tag.alias("tag"), F.when(tag.isin("keyword", "datetime"), F.length(value.cast("string"))).alias("chars"))


def indexable_fields(payloads: DataFrame, variant: str, longest: int = 256) -> DataFrame:
    """key, type of payload fields worth filtering by: one scalar type, not
    long text, not a vector."""
    stats = payload_fields(payloads, variant).filter(F.col("tag") != "array").groupBy("key").agg(
        F.count_distinct("tag").alias("kinds"), F.min("tag").alias("type"), F.avg("chars").alias("mean"))
    low = F.lower("key")
    texty = F.lit(False)
    for hint in lx.TEXT_NAME_HINTS:
        texty = texty | low.contains(hint)
    vectorish = low.rlike("(^|_)(embedding|vector)$")
    wordy = (F.col("type") == "keyword") & (F.col("mean") > longest)
    return stats.filter((F.col("kinds") == 1) & ~texty & ~vectorish & ~wordy
                        & F.col("type").isin("keyword", "integer", "float", "bool", "datetime")).select("key", "type")


def missing_share(df: DataFrame) -> DataFrame:
    """Missing cells (null or a missing-value token) per column."""
    return cells(df).groupBy("column").agg(F.count_if(is_missing(F.col("value"))).alias("missing"))

"""Cleaning and shaping of raw tables."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import lexicon as lx
from gristmill.functions.hashing import is_missing
from gristmill.operators.ordered import most_frequent, percentiles

#: Fixed value: payload columns in order of preference.
PAYLOAD_COLUMNS = (
    "record_id", "chunk_id", "chunk_index", "embedding_index", "chunk_text", "clean_chunk_text", "source_columns",
    "source_column", "source_type", "document_type", "topic", "topics", "aspect", "aspects", "keywords", "sentiment",
    "sentiment_label", "rating", "timestamp", "date", "brand", "main_category", "product_id",
)
#: Fixed value: payload fields that keep their text exactly.
KEEP_TEXT = ("record_id", "chunk_id", "document_id", "text_hash", "id", "uuid", "guid")


def unique_names(names: Iterable[str | None]) -> list[str]:
    """Filled, distinct column names; repeats get a number."""
    taken: set[str] = set()
    out = []
    for place, raw in enumerate(names):
        base = str(raw).strip() if raw is not None and str(raw).strip() else f"column_{place}"
        name, n = base, 0
        while name in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name)
        out.append(name)
    return out


def standard_names(df: DataFrame) -> DataFrame:
    """Trimmed lower-case names of word characters."""
    plain = [re.sub(r"[^\w]", "", c.strip().lower().replace(" ", "_")) for c in df.columns]
    return df.toDF(*unique_names(plain))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if filled[c] == 0])


def trim_text(df: DataFrame) -> DataFrame:
    """Strips text; the literal nan is missing."""
    return df.withColumns({c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("nan")) for c in text_columns(df)})


def imputation(df: DataFrame) -> dict[str, object]:
    """Per column with gaps: the median of a number, else the most frequent
    value (smallest on ties), else "unknown"."""
    gaps = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]).first()
    values: dict[str, object] = {}
    for f in df.schema.fields:
        if not gaps[f.name]:
            continue
        if isinstance(f.dataType, T.NumericType):
            row = percentiles(df, [], f.name, {"m": 0.5}).first()
        else:
            row = most_frequent(df, [], f.name, "m").first()
        values[f.name] = row["m"] if row and row["m"] is not None else ("unknown" if isinstance(f.dataType, T.StringType) else None)
    return values


def impute(df: DataFrame) -> DataFrame:
    """Fills gaps; an integer column whose median is no integer becomes double."""
    out = df
    for name, value in imputation(df).items():
        if value is None:
            continue
        kind = df.schema[name].dataType
        fill = F.lit(value) if isinstance(kind, T.NumericType) else F.lit(value).cast(kind)
        if isinstance(kind, (T.IntegralType, T.DecimalType)) and float(value).is_integer():
            fill = fill.cast(kind)
        out = out.withColumn(name, F.coalesce(F.col(f"`{name}`"), fill))
    return out


def printable(df: DataFrame) -> DataFrame:
    """Removes characters outside printable ASCII from text."""
    return df.withColumns({c: F.regexp_replace(F.col(f"`{c}`"), r"[^\x20-\x7E]", "") for c in text_columns(df)})


def clean(df: DataFrame, ascii_only: bool = True) -> DataFrame:
    """Names, duplicates, empty rows and columns, trimming, gaps, printables,
    in this order."""
    out = drop_empty_columns(standard_names(df).distinct().na.drop("all"))
    out = impute(trim_text(out))
    return printable(out) if ascii_only else out


def canonical_names(df: DataFrame, names: dict[str, list[str]] | None = None) -> DataFrame:
    """Renames known aliases; of several columns for one name the first wins."""
    table = {a.lower(): canonical for canonical, aliases in (names or lx.CANONICAL_NAMES).items() for a in aliases}
    renames: dict[str, str] = {}
    kept = {c for c in df.columns if c.lower() not in table}
    for c in df.columns:
        target = table.get(c.lower())
        if target and target not in kept and target not in renames.values():
            renames[c] = target
    return df.withColumnsRenamed(renames)


def split(df: DataFrame, buckets: dict[str, str], key: str = "record_id") -> dict[str, DataFrame]:
    """Three vertical parts, each with the record key."""
    return {
        part: df.select(key, *[c for c in df.columns if c != key and buckets.get(c) == part])
        for part in ("structured", "metadata", "unstructured")
    }


# --- payloads -----------------------------------------------------------------------


def native(cell: Column) -> Column:
    """Text to the value it spells: boolean, JSON, integer, float or the text."""
    text = F.trim(cell)
    plain = F.lower(text).isin("true", "false")
    bracketed = text.rlike(r"(?s)^(\{.*\}|\[.*\])$")
    number = text.rlike(r"^[+-]?\d+$") & text.try_cast("long").isNotNull()
    real = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")

    def scalar(value: Column) -> Column:
        return F.variant_get(F.try_parse_json(F.to_json(F.struct(value.alias("v")))), "$.v", "variant")

    return (
        F.when(plain, F.try_parse_json(F.lower(text)))
        .when(bracketed & F.try_parse_json(text).isNotNull(), F.try_parse_json(text))
        .when(number, F.try_parse_json(text.try_cast("long").cast("string")))
        .when(real, scalar(text.try_cast("double"))).otherwise(scalar(cell))
    )


def payload(df: DataFrame, keep_text: Iterable[str] = ()) -> Column:
    """JSON object of the filled columns; id fields keep their exact text."""
    exact = {*KEEP_TEXT, *keep_text}
    fields = []
    for name in df.columns:
        col = F.col(f"`{name}`")
        simple = not isinstance(df.schema[name].dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType))
        value = col.cast("string") if name in exact else col
        fields.append((F.when(~is_missing(col), value) if simple else value).alias(name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})


def preferred_payload(df: DataFrame) -> DataFrame:
    return df.select([c for c in PAYLOAD_COLUMNS if c in df.columns])


def flatten(df: DataFrame, longest: int = 0) -> DataFrame:
    """Nested structs as dotted columns. With ``longest`` the first elements of
    arrays of structs also become ``name.0.field``; the array itself stays."""

    def leaves(prefix: str, access: Column, kind: T.DataType) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [leaf for f in kind.fields for leaf in leaves(f"{prefix}.{f.name}", access.getField(f.name), f.dataType)]
        out = [access.alias(prefix)]
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            for i in range(longest):
                element = F.get(access, F.lit(i))
                out += [leaf for f in kind.elementType.fields
                        for leaf in leaves(f"{prefix}.{i}.{f.name}", element.getField(f.name), f.dataType)]
        return out

    return df.select(*[leaf for f in df.schema.fields for leaf in leaves(f.name, F.col(f"`{f.name}`"), f.dataType)])


def flatten_rows(df: DataFrame, key: str, variant: str) -> DataFrame:
    """Any nesting depth, as rows: key, dotted path, value of every leaf.

    One step per level; stops when no object is left.
    """
    spark = df.sparkSession
    todo = df.select(F.col(key), F.lit("").alias("path"), F.col(variant).alias("value"))
    done: DataFrame | None = None
    while True:
        kind = F.schema_of_variant("value")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY<OBJECT")
        ready = todo.filter(~nested | kind.startswith("ARRAY<OBJECT"))
        done = ready if done is None else done.unionByName(ready)
        deeper = todo.filter(nested)
        if deeper.limit(1).count() == 0:
            return done.filter(F.col("path") != "")
        stepped = deeper.withColumnsRenamed({"path": "__path", "value": "__value"}).lateralJoin(
            spark.tvf.variant_explode(F.col("__value").outer()))
        name = F.coalesce(F.col("key"), F.col("pos").cast("string"))
        joined = F.when(F.col("__path") == "", name).otherwise(F.concat_ws(".", "__path", name))
        todo = stepped.select(F.col(key) if key != "key" else F.col(key), joined.alias("path"), "value")


def sanitize(df: DataFrame) -> DataFrame:
    """Bytes to UTF-8 text or base64, dates to ISO text."""
    changed = {}
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            changed[f.name] = F.coalesce(F.try_validate_utf8(col.cast("string")), F.base64(col))
        elif isinstance(f.dataType, T.DateType):
            changed[f.name] = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            changed[f.name] = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
    return df.withColumns(changed) if changed else df

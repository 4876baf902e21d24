"""Vectors: preparing and encoding texts, quantization, metrics, checks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import text as tx
from gristmill.operators.ordered import dense_index
from gristmill.session import cut_lineage

#: Makes an encoder inside a worker: texts -> matrix with one row per text.
EncoderFactory = Callable[[], Callable[[list[str]], np.ndarray]]


def prepare(df: DataFrame, key: str = "chunk_id", text: str = "chunk_text") -> DataFrame:
    """Clean, non-empty texts with their hash."""
    if text not in df.columns:
        raise ValueError(f"column {text} not found")
    cleaned = df.withColumn(text, tx.squeeze(F.col(text))).filter(F.length(text) > 0)
    return cleaned.withColumn("text_hash", F.sha2(F.col(text), 256))


def unique_texts(prepared: DataFrame, key: str = "chunk_id", text: str = "chunk_text",
                 number: bool = True) -> DataFrame:
    """One row per distinct text, the first by key, with a dense index.

    Only keys are aggregated; a text with very many copies costs one row per
    task, and the text itself is read back by its first key.
    """
    first = prepared.groupBy("text_hash").agg(F.min(key).alias(key))
    if number:
        # Hashes and keys only; cut so that numbering does not clean the texts again.
        first = dense_index(cut_lineage(first), [key], "embedding_index")
    return prepared.select(key, text).join(first, key)


def attach(prepared: DataFrame, unique: DataFrame, column: str) -> DataFrame:
    """Many-to-one join on the hash; fails if a text has no match."""
    joined = prepared.join(unique.select("text_hash", column), "text_hash", "left")
    complete = F.when(F.col(column).isNull(), F.raise_error(F.lit(f"text without {column}"))).otherwise(F.col(column))
    return joined.withColumn(column, complete)


def hashing_encoder(size: int = 64) -> EncoderFactory:
    """Signed hashing of tokens, the default encoder; needs no model."""

    def factory():
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), size), dtype=np.float32)
            for row, text in enumerate(texts):
                for token in text.lower().split():
                    code = zlib.crc32(token.encode())
                    out[row, code % size] += 1.0 if code & 0x80000000 else -1.0
            return out

        return encode

    return factory


def encode(df: DataFrame, text: str, factory: EncoderFactory | None = None, batch: int = 2048) -> DataFrame:
    """Adds unit ``vector``; the encoder is made once per worker task."""
    factory = factory or hashing_encoder()

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = factory()
        for part in parts:
            texts = part.tolist()
            rows: list[np.ndarray] = []
            for start in range(0, len(texts), batch):
                raw = np.asarray(run(texts[start:start + batch]), dtype=np.float32)
                size = np.linalg.norm(raw, axis=1, keepdims=True)
                rows.extend(raw / np.where(size == 0, 1.0, size))
            yield pd.Series(rows, dtype=object)

    return df.withColumn("vector", vectors(text))


def embed(df: DataFrame, key: str = "chunk_id", text: str = "chunk_text",
          factory: EncoderFactory | None = None) -> DataFrame:
    """Every row with its vector; each distinct text is encoded once."""
    prepared = prepare(df, key, text)
    coded = encode(unique_texts(prepared, key, text, number=False), text, factory)
    return attach(prepared, coded, "vector")


def summary(embedded: DataFrame) -> DataFrame:
    return embedded.agg(F.count("*").alias("rows"), F.count_distinct("text_hash").alias("unique_texts"),
                        F.max(F.size("vector")).alias("dimension"))


# --- metrics ---------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    floor = F.lit(1e-12)
    return dot(a, b) / (F.when(norm(a) == 0, floor).otherwise(norm(a)) * F.when(norm(b) == 0, floor).otherwise(norm(b)))


def euclid(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def manhattan(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x)


def normalise_score(raw: Column, metric: str) -> Column:
    """Score to 0..1: rescaled, squashed or inverse distance by metric."""
    name = (metric or "cosine").strip().lower()
    if name in ("cosine", "cos"):
        out = clamp((raw + 1.0) / 2.0)
    elif name in ("dot", "dotproduct", "dot_product", "inner", "ip", "inner_product"):
        out = 1.0 / (1.0 + F.exp(-raw))
    elif name in ("euclidean", "l2", "euclid", "manhattan", "l1"):
        out = 1.0 / (1.0 + F.greatest(-raw, F.lit(0.0)))
    else:
        out = clamp(raw)
    return F.coalesce(out, F.lit(0.0))


def clamp(value: Column) -> Column:
    safe = F.when(value.isNull() | F.isnan(value.cast("double")), F.lit(0.0)).otherwise(value)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), safe))


# --- whole-matrix statistics, combined on the map side -----------------------------


def as_matrix(column: pa.Array) -> np.ndarray:
    """Equal-length, non-null list column as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def scales(df: DataFrame, vector: str) -> DataFrame:
    """One row ``scales``: largest magnitude per dimension, 1 for dead ones."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = None
        for batch in batches:
            if batch.num_rows:
                here = np.abs(as_matrix(batch.column(0))).max(axis=0)
                top = here if top is None else np.maximum(top, here)
        if top is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(top), dtype=np.int32)), pa.array(top)], names=["pos", "top"])

    parts = df.filter(F.col(vector).isNotNull()).select(vector).mapInArrow(partial, "pos int, top double")
    tops = parts.groupBy("pos").agg(F.max("top").alias("top"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "top"))),
                         lambda x: F.when(x["top"] == 0, 1.0).otherwise(x["top"]).cast("float"))
    return tops.agg(listed.alias("scales"))


def quantize(df: DataFrame, vector: str, scale_row: DataFrame, name: str = "quantized") -> DataFrame:
    """Symmetric int8 per dimension: round(x / scale * 127), ties to even."""
    return (
        df.withColumn("__scales", scale_row.scalar())
        .withColumn(name, F.zip_with(vector, "__scales", lambda x, m: F.bround(x.cast("double") / m.cast("double") * 127.0)
                                     .cast("tinyint")))
        .drop("__scales")
    )


def dequantize(df: DataFrame, quantized: str, scale_row: DataFrame, name: str = "restored") -> DataFrame:
    return (
        df.withColumn("__scales", scale_row.scalar())
        .withColumn(name, F.zip_with(quantized, "__scales", lambda x, m: (x / 127.0 * m.cast("double")).cast("float")))
        .drop("__scales")
    )


def reconstruction_error(df: DataFrame, vector: str, restored: str) -> DataFrame:
    """Mean absolute error, mean cosine and its distance from one."""
    small = F.lit(1e-9)
    similar = dot(F.col(vector), F.col(restored)) / ((norm(F.col(vector)) + small) * (norm(F.col(restored)) + small))
    gaps = manhattan(F.col(vector), F.col(restored))
    out = df.agg((F.sum(gaps) / F.sum(F.size(vector))).alias("mae"), F.avg(similar).alias("cos"))
    return out.select(F.round("mae", 6).alias("mae"), F.round("cos", 6).alias("mean_cosine_similarity"),
                      F.round(1 - F.col("cos"), 6).alias("cosine_delta"))


def mean_vectors(df: DataFrame, group: str, vector: str, places: int = 9) -> DataFrame:
    """``group, vector``: mean vector per group, summed by numpy in each task."""
    kind = df.schema[group].dataType.simpleString()

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for frame in frames:
            for label, rows in frame.groupby(group, dropna=False)[vector]:
                block = np.stack(rows.to_numpy()).astype(np.float64)
                total, count = sums.get(label, (0.0, 0))
                sums[label] = (total + block.sum(axis=0), count + len(block))
        if sums:
            yield pd.DataFrame({group: list(sums), "total": [s for s, _ in sums.values()], "n": [c for _, c in sums.values()]})

    parts = df.select(group, vector).mapInPandas(partial, f"{group} {kind}, total array<double>, n long")
    cells = parts.select(group, "n", F.posexplode("total").alias("pos", "x")).groupBy(group, "pos").agg(
        F.round(F.sum("x") / F.sum("n"), places).alias("x"))
    return cells.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("vector"))


def check_vectors(df: DataFrame, vector: str, expected: int | None = None) -> DataFrame:
    """One row: wrong size, NaN, infinite, zero and duplicated vectors of the whole table."""
    v = F.col(vector)
    wide = F.lit(expected) if expected is not None else df.agg(F.mode(F.size(v), deterministic=True)).scalar()
    bad = df.agg(
        F.count(v).alias("vectors"), F.count_if(F.size(v) != wide).alias("wrong_size"),
        F.count_if(F.exists(v, F.isnan)).alias("nan_vectors"),
        F.count_if(F.exists(v, lambda x: F.abs(x) == float("inf"))).alias("inf_vectors"),
        F.count_if(F.forall(v, lambda x: x == 0)).alias("zero_vectors"))
    repeated = df.filter(v.isNotNull()).groupBy(vector).agg(F.count("*").alias("n")).filter("n > 1").agg(
        F.count("*").alias("duplicated_vectors"))
    one = {"__one": F.lit(1)}
    return bad.withColumns(one).join(repeated.withColumns(one), "__one").drop("__one")


def vector_columns(df: DataFrame, probe: int = 25) -> list[str]:
    """Columns named like a vector whose first filled cells hold numbers."""
    found = []
    for field in df.schema.fields:
        name = field.name.lower()
        if name not in ("embedding", "vector") and not name.endswith(("_embedding", "_vector")):
            continue
        if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.NumericType):
            found.append(field.name)
        elif isinstance(field.dataType, T.StringType):
            head = df.filter(F.col(field.name).isNotNull()).limit(probe)
            if head.filter(parse_vector(F.col(field.name)).isNotNull()).limit(1).count():
                found.append(field.name)
    return found


def parse_vector(cell: Column) -> Column:
    """Bracketed text to array<double>; null if it is not one."""
    parsed = F.from_json(cell, "array<double>")
    return F.when(F.trim(cell).startswith("[") & ~F.exists(parsed, lambda x: x.isNull()), parsed)


def vector_name(column: str) -> str:
    low = column.lower()
    for suffix in ("_embedding", "_vector"):
        if low.endswith(suffix):
            return low.removesuffix(suffix)
    return "default" if low in ("embedding", "vector") else low


def index_column(df: DataFrame) -> str | None:
    return next((c for c in ("embedding_index", "vector_index", "emb_idx") if c in df.columns), None)

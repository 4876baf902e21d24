"""Sinks: splits, vectors with a manifest, quantized vectors, points."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import hashing as hs
from gristmill.operators import dedup
from gristmill.operators.cleaning import payload
from gristmill.session import cut_lineage

STATUSES = ("uploaded", "duplicate", "skipped", "invalid")


def write_splits(parts: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    for name, df in parts.items():
        writer = df.write.mode("overwrite")
        (writer.option("header", True) if form == "csv" else writer).format(form).save(f"{folder}/{name}")


def write_vectors(rows: DataFrame, unique: DataFrame, folder: str, model: str) -> None:
    """Metadata without vectors, one vector per text, and a manifest row."""
    rows.write.mode("overwrite").parquet(f"{folder}/metadata")
    unique.select("text_hash", "vector").write.mode("overwrite").parquet(f"{folder}/vectors")
    spark = rows.sparkSession
    stored = spark.read.parquet(f"{folder}/vectors")
    one = F.lit(1).alias("__one")
    shape = stored.agg(F.count("*").alias("unique_texts"), F.max(F.size("vector")).alias("dimension"), one)
    total = spark.read.parquet(f"{folder}/metadata").agg(F.count("*").alias("rows"), one)
    manifest = total.join(shape, "__one").select(F.lit(model).alias("model"), "rows", "unique_texts", "dimension", F.lit("float32").alias("dtype"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def write_quantized(quantized: DataFrame, scale_row: DataFrame, folder: str) -> None:
    quantized.write.mode("overwrite").parquet(f"{folder}/quantized")
    scale_row.write.mode("overwrite").parquet(f"{folder}/scales")


def read_quantized(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/quantized"), spark.read.parquet(f"{folder}/scales")


def check_manifest(manifest: DataFrame, vectors: DataFrame, model: str | None = None) -> None:
    """Fails if vectors of another size or model would be mixed."""
    row = manifest.first()
    size = vectors.agg(F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi")).first()
    if size["lo"] is not None and {size["lo"], size["hi"]} != {row["dimension"]}:
        raise ValueError(f"vectors have {size['lo']} to {size['hi']} dimensions, the collection {row['dimension']}")
    if model is not None and model != row["model"]:
        raise ValueError(f"vectors come from {model}, the collection from {row['model']}")


def valid_vector(vector: Column, size: int) -> Column:
    """Right size, finite and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def points(df: DataFrame, order: str, vector: str, size: int, key: list[str] | None = None,
           strategy: str = "primary_key_or_hash") -> DataFrame:
    """Every input row with ``point_id, text_hash, payload`` and one status:
    skipped (no vector), invalid vector, duplicate or uploaded."""
    hashed = df if "text_hash" in df.columns else df.withColumn("text_hash", hs.content_hash(df.drop(vector)))
    rows = hashed.select("*", hs.point_id(hashed, key).alias("point_id"), payload(hashed.drop(vector, "text_hash")).alias("payload"))
    state = F.when(F.col(vector).isNull(), "skipped").when(~valid_vector(F.col(vector), size), "invalid")
    rows = rows.withColumn("status", state)
    fresh = rows.filter(F.col("status").isNull())
    kept = dedup.keep_first(fresh, strategy, order).select(order, F.lit("uploaded").alias("__kept"))
    return (rows.join(kept, order, "left")
            .withColumn("status", F.coalesce("status", "__kept", F.lit("duplicate"))).drop("__kept"))


def accounting(tagged: DataFrame) -> DataFrame:
    """Rows per status in one row; fails unless they add up to the total."""
    counts = tagged.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    added = sum((F.col(s) for s in STATUSES), F.lit(0))
    checked = F.when(added != F.col("total"), F.raise_error(F.lit("rows are unaccounted for"))).otherwise(F.col("total"))
    return counts.withColumn("total", checked)


def write_points(tagged: DataFrame, folder: str, order: str, buckets: int = 64) -> None:
    """Uploaded points keyed by their id, the rest as rejects keyed by ``order``.

    Both are stored in hash buckets of the key; a bucket that gets rows is
    rewritten with its other stored rows, so a rerun replaces and never repeats.
    """
    _replace_by_key(tagged.filter(F.col("status") == "uploaded"), f"{folder}/points", "point_id", buckets)
    rejects = tagged.filter(F.col("status") != "uploaded").select(order, "point_id", "text_hash", "status")
    _replace_by_key(rejects, f"{folder}/rejects", order, buckets)


def _replace_by_key(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    spark = rows.sparkSession
    fresh = cut_lineage(rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
    out = fresh
    try:
        stored = spark.read.schema(fresh.schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        touched = fresh.select("bucket").distinct()
        rest = stored.join(touched, "bucket", "left_semi").join(fresh.select(key), key, "left_anti")
        out = cut_lineage(fresh.unionByName(rest))  # read before its buckets are written
    out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


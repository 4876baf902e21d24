"""Reading files and folders into DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, infer: bool = True, **options: str) -> DataFrame:
    """CSV with a header. ``infer=False`` keeps every column as text."""
    reader = spark.read.option("header", True).option("inferSchema", infer)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.csv(path)


def read_table_file(spark: SparkSession, path: str) -> DataFrame:
    """CSV or parquet, by the ending of the path."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending == "csv":
        return read_csv(spark, path)
    if ending == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file type: {path}")


def read_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata rows with their vector; the two tables meet on ``text_hash``."""
    rows = spark.read.parquet(f"{folder}/metadata")
    vectors = spark.read.parquet(f"{folder}/vectors").select("text_hash", "vector")
    return rows.join(vectors, "text_hash", "left")


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Splits a scan with fewer tasks than cores by ``key``.

    For work that is heavy per row. Only a plain scan may be passed, its task
    count is then known without running it; a large scan is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    tasks = scan._jdf.queryExecution().toRdd().getNumPartitions()
    return scan if tasks >= cores else scan.repartition(cores, F.col(key))

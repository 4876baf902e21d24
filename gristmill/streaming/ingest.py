"""Incremental ingest of files, with restart and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.operators import dedup
from gristmill.operators.relations import not_stored


def stream_files(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*", form: str = "parquet",
                 files_per_batch: int = 100) -> DataFrame:
    """Stream of the files in a folder whose name matches, new ones included."""
    reader = (spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files_per_batch)
              .option("pathGlobFilter", pattern))
    if form == "csv":
        reader = reader.option("header", True)
    return reader.load(folder)


def stream_table(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Stream of a parquet table that is one file or a folder of files."""
    folder, name = path.rstrip("/").rsplit("/", 1)
    reader = spark.readStream.format("parquet").schema(schema).option("maxFilesPerTrigger", files_per_batch)
    # As a glob the path may be either; a plain one must be a folder.
    return reader.load(f"{folder}/{{{name}}}")


def run_to_end(df: DataFrame, target: str, checkpoint: str) -> None:
    """Writes everything there is as parquet and stops; a later run with the
    same checkpoint continues where this one ended."""
    stream = (df.writeStream.format("parquet").outputMode("append").option("path", target)
              .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    stream.awaitTermination()


def deduplicate(df: DataFrame, target: str, rejects: str, checkpoint: str, order: str, keys: list[str],
                valid: Column) -> None:
    """Appends rows whose keys are new, invalid ones to ``rejects``.

    Each batch is compared with all that is stored, then with itself. A batch
    repeated after a failure finds its own rows stored and adds none.
    """
    spark = df.sparkSession
    spark.createDataFrame([], df.schema).write.mode("ignore").parquet(target)

    def store(batch: DataFrame, number: int) -> None:
        batch.filter(~valid).withColumn("batch", F.lit(number)).write.mode("append").parquet(rejects)
        stored = batch.sparkSession.read.schema(df.schema).parquet(target)
        fresh = not_stored(batch.filter(valid), stored, keys)
        if len(keys) == 1:
            kept = dedup.first_per_key(fresh, keys[0], order)
        else:
            kept = fresh.join(dedup.independent_rows(fresh.select(order, *keys), keys, order), order, "left_semi")
        kept.write.mode("append").parquet(target)

    stream = (df.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
              .trigger(availableNow=True).start())
    stream.awaitTermination()


def drop_recent_duplicates(df: DataFrame, ts: str, keys: list[str], delay: str) -> DataFrame:
    """Bounded-state variant: repeats are only found within the delay."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)

"""Tables of the catalog: load, append, upsert, look up."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.operators import inference
from gristmill.operators.cleaning import unique_names
from gristmill.sources import readers

#: Names of the three analytical tables.
STRUCTURED, METADATA, INTELLIGENCE = "structured_data", "metadata_data", "precomputed_intelligence"

_MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def append_order(df: DataFrame, table_columns: list[str]) -> DataFrame:
    """The frame in the table's column order; both must have the same columns."""
    if set(df.columns) != set(table_columns):
        missing, extra = set(table_columns) - set(df.columns), set(df.columns) - set(table_columns)
        raise ValueError(f"columns do not match: missing {sorted(missing)}, extra {sorted(extra)}")
    return df.select(*table_columns)


def load_frame(df: DataFrame, table: str, mode: str = "replace", infer: bool = True, **options: Any) -> list[inference.Guess]:
    """Writes a typed table (replace, append or fail) and returns the guesses."""
    if mode not in _MODES:
        raise ValueError(f"mode must be one of {sorted(_MODES)}")
    spark = df.sparkSession
    named = df.toDF(*unique_names(df.columns))
    guesses = inference.infer(named, **options) if infer else []
    out = inference.typed(named, guesses) if infer else named
    if mode == "append" and spark.catalog.tableExists(table):
        stored = spark.table(table)
        out = append_order(out, stored.columns)
        out = out.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) if f.dataType.simpleString() != "variant"
                           else F.col(f.name) for f in stored.schema.fields])
    out.write.mode(_MODES[mode]).saveAsTable(table)
    return guesses


def load_csv(spark: SparkSession, path: str, table: str, mode: str = "replace", **options: Any) -> list[inference.Guess]:
    """CSV read as text, typed by inference, written as a table."""
    return load_frame(readers.read_csv(spark, path, infer=False), table, mode, **options)


def load_structured(df: DataFrame, **options: Any) -> list[inference.Guess]:
    return load_frame(df, STRUCTURED, **options)


def load_metadata(df: DataFrame, **options: Any) -> list[inference.Guess]:
    return load_frame(df, METADATA, **options)


def load_intelligence(df: DataFrame, **options: Any) -> list[inference.Guess]:
    return load_frame(df, INTELLIGENCE, **options)


def upsert(stored: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """Newest row per key; changes win over stored rows of the same version.

    Filtering ``row_number`` to one lets Spark keep one row per key and task
    before the shuffle.
    """
    both = stored.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    newest = Window.partitionBy(*key).orderBy(F.desc(version), F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") == 1).drop("__n", "__new")


def seed_frame(name: str, df: DataFrame) -> None:
    df.createOrReplaceTempView(name)


def seed_csv(spark: SparkSession, name: str, path: str, **options: str) -> None:
    readers.read_csv(spark, path, **options).createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str, params: dict[str, Any] | list[Any] | None = None, **views: DataFrame) -> DataFrame:
    """SQL with named or positional parameters; ``{name}`` refers to a given frame."""
    return spark.sql(text, args=params, **views)


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)


def describe(spark: SparkSession) -> DataFrame:
    """Catalog: one row per column of each table and view."""
    rows = [(t.name, c.name, c.dataType, c.nullable) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, dtype string, nullable boolean")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


def reconcile(expected: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys on both sides and whether the stage can be skipped."""
    want = expected.select(*key).distinct().agg(F.count("*").alias("expected")).withColumn("__one", F.lit(1))
    have = stored.select(*key).distinct().agg(F.count("*").alias("stored")).withColumn("__one", F.lit(1))
    return want.join(have, "__one").drop("__one").withColumn("complete", F.col("stored") >= F.col("expected"))

"""Intermediate tables in the shared folder, and helpers for Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.session import bound_batches  # noqa: F401 - part of this module's helpers


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, seen by all executors.

    Where it is unset on a local master (tests), a temporary folder is set;
    elsewhere the missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write the frame once to the shared folder and read it from there.

    Cuts the lineage without a localCheckpoint: a lost executor loses nothing.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: list[str]) -> Callable[[str], str]:
    """Names of columns that clash with none of these, however Spark compares them."""
    taken = {c.lower() for c in columns}

    def name(wish: str) -> str:
        while f"_{wish}".lower() in taken:
            wish = f"_{wish}"
        return f"_{wish}"

    return name


def byte_count(docs: DataFrame, column: str) -> int:
    """Bytes of a text or binary column, by which work is split."""
    return docs.agg(F.sum(F.octet_length(column))).head()[0] or 0


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary array and its n + 1 offsets.

    Null counts as empty. The bytes are not copied unless the array has nulls.
    """
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = array.buffers()
    if len(array) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, len(array) + 1, array.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection), in numpy's wrapping arithmetic."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))

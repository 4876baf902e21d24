"""Session settings and the checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every job should run with. None of them fixes a partition count:
#: that belongs to the cluster, and AQE coalesces or splits from there.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "gristmill", master: str | None = None, **extra: str) -> SparkSession:
    """A session with SETTINGS; ``extra`` uses ``__`` for dots in names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder the cluster names.

    The folder comes from ``spark.checkpoint.dir``. Only where neither that
    setting nor a folder set by the caller exists (tests on one machine) is a
    temporary one used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, for data that a later job reads."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Have Arrow batches closed at ``size`` bytes at the latest.

    Batches are counted in rows by default, and ten thousand long texts do not
    fit in a task. A smaller bound that the session has already is kept.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(re.sub(r"\D", "", spark.conf.get(key)) or 0) <= size:
        spark.conf.set(key, str(size))

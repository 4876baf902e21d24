"""Streams give the batch result and add nothing when restarted."""

import tempfile

import pytest
from pyspark.sql import functions as F

from gristmill.plans import catalog
from gristmill.plans.registry import REGISTRY
from gristmill.streaming import ingest, memory

catalog.load()

SCHEMA = "id long, point_id string, text_hash string"


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="stream-")


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder):
    source = ingest.stream_files(spark, f"{folder}/in", spark.createDataFrame([], SCHEMA).schema, "*.parquet")
    ingest.deduplicate(source, f"{folder}/out", f"{folder}/bad", f"{folder}/state", "id", ["point_id", "text_hash"], F.col("point_id").isNotNull())
    return {r["id"] for r in spark.read.parquet(f"{folder}/out").collect()}


def test_dedup_across_batches_and_restarts(spark, folder):
    write(spark, folder, [(1, "a", "h1"), (2, "b", "h1"), (3, "b", "h3"), (4, None, "h4")])
    assert run(spark, folder) == {1, 3}
    assert run(spark, folder) == {1, 3}
    write(spark, folder, [(5, "a", "h9"), (6, "z", "h3"), (7, "new", "h7")])
    assert run(spark, folder) == {1, 3, 7}
    # A lost checkpoint replays all files; what is stored stays once.
    source = ingest.stream_files(spark, f"{folder}/in", spark.createDataFrame([], SCHEMA).schema, "*.parquet")
    ingest.deduplicate(source, f"{folder}/out", f"{folder}/bad", f"{folder}/state2", "id", ["point_id", "text_hash"], F.col("point_id").isNotNull())
    assert sorted(r["id"] for r in spark.read.parquet(f"{folder}/out").collect()) == [1, 3, 7]
    assert spark.read.parquet(f"{folder}/bad").filter("id = 4").count() >= 1


def test_memory_keeps_the_newest_over_several_batches(spark, folder):
    schema = "conv_id long, turn long, role string, text string"
    for start in (0, 4):
        spark.createDataFrame([(1, t, "user", "x" * 40) for t in range(start, start + 4)], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = ingest.stream_files(spark, f"{folder}/in", spark.createDataFrame([], schema).schema, "*.parquet", files_per_batch=1)
    ingest.run_to_end(memory.bounded_memory(source, 5, 30), f"{folder}/out", f"{folder}/state")
    rows = spark.read.parquet(f"{folder}/out").orderBy("version").collect()
    assert len(rows) == 2 and rows[-1]["messages"] == 3 and rows[-1]["tokens"] == 30


def test_streams_of_tables_that_are_a_file_or_a_folder(spark, folder):
    names = ("documents", "conversations", "events")
    for name in names:
        table = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        table.repartition(3).write.parquet(f"{folder}/{name}.parquet")
    for name in ("stream_deduplicate", "stream_memory", "stream_ingest"):
        query = REGISTRY[name]
        rows = [sorted(map(tuple, query(spark, f).collect())) for f in ("/root/testdata/sf0.001", folder)]
        assert rows[0] == rows[1] and rows[0]


def test_memory_of_messages_without_text(spark, folder):
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame([(1, 0, "user", None), (1, 1, None, "hello you")], schema).coalesce(1).write.parquet(f"{folder}/in")
    source = ingest.stream_table(spark, f"{folder}/in", spark.createDataFrame([], schema).schema)
    ingest.run_to_end(memory.bounded_memory(source, 5, 30), f"{folder}/out", f"{folder}/state")
    row = spark.read.parquet(f"{folder}/out").first()
    assert (row["messages"], row["tokens"], row["transcript"]) == (2, 3, "User: \n: hello you")


@pytest.mark.parametrize("sizes,messages,tokens,kept", [([5, 5, 5], 2, 100, 2), ([5, 5, 5], 9, 10, 2), ([5, 50], 9, 10, 1), ([], 3, 3, 0)])
def test_trim(sizes, messages, tokens, kept):
    assert len(memory._trim([(i, n, "") for i, n in enumerate(sizes)], messages, tokens)) == kept

"""Target-distribution importance resampling.

Every text is a bag of hashed features. A bucket's gain is the logarithm of its
share in the target over its share in the documents, a document's weight is the
sum of its features' gains, and the documents with the greatest weight plus
Gumbel noise are a sample without replacement in proportion to the weights.
Their exact order comes from parallel sorting by regular sampling: see ``ranked``.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gristmill.llm import store
from gristmill.llm.words import plain_words

#: Words whose hashes a task remembers.
REMEMBERED = 1 << 18
#: Most sorted runs and most segments; the driver sees at most RUNS x RUNS regular samples.
RUNS = 1024
#: Rows that a segment should hold.
SEGMENT = 200_000
GAIN = 1000


class _Hashes(dict):
    """CRC-32 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = crc32(word)
        return value


def feature_buckets(words: list[bytes], grams: int, buckets: int, hashes: dict[bytes, int]) -> np.ndarray:
    """Bucket of every run of 1 to ``grams`` words, repeats included."""
    found = [np.fromiter(map(hashes.__getitem__, words), np.int64, len(words))]
    tails = [b" " + w for w in words] if grams > 1 else []
    for size in range(2, grams + 1):
        longer = map(crc32, tails[size - 1:], found[-1].tolist())
        found.append(np.fromiter(longer, np.int64, max(0, len(words) - size + 1)))
    return np.concatenate(found) % buckets


def bucket_counts(table: DataFrame, grams: int, buckets: int) -> np.ndarray:
    """Features of all texts per bucket. Tasks send one sum per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hashes = np.zeros(buckets, np.int64), _Hashes()
        for batch in batches:
            for text in batch.column("text"):
                np.add.at(total, feature_buckets(plain_words(text.as_py()), grams, buckets, hashes), 1)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in table.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of the smoothed shares, rounded down."""
    width = len(source)
    over, under = float(source.sum() + width), float(target.sum() + width)
    return np.array([math.floor(GAIN * math.log((t + 1.0) * over / ((s + 1.0) * under)))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(seed: str, name: str) -> int:
    """Gumbel noise of a name, in whole thousandths."""
    h = int(hashlib.sha256(f"{seed}:{name}".encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
    return math.floor(-GAIN * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, grams: int, seed: str) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, hashes = shared.value, _Hashes()
        for batch in batches:
            n_words, n_features, weights = [], [], []
            for text in batch.column("text"):
                words = plain_words(text.as_py())
                at = feature_buckets(words, grams, len(gain), hashes)
                n_words.append(len(words))
                n_features.append(len(at))
                weights.append(int(gain[at].sum()))
            names = (n.as_py() or "" for n in batch.column("name"))
            scores = [w + noise(seed, n) for w, n in zip(weights, names)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n_words, n_features, weights, scores))],
                                             names=["doc_id", "n_words", "n_features", "weight", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("doc_id").cast("string").alias("name"), "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def _key(score: int, doc_id: object, at: int) -> tuple:
    return -score, doc_id is None, 0 if doc_id is None else doc_id, at


def ranked(rows: DataFrame, count: int) -> DataFrame:
    """``rows`` (doc_id, score and others) with ``place``: 1 for the greatest score, ties to the smaller doc_id, null last.

    Parallel sorting by regular sampling: partitions are sorted locally, evenly
    spaced rows of every run give evenly spaced splitters, the pieces between
    splitters are exchanged and merged in their segment, and the counts of the
    segments before give exact places. Rows equal in score and id are told
    apart by their place in the runs, so a segment holds at most about two
    shares of all rows, whatever repeats.
    """
    spark = rows.sparkSession
    segments = min(RUNS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // SEGMENT)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    runs = store.stash(rows.coalesce(RUNS).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "sorted-runs")
    run, step = F.shiftright("at", 33), F.ceil(F.col("size") / segments)
    sizes = runs.groupBy(run.alias("run")).agg(F.count(F.lit(1)).alias("size"))
    sampled = runs.withColumn("run", run).join(sizes, "run").where(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) % step == 0)
    samples = sorted((_key(r["score"], r["doc_id"], r["at"]), r["step"])
                     for r in sampled.select("score", "doc_id", "at", step.alias("step")).collect())
    splitters, seen, share = [], 0, max(1, count / segments)
    for key, weight in samples:
        if seen >= share * (len(splitters) + 1):
            splitters.append(key)
        seen += weight

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = map(_key, *(batch.column(c).to_pylist() for c in ("score", "doc_id", "at")))
            yield batch.append_column("segment", pa.array([bisect_right(splitters, k) for k in keys], pa.int32()))

    dealt = runs.mapInArrow(deal, StructType([*runs.schema.fields, StructField("segment", IntegerType())]))
    held = {r["segment"]: r["count"] for r in dealt.groupBy("segment").count().collect()}
    before = F.lit([0, *accumulate(held.get(s, 0) for s in range(len(splitters)))])
    place = F.row_number().over(Window.partitionBy("segment").orderBy(*order, "at"))
    return dealt.withColumn("place", place + F.element_at(before, F.col("segment") + 1)).drop("at", "segment")


def resample(docs: DataFrame, target: DataFrame, grams: int = 1, buckets: int = 10_000, percent: int = 10,
             least_words: int = 20, seed: str = "2024") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and ``rank`` of every row of ``docs`` (doc_id, text).

    Of the rows with ``least_words`` words the best ``percent`` of a hundred
    are drawn and ranked from 1; the others' rank is null. A null or empty text
    has no features and weight 0. The noise depends on ``seed`` and the id
    alone (a null id counts as an empty name), so repeated rows get equal
    scores and places one after the other. Without any target text all gains
    measure the documents alone; an empty table gives no rows. Other columns
    are not read.
    """
    store.bound_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs, grams, buckets), bucket_counts(target, grams, buckets))
    rows = store.stash(scored(docs, gain, grams, seed), "importance-scores")
    open_to, count = F.col("n_words") >= least_words, rows.where(F.col("n_words") >= least_words).count()
    drawn = percent * count // 100
    best = ranked(rows.where(open_to), count).withColumn("rank", F.when(F.col("place") <= drawn, F.col("place").cast("long"))).drop("place")
    return best.unionByName(rows.where(~open_to).withColumn("rank", F.lit(None).cast("long")))

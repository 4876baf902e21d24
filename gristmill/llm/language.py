"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm import store

#: Hash buckets of the n-grams. The matrix of log-probabilities has
#: buckets x languages doubles: 128 KiB a language, whatever the corpus.
BUCKETS = 1 << 14
GRAMS = (1, 2, 3)
SMOOTHING = 0.5
#: More learned labels than this are an error: the matrix would outgrow a broadcast.
MOST_LANGUAGES = 400
UNKNOWN = "und"
_PIECE = 1 << 18


def pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about 256 Ki characters; a longer text is one range."""
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= _PIECE):
            size += len(texts[end]) + 1
            end += 1
        yield start, end
        start = end


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the joined texts, 0 before and after each, and where each begins."""
    joined = "\0" + "\0\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + 2)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    return codes, starts


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (orders x places) of the n-grams that start at each place, and the texts' starts.

    Texts are lower-cased, and a separator stands at both ends of each. ASCII
    digits, punctuation and white space are that separator too.
    """
    codes, starts = _codes([t.lower() for t in texts])
    plain = (codes < 97) | ((codes > 122) & (codes < 170))
    codes = np.where(plain, np.uint64(0), codes)
    out = np.empty((len(GRAMS), len(codes)), np.int32)
    key = np.zeros(len(codes), np.uint64)
    shifted = codes
    for row, n in enumerate(GRAMS):
        key = key * np.uint64(0x110001) + shifted + np.uint64(n)
        out[row] = (store.mix(key) >> np.uint64(50)).astype(np.int32)
        shifted = np.concatenate([shifted[1:], np.zeros(1, np.uint64)])
    out[:, starts[1:] - 1] = out[:, -1:]  # grams at the end of a text do not look into the next
    return out, starts


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one task: a row for each language and bucket that occurs."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = _texts(batch.column("text")), batch.column("lang").to_pylist()
        for lang in set(langs):
            mine = [t for t, x in zip(texts, langs) if x == lang]
            total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for lo, hi in pieces(mine):
                total += np.bincount(hashed(mine[lo:hi])[0].ravel(), minlength=BUCKETS)
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])],
                                         names=["lang", "bucket", "n"])


def fit(train: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log P(bucket | language) with equal priors.

    ``train`` has ``text`` and non-null ``lang``; all its rows are counted.
    """
    counted = train.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = [r[0] for r in train.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.zeros((len(langs), BUCKETS))
    where = {lang: i for i, lang in enumerate(langs)}
    for r in rows.toLocalIterator():
        counts[where[r["lang"]], r["bucket"]] = r["n"]
    counts += SMOOTHING
    return langs, np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, extra: list[Column] | None = None) -> DataFrame:
    """doc_id, ``extra`` columns, ``lang_pred`` and ``score`` (its posterior).

    A text that is null, empty or has no letter is ``und`` with score 0, as is
    every text when nothing was learned. Equal posteriors: first label in order.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(table.T))  # buckets x languages, bounded above
    extra = extra or []
    source = docs.select("doc_id", *extra, F.coalesce(F.col("text"), F.lit("")).alias("_text"),
                         F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    kept = [c for c in source.columns if not c.startswith("_")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        for batch in batches:
            texts = _texts(batch.column("_text"))
            letters = np.asarray(batch.column("_letters").to_pylist(), bool)
            best, sure = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            if langs:
                for lo, hi in pieces(texts):
                    grams, starts = hashed(texts[lo:hi])
                    sums = np.zeros((hi - lo, len(langs)))
                    for column in range(len(langs)):
                        of = matrix[:, column]
                        sums[:, column] = np.add.reduceat(of[grams[0]] + of[grams[1]] + of[grams[2]], starts)
                    best[lo:hi] = sums.argmax(axis=1)
                    sure[lo:hi] = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            known = letters & bool(langs)
            names = [langs[b] if k else UNKNOWN for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(names, pa.string()), pa.array(np.where(known, sure, 0.0))],
                names=[*kept, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in kept)
    return source.mapInArrow(score, f"{kinds}, lang_pred string, score double")


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """Learn on the rows that are not held out and have a label, predict all.

    Only text and label of training rows are learned from; a prediction sees
    the text alone. Rows whose ``held_out`` is null count as not held out.
    """
    held = F.coalesce(held_out, F.lit(False))
    store.bound_batches(docs.sparkSession)
    langs, table = fit(docs.where(~held & F.col("lang").isNotNull()))
    return predict(docs, langs, table, [held.alias("held_out")])

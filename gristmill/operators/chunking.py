"""Documents to chunks: paragraphs, sentences, word windows, greedy packing."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import text as tx
from gristmill.operators.ordered import dense_index, percentiles
from gristmill.session import cut_lineage

# Where paragraphs and sentences end.
PARAGRAPH_END = r"\n{2,}|\r\n{2,}"
SENTENCE_END = r"(?<=[.!?])\s+"


@dataclass(frozen=True)
class ChunkRule:
    """Words per chunk, words carried over, fewest words kept, and most chunks
    of one document (None: all)."""

    size: int = 200
    overlap: int = 30
    least: int = 15
    most: int | None = None


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, PARAGRAPH_END), tx.strip), lambda p: p != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), tx.strip), lambda s: s != "")


def word_windows(text: Column, rule: ChunkRule = ChunkRule()) -> Column:
    """Fixed windows of words, each starting ``size - overlap`` after the last."""
    step = max(1, rule.size - rule.overlap)

    def cut(parts: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)), F.lit(step))
        return F.transform(starts, lambda i: F.array_join(F.slice(parts, i, rule.size), " "))

    return F.filter(tx.let(tx.words(text), cut), lambda w: w != "")


# --- the sequential part, one document at a time --------------------------------


def _windows(unit: str, rule: ChunkRule) -> Iterator[str]:
    parts = unit.split()
    for start in range(0, len(parts), max(1, rule.size - rule.overlap)):
        yield " ".join(parts[start:start + rule.size])


def _spans(counts: list[int], rule: ChunkRule) -> Iterator[tuple[int, int]]:
    """Ranges of units that fill a chunk; a range of one oversized unit stands
    alone. Ranges overlap by the trailing units that fit the overlap."""
    upto = [0, *accumulate(counts)]
    first = 0
    for at, count in enumerate(counts):
        if count > rule.size:
            if first < at:
                yield first, at
            yield at, at + 1
            first = at + 1
        elif upto[at + 1] - upto[first] > rule.size:
            yield first, at
            first = max(first, bisect_left(upto, upto[at] - rule.overlap, 0, at + 1))
    if first < len(counts):
        yield first, len(counts)


def pack(units: list[str], rule: ChunkRule) -> list[str]:
    counts = [len(u.split()) for u in units]
    packed: list[str] = []
    for start, end in _spans(counts, rule):
        if end == start + 1 and counts[start] > rule.size:
            packed.extend(_windows(units[start], rule))
        else:
            packed.append(" ".join(units[start:end]))
    return packed


def _split(pattern: str, text: str) -> list[str]:
    return [p for p in (part.strip() for part in re.split(pattern, text)) if p]


def _by_sentences(text: str, rule: ChunkRule) -> list[str]:
    units = _split(SENTENCE_END, text)
    return pack(units, rule) if len(units) > 1 else list(_windows(text, rule))


def cut_document(text: str | None, rule: ChunkRule) -> list[str]:
    """Chunks of one document, short ones and repeats left out."""
    body = (text or "").strip()
    length = len(body.split())
    if length <= rule.size:
        return [body] if length >= max(rule.least, 1) else []
    blocks = _split(PARAGRAPH_END, body)
    coarse = pack(blocks, rule) if len(blocks) > 1 else [body]
    fine = (piece for block in coarse
            for piece in ([block] if len(block.split()) <= rule.size else _by_sentences(block, rule)))
    kept = dict.fromkeys(c for c in (piece.strip() for piece in fine) if len(c.split()) >= rule.least)
    return list(kept)[:rule.most]


def chunk_udf(rule: ChunkRule = ChunkRule()):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: cut_document(text, rule))

    return chunks


def chunk_table(df: DataFrame, record: str, columns: Iterable[str], rule: ChunkRule = ChunkRule(),
                keep: Iterable[str] = (), number: bool = True) -> DataFrame:
    """One row per chunk of the merged text columns.

    ``chunk_id`` is dense over (record, chunk index). The chunks are written to
    the checkpoint folder first, so numbering them does not cut them again.
    """
    columns = list(columns)
    merged = df.select(F.col(record).alias("record_id"), *keep, tx.merge_columns([F.col(c) for c in columns]).alias("__doc"))
    chunks = (
        merged.select("record_id", *keep, F.posexplode(chunk_udf(rule)("__doc")).alias("chunk_index", "chunk_text"))
        .withColumn("source_columns", F.lit(", ".join(columns)))
        .withColumn("chunk_word_count", tx.word_count(F.col("chunk_text")))
        .withColumn("chunk_char_count", F.length("chunk_text"))
    )
    names = ["record_id", *keep, "source_columns", "chunk_index", "chunk_text", "chunk_word_count", "chunk_char_count"]
    if not number:
        return chunks.select(*names)
    return dense_index(cut_lineage(chunks), ["record_id", "chunk_index"], "chunk_id").select("chunk_id", *names)


def chunk_summary(chunks: DataFrame) -> DataFrame:
    """Words per chunk and chunks per document, one row."""
    words = chunks.agg(
        F.count("*").alias("chunks"), F.avg("chunk_word_count").alias("mean_words"),
        F.min("chunk_word_count").alias("min_words"), F.max("chunk_word_count").alias("max_words"))
    per_doc = chunks.groupBy("record_id").agg(F.count("*").alias("n"))
    shape = per_doc.agg(F.avg("n").alias("mean_chunks"), F.max("n").alias("max_chunks"))
    tail = percentiles(per_doc, [], "n", {"p95_chunks": 0.95})
    one = {"__one": F.lit(1)}
    return (words.withColumns(one).join(shape.withColumns(one), "__one")
            .join(tail.withColumns(one), "__one", "left").drop("__one"))


class ChunkDocument:
    """Table function ``(text) -> (chunk_index, chunk_text)`` for SQL users."""

    def eval(self, text: str):
        yield from enumerate(cut_document(text, ChunkRule()))


def register_chunk_function(spark, name: str = "chunk_document") -> None:
    spark.udtf.register(name, F.udtf(ChunkDocument, returnType="chunk_index int, chunk_text string"))

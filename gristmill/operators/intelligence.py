"""The table of text signals per chunk."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import lexicon as lx
from gristmill.functions import text as tx
from gristmill.session import bound_batches, cut_lineage

#: Most frequent terms, which every task holds.
COMMON_TERMS = 100_000

OPTIONAL = ("entities", "topics", "aspects", "sentiment", "source_type", "document_type")

#: Fixed value: order of the columns of the result.
COLUMNS = (
    "record_id", "chunk_id", "source_columns", "chunk_text", "clean_chunk_text", "char_count", "word_count",
    "sentence_count", "avg_word_length", "token_estimate", "length_bucket", "readability_score",
    "readability_label", "is_blank", "has_numbers", "has_question", "has_exclamation", "has_currency",
    "has_percent", "sentiment_score", "sentiment_label", "sentiment_intensity", "aspects_detected",
    "aspect_count", "topics_keywords", "complaint_score", "complaint_type", "is_complaint", "is_urgent",
    "intent", "severity", "price_signal", "delivery_signal", "quality_signal", "return_refund_signal",
    "support_signal", "review_pattern_signal", "entity_count", "topic_count", "entities", "topics", "aspects",
    "sentiment", "source_type", "document_type",
)


def _term_counts(common: Broadcast, texts: int, top: int) -> Callable[[Column], Column]:
    """term, tf, first and df of the words of a text that can be among its ``top``.

    Words outside ``common`` all stay, without df; of the others those below the best ``top`` go.
    """
    @F.arrow_udf(T.ArrayType(T.StructType().add("term", "string").add("tf", "integer").add("first", "integer").add("df", "long")))
    def counted(words: pa.Array) -> pa.Array:
        known, out = common.value, []
        for text in words:
            listed = text.as_py() or []
            times, first = Counter(listed), {}
            for place, word in enumerate(listed):
                first.setdefault(word, place)
            rows = [(w, n, first[w], known.get(w)) for w, n in times.items()]
            score = [n * math.log((texts + 1) / (df + 1)) if df else math.inf for _, n, _, df in rows]
            ranked = sorted(x for x in score if x < math.inf)
            least = ranked[-top] if len(ranked) > top else -math.inf
            out.append([dict(zip(("term", "tf", "first", "df"), r)) for r, x in zip(rows, score) if x >= least - 1e-6])
        return pa.array(out, pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32()), ("first", pa.int32()), ("df", pa.int64())])))

    return counted


def topic_words(df: DataFrame, key: str, text: str, top: int = 5) -> DataFrame:
    """``key, topics_keywords``: best words of each text by TF-IDF.

    N counts all texts, empty ones too; ties keep the earlier word. The most
    frequent words travel to the texts, where the best of them are found; only
    these and the rarer words of a text, which the rest of the vocabulary
    joins, leave it.
    """
    stop = sorted(set(lx.TOPIC_STOPWORDS))
    letters = F.regexp_replace(F.lower(tx.clean(F.col(text))), r"[^a-z\s]", " ")
    kept = F.filter(tx.words(letters), lambda w: (F.length(w) > 3) & ~w.isin(stop))
    bound_batches(df.sparkSession)
    listed = df.select(F.col(key).alias("__key"), kept.alias("__words"))
    # Counted from the distinct words of each text, which needs no (text, word) shuffle.
    vocabulary = cut_lineage(
        listed.select(F.explode(F.array_distinct("__words")).alias("__term"))
        .groupBy("__term").agg(F.count("*").alias("__df"))
    )
    count = df.agg(F.count("*")).scalar()
    texts = df.count()
    common = {r["__term"]: r["__df"] for r in vocabulary.orderBy(F.desc("__df"), "__term").limit(COMMON_TERMS).collect()}
    counted = _term_counts(df.sparkSession.sparkContext.broadcast(common), texts, top)
    terms = listed.select("__key", F.size("__words").alias("__total"), F.explode(counted("__words")).alias("__t")).select(
        "__key", "__total", F.col("__t.term").alias("__word"), F.col("__t.tf").alias("__tf"), F.col("__t.first").alias("__first"), F.col("__t.df").alias("__known"))
    # A word has no space, so what is known already meets nothing and is spread by its text.
    asked = F.when(F.col("__known").isNull(), F.col("__word")).otherwise(F.concat(F.lit(" "), F.xxhash64("__key").cast("string")))
    scored = (
        terms.withColumn("__term", asked).join(vocabulary, "__term", "left")
        .withColumn("__score", F.round(
            F.col("__tf") / F.col("__total") * F.log((count + 1) / (F.coalesce("__known", "__df") + 1)), 12))
    )
    place = F.row_number().over(Window.partitionBy("__key").orderBy(F.desc("__score"), "__first"))
    best = (
        scored.withColumn("__n", place).filter(F.col("__n") <= top)
        .groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("__n", F.col("__word").alias("__term")))).alias("__best"))
        .select(F.col("__key").alias(key), F.array_join(F.col("__best.__term"), ",").alias("topics_keywords"))
    )
    return df.select(key).join(best, key, "left").fillna("none", ["topics_keywords"])


def signals(df: DataFrame, text: str = "chunk_text") -> DataFrame:
    """All signals but the topic words: one projection, no shuffle."""
    clean, lower = F.col("clean_chunk_text"), F.col("__lower")
    count, score = F.col("word_count"), F.col("sentiment_score").cast("double")
    aspects, types = F.col("__aspects"), F.col("__types")
    out = (
        df.withColumn("clean_chunk_text", tx.clean(F.col(text)))
        .withColumns({
            "__lower": F.lower(clean), "char_count": F.length(clean), "word_count": tx.word_count(clean),
            "sentence_count": tx.sentence_count(clean),
        })
        .withColumns({
            "avg_word_length": tx.average_word_length(F.col("char_count"), count),
            "__aspects": tx.labels_found(lower, lx.ASPECTS), "__types": tx.labels_found(lower, lx.COMPLAINT_TYPES),
            "complaint_score": tx.complaint_score(lower).cast("short"), "is_urgent": tx.is_urgent(lower),
            "__sentiment": tx.sentiment(lower),
        })
        .withColumn("sentiment_score", F.col("__sentiment").cast("float"))
        .withColumn("__readability", tx.readability(count, F.col("sentence_count"), F.col("avg_word_length")))
    )
    missing = {c: F.lit(None).cast("string") for c in OPTIONAL if c not in df.columns}
    out = out.withColumns(missing).withColumns({
        "token_estimate": tx.tokens_by_words(count),
        "is_blank": F.col("char_count") == 0,
        "has_numbers": clean.rlike(r"(?U)\d"), "has_question": clean.contains("?"),
        "has_exclamation": clean.contains("!"), "has_percent": clean.contains("%"),
        "has_currency": clean.rlike(f"(?i){lx.CURRENCY}"),
        "length_bucket": tx.length_bucket(count),
        "readability_score": F.col("__readability").cast("float"),
        "readability_label": tx.readability_label(F.col("__readability")),
        "sentiment_label": tx.sentiment_label(F.col("__sentiment")),
        "sentiment_intensity": tx.sentiment_intensity(F.col("__sentiment")),
        "aspects_detected": tx.joined_or_none(aspects), "aspect_count": F.size(aspects).cast("short"),
        "complaint_type": tx.joined_or_none(types), "is_complaint": F.size(types) > 0,
        "intent": tx.intent(lower),
        "severity": tx.severity(F.col("complaint_score"), F.col("__sentiment"), F.size(types) > 0, F.col("is_urgent")),
        "entity_count": tx.list_length(F.col("entities")), "topic_count": tx.list_length(F.col("topics")),
        **{name: lower.rlike(tx.quick(pattern)) for name, pattern in lx.SIGNALS.items()},
    })
    return out.drop("__lower", "__aspects", "__types", "__sentiment", "__readability")


def generate(df: DataFrame, key: str = "chunk_id", text: str = "chunk_text", keep_text: bool = True) -> DataFrame:
    """The intelligence table, fixed columns first, pass-through columns last."""
    if text not in df.columns:
        raise ValueError(f"column {text} not found")
    out = signals(df, text).join(topic_words(df, key, text), key)
    if not keep_text:
        out = out.drop(text)
    first = [c for c in COLUMNS if c in out.columns]
    return out.select(*first, *[c for c in out.columns if c not in first])


def summary(df: DataFrame, top: int = 10) -> DataFrame:
    """Most frequent values (null included) of ten category columns."""
    columns = [c for c in ("length_bucket", "readability_label", "sentiment_label", "sentiment_intensity",
                           "aspects_detected", "complaint_type", "is_complaint", "is_urgent", "intent", "severity")
               if c in df.columns]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    counts = long.groupBy("x.column", "x.value").agg(F.count("*").alias("frequency"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("frequency"), F.col("value").asc_nulls_first()))
    return counts.withColumn("__n", place).filter(F.col("__n") <= top).drop("__n")

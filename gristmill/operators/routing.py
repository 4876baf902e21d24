"""Labels for query texts: signals, weighted rules, trained classifiers."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark import Broadcast
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import lexicon as lx
from gristmill.functions import text as tx
from gristmill.session import bound_batches, cut_lineage

#: Words of which a task remembers the n-grams.
REMEMBERED = 200_000
#: Where a routing signal that does not begin with a letter can be: its years.
OTHER_BEGIN = r"(?U)\d{4}"
#: A matcher turns the normalised text into a score column.
Matcher = Callable[[Column], Column]


def first_words(pattern: str) -> set[str]:
    """The runs of letters that can begin a match of ``\\b(one|other)\\b``; the empty one if a match can begin with another character."""
    def spelled(part: str) -> list[str]:
        found = re.search(r"\(\?:([^()]*)\)(\??)|(\\?.)\?", part)
        if not found:
            return [part]
        ways = [*(found[3] if found[1] is None else found[1]).split("|"), *[""] * bool(found[2] or found[3])]
        return [word for way in ways for word in spelled(part[:found.start()] + way + part[found.end():])]

    whole = re.fullmatch(r"\\b\((.*)\)\\b", pattern)[1]
    return {re.match("[a-z]*", word)[0] for part in re.split(r"\|(?![^()]*\))", whole) for word in spelled(part)}


def with_signals(df: DataFrame, text: str) -> tuple[DataFrame, dict[str, Column]]:
    """The frame with a boolean column of each signal, and these columns.

    A text is cut into its words once; a pattern is only looked for in texts that hold a
    word with which it can begin, or one of the characters that Java's patterns take for an
    ASCII letter and ``lower`` does not make one.
    """
    begin = {name: first_words(pattern) for name, (pattern, _, _) in lx.ROUTE_SIGNALS.items()}
    every = sorted(set().union(*begin.values()) - {""})
    flat = F.col("__flat")
    odd = (F.octet_length(flat) != F.length(flat)) & flat.rlike("[\u0130\u0131\u017f\u212a]")
    df = df.withColumn("__flat", tx.squeeze(F.col(text))).withColumns({
        "__words": F.array_intersect(F.split(F.lower(flat), "[^a-z]+"), F.array(*map(F.lit, every))), "__odd": odd})
    flags = {}
    for name, (pattern, _, _) in lx.ROUTE_SIGNALS.items():
        maybe = F.col("__odd") | F.arrays_overlap("__words", F.array(*map(F.lit, sorted(begin[name] - {""}))))
        if "" in begin[name]:
            maybe = maybe | flat.rlike(OTHER_BEGIN)
        flags[name] = F.when(maybe, flat.rlike(f"(?iU){pattern}")).otherwise(False)
    return df.withColumns({f"__is_{name}": flag for name, flag in flags.items()}), {name: F.col(f"__is_{name}") for name in flags}


def route(df: DataFrame, text: str, last_mode: str | None = None, turns: str | None = None,
          dominance: float = 0.75) -> DataFrame:
    """Adds mode, confidence and the two normalised signals.

    ``last_mode`` names a column with the mode of the previous turn and
    ``turns`` one with the number of past turns; both only matter for texts
    that refer back to the conversation.
    """
    df, flags = with_signals(df, text)

    def total(side: int) -> Column:
        score = F.lit(0.0)
        for name, spec in lx.ROUTE_SIGNALS.items():
            if spec[side]:
                score = score + F.when(flags[name], spec[side]).otherwise(0.0)
        return score

    structured, semantic = total(1), total(2)
    refers = F.lit(False)
    if turns:
        flat = F.col("__flat")
        refers = (F.col(turns) > 0) & (flat.rlike(f"(?iU){lx.FOLLOW_UP_START}") | flat.rlike(f"(?iU){lx.BACK_REFERENCE}"))
    if last_mode:
        structured = structured + F.when(refers & (F.col(last_mode) == "structured_only"), 0.3).otherwise(0.0)
        semantic = semantic + F.when(refers & (F.col(last_mode) == "semantic_only"), 0.3).otherwise(0.0)
    out = df.withColumns({"__x": structured, "__y": semantic})
    out = out.withColumn("__total", F.col("__x") + F.col("__y"))
    share = {"structured_signal": F.coalesce(F.try_divide("__x", "__total"), F.lit(0.0)),
             "semantic_signal": F.coalesce(F.try_divide("__y", "__total"), F.lit(0.0))}
    out = out.withColumns(share)
    x, y = F.col("structured_signal"), F.col("semantic_signal")
    mixed = F.when(refers, "hybrid_sequential").otherwise("hybrid_parallel")
    mode = (F.when(F.col("__total") <= 0, "hybrid_parallel").when(x >= dominance, "structured_only")
            .when(y >= dominance, "semantic_only").otherwise(mixed))
    confidence = (F.when(F.col("__total") <= 0, 0.3).when(x >= dominance, x).when(y >= dominance, y)
                  .otherwise(0.5 + 0.5 * (1 - F.abs(x - y))))
    return (
        out.withColumn("mode", mode).withColumn("confidence", F.round(confidence, 4))
        .withColumn("structured_signal", F.round(x, 4)).withColumn("semantic_signal", F.round(y, 4))
        .drop("__x", "__y", "__total", "__flat", "__words", "__odd", *(f"__is_{name}" for name in flags))
    )


# --- weighted rules ---------------------------------------------------------------


def regex_matcher(patterns: list[tuple[str, float]]) -> Matcher:
    """Sum of the weights of the patterns that occur."""
    return lambda text: sum((F.when(text.rlike(f"(?iU){p}"), w).otherwise(0.0) for p, w in patterns), F.lit(0.0))


def keyword_matcher(keywords: list[tuple[str, float]]) -> Matcher:
    """Sum of the weights of whole words."""
    return lambda text: sum((F.when(F.array_contains(F.split(text, " "), k.lower()), w).otherwise(0.0)
                             for k, w in keywords), F.lit(0.0))


def phrase_matcher(phrases: list[tuple[str, float]]) -> Matcher:
    """Sum of the weights of contained phrases."""
    return lambda text: sum((F.when(text.contains(p.lower()), w).otherwise(0.0) for p, w in phrases), F.lit(0.0))


MATCHERS: dict[str, Callable[[list[tuple[str, float]]], Matcher]] = {
    "regex": regex_matcher, "keyword": keyword_matcher, "phrase": phrase_matcher,
}


def register_matcher(name: str, factory: Callable[[list[tuple[str, float]]], Matcher]) -> None:
    MATCHERS[name] = factory


def default_rules() -> dict[str, list[Matcher]]:
    return {label: [regex_matcher(patterns)] for label, patterns in lx.ROUTING_RULES.items()}


def classify(df: DataFrame, text: str, rules: dict[str, list[Matcher]] | None = None,
             boosts: dict[str, float] | None = None, fallback: str = "hybrid", dominant: float = 1.2,
             gap: float = 0.4, minimum: float = 0.5, available: set[str] | None = None) -> DataFrame:
    """Adds label, confidence, the path and which stores it needs.

    A clear leader wins, a close second sends the text to ``fallback``; stores
    that are not ``available`` are switched off.
    """
    bound_batches(df.sparkSession)  # whole texts go through Python to be folded
    rules = rules or default_rules()
    normal = F.col("__normal")
    scored = []
    for place, (label, matchers) in enumerate(rules.items()):
        score = sum((m(normal) for m in matchers), F.lit((boosts or {}).get(label, 0.0)))
        scored.append(F.struct(score.cast("double").alias("score"), F.lit(-place).alias("place"), F.lit(label).alias("label")))
    best = F.sort_array(F.array(*scored), asc=False)
    out = df.withColumn("__normal", tx.normalise(F.col(text))).withColumn("__best", best)
    first = F.col("__best")[0]["score"]
    second = F.col("__best")[1]["score"] if len(rules) > 1 else F.lit(0.0)
    sure = first / (first + second + 1e-9)
    leader = F.col("__best")[0]["label"]
    weak = first < minimum
    clear = (first >= dominant) & (first - second >= gap)
    close = (second >= 0.6 * dominant) & (first - second < gap)
    label = F.when(weak, fallback).when(clear, leader).when(close, fallback).otherwise(leader)
    confidence = (F.when(weak, 0.0).when(clear, F.least(sure, F.lit(0.98))).when(close, sure * 0.85)
                  .otherwise(F.least(sure, F.lit(0.90))))
    capped = F.when(label == fallback, F.least(confidence, F.lit(0.35))).otherwise(confidence)
    out = out.withColumn("label", label).withColumn("confidence", F.round(capped, 4)).drop("__normal", "__best")
    return with_route(out, fallback, available)


def with_route(df: DataFrame, fallback: str = "hybrid", available: set[str] | None = None) -> DataFrame:
    """Path and stores of each label, restricted to what is available."""
    table = F.create_map(*[x for name, (sql, vector, path) in lx.ROUTES.items() for x in (
        F.lit(name), F.struct(F.lit(sql).alias("sql"), F.lit(vector).alias("vector"), F.lit(path).alias("path")))])
    entry = F.coalesce(F.try_element_at(table, F.col("label")), F.try_element_at(table, F.lit(fallback)))
    sql = entry["sql"] & F.lit(available is None or "sql" in available)
    vector = entry["vector"] & F.lit(available is None or "vector" in available)
    return df.withColumns({
        "needs_sql": sql, "needs_vector": vector,
        "routing_path": F.when(sql | vector, entry["path"]).otherwise("none"),
        "downgraded": (entry["sql"] != sql) | (entry["vector"] != vector),
    })


# --- trained classifiers --------------------------------------------------------------


def char_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams of each word padded by one space on both sides."""
    padded = F.transform(tx.words(F.lower(text)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def sized(word: Column, n: int) -> Column:
        # a lambda of two arguments would take n for the place in the array
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1))), lambda i: F.substr(word, i, F.lit(n)))

    def grams(word: Column) -> Column:
        sizes = [sized(word, n) for n in range(low, high + 1)]
        return F.array_distinct(F.concat(*sizes)) if low == high else F.concat(*sizes)

    return F.flatten(F.transform(padded, grams))


def _without_summary(model):
    """The fitted model without its training summary. The summary holds the
    session, which cannot be shipped once the session has observed a query."""
    model._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.apply(None))
    return model


def _predictor(model, indexer, features: Column | None, cap: float = 0.95) -> Callable[[DataFrame], DataFrame]:
    names = IndexToString(inputCol="prediction", outputCol="label", labels=indexer.labels)
    drop = ("__tf", "__features", "rawPrediction", "probability", "prediction", "__label")

    def apply(df: DataFrame) -> DataFrame:
        ready = df if features is None else df.withColumn("__features", features)
        scored = names.transform(model.transform(ready))
        sure = F.least(F.array_max(vector_to_array("probability")), F.lit(cap))
        return scored.withColumn("confidence", sure).drop(*drop)

    return apply


def _vocabulary(texts: DataFrame, text: str, size: int) -> list[str]:
    """The most frequent n-grams, made once for each distinct word."""
    words = texts.select(F.explode(tx.words(F.lower(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    grams = words.select("n", F.explode(char_ngrams(F.col("word"))).alias("gram")).groupBy("gram").agg(F.sum("n").alias("n"))
    return [r["gram"] for r in grams.orderBy(F.desc("n"), "gram").limit(size).collect()]


def _gram_counts(vocabulary: Broadcast) -> Callable[[Column], Column]:
    """Vector of a text's counts of the n-grams, those of a word remembered while a task goes on."""
    place: dict[str, int] = {}
    memory: dict[str, np.ndarray] = {}

    def places(word: str) -> np.ndarray:
        if word not in memory:
            if len(memory) > REMEMBERED:
                memory.clear()
            padded = f" {word} "
            grams = (padded[i:i + n] for n in range(2, 5) for i in range(max(len(padded) - n + 1, 1)))
            memory[word] = np.array([place[g] for g in grams if g in place], np.int64)
        return memory[word]

    @F.udf(VectorUDT())
    def counted(words: list[str] | None) -> SparseVector:
        if not place:
            place.update({g: i for i, g in enumerate(vocabulary.value)})
        total = np.bincount(np.concatenate([np.zeros(0, np.int64), *map(places, words or [])]), minlength=len(place))
        held = np.flatnonzero(total)
        return SparseVector(len(place), held, total[held].astype(float))

    return counted


def train_text(df: DataFrame, text: str, label: str, features: int = 2000) -> Callable[[DataFrame], DataFrame]:
    """TF-IDF over character n-grams and logistic regression, fitted on the cluster."""
    bound_batches(df.sparkSession)
    ready = df.select(F.col(text), F.col(label).alias("__name"))
    indexer = StringIndexer(inputCol="__name", outputCol="__label").fit(ready)
    vocabulary = df.sparkSession.sparkContext.broadcast(_vocabulary(ready, text, features))
    counts = _gram_counts(vocabulary)(tx.words(F.lower(F.col(text))))
    rows = cut_lineage(indexer.transform(ready.select("__name", counts.alias("__tf"))).drop("__name"))
    model = Pipeline(stages=[
        IDF(inputCol="__tf", outputCol="__features"),
        LogisticRegression(featuresCol="__features", labelCol="__label", maxIter=50, regParam=0.01),
    ]).fit(rows)
    _without_summary(model.stages[-1])
    apply = _predictor(model, indexer, None)
    return lambda data: apply(data.withColumn("__tf", counts))


def train_vectors(df: DataFrame, vector: str, label: str) -> Callable[[DataFrame], DataFrame]:
    """Logistic regression on stored vectors."""
    features = array_to_vector(F.col(vector).cast("array<double>"))
    ready = df.select(features.alias("__features"), F.col(label).alias("__name"))
    indexer = StringIndexer(inputCol="__name", outputCol="__label").fit(ready)
    model = LogisticRegression(featuresCol="__features", labelCol="__label", maxIter=50).fit(indexer.transform(ready))
    return _predictor(_without_summary(model), indexer, features)

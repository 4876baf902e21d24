"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document, expectation-
maximisation estimates their accuracies, and the posterior labels of a bounded
sample train a hashed linear scorer that then judges every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm import store, weak

#: Hash buckets of the scorer; its weights are 64 KiB of doubles.
BUCKETS = 1 << 13
#: The scorer is trained on about so many documents, drawn by hash of doc_id.
SAMPLE = 20_000
ROUNDS, RATE, DECAY = 150, 2.0, 1e-4
KEEP = 0.5
SYMBOLS = "#*$%&|<>"
#: Statistics of ordinary prose. Each text's own are averaged with those of
#: USUAL_WORDS such words, so that a few words prove little.
USUAL = {"symbols": 0.0, "capitals": 0.05, "exclaims": 0.0, "variety": 0.8, "letters": 0.97, "stops": 0.03, "repeats": 0.0}
USUAL_WORDS = 10
#: Trigrams of texts shorter than this are not scaled up to unit length.
USUAL_BYTES = 200
TEXT_STATISTICS = tuple(USUAL)

_LETTER, _UPPER, _DIGIT, _SPACE, _SYMBOL, _STOP, _OTHER, _HIGH = range(8)


def _classes() -> np.ndarray:
    """The class of each byte; bytes of non-ASCII characters are a class of their own."""
    of = np.full(256, _OTHER, np.int64)
    for low, high, kind in ((97, 122, _LETTER), (65, 90, _UPPER), (48, 57, _DIGIT), (9, 13, _SPACE), (128, 255, _HIGH)):
        of[low:high + 1] = kind
    of[32] = _SPACE
    of[[ord(c) for c in SYMBOLS]] = _SYMBOL
    of[[ord(c) for c in ".,;:?!"]] = _STOP
    return of


_CLASS = _classes()


def statistics(raw: np.ndarray) -> dict[str, float]:
    """The number of words and shares from 0 to 1 that describe one text's bytes."""
    kind = _CLASS[raw]
    count = np.bincount(kind, minlength=8)
    solid = max(1, len(raw) - count[_SPACE])
    gap = kind == _SPACE
    starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]])) if len(raw) else np.zeros(0, np.int64)
    # order-dependent sums of the words name them: a word and its copy have one name
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw)))) if len(starts) and starts[0] == 0 else None
    if place is None and len(starts):
        raw, gap = raw[starts[0]:], gap[starts[0]:]
        starts = starts - starts[0]
        place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    if len(starts):
        value = np.where(gap, np.uint64(0), store.mix((raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                                                      + place.astype(np.uint64)))
        words = np.add.reduceat(value, starts)
        variety = len(np.unique(words)) / np.sqrt(len(words)) / 8
        repeats = float((words[1:] == words[:-1]).mean()) if len(words) > 1 else 0.0
    else:
        variety = repeats = 0.0
    letters = count[_LETTER] + count[_UPPER] + count[_HIGH]
    found = {
        "symbols": count[_SYMBOL] / solid, "capitals": count[_UPPER] / max(1, letters),
        "exclaims": float((raw == 33).sum()) / solid, "variety": min(1.0, variety), "letters": (letters + count[_DIGIT]) / solid,
        "stops": count[_STOP] / solid, "repeats": repeats,
    }
    n = float(len(starts))
    return {"words": n} | {k: (v * n + USUAL[k] * USUAL_WORDS) / (n + USUAL_WORDS) for k, v in found.items()}


def labels(s: dict[str, Column]) -> dict[str, Column]:
    """Labeller -> vote from the statistics: -1 bad, 1 good, 0 abstains."""
    def vote(bad: Column, good: Column) -> Column:
        return F.when(s["words"] == 0, 0).when(bad, -1).when(good, 1).otherwise(0).cast("int")

    long = s["words"] >= 20
    return {
        "label_symbols": vote(s["symbols"] > 0.05, s["symbols"] < 0.01),
        "label_capitals": vote(long & (s["capitals"] > 0.4), s["capitals"] < 0.2),
        "label_exclaims": vote(s["exclaims"] > 0.04, s["exclaims"] < 0.01),
        "label_variety": vote(long & (s["variety"] < 0.35), s["variety"] > 0.5),
        "label_letters": vote(s["letters"] < 0.89, s["letters"] > 0.93),
        "label_stops": vote(long & ((s["stops"] < 0.001) | (s["stops"] > 0.15)), s["stops"].between(0.005, 0.1)),
        "label_repeats": vote(long & (s["repeats"] > 0.2), s["repeats"] < 0.05),
    }


def features(raw: np.ndarray, s: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Sparse hashed features (buckets, values), of unit length by kind.

    Trigrams of bytes (capitals folded) and of byte classes count by the root
    of their number; statistics count as one bucket for each tenth reached.
    """
    kind = _CLASS[raw].astype(np.uint64)
    folded = np.where(kind == _UPPER, raw + 32, raw).astype(np.uint64)
    parts = []
    for salt, of in ((1, folded), (2, kind)):
        if len(of) >= 3:
            key = store.mix((of[:-2] << np.uint64(16)) ^ (of[1:-1] << np.uint64(8)) ^ of[2:] ^ np.uint64(salt << 40))
            counts = np.bincount((key >> np.uint64(51)).astype(np.int64), minlength=BUCKETS)
            at = np.flatnonzero(counts)
            weight = np.sqrt(counts[at])
            parts.append((at, weight / np.sqrt(max(USUAL_BYTES, len(key)))))
    steps = [i * 1000 + t for i, name in enumerate(TEXT_STATISTICS) for t in range(int(np.ceil(min(1.0, s[name]) * 20)) + 1)]
    at = (store.mix(np.array(steps, np.uint64) ^ np.uint64(3 << 40)) >> np.uint64(51)).astype(np.int64)
    parts.append((at, np.full(len(at), 0.3)))
    return np.concatenate([a for a, _ in parts]), np.concatenate([v for _, v in parts])


def _each(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    data, at = store.text_bytes(batch.column("text"))
    for i in range(batch.num_rows):
        yield data[at[i]:at[i + 1]]


def _passed(docs: DataFrame) -> tuple[list[str], str]:
    """The columns carried beside the text and their DDL."""
    fields = [f for f in docs.schema if f.name != "text"]
    return [f.name for f in fields], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text."""
    names = ("words", *TEXT_STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(raw) for raw in _each(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([x[n] for x in found], pa.float64()) for n in names]],
                                             names=["doc_id", *names])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, _passed(docs)[1] + "".join(f", {n} double" for n in names))


def train(sample: DataFrame) -> np.ndarray:
    """Weights (BUCKETS and a bias) of a logistic scorer for ``text`` and ``p_good``.

    Features are written once; each round sums the gradient over them in Spark
    and brings back one vector per partition of the bounded sample.
    """
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [features(raw, statistics(raw)) for raw in _each(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("p_good"), pa.array([a.astype(np.int32).tobytes() for a, _ in pairs], pa.binary()),
                 pa.array([v.astype(np.float32).tobytes() for _, v in pairs], pa.binary())], names=["p", "at", "value"])

    parts = 4
    ready = store.stash(sample.select("text", "p_good").mapInArrow(extract, "p double, at binary, value binary").coalesce(parts), "scorer-features")
    weights, total = np.zeros(BUCKETS + 1), ready.count()
    if not total:
        return weights

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole-shard gradient descent from the shared start, as one summand."""
        ats, values, lengths, ps = [], [], [], []
        for batch in batches:
            ats += [np.frombuffer(x, np.int32) for x in batch.column("at").to_pylist()]
            values += [np.frombuffer(x, np.float32) for x in batch.column("value").to_pylist()]
            ps += batch.column("p").to_pylist()
        if not ps:
            return
        lengths = np.array([len(a) for a in ats])
        at, value, p = np.concatenate(ats), np.concatenate(values).astype(float), np.array(ps)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        balance = np.where(p > 0.5, 0.5 / max(1e-9, (p > 0.5).mean()), 0.5 / max(1e-9, (p <= 0.5).mean()))
        w = np.zeros(BUCKETS + 1)
        for _ in range(ROUNDS):
            score = np.add.reduceat(w[at] * value, starts) + w[-1]
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - p) * balance / len(p)
            step = np.bincount(at, np.repeat(error, lengths) * value, BUCKETS)
            w[:-1] -= RATE * (step + DECAY * w[:-1])
            w[-1] -= RATE * error.sum()
        yield pa.RecordBatch.from_arrays([pa.array([(w * len(p)).tobytes()], pa.binary()), pa.array([len(p)], pa.int64())], names=["w", "n"])

    rows = ready.mapInArrow(fit, "w binary, n long").collect()  # at most one vector a shard
    return sum(np.frombuffer(r["w"]) for r in rows) / sum(r["n"] for r in rows)


def judge(docs: DataFrame) -> DataFrame:
    """The given columns with ``score`` (0 to 1) and ``good``.

    A null or empty text has no evidence: its labellers abstain, its score is
    0 and it is rejected. Where no document draws a bad vote or all draw one,
    there are not two classes to tell apart, and the posterior itself is the
    weak label all the same. Equal texts get equal scores; repeated rows each
    get theirs; an empty table gives no row. Columns named ``score`` or
    ``good`` are replaced.
    """
    store.bound_batches(docs.sparkSession)
    docs = docs.drop("score", "good")
    voted = labels({name: F.col(name) for name in ("words", *TEXT_STATISTICS)})
    known = store.stash(described(docs).select("doc_id", *[v.alias(n) for n, v in voted.items()]), "weak-votes")
    model = weak.estimate(weak.vote_patterns(known, list(voted)), len(voted))
    share = min(1.0, SAMPLE / max(1, known.count()))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000 + 0.5)
    sample = docs.where(drawn).select("doc_id", "text")
    # the sample's labels come from its texts, by the voters and their accuracies
    marked = _with_votes(sample, model, list(voted))
    weights = train(marked)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights)  # BUCKETS + 1 doubles

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        w, scores = shared.value, np.zeros(len(texts))
        data, ends = store.text_bytes(texts)
        for i in range(len(texts)):
            raw = data[ends[i]:ends[i + 1]]
            if len(raw):
                at, value = features(raw, statistics(raw))
                scores[i] = 1 / (1 + np.exp(-np.clip(w[at] @ value + w[-1], -30, 30)))
        return pa.array(scores)

    # not deterministic only in that a filter on the score must not compute it again
    return docs.withColumn("score", scored.asNondeterministic()(F.coalesce("text", F.lit("")))).withColumn("good", F.col("score") >= KEEP)


def _with_votes(sample: DataFrame, model: weak.Accuracies, names: list[str]) -> DataFrame:
    """text and p_good of the sampled documents."""
    keys = ("words", *TEXT_STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(raw) for raw in _each(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("text"), *[pa.array([x[n] for x in found], pa.float64()) for n in keys]],
                                             names=["text", *keys])

    rows = sample.select("text").mapInArrow(run, "text string" + "".join(f", {n} double" for n in keys))
    votes = labels({name: F.col(name) for name in keys})
    return rows.select("text", model.posterior({n: votes[n] for n in names}).alias("p_good"))

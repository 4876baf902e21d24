"""Phrase search, periodic runs and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import positional_index, queries, resampling, runs
from gristmill.llm.words import plain_words

FOLDER = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "\n\n", "One.", "a  b", " a b ", "Tab\tand\xa0space\x0bhere", "é" * 120, "x" * 400, "日本 語 1 23 4a", "x " * 3000, "a b c " * 9]
SCHEMA = "doc_id long, text string, term string, block long, row long, score double, rank string, runs int"


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward texts with clashing extra columns, repeated rows, null and equal ids."""
    rows = [(i, t, "t", 1, 2, 9.0, "r", 3) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], rows[5], *[(None, "no id at all", None, None, None, None, None, None)] * 2, (12, "other text", "t", 1, 2, 0.0, "r", 1)], SCHEMA)


def slow_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def rows_of(df):
    return sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect())))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    got = queries.QUERIES[name](spark, FOLDER)
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    assert sorted(columns) == sorted(got.columns)
    assert rows_of(got) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())


def test_plain_words():
    for text in [*TEXTS, "it's A-Z [x] ~ 9\x00b", "ÀÉ Ünd x"]:
        assert [w.decode() for w in plain_words(text)] == slow_words(text)


# --- phrases -----------------------------------------------------------------------------------

def phrase_texts(seed, n=40):
    rng = random.Random(seed)
    return [" ".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 3, 12, 40, 90]))) for _ in range(n)]


def slow_phrases(text, item, window):
    words, test = slow_words(text), slow_words(item)
    width = min(window, len(test))
    grams = {tuple(test[i:i + width]) for i in range(len(test) - width + 1)} if test else set()
    return {k for i in range(len(words) - width + 1) if tuple(words[i:i + width]) in grams for k in range(i, i + width)}


def slow_neighbourhoods(text, item, window, slack):
    words, test = slow_words(text), slow_words(item)
    width, out = min(window, len(test)), set()
    for terms in {frozenset(test[i:i + width]) for i in range(len(test) - width + 1)} if test else ():
        for i in range(len(words)):
            for end in range(i + 1, min(len(words), i + width + slack) + 1):
                if terms <= set(words[i:end]) and not terms <= set(words[i + 1:end]) and not terms <= set(words[i:end - 1]):
                    out |= set(range(i, end))
    return out


@pytest.mark.parametrize("block,slack", [(positional_index.BLOCK, None), (24, None), (24, 3), (positional_index.BLOCK, 0)])
def test_matches_equal_brute_force(spark, monkeypatch, block, slack):
    monkeypatch.setattr(positional_index, "TILE", 50)
    monkeypatch.setattr(positional_index, "TEST_WORDS", 100)
    docs = list(enumerate([*phrase_texts(1), None, "The end"]))
    items = list(enumerate([*phrase_texts(2, 12), None, "A, b; C d", "the", "nowhere to be found"]))
    index = positional_index.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), block=block, reach=16)
    found = positional_index.find(index, spark.createDataFrame(items, "item_id long, text string"), 5, slack).join(index.documents, "row").collect()
    got = {}
    for r in found:
        got.setdefault((r["doc_id"], int(r["name"])), set()).update(range(r["start"], r["end"]))
    slow = slow_phrases if slack is None else lambda t, i, w: slow_neighbourhoods(t, i, w, slack)
    want = {(d, i): hit for d, text in docs for i, item in items if (hit := slow(text, item, 5))}
    assert got == want and len(want) > 50


def test_contamination_odd_rows(spark, odd):
    items = spark.createDataFrame([("7", "A b"), (None, "other TEXT"), ("7", "é" * 120), ("8", None), ("9", "...")], "item_id string, text string")
    rows = positional_index.contamination(odd, items).collect()
    assert len(rows) == odd.count()
    hit = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in rows if r["n_hit"]}
    assert hit == {(5, 2, 2, ("7",)), (6, 2, 2, ("7",)), (8, 1, 1, ("7",)), (12, 2, 2, ()), (12, 27, 18, ("7",))}
    assert all(r["n_hit"] == 0 for r in positional_index.contamination(odd, items.limit(0)).collect())
    assert positional_index.contamination(odd.limit(0), items).count() == 0
    with pytest.raises(ValueError):
        positional_index.find(positional_index.build(odd), items, positional_index.REACH + 1)


# --- periodic runs -----------------------------------------------------------------------------

def slow_runs(words):
    found, ids = [], np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if words else np.zeros(0, int)
    for q in range(1, len(ids) // 4 + 1):
        apart = np.concatenate([[-1], np.flatnonzero(ids[q:] != ids[:-q]), [len(ids) - q]])
        for k in np.flatnonzero(np.diff(apart) > 1):
            start, n = int(apart[k]) + 1, int(apart[k + 1] - apart[k] - 1) + q
            part = ids[start:start + n]
            if n >= max(6, 4 * q) and not any((part[p:] == part[:-p]).all() for p in range(1, q)):
                found.append((start, n, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def slow_collapsed(words, found):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(600):
        n, letters = rng.randrange(90), "abcdefgh"[:rng.choice([1, 2, 2, 3, 8])]
        words = [rng.choice(letters).encode() for _ in range(n)]
        if n > 10 and rng.random() < 0.7:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randrange(3, 11)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)] + words[:rng.randrange(9)]
        found = runs.periodic_runs(words)
        assert found == slow_runs(words)
        assert runs.collapsed(words, found) == slow_collapsed(words, found)


def test_long_periodic_texts():
    assert runs.periodic_runs([b"a"] * 30_000) == [(0, 30_000, 1)]
    assert runs.periodic_runs([b"x", *[b"a", b"b", b"a"] * 9000, b"a"]) == [(1, 27_001, 3)]
    rng = random.Random(1)
    assert runs.periodic_runs([str(rng.randrange(500)).encode() for _ in range(30_000)]) == []


def slow_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = slow_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(slow_collapsed(words, found)).encode()).hexdigest())


def test_runs_of_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.QUERIES["op12_periodic_runs"](spark, FOLDER).collect()))
    assert got == sorted(slow_row(i, t) for i, t in docs)
    assert sum(r[1] for r in got) > 10


def test_runs_odd_rows(odd):
    rows = runs.find_runs(queries.with_periodic_tails(odd)).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] not in (5, 12)}
    assert by[11]["best"].asDict() == {"start": 0, "length": 3000, "period": 1} and by[11]["collapsed"] == "x"
    assert all(by[i]["n_words"] == 0 and by[i]["runs"] == [] and by[i]["best"] is None and by[i]["collapsed"] == "" for i in range(4))
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert {r["collapsed"] for r in rows if r["doc_id"] == 12} == {"a b c", "other text"} or zlib.crc32(b"12") % 10 == 0
    assert runs.find_runs(odd.limit(0)).count() == 0


# --- importance resampling ---------------------------------------------------------------------

def slow_resample(docs, target, grams, buckets, percent, least, seed):
    def features(text):
        w = slow_words(text)
        return [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, grams + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    over, under = float(s.total() + buckets), float(t.total() + buckets)
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * over / ((s[b] + 1.0) * under))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        at = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in at)
        rows.append((i, len(slow_words(text)), len(at), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[:percent * len(able) // 100]
    return sorted(map(repr, [(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in able[len(drawn):]] + [(*r, None) for r in rows if r[1] < least]))


@pytest.mark.parametrize("grams,runs_kept", [(1, 1024), (3, 3)])
def test_resampling_equals_brute_force(spark, monkeypatch, grams, runs_kept):
    monkeypatch.setattr(resampling, "RUNS", runs_kept)
    monkeypatch.setattr(resampling, "REMEMBERED", 3)
    rng = random.Random(5)
    docs = [(rng.choice([None, *range(300)]), " ".join(rng.choice(["Alpha", "beta", "gamma-delta", "é"]) for _ in range(rng.randrange(9)))) for _ in range(500)]
    docs += [(7, "alpha alpha beta")] * 200 + [(8, None), (None, "beta beta beta")]
    target = ["alpha beta", None, "alpha alpha É"]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string"),
                              grams=grams, buckets=50, percent=60, least_words=2, seed="s").collect()
    assert sorted(map(repr, map(tuple, got))) == slow_resample(docs, target, grams, 50, 60, 2, "s")


def test_segments_share_rows_and_places_are_exact(spark):
    rows = spark.range(20_000).select(F.lit(5).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("score"))
    got = resampling.ranked(rows.repartition(6), 20_000).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 20_001))
    assert all(a["score"] >= b["score"] for a, b in zip(got, got[1:]))


def test_resampling_odd_rows(spark, odd):
    target = odd.select(F.lit("a b").alias("text"), "score")
    assert resampling.resample(odd, target, least_words=1).count() == odd.count()
    rows = resampling.resample(odd, target.limit(0), least_words=0, percent=100).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))
    assert {r["weight"] for r in rows if r["n_features"] == 0} == {0}
    assert resampling.resample(odd.limit(0), target).count() == 0
    names = odd.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert resampling.resample(names, target, least_words=1, percent=50).count() == odd.count()

"""Similarity joins against brute force, with crowded tokens and chains."""

import random

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.operators import evidence, setjoin


def texts_of(seed, n=60):
    rng = random.Random(seed)
    out = []
    for q in ("a", "b"):
        base = [rng.randrange(10**9) for _ in range(40)]
        for i in range(n):
            own = list(base) if i % 3 else [rng.randrange(10**9) for _ in range(rng.randrange(1, 40))] + base[:5]
            for _ in range(rng.randrange(0, 7)):
                own[rng.randrange(len(own))] = rng.randrange(10**9)
            out.append((q, i, sorted(set(own)), [rng.choice("xy"), "", rng.choice("xyz")]))
    return out


def table(spark, rows):
    df = spark.createDataFrame(rows, "query_id string, i int, set array<long>, marks array<string>")
    return df.withColumn("at", F.struct(F.col("i").cast("double").alias("down"), F.lit("t").alias("tie"))).drop("i")


def alike(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("cell", [2000, 7])
def test_links_and_losers_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(setjoin, "CELL", cell)
    monkeypatch.setattr(setjoin, "TASK_TOKENS", 2000)
    rows = [*texts_of(1), ("c", 0, [1, 2], ["", "", ""]), ("c", 1, [1, 2], ["", "", ""]), ("c", 2, [], ["", "", ""]), ("d", 0, [5], ["", "", ""])]
    df = table(spark, rows)
    found = {(r["query_id"], int(r["earlier"]["down"]), int(r["later"]["down"])): r["similarity"] for r in setjoin.links(df, 0.7).collect()}
    want = {(q, i, j): v for q, i, a, _ in rows for p, j, b, _ in rows if p == q and i < j and a and b and (v := alike(a, b)) >= 0.7}
    assert found == pytest.approx(want) and len(want) > 100
    for linked in (None, lambda s, one, two: s > 0.9 or sum(x == y != "" for x, y in zip(one, two)) >= 2):
        kept, lost = [], set()
        for q, i, a, m in rows:
            if any(p == q and a and b and (s := alike(a, b)) >= 0.7 and (linked is None or linked(s, n, m)) for p, _, b, n in kept):
                lost.add((q, i))
            else:
                kept.append((q, i, a, m))
        assert {(r["query_id"], int(r["at"]["down"])) for r in setjoin.losers(df, 0.7, linked).collect()} == lost and lost


def test_a_round_has_one_link_per_set(spark):
    """A thousand near copies of one text give no more pairs than sets."""
    rng = random.Random(2)
    base = list(range(100))
    rows = [("q", i, sorted({*base[:99], 10**6 + i}), [""]) for i in range(600)]
    rng.shuffle(rows)
    df = table(spark, rows)
    assert {int(r["at"]["down"]) for r in setjoin.losers(df, 0.8).collect()} == set(range(1, 600))


def test_no_pairs_among_different_sets(spark):
    df = table(spark, [("q", i, [i], [""]) for i in range(20)])
    assert setjoin.links(df, 0.5).count() == 0 and setjoin.losers(df, 0.5).count() == 0
    assert setjoin.links(df.limit(0), 0.5).count() == 0 and setjoin.losers(df.limit(0), 0.5).count() == 0


def test_context_repeats_are_judged_on_whole_texts(spark):
    start = "The same opening of many documents, which is longer than what is shown. " * 3
    rows = [("q", i, start + end, 1.0 - i / 10) for i, end in enumerate(["one", "two", "two!!", "", ""])] + [("q", 9, None, None), ("q", 8, " ", 0.1)]
    df = spark.createDataFrame(rows, "query_id string, chunk_id int, chunk_text string, score double")
    got = evidence.clean_context(df, "chunk_text", "score", "chunk_id", chars=20).collect()
    assert [r["chunk_id"] for r in sorted(got, key=lambda r: r["position"])] == [0, 1, 2, 3, 8, 9]
    assert all(len(r["context_text"]) <= 21 and r["is_item"] for r in got)
    few = evidence.clean_context(df, "chunk_text", "score", "chunk_id", items=1, sources=2).collect()
    assert [(r["is_item"], r["is_source"]) for r in sorted(few, key=lambda r: r["position"])] == [(True, True), (False, True)]


def test_hashed_runs_are_the_distinct_runs_of_words(spark):
    texts = ["", "one", "a b c d", "a b c d e", "a b c d e f a b c d e f", "x  y z", "é ß 東京 a b c", "d c b a"]
    rows = spark.createDataFrame(enumerate(texts), "i int, t string").select(
        "i", tx.shingles(F.col("t")).alias("runs"), tx.shingle_print(F.col("t")).alias("p")).collect()
    names = {}
    for r in rows:
        assert len(set(r["p"]["set"])) == len(r["p"]["set"]) == len(r["runs"])
        for run in r["runs"]:
            names.setdefault(run, set(r["p"]["set"])).intersection_update(r["p"]["set"])
    assert {i for r in rows for i in r["p"]["set"]} == set().union(*names.values()) and len({r["p"]["digest"] for r in rows}) == len(texts)


def test_sets_without_a_likely_partner_stay_where_they_are(spark):
    rows = [("q", 0, [1, *range(10, 40)], ["", "", ""]), ("q", 1, [1, *range(100, 130)], ["", "", ""]), ("q", 2, list(range(200, 230)), ["", "", ""]),
            ("q", 3, list(range(200, 231)), ["", "", ""])]
    members = setjoin.reduced(table(spark, rows), 0.0).withColumn("open", F.lit(True))
    met = setjoin._met(members, 0.8, False)
    assert {r["at"]["down"] for r in met.select("at").collect()} == {2, 3}

"""Order operators: same result for any partitioning, with a hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gristmill.operators import metrics
from gristmill.operators import ordered as o


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 3000
    keys = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcde"), n))
    frame = pd.DataFrame({"key": keys, "at": rng.permutation(n), "v": rng.integers(0, 50, n)})
    return frame, spark.createDataFrame(frame)


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_dense_index(skewed, parts, monkeypatch):
    monkeypatch.setattr(o, "RANGES", 7)
    frame, df = skewed
    out = o.dense_index(df.repartition(parts), ["at"], "i", piece_rows=50).toPandas().sort_values("at")
    assert out["i"].tolist() == list(range(len(frame)))
    back = o.dense_index(df.repartition(parts), ["at"], "i", start=1, descending=True).toPandas().sort_values("at", ascending=False)
    assert back["i"].tolist() == list(range(1, len(frame) + 1))


@pytest.mark.parametrize("parts", [1, 7, 64])
@pytest.mark.parametrize("descending", [False, True])
def test_running_total(skewed, parts, descending):
    frame, df = skewed
    out = o.running_total(df.repartition(parts), ["key"], ["at"], F.col("v"), "t", descending=descending, piece_rows=70).toPandas()
    want = frame.sort_values("at", ascending=not descending).assign(t=lambda f: f.groupby("key")["v"].cumsum())
    pd.testing.assert_frame_equal(out.sort_values("at", ignore_index=True)[["key", "at", "t"]],
                                  want.sort_values("at", ignore_index=True)[["key", "at", "t"]], check_dtype=False)


@pytest.mark.parametrize("piece_rows", [5, 100_000])
def test_percentiles_equal_numpy(skewed, monkeypatch, piece_rows):
    monkeypatch.setattr(o, "RANGES", 16)
    frame, df = skewed
    marks = {"a": 0.0, "b": 0.37, "c": 0.95, "d": 1.0}
    out = o.percentiles(df, ["key"], "v", marks, piece_rows).toPandas().set_index("key")
    for key, part in frame.groupby("key")["v"]:
        for name, p in marks.items():
            assert out.loc[key, name] == pytest.approx(np.percentile(part, 100 * p))
    whole = o.percentiles(df, [], "at", {"m": 0.5, "q": 0.9}, piece_rows).first()
    assert (whole["m"], whole["q"]) == pytest.approx(tuple(np.percentile(frame["at"], [50, 90])))


def test_pieces_grow_with_rows(spark, monkeypatch):
    df = spark.range(0, 4000).withColumn("x", F.col("id") * F.col("id"))
    assert [o.cut_points(df.limit(n), "x", 100).pieces for n in (90, 900)] == [1, 9]
    monkeypatch.setattr(o, "RANGES", 8)
    cuts = o.cut_points(df, "x", 100)
    assert cuts.steps == 5 and cuts.pieces == 40
    held = [r["count"] for r in o.with_piece(df, F.col("x").cast("double"), cuts).groupBy("__piece").count().collect()]
    assert len(held) > 30 and max(held) < 500 and sum(held) == 4000


def test_order_with_odd_keys(spark, monkeypatch):
    monkeypatch.setattr(o, "RANGES", 3)
    keys = [None, float("-inf"), float("inf"), float("nan"), *([2.0] * 30), *map(float, range(-20, 20))]
    df = spark.createDataFrame(list(enumerate(keys)), "id int, x double")
    got = [r["id"] for r in o.dense_index(df, ["x", "id"], "i", piece_rows=5).orderBy("i").collect()]
    assert got == [r["id"] for r in df.orderBy("x", "id").collect()]
    assert o.dense_index(df.limit(0), ["x"], "i").count() == 0
    total = o.running_total(df, [], ["x", "id"], F.lit(1), "t", piece_rows=5)
    assert [r["t"] for r in total.orderBy("x", "id").collect()] == list(range(1, len(keys) + 1))


def test_mode_takes_the_smallest_tie(spark):
    df = spark.createDataFrame([("x", 2), ("x", 1), ("x", 2), ("x", 1), ("y", None), ("y", 5)], "k string, v int")
    assert {r["k"]: r["m"] for r in o.most_frequent(df, ["k"], "v", "m").collect()} == {"x": 1, "y": 5}


def test_page(spark):
    df = spark.range(95).withColumn("x", -F.col("id"))
    assert [r["id"] for r in o.page(df, ["id"], 10, 10).orderBy("id").collect()] == [90, 91, 92, 93, 94]
    with pytest.raises(ValueError):
        o.page(df, ["id"], 1, 1001)


def test_join_same_matches_nulls(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 3)], "k string, b int")
    assert [tuple(r) for r in o.join_same(a, b, ["k"]).collect()] == [(None, 1, 3)]


def test_latency_of_the_newest_samples(spark):
    log = spark.range(5000).select("id", (F.col("id") % 1000).cast("double").alias("wait"))
    row = metrics.latency_summary(log, "wait", [F.desc("id")], 101).first()
    want = np.arange(899.0, 1000.0)
    assert (row["samples"], row["avg"], row["min"], row["max"]) == (101, 949.0, 899.0, 999.0)
    assert row["p95"] == pytest.approx(np.quantile(want, 0.95)) and row["p99"] == pytest.approx(np.quantile(want, 0.99))


def test_trailing_count_equals_a_loop_and_grows_with_the_rows(spark):
    rng = np.random.default_rng(4)
    seconds = rng.integers(-9000, 9000, 300).tolist() + [0, 0, 3600, 7200, -3600]
    rows = [(i, i % 2, s) for i, s in enumerate(seconds)] + [(900, 0, None), (901, 0, None)]
    df = spark.createDataFrame(rows, "id int, key int, s long").withColumn("ts", F.timestamp_seconds("s"))
    out = metrics.trailing_count(df, "key", "ts", 3600)
    assert out.columns == ["id", "key", "s", "ts", "recent"]
    want = {i: sum(k == q and (s is None and u is None or None not in (s, u) and s - 3600 <= u <= s) for _, q, u in rows) for i, k, s in rows}
    assert {r["id"]: r["recent"] for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "-3600000000" not in plan

"""Greedy dedup, search, diversity and quantization against plain loops."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gristmill.operators import dedup, graph_search, evidence as ev
from gristmill.operators import search as se
from gristmill.operators import vectors as vec
from gristmill.sources import writers


def test_or_strategy_keeps_what_a_scan_keeps(spark):
    df = spark.createDataFrame([(1, "id1", "h1"), (2, "id2", "h1"), (3, "id2", "h3")], "ord int, point_id string, text_hash string")
    assert {r["ord"] for r in dedup.keep_first(df, "primary_key_or_hash", "ord").collect()} == {1, 3}


@pytest.mark.parametrize("seed", [0, 1])
def test_or_strategy_with_a_hot_key(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "hot" if rng.random() < 0.35 else f"i{rng.randint(0, 40)}", f"h{rng.randint(0, 60)}") for i in range(400)]
    ids, hashes, want = set(), set(), set()
    for i, a, b in rows:
        if a not in ids and b not in hashes:
            ids.add(a)
            hashes.add(b)
            want.add(i)
    df = spark.createDataFrame(rows, "ord int, point_id string, text_hash string").repartition(7)
    assert {r["ord"] for r in dedup.keep_first(df, "primary_key_or_hash", "ord").collect()} == want
    again = dedup.keep_first(df.filter(F.col("ord").isin(list(want))), "primary_key_or_hash", "ord")
    assert again.count() == len(want)


def near_rows():
    base = [f"w{i}" for i in range(80)]
    changed = [*base[:79], "z"]
    texts = [" ".join(base), " ".join(base).upper() + "!!", " ".join(changed), "something else entirely here now", "", ""]
    return [("q", i, t) for i, t in enumerate(texts, 1)]


def test_near_duplicates_greedy(spark):
    df = spark.createDataFrame(near_rows(), "query_id string, rank int, text string")
    assert {r["rank"] for r in dedup.drop_near_duplicates(df).collect()} == {1, 4, 5, 6}


def test_null_keys_are_shared_with_no_row(spark):
    rows = [(i, f"id{i}", None) for i in range(12)] + [(12, None, None), (13, None, "h"), (14, "id3", "h"), (15, None, "h")]
    df = spark.createDataFrame(rows, "ord int, point_id string, text_hash string")
    kept = {s: {r["ord"] for r in dedup.keep_first(df, s, "ord").collect()} for s in ("text_hash", "primary_key", "primary_key_or_hash")}
    assert kept["text_hash"] == set(range(14)) and kept["primary_key"] == set(range(14)) | {15} and kept["primary_key_or_hash"] == set(range(14))


def test_near_duplicates_of_any_number(spark):
    same = spark.range(501).select(F.lit("q").alias("query_id"), F.col("id").alias("rank"), F.lit("one text of several words again").alias("text"))
    assert [r["rank"] for r in dedup.drop_near_duplicates(same).collect()] == [0]
    pairs = dedup.similar_pairs(same.withColumnsRenamed({"rank": "chunk_id", "text": "chunk_text"})).collect()
    assert len(pairs) == 500 and {(r["left"], r["similarity"]) for r in pairs} == {(0, 1.0)}


def test_near_duplicates_equal_the_plain_scan(spark):
    rng = np.random.default_rng(4)
    rows = []
    for q in "ab":
        bases = [[str(w) for w in rng.integers(0, 40, 60)] for _ in range(6)]
        for i in range(60):
            parts = list(bases[rng.integers(6)])
            for _ in range(rng.integers(0, 3)):
                parts[rng.integers(60)] = str(rng.integers(0, 40))
            rows.append((q, i, " ".join(parts[: rng.integers(50, 61)])))
    df = spark.createDataFrame(rows, "query_id string, rank int, text string")
    kept = {}
    for q, i, text in rows:
        mine = {tuple(text.split()[k:k + 5]) for k in range(len(text.split()) - 4)}
        if not any(len(mine & other) >= 0.85 * len(mine | other) for other in kept.get(q, {}).values()):
            kept.setdefault(q, {})[i] = mine
    got = {(r["query_id"], r["rank"]) for r in dedup.drop_near_duplicates(df).collect()}
    assert got == {(q, i) for q, found in kept.items() for i in found} and len(got) < len(rows)


def test_similar_texts_need_metadata(spark):
    parts = [f"w{i}" for i in range(60)]
    text, other = " ".join(parts), " ".join([*parts[:59], "z"])
    rows = [("q", 1, 0.9, text, "t", "p"), ("q", 2, 0.8, other, "t", "p"), ("q", 3, 0.7, other, "u", "p"), ("q", 4, 0.6, text, "z", "z")]
    df = spark.createDataFrame(rows, "query_id string, chunk_id int, score double, chunk_text string, topic string, product_id string")
    assert {r["chunk_id"] for r in dedup.drop_similar(df).collect()} == {1, 3}


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(400, 8)).astype(np.float32)
    points[7] = points[3]
    queries = rng.normal(size=(5, 8))
    p = spark.createDataFrame(pd.DataFrame({"point_id": range(400), "vector": [v.tolist() for v in points], "tag": [i % 3 for i in range(400)]}))
    q = spark.createDataFrame(pd.DataFrame({"query_id": list("abcde"), "vector": [v.tolist() for v in queries]}))
    return points.astype(np.float64), queries, p, q


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_search_equals_brute_force(cloud, parts):
    points, queries, p, q = cloud
    got = se.top_k(p.repartition(parts), q, 10).orderBy("query_id", "rank").collect()
    for i, name in enumerate("abcde"):
        scores = np.round(points @ queries[i] / np.linalg.norm(points, axis=1) / np.linalg.norm(queries[i]), 6)
        want = sorted(range(len(points)), key=lambda j: (-scores[j], j))[:10]
        assert [r["point_id"] for r in got if r["query_id"] == name] == want


def test_search_in_query_blocks(cloud, monkeypatch):
    _, _, p, q = cloud
    want = {tuple(r) for r in se.top_k(p, q, 4).collect()}
    monkeypatch.setattr(se, "QUERY_BLOCK_BYTES", 100)
    assert {tuple(r) for r in se.top_k(p, q, 4).collect()} == want


def test_filter_applies_before_ranking(cloud):
    _, _, p, q = cloud
    got = se.top_k(p, q, 5, filters={"tag": 1})
    assert got.count() == 25 and got.join(p, "point_id").filter("tag <> 1").count() == 0


def test_fusion_ignores_the_order_of_lists(spark):
    rows = [("q", v, r, p, 1.0 / r) for v, ps in (("a", "xyz"), ("b", "yzx"), ("c", "zw")) for r, p in enumerate(ps, 1)]
    df = spark.createDataFrame(rows, "query_id string, variant string, rank int, point_id string, score double")
    first = {r["point_id"]: (round(r["rrf_score"], 12), r["lists"]) for r in se.fuse(df).collect()}
    assert first == {r["point_id"]: (round(r["rrf_score"], 12), r["lists"]) for r in se.fuse(df.orderBy(F.desc("variant"))).collect()}
    assert first["z"] == (round(1 / 63 + 1 / 62 + 1 / 61, 12), 3) and first["w"][1] == 1


def plain_mmr(rows, top, weight):
    def cos(a, b):
        return np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))
    left, out = sorted(rows, key=lambda r: (-r[1], r[0])), []
    while left and len(out) < top:
        def value(r):
            return r[1] if not out else weight * r[1] - (1 - weight) * max(cos(r[2], s[2]) for s in out)
        best = max(left, key=lambda r: round(value(r), 12))
        out.append(best)
        left.remove(best)
    return [r[0] for r in out]


def test_mmr_equals_the_plain_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.random()), rng.normal(size=4).tolist()) for i in range(30)]
    df = spark.createDataFrame([("q", *r) for r in rows] + [("q", 99, 5.0, None)], "query_id string, point_id int, relevance double, vector array<double>")
    got = se.mmr(df, 12, 0.4).orderBy("position").collect()
    assert [r["point_id"] for r in got] == plain_mmr(rows, 12, 0.4)
    tail = se.mmr(df, 31, 0.4).orderBy("position").collect()
    assert tail[-1]["point_id"] == 99
    wide = [(i, float(rng.random() * 20), rng.normal(size=4).tolist()) for i in range(700)]
    many = spark.createDataFrame([("q", *r) for r in wide], "query_id string, point_id int, relevance double, vector array<double>")
    assert [r["point_id"] for r in se.mmr(many, 8, 0.4).orderBy("position").collect()] == plain_mmr(wide, 8, 0.4)


def test_quantization_error_is_bounded(cloud):
    points, _, p, _ = cloud
    scale = vec.scales(p, "vector")
    back = vec.dequantize(vec.quantize(p, "vector", scale), "quantized", scale).toPandas()
    bound = np.abs(points).max(axis=0) / 254 + 1e-6
    assert (np.abs(np.stack(back["restored"]) - points[back["point_id"]]) <= bound).all()


def test_dead_dimension_and_bad_vectors(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, -2.0]), (3, [0.0, 0.0]), (4, [0.0, float("nan")]), (5, [0.0, float("inf")]), (6, [1.0]), (7, [0.0, 1.0]), (8, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    assert vec.scales(df.filter("id < 3"), "v").first()["scales"] == [1.0, 2.0]
    got = vec.check_vectors(df, "v", 2).first()
    assert (got["vectors"], got["wrong_size"], got["nan_vectors"], got["inf_vectors"], got["zero_vectors"], got["duplicated_vectors"]) == (7, 1, 1, 1, 1, 1)


def test_points_account_for_every_row(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [0.0, 0.0]), (4, "c", None), (5, "d", [1.0])]
    df = spark.createDataFrame(rows, "ord int, text string, v array<float>")
    got = writers.accounting(writers.points(df, "ord", "v", 2)).first()
    assert got.asDict() == {"total": 5, "uploaded": 1, "duplicate": 1, "skipped": 1, "invalid": 2}


def test_embedding_encodes_each_text_once(spark):
    df = spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, " "), (4, "c")], "chunk_id int, chunk_text string")
    out = {r["chunk_id"]: r["vector"] for r in vec.embed(df).collect()}
    assert set(out) == {1, 2, 4} and out[1] == out[2]
    assert np.linalg.norm(out[4]) == pytest.approx(1.0)


def test_attach_fails_on_a_missing_text(spark):
    prepared = vec.prepare(spark.createDataFrame([(1, "a")], "chunk_id int, chunk_text string"))
    with pytest.raises(Exception, match="text without"):
        vec.attach(prepared, spark.createDataFrame([("x", 1)], "text_hash string, n int"), "n").collect()


def test_reconstruction_orders_and_deduplicates(spark):
    rows = [("q", 1, "d", 2, "second", 0.5, 0.5), ("q", 2, "d", 1, "first", 0.9, 0.9), ("q", 3, "d", 1, "again", 0.8, 0.8), ("q", 4, "d", 3, "First!", 0.1, 0.1)]
    df = spark.createDataFrame(rows, "query_id string, point_id int, doc string, at int, text string, score double, normalized_score double").withColumn("rank", F.col("point_id"))
    got = ev.chunked_documents(df, "doc", "at", "text").first()
    assert got["text"] == "first ... second" and got["chunk_count"] == 3 and got["chunk_id"] == 2 and got["document_location"] == [1, 2, 3]


def test_compressor_guard_and_counts(spark):
    rows = [("q", i, "same text" if i < 3 else f"text number {i} {'x' * i}", i / 10, f"r{i % 2}") for i in range(8)]
    df = spark.createDataFrame(rows, "query_id string, chunk_id int, chunk_text string, score double, record_id string")
    out, counts = ev.compress(df, F.lit("2024-01-01").cast("timestamp"))
    assert {r["record_id"] for r in out.collect()} == {"r0", "r1"}
    assert counts["final"].get["rows"] == 2
    assert ev.checked_compressor(df, lambda d: d.unionByName(d)).count() == 8
    assert ev.checked_compressor(df, lambda d: d.limit(2)).count() == 2


def test_graph_walks_find_neighbours_and_touch_few(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24))
    vectors = centres[rng.integers(0, 40, 6000)] + 0.5 * rng.normal(size=(6000, 24))
    vectors[100:103] = vectors[50]
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(9000, None), (9001, []), (9002, [0.0] * 24), (9003, [1.0])],
                                   "point_id long, vector array<double>")
    asked = points.where("point_id % 50 = 0").withColumnRenamed("point_id", "query_id")
    for rows in (20_000, 3000):
        got = graph_search.search(graph_search.build(points, shard_rows=rows), asked, 10, ef=128).collect()
        units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        true = {q: set(np.argsort(-(units @ units[q]), kind="stable")[:10].tolist()) for q in range(0, 6000, 50)}
        assert sum(r["point_id"] in true[r["query_id"]] for r in got) >= 0.9 * 10 * len(true)
        assert all(r["touched"] < 0.2 * 6000 * (20_000 // rows if rows < 20_000 else 1) for r in got)
        assert [r["point_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 50][:4] == [50, 100, 101, 102]
    assert graph_search.search(graph_search.build(points.limit(0)), asked, 10).count() == 0


def test_search_holds_few_scores_and_queries_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(3)
    scores, ids = rng.random((40, 30)), np.arange(30)
    whole, tiled = se._Best(40, 5, None), se._Best(40, 5, None)
    whole.add(scores, ids)
    for first in range(0, 40, 7):
        tiled.add(scores[first:first + 7], ids, first)
    assert [(q, i.tolist()) for q, _, i in whole.drain()] == [(q, i.tolist()) for q, _, i in tiled.drain()]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 8)))], "point_id int, vector array<double>")
    asked = rows.withColumnRenamed("point_id", "query_id").where("query_id % 3 = 0")
    index = graph_search.build(rows, shard_rows=20)
    one = sorted(graph_search.search(index, asked, 3).collect())
    monkeypatch.setattr(graph_search, "QUERIES", 6)
    assert sorted(graph_search.search(index, asked, 3).collect()) == one and len(one) == 60

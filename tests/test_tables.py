"""Types, cleaning, filters, catalog tables and merges on small fixtures."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from gristmill.operators import analyse as an
from gristmill.operators import cleaning as cl
from gristmill.operators import filters as flt
from gristmill.operators import inference as inf
from gristmill.operators import profile as pf
from gristmill.operators import relations as rel
from gristmill.sources import readers, tables, writers


def kinds(spark, **columns):
    rows = list(zip(*columns.values()))
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    return {g.column: g.kind for g in inf.infer(df)}, df


def test_inferred_kinds(spark):
    n = 100
    got, df = kinds(
        spark, flag=["Yes", "no", "T", "0"] * 25, uid=["6ba7b810-9dad-11d1-80b4-00c04fd430c8"] * n, doc=['{"a": 1}', "[1]"] * 50,
        money=["$1,234.50"] * n, acc=["(12.5)", "3.25"] * 50, pct=["45%"] * n, sci=["1e3"] * n, code=["007"] * n, small=["12"] * n,
        big=["40000000000"] * n, day=["2024-03-0" + str(1 + i % 9) for i in range(n)], us=["12/31/2024"] * n, ts=["2024-03-01 10:00:00"] * n,
        named=["3 Mar 2024"] * n, long=["March 3, 2024"] * n, rfc=["Sun, 3 Mar 2024 10:11:12"] * n, words=["abc"] * n,
        few_bad=["5"] * 99 + ["x"], many_bad=["5"] * 96 + ["x"] * 4)
    assert got == {
        "flag": "boolean", "uid": "uuid", "doc": "json", "money": "decimal(6,2)", "acc": "decimal(4,2)", "pct": "tinyint", "sci": "smallint",
        "code": "string", "small": "tinyint", "big": "bigint", "day": "date", "us": "date", "ts": "timestamp_ntz", "named": "date",
        "long": "date", "rfc": "timestamp_ntz", "words": "string", "few_bad": "tinyint", "many_bad": "string"}
    row = inf.typed(df).first()
    assert float(row["money"]) == 1234.5 and float(row["acc"]) == -12.5 and row["pct"] == 45 and row["sci"] == 1000
    assert row["us"] == dt.date(2024, 12, 31) and row["rfc"] == dt.datetime(2024, 3, 3, 10, 11, 12) and row["flag"] is True


def test_number_columns(spark):
    df = spark.createDataFrame([(1.0, 1.25, 1 / 3, 300)], "whole double, cents double, third double, n long")
    assert {g.column: g.kind for g in inf.infer(df)} == {"whole": "tinyint", "cents": "decimal(4,2)", "third": "double", "n": "smallint"}


@pytest.mark.parametrize("low,high,kind", [(-128, 127, "tinyint"), (-129, 0, "smallint"), (0, 2 ** 31 - 1, "int"), (0, 2 ** 31, "bigint"), (0, 2 ** 63, "decimal(38,0)"), (0, 10 ** 38, "string")])
def test_narrowest_integer(low, high, kind):
    assert inf.narrowest_integer(low, high) == kind


def test_unique_names():
    assert cl.unique_names(["a", " ", None, "a", "a_1", "a"]) == ["a", "column_1", "column_2", "a_1", "a_1_1", "a_2"]


def test_clean(spark):
    rows = [(" x ", 1.0, None), (" x ", 1.0, None), ("nan", None, None), ("y", 3.0, None), ("ÿz", 8.0, None), (None, None, None)]
    out = cl.clean(spark.createDataFrame(rows, "` My Name` string, v double, gone string"))
    assert out.columns == ["my_name", "v"]
    # One duplicate and the empty row go; median of 1, 3, 8; mode is the smallest of three single values.
    assert sorted(map(tuple, out.collect())) == [("x", 1.0), ("x", 3.0), ("y", 3.0), ("z", 8.0)]


def test_canonical_names_do_not_collide(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "date int, created_at int, SKU int, other int")
    assert cl.canonical_names(df).columns == ["timestamp", "created_at", "product_id", "other"]
    taken = spark.createDataFrame([(1, 2)], "cost int, price int")
    assert cl.canonical_names(taken).columns == ["price", "price"] or len(set(cl.canonical_names(taken).columns)) == 2


def test_filter_trees(spark):
    df = spark.createDataFrame([(1, ["hr", "it"], "active", 5, {"x": 1}), (2, None, "old", None, {"x": 2}), (3, ["legal"], None, 9, None)],
                               "id int, tags array<string>, status string, year int, meta struct<x: int>")

    def ids(spec):
        return {r["id"] for r in df.filter(flt.tree(df, spec)).collect()}

    assert ids({"tags": ["hr", "x"]}) == {1}
    assert ids({"tags": "legal"}) == {3}
    assert ids({"must_not": [{"tags": "hr"}]}) == {2, 3}
    assert ids({"year": {"gte": 5, "lt": 9}}) == {1}
    assert ids({"should": [{"status": "old"}, {"year": {"gt": 8}}]}) == {2, 3}
    assert ids({"must": [{"should": [{"id": 1}, {"id": 2}]}], "must_not": [{"status": "old"}]}) == {1}
    assert ids({"status": {"except": ["old"]}}) == {1}
    assert ids({"meta.x": (2, None)}) == {2}
    assert ids({"missing": 1}) == set() and ids({"must_not": [{"missing": 1}]}) == {1, 2, 3}
    assert ids({"status": None}) == {1, 2, 3} and ids({"year": "5"}) == set()
    with pytest.raises(ValueError):
        ids({"year": {"near": 3}})


def test_text_predicates_are_literal(spark):
    df = spark.createDataFrame([("50% off",), ("50 off",), ("A_b",), ("axb",)], "t string")
    assert [r["t"] for r in df.filter(flt.predicate("t", "contains", "50%")).collect()] == ["50% off"]
    assert [r["t"] for r in df.filter(flt.predicate("t", "startswith", "a_")).collect()] == ["A_b"]


def test_join_edges_must_connect(spark):
    a = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError):
        an.join_edges({"a": a, "b": a, "c": a}, "a", [("b", "x", "c", "x")])


def test_load_modes_and_append_guard(spark):
    df = spark.createDataFrame([("11", "a")], "n string, t string")
    tables.load_frame(df, "load_test", "replace")
    tables.load_frame(spark.createDataFrame([("b", "22")], "t string, n string"), "load_test", "append")
    assert {tuple(r) for r in spark.table("load_test").collect()} == {(11, "a"), (22, "b")}
    with pytest.raises(ValueError, match="columns do not match"):
        tables.load_frame(spark.createDataFrame([("1",)], "n string"), "load_test", "append")
    with pytest.raises(Exception):
        tables.load_frame(df, "load_test", "fail")
    assert tables.table_exists(spark, "load_test") and tables.describe(spark).filter("table = 'load_test'").count() == 2
    spark.sql("drop table load_test")


def test_csv_and_vector_files(spark):
    folder = tempfile.mkdtemp()
    writers.write_splits({"s": spark.createDataFrame([(1, "x")], "id int, t string")}, folder, "csv")
    assert readers.read_csv(spark, f"{folder}/s").first().asDict() == {"id": 1, "t": "x"}
    with pytest.raises(Exception):
        readers.read_csv(spark, f"{folder}/none").collect()
    rows = spark.createDataFrame([(1, "h"), (2, "h")], "id int, text_hash string")
    unique = spark.createDataFrame([("h", [1.0, 2.0])], "text_hash string, vector array<float>")
    writers.write_vectors(rows, unique, folder, "m")
    assert readers.read_vectors(spark, folder).count() == 2
    manifest = spark.read.json(f"{folder}/manifest")
    assert manifest.first().asDict() == {"model": "m", "rows": 2, "unique_texts": 1, "dimension": 2, "dtype": "float32"}
    writers.check_manifest(manifest, unique, "m")
    with pytest.raises(ValueError):
        writers.check_manifest(manifest, spark.createDataFrame([([1.0],)], "vector array<float>"))


def test_merge_sources(spark):
    chunks = spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (3, 11, "c")], "chunk_id int, document_id int, text string")
    intel = spark.createDataFrame([(1, "pos", "drop"), (2, "neg", "drop"), (3, "pos", "drop")], "chunk_id int, mood string, text string")
    meta = spark.createDataFrame([(10, "t1"), (11, "t2")], "document_id int, title string")
    out = rel.merge_sources({"meta": meta, "chunks": chunks, "intel": intel})
    assert {tuple(r) for r in out.select("chunk_id", "text", "mood", "title").collect()} == {(1, "a", "pos", "t1"), (2, "b", "neg", "t1"), (3, "c", "pos", "t2")}
    with pytest.raises(ValueError):
        rel.merge_sources({"a": chunks, "b": spark.createDataFrame([(1,)], "other int")})


def test_foreign_keys_of_the_star_are_found(spark):
    folder = "/root/testdata/sf0.001"
    named = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in ("region", "nation", "customer", "orders")}
    found = rel.verify(named, rel.discover(rel.describe(named)), least=0.4)
    good = {(r["from_table"], r["from_column"], r["to_table"], r["to_column"]) for r in found.filter("inclusion = 1.0").collect()}
    assert ("orders", "o_custkey", "customer", "c_custkey") in good
    assert ("nation", "n_regionkey", "region", "r_regionkey") in good
    assert ("customer", "c_nationkey", "nation", "n_nationkey") in good


def test_primary_key_detection(spark):
    single = spark.createDataFrame([(1, "a"), (2, "a")], "order_id int, t string")
    assert pf.primary_key(single) == (["order_id"], "single_column")
    both = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "a_id int, b_key int")
    assert pf.primary_key(both) == (["a_id", "b_key"], "composite")
    assert pf.primary_key(spark.createDataFrame([(1,), (1,)], "x int")) == (None, "none")


def test_native_values(spark):
    cells = ["TRUE", '{"a": 1}', "[1, 2]", "42", "1.5", " text ", "2024-01-01"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = {r["i"]: r["t"] for r in df.select("i", pf.value_tag(cl.native(F.col("c"))).alias("t")).collect()}
    assert [got[i] for i in range(7)] == ["bool", "object", "array", "integer", "float", "keyword", "datetime"]


def test_flatten(spark):
    df = spark.createDataFrame([((1, ("x",)), [("a",), ("b",)])], "p struct<a: int, q: struct<r: string>>, l array<struct<s: string>>")
    assert cl.flatten(df, 2).columns == ["p.a", "p.q.r", "l", "l.0.s", "l.1.s"]


# --- plans ---------------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    text = plan(orders.filter(flt.from_spec(orders, {"o_orderstatus": "F"})).select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text


def test_first_n_is_limited_before_the_shuffle(spark):
    from gristmill.operators import conversation as cv

    talk = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert "WindowGroupLimit" in plan(cv.last_messages(talk, 3))
    assert "WindowGroupLimit" in plan(tables.upsert(talk, talk, ["conv_id"], "turn"))


def test_no_query_uses_a_cartesian_product(spark):
    from gristmill.plans import catalog
    from gristmill.plans.registry import REGISTRY

    catalog.load()
    for name in ("revenue_share_by_region", "topic_words", "discover_relationships", "chunk_summary", "quantize"):
        assert "CartesianProduct" not in plan(REGISTRY[name](spark, "/root/testdata/sf0.001")), name


def test_long_whole_numbers_keep_every_digit(spark):
    ids = [10 ** 17 + i for i in range(200)]
    df = spark.createDataFrame([(str(i), f"{i:,}", str(i * 10 ** 9)) for i in ids], "plain string, commas string, huge string")
    assert {g.column: g.kind for g in inf.infer(df)} == {"plain": "bigint", "commas": "bigint", "huge": "decimal(38,0)"}
    got = inf.typed(df)
    assert sorted(r["plain"] for r in got.collect()) == ids and sorted(r["commas"] for r in got.collect()) == ids
    assert got.select("huge").distinct().count() == 200


def test_types_from_counted_values(spark):
    rows = [("2024-01-0" + str(i % 5 + 1), "x" * 70 if i % 50 else "1", None, "7" if i % 100 else "bad", " yes ") for i in range(400)]
    df = spark.createDataFrame(rows, "day string, long string, none string, `a.b` string, flag string")
    values = inf._values(df, df.columns)
    counts = {r["column"]: r["n"] for r in values.groupBy("column").agg(F.count("*").alias("n")).collect()}
    assert counts == {"day": 5, "long": 393, "a.b": 2, "flag": 1} and values.agg(F.sum("rows")).first()[0] == 1600
    guesses = {g.column: (g.kind, g.notes) for g in inf.infer(df)}
    assert guesses == {"day": ("date", ()), "long": ("string", ()), "none": ("string", ("only empty values",)), "a.b": ("tinyint", ()), "flag": ("boolean", ())}
    assert inf.infer(df, 0.005)[3].notes == ("tinyint failed on 1.0%",)
    assert {g.kind for g in inf.infer(df.limit(0))} == {"string"}

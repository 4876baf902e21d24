"""Sources and sinks: what was written is read back and compared whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.operators import cleaning, evidence, relations, vectors
from gristmill.plans.registry import Tables, query
from gristmill.session import shared_path
from gristmill.sources import readers, tables, writers


@query("S5 S15", """
with u as (select text, min(doc_id) as vec_id from documents group by text)
select d.doc_id, case when e.embedding is not null then [round(cast(x as double), 6) for x in e.embedding] end as vector, m.rows, m.unique_texts, m.dimension
from documents d join u on d.text = u.text left join embeddings e on e.vec_id = u.vec_id
cross join (select count(*) as rows, count(distinct text) as unique_texts, 64 as dimension from documents) m""")
def embedding_store(t: Tables) -> DataFrame:
    """Vectors stored once per text with metadata and manifest, and loaded again."""
    folder = shared_path(t.spark, "vectors")
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("text_hash"))
    first = rows.groupBy("text_hash").agg(F.min("doc_id").alias("vec_id"))
    unique = first.join(t.embeddings, "vec_id", "left").select("text_hash", F.col("embedding").alias("vector"))
    writers.write_vectors(rows, unique, folder, "given")
    manifest = t.spark.read.json(f"{folder}/manifest").select("rows", "unique_texts", "dimension")
    vector = F.transform("vector", lambda x: tx.rounded(x.cast("double"), 6))
    return readers.read_vectors(t.spark, folder).select("doc_id", vector.alias("vector")).join(manifest, F.lit(True))


@query("S6 S7 S10 S13", """
select o_orderkey, o_orderstatus, o_totalprice, 6 as columns from orders where o_orderkey % 2 = 0
union all select o_orderkey, o_orderstatus, o_totalprice, 6 from orders where o_orderkey % 2 = 1""")
def table_modes(t: Tables) -> DataFrame:
    """Replace, then append with columns in another order; looked up in the catalog."""
    name = f"orders_{uuid.uuid4().hex}"
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    tables.load_frame(orders.where("o_orderkey % 2 = 0"), name, "replace", infer=False)
    tables.load_frame(orders.where("o_orderkey % 2 = 1").select(*reversed(orders.columns)), name, "append", infer=False)
    if not tables.table_exists(t.spark, name):
        raise RuntimeError(f"{name} is not in the catalog")
    columns = t.spark.table(name).columns
    return t.spark.table(name).select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(len(columns)).alias("columns"))


@query("S16", """
select vec_id, true as close from embeddings where embedding is not null""")
def quantized_store(t: Tables) -> DataFrame:
    """A quantized archive read back; every vector within one step of the original."""
    folder = shared_path(t.spark, "quantized")
    points = t.embeddings.where("embedding is not null")
    scale = vectors.scales(points, "embedding")
    writers.write_quantized(vectors.quantize(points, "embedding", scale), scale, folder)
    stored, scales = writers.read_quantized(t.spark, folder)
    back = vectors.dequantize(stored.select("vec_id", "quantized"), "quantized", scales).select("vec_id", "restored")
    near = F.forall(F.arrays_zip("embedding", "restored"), lambda x: F.abs(x["embedding"] - x["restored"]) < 0.01)
    return points.join(back, "vec_id").select("vec_id", near.alias("close"))


@query("S18 S21", """
select min(vec_id) as vec_id from embeddings where embedding is not null group by vec_id % 97""")
def point_sink(t: Tables) -> DataFrame:
    """Points written twice: the rerun replaces them by id."""
    folder = shared_path(t.spark, "points")
    rows = t.embeddings.select("vec_id", F.concat(F.lit("k"), F.col("vec_id") % 97).alias("key"), "embedding")
    tagged = writers.points(rows, "vec_id", "embedding", 64, ["key"], strategy="primary_key")
    for _ in range(2):
        writers.write_points(tagged, folder, "vec_id")
    return t.spark.read.parquet(f"{folder}/points").select("vec_id")


@query("S19", """
select c_custkey, c_name, orders, total from customer left join (
  select o_custkey, count(*) as orders, round(sum(o_totalprice), 2) as total from orders group by o_custkey) on c_custkey = o_custkey""")
def merged_sources(t: Tables) -> DataFrame:
    """Sources of several sizes joined to the largest by the key that they share."""
    per_customer = t.orders.groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    customers = t.customer.select(F.col("c_custkey").alias("customer_id"), "c_name")
    merged = relations.merge_sources({"orders": per_customer, "customers": customers})
    return merged.select(F.col("customer_id").alias("c_custkey"), "c_name", "orders", "total")


@query("T1", "select r_regionkey as \"key\", r_name as \"key_1\", r_regionkey + 1 as column_2 from region")
def filled_names(t: Tables) -> DataFrame:
    """Repeated and empty column names made unique."""
    rows = t.region.select("r_regionkey", "r_name", F.col("r_regionkey") + 1)
    return rows.toDF(*cleaning.unique_names(["key", "key", " "]))


@query("Y5", "select doc_id from documents where n_chars < 1000")
def compressor_accepted(t: Tables) -> DataFrame:
    """A user's compressor that shrinks is applied, one that grows is not."""
    docs = t.documents.select("doc_id", "n_chars")
    small = evidence.checked_compressor(docs, lambda d: d.where("n_chars < 1000"))
    return evidence.checked_compressor(small, lambda d: d.union(d)).select("doc_id")

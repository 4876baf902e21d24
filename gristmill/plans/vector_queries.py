"""Vectors: the queries of a search are the mean vectors of the labels, so
their number does not grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import lexicon as lx
from gristmill.operators import graph_search
from gristmill.operators import search as se
from gristmill.operators import vectors as vec
from gristmill.plans.registry import Tables, query
from gristmill.plans.text_queries import ASCII, TYPE_SQL, count_sql, quoted
from gristmill.session import cut_lineage

CENTROIDS = """with cells as (select label, pos, round(avg(embedding[pos]::double), 9) as x
   from embeddings, range(1, 65) r(pos) group by all),
 q as (select label as query_id, list(x order by pos) as v from cells group by label),
 p as (select vec_id as point_id, embedding::double[] as e, label from embeddings)"""
HITS = CENTROIDS + """,
 h as (select query_id, point_id, label, round(list_cosine_similarity(v, e), 6) as score from q, p),
 r as (select *, row_number() over (partition by query_id order by score desc, point_id) as rank from h)"""


def points(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"), "label")


def label_queries(t: Tables) -> DataFrame:
    return vec.mean_vectors(t.embeddings, "label", "embedding").withColumnRenamed("label", "query_id")


@query("V7 K4", HITS + " select query_id, point_id, score, rank from r where rank <= 20")
def search_top_k(t: Tables) -> DataFrame:
    return se.top_k(points(t), label_queries(t), 20)


@query("V7 F13 F20 K4", HITS.replace("from q, p)", "from q, p where label in (1, 2, 3))") + """
select query_id, point_id, score, rank from r where rank <= 15 and score >= 0.05""")
def search_filtered(t: Tables) -> DataFrame:
    return se.top_k(points(t), label_queries(t), 15, 0.05, filters={"label": [1, 2, 3]})


@query("K5 F20", HITS + " select query_id, point_id, score from r where score >= 0.2")
def search_above_threshold(t: Tables) -> DataFrame:
    return se.above(points(t), label_queries(t), 0.2)


@query("V17", CENTROIDS.replace("range(1, 65)", "range(1, 33)") + """,
 h as (select query_id, point_id, round(list_cosine_similarity(v, e[1:32]), 6) as score from q, p),
 r as (select *, row_number() over (partition by query_id order by score desc, point_id) as rank from h)
select query_id, point_id, score, rank from r where rank <= 10""")
def search_named_vector(t: Tables) -> DataFrame:
    """Points with two named vectors; the search names one of them."""
    named = F.create_map(F.lit("whole"), F.col("embedding"), F.lit("head"), F.slice("embedding", 1, 32))
    rows = t.embeddings.select(F.col("vec_id").alias("point_id"), named.alias("vectors")).withColumn("vector", F.col("vectors")["head"])
    asked = label_queries(t).withColumn("vector", F.slice("vector", 1, 32))
    return se.top_k(rows, asked, 10)


def metric_lists(t: Tables) -> DataFrame:
    found, asked = None, cut_lineage(label_queries(t))
    for name in ("cosine", "dot", "manhattan"):
        part = se.top_k(points(t), asked, 30, metric=name).withColumn("variant", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return found


LISTS = CENTROIDS + """,
 s as (select query_id, point_id, 'cosine' as variant, round(list_cosine_similarity(v, e), 6) as score from q, p
   union all select query_id, point_id, 'dot', round(list_inner_product(v, e), 6) from q, p
   union all select query_id, point_id, 'manhattan', round(-list_sum(list_transform(list_zip(v, e), lambda z: abs(z[1] - z[2]))), 6) from q, p),
 r as (select *, row_number() over (partition by query_id, variant order by score desc, point_id) as rank from s),
 l as (select * from r where rank <= 30)"""


@query("V12 V11 D7", CENTROIDS + """
select query_id, point_id, round(least(1, greatest(0, (list_cosine_similarity(v, e) + 1) / 2)), 5) as cosine,
  round(1 / (1 + exp(-list_inner_product(v, e))), 5) as dot, round(1 / (1 + list_distance(v, e)), 5) as euclid,
  round(1 / (1 + list_sum(list_transform(list_zip(v, e), lambda z: abs(z[1] - z[2])))), 5) as manhattan
from q join p on query_id = label""")
def normalised_metrics(t: Tables) -> DataFrame:
    """Each vector against the mean of its own label, under four metrics."""
    pairs = points(t).join(F.broadcast(label_queries(t).withColumnRenamed("vector", "mean")), F.col("label") == F.col("query_id"))
    a, b = F.col("mean"), F.col("vector")
    return pairs.select(
        "query_id", "point_id", F.round(vec.normalise_score(vec.cosine(a, b), "cosine"), 5).alias("cosine"),
        F.round(vec.normalise_score(vec.dot(a, b), "dot"), 5).alias("dot"),
        F.round(vec.normalise_score(-vec.euclid(a, b), "l2"), 5).alias("euclid"),
        F.round(vec.normalise_score(-vec.manhattan(a, b), "l1"), 5).alias("manhattan"))


@query("V9 U2", LISTS + """
select query_id, point_id, round(sum(1.0::double / (60 + rank)), 9) as rrf_score, count(distinct variant) as lists, max(score) as score
from l group by query_id, point_id""")
def rank_fusion(t: Tables) -> DataFrame:
    return se.fuse(metric_lists(t)).withColumn("rrf_score", F.round("rrf_score", 9))


@query("V10", LISTS + """
select query_id, cast(point_id as varchar) as id, max(score) as score from l group by query_id, point_id""")
def best_hit_per_id(t: Tables) -> DataFrame:
    return se.best_per_id(metric_lists(t), ["point_id"], []).select("query_id", "id", "score")


@query("V15 V16 V11", LISTS + """,
 f as (select query_id, point_id, count(distinct variant) as lists from l group by query_id, point_id),
 c as (select query_id, round(least(1.0, avg(lists) / 3), 4) as coverage from f group by query_id),
 n as (select query_id, rank, (score + 1) / 2 as s, point_id % 2 = 0 as meta from l where variant = 'cosine'),
 g as (select query_id, arg_min(s, rank) as top, avg(s) as mean, 1 - (max(s) - min(s)) as close, avg(case when meta then 1.0::double else 0 end) as m from n group by query_id)
select query_id, coverage, round(least(1, greatest(0, 0.40::double * top + 0.20::double * mean + 0.15::double * close + 0.15::double * m + 0.10::double * coverage)), 4) as confidence
from g join c using (query_id)""")
def retrieval_confidence(t: Tables) -> DataFrame:
    lists = metric_lists(t)
    share = se.coverage(se.fuse(lists), 3)
    best = lists.filter(F.col("variant") == "cosine")
    sure = se.confidence(best, vec.normalise_score(F.col("score"), "cosine"), F.col("point_id") % 2 == 0, share)
    return share.join(sure, "query_id")


STRATEGY_SQL = " ".join(f"when '{n}' then {{'m': {m}::double, 'd': {d}::double}}" for n, (m, d, _) in lx.QUERY_STRATEGY.items())


@query("V14 X37", rf"""with c as (select conv_id, turn, trim({ASCII.format('text')}, E' \n\t\r') as a from conversations),
 k as (select conv_id, turn, {count_sql('a', r'[^\s]+')} as n, case when a = '' then 'search' {TYPE_SQL} when ends_with(a, '?')
   or regexp_matches(a, {quoted(rf'(?i)^(?:{lx.QUESTION_WORDS})\b')}) then 'informational' when {count_sql('a', r'[^\s]+')} <= 4 then 'search'
   else 'informational' end as query_type from c),
 s as (select *, case query_type {STRATEGY_SQL} end as s from k),
 w as (select *, greatest(1, round_even(20 * s.m, 0)) as wide from s)
select conv_id, turn, query_type, cast(greatest(5, least(100, case when n > 25 then round_even(wide * 1.2::double, 0) else wide end)) as integer) as top_k,
  round(least(1, greatest(0, 0.3::double + s.d)), 4) as score_threshold from w""")
def adaptive_depth(t: Tables) -> DataFrame:
    return se.adaptive_depth(t.conversations, "text").select("conv_id", "turn", "query_type", "top_k", "score_threshold")


@query("V13")
def diverse_hits(t: Tables) -> DataFrame:
    best = se.top_k(points(t), label_queries(t), 50).withColumn("relevance", vec.normalise_score(F.col("score"), "cosine"))
    candidates = best.join(points(t).select("point_id", "vector"), "point_id")
    return se.mmr(candidates, 10, 0.5)


@query("V8")
def approximate_recall(t: Tables) -> DataFrame:
    exact = se.top_k(points(t), label_queries(t), 10)
    return se.recall(exact, se.approximate(points(t), label_queries(t), 10, distance=1.4))


@query("V8")
def graph_recall(t: Tables) -> DataFrame:
    """Recall of ten by graph walks for every twentieth vector against all, and the share of the vectors touched."""
    asked = t.embeddings.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    guess = cut_lineage(graph_search.search(graph_search.build(points(t)), asked, 10, ef=48))
    exact = se.top_k(points(t), asked, 10)
    share = guess.where("rank = 1").agg(F.avg("touched").alias("touched")).join(t.embeddings.agg(F.count("*").alias("n")))
    return se.recall(exact, guess).join(share.select(F.round(F.col("touched") / F.col("n"), 4).alias("touched_share")))


@query("V1 V2", r"""with p as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from documents), h as (select doc_id, sha256(t) as text_hash from p where t <> ''),
 f as (select text_hash, min(doc_id) as doc_id from h group by text_hash)
select doc_id, text_hash, row_number() over (order by doc_id) - 1 as embedding_index from f""")
def unique_texts(t: Tables) -> DataFrame:
    prepared = vec.prepare(t.spread("documents", "doc_id").select("doc_id", "text"), "doc_id", "text")
    return vec.unique_texts(prepared, "doc_id", "text").select("doc_id", "text_hash", "embedding_index")


@query("J7", r"""with h as (select doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) as text_hash from documents where trim(text) <> ''),
 f as (select text_hash, min(doc_id) as first from h group by text_hash), i as (select *, row_number() over (order by first) - 1 as embedding_index from f)
select doc_id, embedding_index from h join i using (text_hash)""")
def attach_embedding_index(t: Tables) -> DataFrame:
    prepared = vec.prepare(t.spread("documents", "doc_id").select("doc_id", "text"), "doc_id", "text")
    unique = vec.unique_texts(prepared, "doc_id", "text")
    return vec.attach(prepared, unique, "embedding_index").select("doc_id", "embedding_index")


@query("V3 A17 Y1", r"""with h as (select sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) as h from documents where trim(text) <> '')
select count(*) as rows, count(distinct h) as unique_texts, 64 as dimension from h""")
def embed_documents(t: Tables) -> DataFrame:
    coded = vec.embed(t.spread("documents", "doc_id").select("doc_id", "text"), "doc_id", "text")
    return vec.summary(coded)


SCALES = """with m as (select pos, case when max(abs(embedding[pos])) = 0 then 1 else max(abs(embedding[pos])) end as m from embeddings, range(1, 65) r(pos) group by pos)"""
QUANTIZED = SCALES + """, z as (select vec_id, pos, embedding[pos]::double as x, m::double as m, round_even(embedding[pos]::double / m::double * 127.0, 0) as q
   from embeddings, m)"""


@query("V4", QUANTIZED + " select vec_id, cast(sum(q) as bigint) as total, cast(sum(q * pos) as bigint) as weighted from z group by vec_id")
def quantize(t: Tables) -> DataFrame:
    coded = vec.quantize(t.embeddings, "embedding", vec.scales(t.embeddings, "embedding"))
    return coded.select("vec_id", F.posexplode("quantized").alias("pos", "q")).groupBy("vec_id").agg(
        F.sum(F.col("q").cast("long")).alias("total"), F.sum(F.col("q").cast("long") * (F.col("pos") + 1)).alias("weighted"))


@query("V5", QUANTIZED + " select vec_id, round(max(abs(x - cast(q / 127.0::double * m as float)::double)), 6) as worst, bool_and(abs(x - q / 127.0::double * m) <= m / 254 + 1e-7) as bounded from z group by vec_id")
def dequantize(t: Tables) -> DataFrame:
    scale = vec.scales(t.embeddings, "embedding")
    back = vec.dequantize(vec.quantize(t.embeddings, "embedding", scale), "quantized", scale).withColumn("s", scale.scalar())
    cells = back.select("vec_id", F.explode(F.arrays_zip("embedding", "restored", "s")).alias("c"))
    gap = F.abs(F.col("c.embedding").cast("double") - F.col("c.restored").cast("double"))
    return cells.groupBy("vec_id").agg(F.round(F.max(gap), 6).alias("worst"),
                                       F.bool_and(gap <= F.col("c.s") / 254 + 1e-7).alias("bounded"))


@query("V6", QUANTIZED + """, r as (select vec_id, pos, x, q / 127.0::double * m as y from z),
 c as (select vec_id, sum(abs(x - y)) as gap, count(*) as n, sum(x * y) / ((sqrt(sum(x * x)) + 1e-9) * (sqrt(sum(y * y)) + 1e-9)) as c from r group by vec_id)
select round(sum(gap) / sum(n), 5) as mae, round(avg(c), 5) as mean_cosine_similarity from c""")
def reconstruction_error(t: Tables) -> DataFrame:
    scale = vec.scales(t.embeddings, "embedding")
    back = vec.dequantize(vec.quantize(t.embeddings, "embedding", scale), "quantized", scale)
    out = vec.reconstruction_error(back, "embedding", "restored")
    return out.select(F.round("mae", 5).alias("mae"), F.round("mean_cosine_similarity", 5).alias("mean_cosine_similarity"))


@query("P21 P27", """select count(*) as vectors, 0::bigint as wrong_size, count(*) filter (len(list_filter(embedding, lambda x: isnan(x))) > 0) as nan_vectors,
  count(*) filter (len(list_filter(embedding, lambda x: isinf(x))) > 0) as inf_vectors, count(*) filter (len(list_filter(embedding, lambda x: x <> 0)) = 0) as zero_vectors,
  (select count(*) from (select embedding from embeddings group by embedding having count(*) > 1)) as duplicated_vectors from embeddings""")
def check_vectors(t: Tables) -> DataFrame:
    return vec.check_vectors(t.embeddings, "embedding", 64)

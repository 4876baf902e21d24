"""Evidence over whole tables: the source of a document, the type of an event
or the nation of a customer plays the query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.operators import dedup
from gristmill.operators import evidence as ev
from gristmill.operators import relations as rel
from gristmill.operators import search as se
from gristmill.plans.registry import Tables, query
from gristmill.session import bound_batches

FORM = r"trim(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[^\p{L}\p{N}_ ]', '', 'g'))"
HITS = """with h as (select source as query_id, doc_id as chunk_id, doc_id as record_id, text, lang as topic, round((n_chars % 1000) / 1000, 3) as score,
  case when doc_id % 6 = 0 then null else timestamp '2024-01-31' - to_days(cast(doc_id % 500 as integer)) end as review_date,
  case when doc_id % 3 = 0 then 'Positive' else 'neutral' end as sentiment_label, case when doc_id % 4 = 0 then '4.5' else 'n/a' end as rating from documents)"""


def hits(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    day = F.expr("timestamp_ntz '2024-01-31 00:00:00' - make_dt_interval(cast(doc_id % 500 as int))")
    return t.documents.select(
        F.col("source").alias("query_id"), i.alias("chunk_id"), i.alias("record_id"), F.col("text").alias("chunk_text"),
        F.col("lang").alias("topic"), F.round((F.col("n_chars") % 1000) / 1000, 3).alias("score"),
        F.when(i % 6 != 0, day).alias("review_date"), F.when(i % 3 == 0, "Positive").otherwise("neutral").alias("sentiment_label"),
        F.when(i % 4 == 0, "4.5").otherwise("n/a").alias("rating"))


def as_of():
    return F.lit("2024-02-01").cast("timestamp")


@query("E2 X27", HITS + f""", f as (select *, row_number() over (partition by query_id, sha256({FORM}) order by score desc, chunk_id) as n from h)
select query_id, chunk_id, score from f where n = 1""")
def best_of_equal_texts(t: Tables) -> DataFrame:
    return dedup.best_per_text(hits(t)).select("query_id", "chunk_id", "score")


#: Distinct forms ``f`` (query_id, spot, form) to alike pairs ``e``, by shared runs of five words.
ALIKE = """ g as (select query_id, spot, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end) as gram
   from (select *, list_filter(string_split(form, ' '), lambda x: x <> '') as w from f where form <> '')),
 z as (select query_id, spot, count(*) as n from g group by all),
 p as (select a.query_id, a.spot as earlier, b.spot as later, count(*) as c from g a join g b on a.query_id = b.query_id and a.gram = b.gram and a.spot < b.spot group by all),
 e as (select p.query_id, earlier, later, c / (x.n + y.n - c) as similarity from p join z x on x.query_id = p.query_id and x.spot = earlier join z y on y.query_id = p.query_id and y.spot = later)"""
#: The rows of ``f`` that a scan by ``at`` drops, given linked pairs ``l``.
SCAN = """ o as (select query_id, spot, row_number() over (partition by query_id order by spot) as n from (select query_id, earlier as spot from l union select query_id, later from l)),
 r as (select o.query_id, o.n, o.spot, list(q.n) filter (q.n is not null) as before from o left join l on l.query_id = o.query_id and l.later = o.spot
   left join o q on q.query_id = l.query_id and q.spot = l.earlier group by all),
 walk as (select distinct query_id, 0::bigint as n, []::bigint[] as kept from o union all
   select w.query_id, r.n, case when list_has_any(w.kept, coalesce(r.before, [])) then w.kept else list_append(w.kept, r.n) end from walk w join r on r.query_id = w.query_id and r.n = w.n + 1),
 ends as (select query_id, arg_max(kept, n) as kept from walk group by query_id),
 lost as (select query_id, spot from r join ends using (query_id) where not list_contains(ends.kept, r.n))"""
RANKED = HITS.replace("with h", "with recursive h") + """, k as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as spot from h),"""


@query("E3 X28 X29", RANKED + rf""" n as (select *, trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) as form from k),
 f as (select * from n qualify form = '' or row_number() over (partition by query_id, form order by spot) = 1),{ALIKE},
 l as (select * from e where similarity >= 0.85),{SCAN}
select query_id, chunk_id, spot as rank from f anti join lost using (query_id, spot)""")
def drop_near_duplicates(t: Tables) -> DataFrame:
    ranked = ev.rerank(hits(t), "score", "chunk_id")
    return dedup.drop_near_duplicates(ranked, "chunk_text").select("query_id", "chunk_id", "rank")


@query("E4", RANKED + f""" n as (select *, {FORM} as form from k),
 f as (select * from n qualify form = '' or row_number() over (partition by query_id, form, topic order by spot) = 1),{ALIKE},
 l as (select * from e where similarity > 0.97),{SCAN}
select query_id, chunk_id from f anti join lost using (query_id, spot)""")
def drop_similar(t: Tables) -> DataFrame:
    return dedup.drop_similar(hits(t)).select("query_id", "chunk_id")


@query("E5", HITS + f""", n as (select query_id, chunk_id as spot, {FORM} as form from h),
 f as (select query_id, form, min(spot) as spot from n where form <> '' group by query_id, form),{ALIKE}
select query_id, earlier as "left", later as "right", similarity from e where similarity >= 0.85
union all select query_id, f.spot, n.spot, 1.0::double from n join f using (query_id, form) where n.spot <> f.spot""")
def similar_pairs(t: Tables) -> DataFrame:
    return dedup.similar_pairs(hits(t), threshold=0.85)


SCORES = HITS + r""", w as (select *, len(regexp_extract_all(text, '[^\s]+')) as words, date_diff('day', review_date, timestamp '2024-02-01') as days from h),
 s as (select *, least(1.0::double, case when words >= 40 then 0.25::double when words >= 20 then 0.15 else 0 end + case when sentiment_label = 'Positive' then 0.15 else 0 end
    + 0.15 + case when rating = '4.5' then 0.10 else 0 end) as quality,
  case when days is null then 0.0::double when days < 30 then 1.0 when days < 180 then 0.8 when days < 365 then 0.5 else 0.2 end as recency from w),
 x as (select *, round(score * 0.70::double + quality * 0.20::double + recency * 0.10::double, 5) as hybrid_score from s)"""


@query("E6 D4", SCORES + " select chunk_id, round(quality, 6) as quality, recency from x")
def quality_and_recency(t: Tables) -> DataFrame:
    rows = hits(t)
    return rows.select("chunk_id", F.round(ev.quality(rows), 6).alias("quality"), ev.recency(F.col("review_date"), as_of()).alias("recency"))


@query("E7 K6", SCORES + """, r as (select *, row_number() over (partition by query_id order by hybrid_score desc, chunk_id) as rank from x)
select query_id, chunk_id, hybrid_score, rank from r where rank <= 20""")
def hybrid_rerank(t: Tables) -> DataFrame:
    scored = ev.with_hybrid_score(hits(t), as_of())
    return ev.limit_per_query(scored, "hybrid_score", "chunk_id", 20).select("query_id", "chunk_id", "hybrid_score", "rank")


@query("E8", HITS + """, k as (select *, case when chunk_id % 5 = 0 then null else topic end as t from h)
select query_id, chunk_id from k where t is not null qualify row_number() over (partition by query_id, t order by score desc, chunk_id) = 1
union all select query_id, chunk_id from k where t is null""")
def one_per_topic(t: Tables) -> DataFrame:
    return ev.one_per(hits(t), F.when(F.col("chunk_id") % 5 != 0, F.col("topic")), "score", "chunk_id").select("query_id", "chunk_id")


@query("E9 E2 E4 E7 E8 K6", SCORES.replace("with h", "with recursive h") + f""", n as (select *, {FORM} as form, row_number() over (partition by query_id order by score desc, chunk_id) as spot from x),
 f as (select * from n qualify row_number() over (partition by query_id, sha256(form) order by spot) = 1),{ALIKE},
 l as (select * from e where similarity > 0.97),{SCAN},
 u as (select * from f anti join lost using (query_id, spot)),
 v as (select * from u where topic is not null qualify row_number() over (partition by query_id, topic order by hybrid_score desc, chunk_id) = 1 union all select * from u where topic is null)
select query_id, chunk_id, hybrid_score, row_number() over (partition by query_id order by hybrid_score desc, chunk_id) as rank from v qualify rank <= 10""")
def compress_context(t: Tables) -> DataFrame:
    out, _ = ev.compress(hits(t), as_of(), most=10)
    return out.select("query_id", "chunk_id", "hybrid_score", "rank")


EVENT_HITS = """with e as (select event_type as query_id, user_id as doc, event_id as point_id, event_id % 5 as pos, props || ' ' || event_type as text, value / 997 as score from events),
 r as (select *, row_number() over (partition by query_id order by score desc, point_id) as rank from e),
 h as (select *, (score + 1) / 2 as normal from r)"""


def event_hits(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_type").alias("query_id"), F.col("user_id").alias("doc"), F.col("event_id").alias("point_id"),
                           (F.col("event_id") % 5).alias("at"), F.concat_ws(" ", "props", "event_type").alias("text"), (F.col("value") / 997).alias("score"))
    return se.ranked(rows).withColumn("normalized_score", (F.col("score") + 1) / 2)


@query("E10", EVENT_HITS + """ select query_id, doc as document_id, text, round(score, 4) as score, round(normal, 4) as normalized_score, round(normal, 4) as rerank_score,
  round(0.6::double * normal + 0.4::double * normal, 4) as retrieval_confidence, 1::bigint as chunk_count, point_id as chunk_id from h""")
def flat_documents(t: Tables) -> DataFrame:
    return ev.flat_documents(event_hits(t), F.col("text"), F.col("doc"))


@query("E11", EVENT_HITS + r""", d as (select * from h qualify row_number() over (partition by query_id, doc, pos order by rank) = 1),
 f as (select *, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) as form from d),
 u as (select query_id, doc, string_agg(text, ' ... ' order by pos, rank) as text from (select * from f qualify row_number() over (partition by query_id, doc, form order by pos, rank) = 1) group by all)
select f.query_id, f.doc as document_id, any_value(u.text) as text, round(max(f.score), 4) as score, count(*) as chunk_count,
  arg_min(f.point_id, f.rank) as chunk_id, list_sort(list_distinct(list(f.pos))) as document_location from f join u on f.query_id = u.query_id and f.doc = u.doc group by all""")
def chunked_documents(t: Tables) -> DataFrame:
    out = ev.chunked_documents(event_hits(t), "doc", "at", "text")
    return out.select("query_id", "document_id", "text", "score", "chunk_count", "chunk_id", "document_location")


EVIDENCE = """with s as (select c_nationkey as query_id, 'structured' as source, 'structured:' || c_custkey as evidence_id, c_custkey as id,
   least(1, greatest(0, c_acctbal / 10000)) as confidence, 3.0::double / 4 as richness, 0 as fresh, '["' || c_custkey || '"]' as print from customer),
 m as (select s_nationkey, 'semantic', 'semantic:' || s_suppkey, s_suppkey, least(1, greatest(0, s_acctbal / 10000)), 1.0::double, 1, '' from supplier),
 u as (select * from s union all select * from m),
 l as (select query_id, id from u group by all having count(distinct source) > 1),
 k as (select u.*, l.id is not null as linked from u left join l on u.query_id = l.query_id and u.id = l.id)"""


def evidence(t: Tables) -> DataFrame:
    left = t.customer.select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("id"), F.col("c_name").alias("label"),
                             F.lit(None).cast("string").alias("date"), F.col("c_mktsegment").alias("kind"), "c_acctbal")
    right = t.supplier.select(F.col("s_nationkey").alias("query_id"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"),
                              F.lit("2024-01-01").alias("date"), "s_acctbal")
    return ev.merge(
        ev.as_evidence(left, "structured", ["id", "label", "date", "kind"], F.col("c_acctbal") / 10000, "id"),
        ev.as_evidence(right, "semantic", ["id", "label", "date"], F.col("s_acctbal") / 10000, "id"))


@query("U1 J11", EVIDENCE + """ select query_id, evidence_id, source, case when linked then ['semantic', 'structured'] else []::varchar[] end as linked_sources from k""")
def link_evidence(t: Tables) -> DataFrame:
    return ev.link(evidence(t)).select("query_id", "evidence_id", "source", "linked_sources")


@query("E13 D5", EVIDENCE + """, r as (select *, round(0.55::double * confidence + 0.30::double * richness + 0.05::double * fresh + case when linked then 0.10::double else 0 end, 9) as rank_score from k),
 n as (select *, row_number() over (partition by query_id order by rank_score desc, evidence_id) as rank from r)
select query_id, evidence_id, round(rank_score, 6) as rank_score, rank from n""")
def rank_evidence(t: Tables) -> DataFrame:
    return ev.rank_evidence(ev.link(evidence(t))).select("query_id", "evidence_id", F.round("rank_score", 6).alias("rank_score"), "rank")


@query("E12", """with e as (select event_type as query_id, event_id, user_id, props from events)
select query_id, user_id, props, min(event_id) as first from e group by all""")
def drop_repeated_evidence(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_type").alias("query_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event"), "user_id", "props")
    kept = ev.drop_repeated(ev.as_evidence(rows, "structured", ["user_id", "props"], F.lit(1.0), "event"))
    return kept.select("query_id", F.col("record")["user_id"].cast("long").alias("user_id"), F.col("record")["props"].alias("props"),
                       F.substring_index("evidence_id", ":", -1).cast("long").alias("first"))


@query("E14", """with c as (select c_custkey, case when c_custkey % 2 = 0 then c_acctbal / 9973 end as a, case when c_custkey % 3 = 0 then 0.5 end as b from customer)
select c_custkey, round((coalesce(0.35::double * least(1, greatest(0, a)), 0) + coalesce(0.30::double * b, 0) + 0.35::double * 0.8) /
  (case when a is null then 0 else 0.35::double end + case when b is null then 0 else 0.30::double end + 0.35::double), 6) as confidence from c""")
def combined_confidence(t: Tables) -> DataFrame:
    a = F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") / 9973)
    b = F.when(F.col("c_custkey") % 3 == 0, F.lit(0.5))
    return t.customer.select("c_custkey", F.round(ev.combined_confidence(a, b, F.lit(0.8)), 6).alias("confidence"))


@query("E16", HITS + """, r as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from h),
 c as (select query_id, rank, topic, sentiment_label from r),
 u as (select query_id, 'topic' as field, topic as value, min(rank) as first from c group by all union all select query_id, 'sentiment_label', sentiment_label, min(rank) from c group by all)
select query_id, field, string_agg(value, ',' order by first) as "values" from u group by all""")
def harvest_entities(t: Tables) -> DataFrame:
    ranked = ev.rerank(hits(t), "score", "chunk_id")
    return ev.harvest_entities(ranked, ["topic", "sentiment_label"]).select("query_id", "field", F.array_join("values", ",").alias("values"))


CONTEXT = HITS + r""", b as (select *, trim(text, E' \n\t\r') as whole, case when chunk_id % 9 = 0 then null else score end as s from h),
 c as (select *, case when length(whole) > 100 then rtrim(whole[1:100], E' \n\t\r') || '…' else whole end as body,
   list_reduce(list_prepend(trim(regexp_replace(lower(whole), '\s+', ' ', 'g')), ['.', ',', '#', '*', '%', '&', '$', '!', '?', ';', ':', '-', '+', '=', '~', '@', '/', '(', ')', '<', '>', '|', '"', chr(39)]),
     lambda t, m: regexp_replace(t, '[' || m || '][' || m || ']+', m, 'g')) as form from b),
 d as (select * from c qualify whole = '' or row_number() over (partition by query_id, sha256(form) order by s is null, s desc, chunk_id) = 1),
 p as (select *, row_number() over (partition by query_id order by s is null, s desc, chunk_id) as position from d)"""


def context(t: Tables) -> DataFrame:
    rows = hits(t).withColumn("score", F.when(F.col("chunk_id") % 9 != 0, F.col("score")))
    return ev.clean_context(rows, "chunk_text", "score", "chunk_id", chars=100)


@query("E17 X44", CONTEXT + " select query_id, chunk_id, body as context_text, position from p")
def clean_context(t: Tables) -> DataFrame:
    return context(t).select("query_id", "chunk_id", "context_text", "position")


@query("E17", CONTEXT + " select query_id, round(coalesce(avg(s), 0), 3) as confidence from p where position <= 3 group by query_id")
def context_confidence(t: Tables) -> DataFrame:
    return ev.context_confidence(context(t), "score")


@query("E18", """select event_id, 0 as row_number, json_extract_string(props, '$.k') as k from events where event_id % 3 = 0
union all select event_id, unnest([0, 1]), unnest([json_extract_string(props, '$.k'), cast(user_id as varchar)]) from events where event_id % 3 = 1
union all select event_id, unnest([0, 1]), unnest([cast(user_id as varchar), 'x']) from events where event_id % 3 = 2""")
def records_from_contexts(t: Tables) -> DataFrame:
    user = F.col("user_id").cast("string")
    cell = (F.when(F.col("event_id") % 3 == 0, F.col("props"))
            .when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), F.col("props"), F.lit(', {"k": '), user, F.lit("}]")))
            .otherwise(F.concat(F.lit('{"columns": ["k"], "rows": [["'), user, F.lit('"], ["x"]]}'))))
    out = ev.records_from_json(t.events.select("event_id", cell.alias("cell")), "cell")
    return out.select("event_id", "row_number", F.col("record")["k"].alias("k"))


@query("E19", """with r as (select o_orderstatus as query_id, o_orderkey, o_orderpriority, row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey) as rank from orders)
select query_id, '## Structured Facts' || chr(10) || '| o_orderkey | o_orderpriority |' || chr(10) || '| --- | --- |' || chr(10) ||
  string_agg('| ' || o_orderkey || ' | ' || o_orderpriority || ' |' || chr(10), '' order by rank) as facts from r where rank <= 10 group by query_id""")
def render_facts(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderstatus").alias("query_id"), "o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("score"))
    return ev.render_table(ev.rerank(rows, "score", "o_orderkey"), ["o_orderkey", "o_orderpriority"], rows=10)


@query("E19")
def render_contexts(t: Tables) -> DataFrame:
    ranked = ev.limit_per_query(hits(t), "score", "chunk_id", 10)
    facts = ev.render_table(ranked, ["chunk_id", "topic", "score"])
    snippets = ev.render_snippets(ranked, "chunk_text", "score", rows=5, chars=300)
    asked = t.documents.select(F.col("source").alias("query_id")).distinct().withColumn("question", F.concat(F.lit("What is in "), "query_id"))
    return ev.render_context(asked, "question", facts, snippets, "Answer from the context.", 1500)


@query("E20", HITS + """, r as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from h)
select query_id, count(*) as n, min(chunk_id) filter (rank = 1) as first from r group by query_id""")
def source_lists(t: Tables) -> DataFrame:
    ranked = ev.rerank(hits(t), "score", "chunk_id")
    out = ev.source_list(ranked, ["chunk_id", "topic", "score"], "rank")
    return out.select("query_id", F.size("sources").cast("long").alias("n"), F.get_json_object(F.col("sources")[0], "$.chunk_id").cast("long").alias("first"))


@query("J10", HITS + """, r as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from h)
select query_id, chunk_id as doc_id, rank, score, quality from r join labels on chunk_id = doc_id""")
def retrieve_in_hit_order(t: Tables) -> DataFrame:
    ranked = ev.rerank(hits(t), "score", "chunk_id").withColumnRenamed("chunk_id", "doc_id")
    return rel.retrieve(ranked, t.labels, "doc_id").select("query_id", "doc_id", "rank", "score", "quality")


@query("X28 X29", r"""with b as (select item_id, list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), '\s+'), lambda w: w <> '') as w from benchmark),
 d as (select doc_id, list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), '\s+'), lambda w: w <> '') as w from documents),
 x as (select item_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) as s from b where len(w) >= 5),
 y as (select doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) as s from d where len(w) >= 5)
select item_id, count(distinct s) as shared from x join (select distinct s from y) using (s) group by item_id""")
def shingles_shared_with_benchmark(t: Tables) -> DataFrame:
    """Shingles of each benchmark item that occur in any document; texts of fewer than five words have none.

    Shingles go by 64-bit hashes, and only those that the benchmark holds leave the documents.
    """
    def parts(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, tx.shingle_print(tx.dedup_form(F.col("text"))).alias("p")).where("p.n >= 5").select(key, F.explode("p.set").alias("s"))

    bound_batches(t.spark)
    wanted = parts(t.benchmark, "item_id")
    known = parts(t.spread("documents", "doc_id"), "doc_id").select("s").join(wanted.select("s").distinct(), "s", "left_semi").distinct()
    return wanted.join(known, "s", "left_semi").groupBy("item_id").agg(F.count("*").alias("shared"))

"""Chunking of whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.operators import chunking as ch
from gristmill.operators import ordered
from gristmill.plans.registry import Tables, query

WINDOWS_SQL = r"""with w as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents),
 c as (select doc_id, unnest(list_transform(range(0, len(w), 170), lambda i: w[i + 1:i + 200])) as w, unnest(range(0, (len(w) + 169) // 170)) as n from w)"""


@query("X19", WINDOWS_SQL + " select doc_id, n as chunk_index, len(w) as words, sha256(array_to_string(w, ' ')) as chunk from c")
def word_windows(t: Tables) -> DataFrame:
    chunks = t.spread("documents", "doc_id").select("doc_id", F.posexplode(ch.word_windows(F.col("text"))).alias("n", "chunk"))
    return chunks.select("doc_id", F.col("n").cast("long").alias("chunk_index"),
                         tx.word_count(F.col("chunk")).cast("long").alias("words"), F.sha2("chunk", 256).alias("chunk"))


@query("X18", r"""with s as (select doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)),
   lambda x: trim(x, E' \n\t\r')), lambda x: x <> '')) as sentence from documents)
select doc_id, count(*) as sentences, max(length(sentence)) as longest from s group by doc_id""")
def sentence_split(t: Tables) -> DataFrame:
    rows = t.spread("documents", "doc_id").select("doc_id", F.explode(ch.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.length("s")).cast("long").alias("longest"))


@query("X18", r"""select doc_id, len(list_filter(regexp_split_to_array(text, '\n{2,}|\r\n{2,}'), lambda p: trim(p, E' \n\t\r') <> '')) as paragraphs from documents""")
def paragraph_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(ch.paragraphs(F.col("text"))).cast("long").alias("paragraphs"))


@query("X20 X21 X22 C9 X17")
def chunk_documents(t: Tables) -> DataFrame:
    return ch.chunk_table(t.spread("documents", "doc_id"), "doc_id", ["text", "lang"])


@query("A16", WINDOWS_SQL + """, p as (select doc_id, count(*) as n from c group by doc_id)
select (select count(*) from c) as chunks, (select round(avg(len(w)), 6) from c) as mean_words, (select min(len(w)) from c) as min_words,
  (select max(len(w)) from c) as max_words, round(avg(n), 6) as mean_chunks, max(n) as max_chunks, round(quantile_cont(n, 0.95), 6) as p95_chunks from p""")
def chunk_summary(t: Tables) -> DataFrame:
    chunks = t.spread("documents", "doc_id").select(F.col("doc_id").alias("record_id"), F.explode(ch.word_windows(F.col("text"))).alias("c"))
    out = ch.chunk_summary(chunks.withColumn("chunk_word_count", tx.word_count(F.col("c"))))
    return out.select("chunks", F.round("mean_words", 6).alias("mean_words"), F.col("min_words").cast("long").alias("min_words"),
                      F.col("max_words").cast("long").alias("max_words"), F.round("mean_chunks", 6).alias("mean_chunks"),
                      "max_chunks", F.round("p95_chunks", 6).alias("p95_chunks"))


@query("C9", "select o_orderkey, row_number() over (order by o_orderkey) - 1 as record_id from orders")
def dense_record_ids(t: Tables) -> DataFrame:
    return ordered.dense_index(t.orders.select("o_orderkey"), ["o_orderkey"], "record_id")

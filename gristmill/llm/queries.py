"""The named queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import (
    bpe, html_text, kmeans_tree, language, packing, positional_index, quality_rules, resampling, runs, simhash, suffix_dedup, warc, weak_quality,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def oracle(sql: str) -> Callable[[Callable], Callable]:
    """The same rows in DuckDB SQL."""
    def add(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        ORACLES[build.__name__] = sql
        return build

    return add


#: Plain words of a text as a DuckDB expression.
WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; learned where crc32(doc_id) mod 4 is not 2."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return language.identify(table(spark, folder, "documents"), held_out)


@query
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rule counts and the weakly supervised verdict for every document."""
    return quality_rules.judge(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


@query
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op4_weak_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score and verdict for every document."""
    return weak_quality.judge(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "score", "good")


@query
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to WARC archives and read back from them."""
    return warc.round_trip(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file, the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's token pieces and their places in sequences of 1024."""
    return packing.pack(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op5_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, folder, "pages"))


@query
def op8_kmeans_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest found of every query vector."""
    return kmeans_tree.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document and the bytes they decode to, as digests."""
    import public_tokenizers

    return bpe.round_trip(table(spark, folder, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What remains of every document without repeated strings of 100 bytes."""
    return suffix_dedup.remove_repeats(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
@oracle(f"""with d as (select doc_id, row_number() over () as r, {WORDS} as w from documents),
 b as (select item_id, w, least(10, len(w)) as size from (select item_id, {WORDS} as w from benchmark) where len(w) > 0),
 wanted as (select distinct item_id, size, array_to_string(w[i + 1:i + size], ' ') as gram from (select *, unnest(range(len(w) - size + 1)) as i from b)),
 grams as (select r, i, size, array_to_string(w[i + 1:i + size], ' ') as gram from (
   select d.r, d.w, s.size, unnest(range(len(d.w) - s.size + 1)) as i from d join (select distinct size from b) s on len(d.w) >= s.size)),
 met as (select r, i, g.size, item_id from grams g join wanted using (gram, size)),
 hit as (select r, count(distinct place) as n_hit from (select r, unnest(range(i, i + size)) as place from (select distinct r, i, size from met)) group by r),
 named as (select r, count(*) as n_items, string_agg(name, ',' order by name) as names from (select distinct r, item_id::varchar as name from met) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
 coalesce(n_hit, 0) > 0 as contaminated from d left join hit using (r) left join named using (r)""")
def op11_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document inside phrases of benchmark items, and which items these are."""
    found = positional_index.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where the texts of one document in ten, by its id, repeat a part of themselves to the end."""
    mark = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split("text", r"[ \x09-\x0D]+"), "")
    chosen = docs.select("doc_id", "text", F.floor(mark / 10).alias("g"), F.when(mark % 10 == 0, words).alias("w"))
    parts = chosen.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.pmod("g", "n")).cast("int"))
    parts = parts.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    whole = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return parts.select("doc_id", F.when(F.col("a").isNotNull(), whole).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words of every document, and its text without their repeats."""
    found = runs.find_runs(with_periodic_tails(table(spark, folder, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: CRC-32 of distinct words in DuckDB: the byte table, then a fold over the bytes.
CRC = """crc_table as (with recursive t(b, c, k) as (select b, b, 0 from range(256) r(b) union all
   select b, case when (c & 1) = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from t where k < 8) select list(c order by b) as l from t where k = 8),
 crcs as (select word, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(strlen(word)),
   lambda i: 16 * (strpos('0123456789ABCDEF', hex(word)[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', hex(word)[2 * i + 2]) - 1)),
   lambda c, b: xor(l[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) as crc from (select distinct word from every), crc_table)"""


@query
@oracle(f"""with d as (select doc_id, row_number() over () as r, {WORDS} as w from documents), b as (select {WORDS} as w from benchmark),
 every as (select r, word, 0 as target from (select r, unnest(w) as word from d) union all select 0, word, 1 from (select unnest(w) as word from b)),
 {CRC},
 placed as (select r, target, crc % 10000 as bucket from every join crcs using (word)),
 totals as (select count(*) filter (target = 0) as s_all, count(*) filter (target = 1) as t_all from placed),
 gains as (select bucket, floor(1000 * ln((t + 1)::double * (s_all + 10000)::double / ((s + 1)::double * (t_all + 10000)::double)))::bigint as gain from (
   select bucket, count(*) filter (target = 0) as s, count(*) filter (target = 1) as t from placed group by bucket), totals),
 weights as (select r, sum(gain)::bigint as weight from placed join gains using (bucket) where target = 0 group by r),
 scored as (select doc_id, r, len(w) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((
   (('0x' || sha256('2024:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5::double) / 4294967296::double))))::bigint as score from d left join weights using (r)),
 placed_docs as (select r, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when place <= 10 * n // 100 then place end as rank from scored left join placed_docs using (r)""")
def op13_importance_resample(spark: SparkSession, folder: str) -> DataFrame:
    """Importance weights of every document for the benchmark, and the ranks of those drawn."""
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")

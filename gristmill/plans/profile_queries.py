"""Profiles, keys, relationships and merges of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators import analyse as an
from gristmill.operators import profile as pf
from gristmill.operators import relations as rel
from gristmill.plans.registry import Tables, query

TEXT_DOCS = r"""select '{0}' as "column", count(*) as total_rows, count(*) - count({0}) as null_count, count(distinct {0}) as unique_count,
  round(avg(length({0})), 4) as avg_chars, round(quantile_cont(length({0}), 0.75), 4) as p75_chars, max(length({0})) as max_chars,
  round(quantile_cont(len(regexp_extract_all({0}, '[^\s]+')), 0.75), 4) as p75_words from documents"""


@query("P1", " union all ".join(TEXT_DOCS.format(c) for c in ("text", "lang", "source")))
def text_column_statistics(t: Tables) -> DataFrame:
    stats = pf.text_statistics(t.spread("documents", "doc_id").select("text", "lang", "source"))
    return stats.select("column", "total_rows", "null_count", "unique_count", F.round("avg_chars", 4).alias("avg_chars"),
                        F.round("p75_chars", 4).alias("p75_chars"), F.col("max_chars").cast("long").alias("max_chars"),
                        F.round("p75_words", 4).alias("p75_words"))


def ratio_sql(table: str, column: str, kind: str) -> str:
    return f"select '{table}' as \"table\", '{column}' as \"column\", '{kind}' as family, count(distinct {column}) / count({column}) as r, {'quantile_cont(length(' + column + '), 0.75)' if kind == 'textual' else 0} as p, {'quantile_cont(len(regexp_extract_all(' + column + ', ' + chr(39) + '[^ ]+' + chr(39) + ')), 0.75)' if kind == 'textual' else 0} as w from {table}"


ROLE_COLUMNS = {
    "customer": {"c_custkey": "numeric", "c_name": "textual", "c_nationkey": "numeric", "c_acctbal": "numeric", "c_mktsegment": "textual"},
    "documents": {"doc_id": "numeric", "text": "textual", "lang": "textual", "source": "textual", "n_chars": "numeric"},
    "events": {"event_id": "numeric", "ts": "temporal", "user_id": "numeric", "event_type": "textual", "value": "numeric", "props": "textual"},
}
ROLES = "with s as (" + " union all ".join(ratio_sql(t, c, k) for t, cs in ROLE_COLUMNS.items() for c, k in cs.items()) + """),
 b as (select *, case when family <> 'textual' then 'structured' when p >= 80 and w >= 10 then 'unstructured' else 'metadata' end as bucket from s),
 r as (select *, case when bucket = 'structured' then family when bucket = 'unstructured' then 'textual'
   when r >= 0.95 and p <= 40 then 'identifier' else 'categorical' end as role from b)"""


@query("P2 P3 P4", ROLES + ' select "table", "column", bucket, role, role = \'textual\' as searchable, role = \'numeric\' as aggregatable from r')
def column_roles(t: Tables) -> DataFrame:
    return pf.registry(t.named(*ROLE_COLUMNS)).select("table", "column", "bucket", "role", "searchable", "aggregatable")


POSITIONS = " ".join(f"when '{c}' then {i}" for cs in ROLE_COLUMNS.values() for i, c in enumerate(cs))


@query("P5", ROLES + f""" select "table", sha256("table" || '|' || string_agg("column" || ':' || role, '|' order by case "column" {POSITIONS} end))[1:16] as fingerprint from r group by "table" """)
def schema_fingerprint(t: Tables) -> DataFrame:
    return pf.fingerprint(pf.registry(t.named(*ROLE_COLUMNS)))


@query("P6", ROLES + """ select "table", arg_max("column", r) as primary_key from r where role = 'identifier' group by "table" """)
def key_by_uniqueness(t: Tables) -> DataFrame:
    return pf.key_by_uniqueness(pf.registry(t.named(*ROLE_COLUMNS)))


def profile_sql(table: str, column: str, numeric: bool) -> str:
    stats = (f"round(stddev_samp({column}), 3) as stddev, round(avg({column}), 4) as avg, cast(null as double) as avg_length" if numeric
             else f"cast(null as double), cast(null as double), round(avg(length(cast({column} as varchar))), 4)")
    return f"select '{column}' as \"column\", count(*) as row_count, count(*) - count({column}) as null_count, count(distinct {column}) as distinct_count, {stats} from {table}"


@query("P7", " union all ".join(profile_sql("orders", c, n) for c, n in (
    ("o_orderkey", True), ("o_custkey", True), ("o_totalprice", True), ("o_orderstatus", False), ("o_orderdate", False), ("o_orderpriority", False))))
def value_profile(t: Tables) -> DataFrame:
    out = pf.value_profile(t.orders, "orders")
    return out.select("column", "row_count", "null_count", "distinct_count", F.round("stddev", 3).alias("stddev"),
                      F.round("avg", 4).alias("avg"), F.round("avg_length", 4).alias("avg_length"))


def top_sql(table: str, column: str) -> str:
    return f"select '{column}' as \"column\", cast({column} as varchar) as value, count(*) as freq, row_number() over (order by count(*) desc, cast({column} as varchar)) as rank from {table} where {column} is not null group by {column}"


@query("P8", "select * from (" + " union all ".join(top_sql("part", c) for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size")) + ") where rank <= 5")
def top_values(t: Tables) -> DataFrame:
    return pf.top_values(t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))


def kind_sql(table: str, column: str, kind: str) -> str:
    whole, span = ("true", f"max({column})::double - min({column})::double") if kind == "int" else ("false", "0::double")
    return f"select '{table}' as tbl, '{column}' as col, '{kind}' as f, {whole} as whole, count(*) as n, count(distinct {column}) as d, {span} as span, {'avg(length(' + column + '))' if kind == 'text' else 'null'} as len from {table}"


KIND_COLUMNS = {
    "customer": {"c_custkey": "int", "c_name": "text", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "text"},
    "part": {"p_partkey": "int", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "int", "p_retailprice": "double"},
    "orders": {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "text", "o_totalprice": "double", "o_orderpriority": "text"},
}
KINDS = "with s as (" + " union all ".join(kind_sql(t, c, k) for t, cs in KIND_COLUMNS.items() for c, k in cs.items()) + """),
 h as (select *, case when n < 20 then 0.5::double else greatest(0.02::double, least(0.5::double, 1 / (1 + log10(greatest(n, 10) / 10)))) end as threshold,
   whole and span > 0 and d / (span + 1) >= 0.9 as dense, n > 1 and d = n as uniq from s),
 k as (select *, case when uniq and ((f = 'text' and len <= 40) or dense) then 'identifier'
   when d / n <= threshold and d <= greatest(500, floor(n * threshold)) then 'categorical' when f = 'text' then 'textual' else 'numeric' end as kind from h)"""


def kinds(t: Tables) -> DataFrame:
    parts = [pf.with_kind(pf.value_profile(df.select(*KIND_COLUMNS[name]), name)) for name, df in t.named(*KIND_COLUMNS).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("P9 P10 P11", KINDS + ' select tbl as "table", col as "column", kind, dense as is_dense, round(threshold, 6) as threshold from k')
def column_kinds(t: Tables) -> DataFrame:
    return kinds(t).select("table", "column", "kind", "is_dense", F.round(pf.categorical_threshold(F.col("row_count")), 6).alias("threshold"))


@query("P12", KINDS + """, u as (select *, row_number() over (partition by tbl order by kind <> 'identifier', coalesce(len, 0), col) as r from k where uniq)
select tbl as "table", col as "column", r = 1 as is_primary from u""")
def keys_of_tables(t: Tables) -> DataFrame:
    return pf.keys(kinds(t))


@query("P24", KINDS + " select round(0.7::double * count(*) filter (kind <> 'unknown') / count(*) + 0.3, 3) as score from k")
def understanding_score(t: Tables) -> DataFrame:
    return pf.understanding(kinds(t))


@query("P25", KINDS + ' select tbl as "table", coalesce(list_sort(list(col) filter (kind = \'numeric\')), []) as numeric_columns, coalesce(list_sort(list(col) filter (kind = \'identifier\')), []) as identifier_columns, coalesce(list_sort(list(col) filter (kind = \'categorical\')), []) as categorical_columns from k group by tbl')
def registry_view(t: Tables) -> DataFrame:
    return pf.registry_view(kinds(t)).select("table", "numeric_columns", "identifier_columns", "categorical_columns")


@query("P13 P14")
def discover_relationships(t: Tables) -> DataFrame:
    return rel.discover(rel.describe(t.named("region", "nation", "customer", "orders")))


KEYED = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "supplier": ["s_suppkey", "s_name", "s_nationkey"],
         "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]}
INCLUSION = "with c as (" + " union all ".join(
    f"select '{table}' as tbl, '{column}' as col, {'1' if column.endswith('key') else '2'} as family, {column}::varchar as v from {table} where {column} is not null"
    for table, columns in KEYED.items() for column in columns) + """), d as (select tbl, col, family, v, count(*) as n from c group by all),
 k as (select tbl, col, count(*) as distinct_values, count(*) = sum(n) as uniq from d group by all),
 m as (select a.tbl as from_table, a.col as from_column, b.tbl as to_table, b.col as to_column, count(*) as included from d a join d b on a.family = b.family and a.v = b.v and a.tbl <> b.tbl group by all)"""


@query("P13 P14 P15", INCLUSION + """ select from_table, from_column, to_table, to_column, x.distinct_values, included, included / x.distinct_values as ratio, y.uniq as to_unique
 from m join k x on x.tbl = from_table and x.col = from_column join k y on y.tbl = to_table and y.col = to_column""")
def inclusion_dependencies(t: Tables) -> DataFrame:
    return rel.inclusions(t.named(*KEYED))


@query("P13 J1 A1", "select r_name, count(*) as orders, count(distinct c_custkey) as customers from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name")
def orders_by_region_over_found_keys(t: Tables) -> DataFrame:
    """The joins follow keys that are discovered in the tables."""
    tables = t.named("region", "nation", "customer", "orders")
    path = rel.join_path(rel.foreign_keys(rel.inclusions(tables)), "orders", ["region"])
    return an.join_edges(tables, "orders", path).groupBy("r_name").agg(F.count("*").alias("orders"), F.count_distinct("c_custkey").alias("customers"))


PAIRS = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"),
         ("nation", "n_regionkey", "region", "r_regionkey"), ("orders", "o_custkey", "orders", "o_orderkey"),
         ("labels", "doc_id", "documents", "doc_id")]


@query("P15", " union all ".join(
    f"select '{lt}.{lc}' as candidate, count(*) as distinct_values, count(b.v) as included, round(count(b.v) / count(*), 6) as ratio from (select distinct {lc} as v from {lt}) a left join (select distinct {rc} as v from {rt}) b using (v)"
    for lt, lc, rt, rc in PAIRS))
def key_inclusion(t: Tables) -> DataFrame:
    parts = [rel.inclusion(getattr(t, lt), lc, getattr(t, rt), rc).select(
        F.lit(f"{lt}.{lc}").alias("candidate"), "distinct_values", "included", F.round("ratio", 6).alias("ratio")) for lt, lc, rt, rc in PAIRS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("P16", """with u as (select 'doc_id' as "column", count(distinct doc_id) / count(doc_id) as uniqueness from documents)
select "column", round(uniqueness, 6) as uniqueness, round(0.9 * 0.4 + uniqueness * 0.6, 6) as score from u where uniqueness >= 0.98""")
def identifier_columns(t: Tables) -> DataFrame:
    return pf.identifier_columns(t.documents).select("column", F.round("uniqueness", 6).alias("uniqueness"), F.round("score", 6).alias("score"))


@query("P17", """select round(count(*) / sum(n), 6) as ratio from (select user_id, event_type, count(*) as n from events group by all)""")
def composite_uniqueness(t: Tables) -> DataFrame:
    return pf.uniqueness(t.events, ["user_id", "event_type"]).select(F.round("ratio", 6).alias("ratio"))


@query("P19 T6", """select 'props' as "column", count(props) as filled, count(*) filter (not json_valid(props)) as unparsable from events
union all select 'broken', count(*), count(*) filter (event_id % 3 = 0) from events""")
def structure_report(t: Tables) -> DataFrame:
    broken = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    return pf.structure_report(t.events.withColumn("broken", broken), ["props", "broken"])


@query("P20", "select cast(sum(n - 1) as bigint) as duplicate_ids from (select l_orderkey, l_linenumber, count(*) as n from lineitem group by all)")
def duplicate_ids(t: Tables) -> DataFrame:
    return pf.duplicate_ids(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("P22", """select count(*) as row_count, 3::bigint as column_count, count(*) - count(distinct vec_id) as duplicate_ids, 0::bigint as missing_vectors,
  count(*) as vectors, 0::bigint as wrong_size from embeddings""")
def ingestion_report(t: Tables) -> DataFrame:
    return pf.ingestion_report(t.embeddings, ["vec_id"], "embedding", 64).select(
        "row_count", "column_count", "duplicate_ids", "missing_vectors", "vectors", "wrong_size")


def tag_sql(key: str, expression: str) -> str:
    return (f"select '{key}' as key, case when typeof({expression}) in ('BIGINT', 'INTEGER') then 'integer' when regexp_full_match(cast({expression} as varchar), "
            f"'\\d{{4}}-\\d{{2}}-\\d{{2}}') then 'datetime' else 'keyword' end as tag, length(cast({expression} as varchar)) as n from events")


@query("P23 T18", "with f as (" + " union all ".join(tag_sql(k, e) for k, e in (
    ("event_id", "event_id"), ("event_type", "event_type"), ("user_id", "user_id"), ("when", "strftime(ts, '%Y-%m-%d')"), ("props_text", "props"))) + """)
select key, min(tag) as type from f where not contains(key, 'text') group by key having count(distinct tag) = 1 and avg(n) <= 256""")
def indexable_fields(t: Tables) -> DataFrame:
    events = t.events.select("event_id", "event_type", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("when"),
                             F.col("props").alias("props_text"), F.from_json("props", "k int").alias("props"))
    return pf.indexable_fields(events.select(F.to_variant_object(F.struct("*")).alias("v")), "v")


@query("T16", """select 'source' as "column", count(*) filter (source is null or lower(trim(source)) in ('', 'nan', 'null', 'none', 'n/a', 'na', 'unknown', 'src1')) -
  count(*) filter (source = 'src1') as missing from documents union all select 'lang', count(*) filter (lang = 'en') from documents""")
def missing_values(t: Tables) -> DataFrame:
    return pf.missing_share(t.documents.select("source", F.when(F.col("lang") == "en", " N/A ").otherwise(F.col("lang")).alias("lang")))


@query("J3 J4", """select count(*) as rows, count(quality) as labelled, cast(sum(n_chars) as bigint) as chars from documents left join labels using (doc_id)""")
def merge_sources(t: Tables) -> DataFrame:
    merged = rel.merge_sources({"documents": t.documents, "labels": t.labels})
    return merged.agg(F.count("*").alias("rows"), F.count("quality").alias("labelled"), F.sum("n_chars").alias("chars"))


@query("J5", """with a as (select c_custkey, row_number() over (order by c_custkey) as r from customer),
 b as (select c_name, row_number() over (order by c_custkey) as r from customer) select c_custkey, c_name from a join b using (r)""")
def align_by_position(t: Tables) -> DataFrame:
    return rel.align(t.customer.select("c_custkey"), t.customer.select("c_custkey", "c_name"), "c_custkey").select("c_custkey", "c_name")


@query("J6", """select d.doc_id as chunk_id, d.lang, l.quality from documents d left join labels l using (doc_id)""")
def merge_intelligence(t: Tables) -> DataFrame:
    meta = t.documents.select(F.col("doc_id").alias("chunk_id"), "lang")
    return rel.merge_intelligence(meta, t.labels.select(F.col("doc_id").alias("chunk_id"), "quality", F.lit("x").alias("lang")))


@query("J8", "select o_orderkey, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def lookup_by_ids(t: Tables) -> DataFrame:
    ids = t.customer.filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    return rel.lookup(t.orders, "o_custkey", ids).select("o_orderkey", "o_totalprice")


@query("J9", """select v.vec_id, coalesce(q.quality, 0)::double as score, d.source from embeddings v join documents d on v.vec_id = d.doc_id left join labels q on q.doc_id = v.vec_id""")
def hits_with_metadata(t: Tables) -> DataFrame:
    """vec_id is paired with doc_id; labels give the score where there is one."""
    hits = t.embeddings.join(t.labels, F.col("vec_id") == F.col("doc_id"), "left").select(
        F.col("vec_id").alias("doc_id"), F.col("quality").cast("double").alias("score"))
    return rel.hits_with_metadata(hits, t.documents.select("doc_id", "source"), "doc_id").select(
        F.col("doc_id").alias("vec_id"), "score", "source")


@query("J12", "select event_id, user_id from events where user_id not in (select c_custkey from customer where c_nationkey < 12)")
def not_stored(t: Tables) -> DataFrame:
    stored = t.customer.filter(F.col("c_nationkey") < 12).select(F.col("c_custkey").alias("user_id"))
    return rel.not_stored(t.events.select("event_id", "user_id"), stored, ["user_id"])

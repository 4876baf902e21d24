"""Filter operators: comparisons, text, spec dicts, roles, payload trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.operators import filters as flt
from gristmill.plans.registry import Tables, query


@query("F3 T11", """
select event_id, event_type from events where try_cast(json_extract_string(props, '$.k') as double) > 70
  and try_cast(json_extract_string(props, '$.k') as double) <= 90.5""")
def filter_compare_cast(t: Tables) -> DataFrame:
    events = t.events.withColumn("k", F.get_json_object("props", "$.k"))
    test = flt.predicate("k", "gt", 70, numeric=True) & flt.predicate("k", "lte", 90.5, numeric=True)
    return events.filter(test).select("event_id", "event_type")


@query("F3 F4", """
select c_custkey, c_acctbal from customer where c_acctbal between 1000 and 2500.5 and c_custkey >= 100""")
def filter_between(t: Tables) -> DataFrame:
    test = flt.predicate("c_acctbal", "between", 1000, 2500.5, numeric=True) & flt.predicate("c_custkey", "gte", 100)
    return t.customer.filter(test).select("c_custkey", "c_acctbal")


@query("F5 F7", """
select p_partkey, p_brand, p_type from part where p_brand in ('Brand#1', 'Brand#17') and p_type != 'ECONOMY'
  and p_size not in (1, 2, 3) and p_name is not null""")
def filter_in_list(t: Tables) -> DataFrame:
    test = flt.both([
        flt.predicate("p_brand", "in_list", ["Brand#1", "Brand#17"]), flt.predicate("p_type", "neq", "ECONOMY"),
        flt.predicate("p_size", "not_in", [1, 2, 3]), flt.predicate("p_name", "is_not_null")])
    return t.part.filter(test).select("p_partkey", "p_brand", "p_type")


@query("F6", """
select p_partkey, p_name from part where contains(lower(p_name), 'ring') or starts_with(lower(p_name), 'red')
  or ends_with(lower(p_name), 'bolt')""")
def filter_text_contains(t: Tables) -> DataFrame:
    test = flt.any_of([flt.predicate("p_name", "contains", "RING"), flt.predicate("p_name", "startswith", "Red"),
                       flt.predicate("p_name", "endswith", "Bolt")])
    return t.part.filter(test).select("p_partkey", "p_name")


@query("F8", "select p_partkey, p_type, p_name from part where p_type like '%M%' and p_name ilike 'S%_ng'")
def filter_like(t: Tables) -> DataFrame:
    test = flt.predicate("p_type", "like", "%M%") & flt.predicate("p_name", "ilike", "S%_ng")
    return t.part.filter(test).select("p_partkey", "p_type", "p_name")


@query("F9 X32", """
select p_partkey, p_name from part where list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'widget')""")
def filter_array_contains(t: Tables) -> DataFrame:
    words = t.part.withColumn("words", tx.tokens(F.col("p_name")))
    return words.filter(flt.predicate("words", "array_contains", "widget")).select("p_partkey", "p_name")


@query("F10 F11", """
select o_orderkey, o_orderpriority, o_totalprice from orders where o_totalprice >= 100000 and o_totalprice <= 200000
  and o_orderpriority in ('1-URGENT', '2-HIGH') and contains(lower(o_orderpriority), 'h') and o_orderstatus = 'O'""")
def filter_spec(t: Tables) -> DataFrame:
    test = flt.from_spec(t.orders, {
        "o_totalprice": {"min": 100000, "max": 200000},
        "o_orderpriority": {"one_of": ["1-URGENT", "2-HIGH"], "like": "H"},
    }, {"o_orderstatus": "O"})
    return t.orders.filter(test).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("F12 D6", """
select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderdate >= '1997-01-01' and o_orderdate < '1998-01-01'
  and o_orderstatus in ('F', 'P') and o_totalprice >= 250000""")
def filter_by_role(t: Tables) -> DataFrame:
    tests = [flt.for_role("o_orderdate", {"year": 1997}, "temporal"),
             flt.for_role("o_orderstatus", ["F", "P"], "categorical"),
             flt.for_role("o_totalprice", {"gte": 250000}, "numeric")]
    return t.orders.filter(flt.both(tests)).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("F13", """
select doc_id, lang, source, n_chars from documents where lang in ('en', 'de') and n_chars >= 500
  and (source in ('src1', 'src2') or n_chars < 1500) and not (lang = 'de' and n_chars > 1000) and source not in ('src3')""")
def filter_tree(t: Tables) -> DataFrame:
    docs = t.documents
    test = flt.tree(docs, {
        "must": [{"lang": ["en", "de"]}, {"n_chars": {"gte": 500}}],
        "should": [{"source": ["src1", "src2"]}, {"n_chars": {"lt": 1500}}],
        "must_not": [{"must": [{"lang": "de"}, {"n_chars": {"gt": 1000}}]}, {"source": "src3"}, {"absent": 1}],
    })
    return docs.filter(test).select("doc_id", "lang", "source", "n_chars")


@query("F14", """
select event_id from events where value between 10 and 30 and event_type not in ('view')
  and list_contains([user_id, user_id + 1], 8)""")
def filter_tree_nested(t: Tables) -> DataFrame:
    events = t.events.withColumn("meta", F.struct(F.array(F.col("user_id"), F.col("user_id") + 1).alias("users")))
    test = flt.tree(events, {"value": (10, 30), "event_type": {"except": ["view"]}, "meta.users": 8})
    return events.filter(test).select("event_id")


@query("F15", "select c_custkey, c_name from customer where c_mktsegment = 'BUILDING' and c_nationkey = 7 order by c_custkey limit 100")
def filter_equal_limit(t: Tables) -> DataFrame:
    wanted = {"c_mktsegment": "BUILDING", "c_nationkey": 7, "c_name": None}
    test = flt.both([flt.predicate(k, "eq", v) for k, v in wanted.items() if v is not None])
    return t.customer.filter(test).orderBy("c_custkey").select("c_custkey", "c_name").limit(100)


@query("F16", "select doc_id, lang from documents where lower(cast(lang as varchar)) = 'en' and lower(source) = 'src4'")
def filter_equal_ignoring_case(t: Tables) -> DataFrame:
    test = flt.equal_text("lang", "EN") & flt.equal_text("source", "SRC4")
    return t.documents.filter(test).select("doc_id", "lang")


@query("F17", "select doc_id from documents where contains(lower(text), 'worthless')")
def keyword_search(t: Tables) -> DataFrame:
    return flt.keyword_search(t.documents, "Worthless").select("doc_id")


@query("F11", """
select o_orderkey, null_comment from (select o_orderkey, o_orderstatus, o_orderpriority, case when o_orderkey % 3 = 0 then null else o_orderpriority end as c,
  case when o_orderkey % 3 = 0 then null else o_orderpriority end is null as null_comment from orders)
where o_orderstatus not in ('F', 'P') and (o_orderpriority ilike '%h' or o_orderpriority ilike '%URGENT') and not (o_orderkey % 3 <> 0 and c is null)""")
def filter_spec_nulls(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("c", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")))
    urgent = flt.from_spec(rows, {"o_orderstatus": {"not_in": ["F", "P"]}, "o_orderpriority": {"ilike": "%urgent"}})
    high = flt.from_spec(rows, {"o_orderstatus": {"nin": ["F", "P"]}, "o_orderpriority": {"ilike": "%H"}})
    missing, filled = flt.from_spec(rows, {"c": {"is_null": True}}), flt.from_spec(rows, {"c": {"is_not_null": True}})
    return rows.filter((urgent | high) & (missing | filled)).select("o_orderkey", missing.alias("null_comment"))


@query("F18", "select s_suppkey, s_name, s_acctbal from supplier where s_acctbal < 0 order by s_suppkey limit 50")
def list_rows(t: Tables) -> DataFrame:
    return (t.supplier.filter(flt.from_spec(t.supplier, {"s_acctbal": {"<": 0}}))
            .select("s_suppkey", "s_name", "s_acctbal").orderBy("s_suppkey").limit(50))


@query("F19", """
with q as (select o_orderkey, case o_orderstatus when 'F' then 'orders above ' when 'O' then 'at most '
    when 'P' then 'minimum ' else 'near ' end || cast(cast(floor(o_totalprice) as bigint) as varchar) || ' total' as txt from orders),
 m as (select o_orderkey, regexp_extract(txt, '(?i)above\\s+(\\d+(?:\\.\\d+)?)', 1) a,
   regexp_extract(txt, '(?i)(?:at least|minimum|min)\\s+(\\d+(?:\\.\\d+)?)', 1) b,
   regexp_extract(txt, '(?i)(?:at most|maximum|max)\\s+(\\d+(?:\\.\\d+)?)', 1) c from q)
select o_orderkey, cast(nullif(a || b, '') as double) as gte, cast(nullif(c, '') as double) as lte from m""")
def numeric_range_phrases(t: Tables) -> DataFrame:
    lead = (F.when(F.col("o_orderstatus") == "F", "orders above ").when(F.col("o_orderstatus") == "O", "at most ")
            .when(F.col("o_orderstatus") == "P", "minimum ").otherwise("near "))
    text = F.concat(lead, F.floor("o_totalprice").cast("string"), F.lit(" total"))
    phrase = t.orders.withColumn("range", tx.numeric_range(text))
    return phrase.select("o_orderkey", "range.gte", "range.lte")

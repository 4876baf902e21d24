"""Cleaning, typing, sources and sinks over whole tables."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators import cleaning as cl
from gristmill.operators import dedup
from gristmill.operators import inference as inf
from gristmill.operators import profile as pf
from gristmill.plans.registry import Tables, query
from gristmill.session import shared_path
from gristmill.sources import readers, tables, writers


def as_text(df: DataFrame) -> DataFrame:
    """The table as a CSV reader without types would give it."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


@query("C2 U3", "select distinct l_returnflag, l_linestatus, l_quantity, l_discount from lineitem")
def drop_duplicate_rows(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", "l_discount").distinct()


GAPPY = """with g as (select event_id, case when event_id % 7 = 0 then null else '  ' || event_type || ' ' end as kind,
  case when event_id % 5 = 0 then null else value end as value from events),
 t as (select event_id, case when trim(kind) = 'view' then null else trim(kind) end as kind, value from g)"""


def gappy(t: Tables) -> DataFrame:
    nan = F.when(F.col("event_type") == "view", "nan").otherwise(F.col("event_type"))
    return t.events.select("event_id", F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("  "), nan, F.lit(" "))).alias(" Kind "),
                           F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"), F.lit(None).cast("string").alias("empty"))


@query("C1 C3 C4 C5 C6", GAPPY + """, m as (select kind as mk from t where kind is not null group by kind order by count(*) desc, kind limit 1)
select event_id, coalesce(kind, (select mk from m)) as kind, round(coalesce(value, (select median(value) from t)), 6) as value from t""")
def clean_table(t: Tables) -> DataFrame:
    return cl.clean(gappy(t)).withColumn("value", F.round("value", 6))


@query("C7", r"""select conv_id, turn, regexp_replace(text, '[^\x20-\x7E]', '', 'g') as text from conversations""")
def printable_text(t: Tables) -> DataFrame:
    return cl.printable(t.conversations.select("conv_id", "turn", "text"))


@query("C8", "select p_partkey as product_id, p_name as description, p_brand as brand, p_retailprice as price, p_size as details from part")
def canonical_names(t: Tables) -> DataFrame:
    raw = t.part.select(F.col("p_partkey").alias("SKU"), F.col("p_name").alias("Product_Description"), F.col("p_brand").alias("manufacturer"),
                        F.col("p_retailprice").alias("cost"), F.col("p_size").alias("details"))
    return cl.canonical_names(raw)


@query("C10", """select o_orderkey as record_id, o_totalprice, o_orderstatus from orders""")
def split_columns(t: Tables) -> DataFrame:
    buckets = {"o_totalprice": "structured", "o_orderstatus": "metadata"}
    parts = cl.split(t.orders.withColumnRenamed("o_orderkey", "record_id"), buckets)
    return parts["structured"].join(parts["metadata"], "record_id")


@query("C11", """select event_id, json_object('event_id', cast(event_id as varchar)) as payload from events where event_type = 'view'
union all select event_id, json_object('event_id', cast(event_id as varchar), 'event_type', event_type) from events where event_type <> 'view'""")
def payloads(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.when(F.col("event_type") == "view", "N/A").otherwise(F.col("event_type")).alias("event_type"))
    return rows.select("event_id", cl.payload(rows, ["event_id"]).alias("payload"))


@query("C12", """select event_id, cast(json_extract_string(props, '$.k') as integer) as "props.k", user_id as "who.user.id", [user_id] as "who.all" from events""")
def flatten_structs(t: Tables) -> DataFrame:
    nested = t.events.select("event_id", F.from_json("props", "k int").alias("props"),
                             F.struct(F.struct(F.col("user_id").alias("id")).alias("user"), F.array("user_id").alias("all")).alias("who"))
    return cl.flatten(nested)


@query("C12 T15", """select event_id, 'a.props.k' as path, json_extract_string(props, '$.k') as value from events
union all select event_id, 'a.kind', event_type from events""")
def flatten_to_rows(t: Tables) -> DataFrame:
    nested = t.events.select("event_id", F.to_variant_object(F.struct(F.struct(F.from_json("props", "k int").alias("props"),
                             F.col("event_type").alias("kind")).alias("a"))).alias("v"))
    return cl.flatten_rows(nested, "event_id", "v").select("event_id", "path", F.col("value").cast("string").alias("value"))


@query("C13", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as o_orderdate, o_orderstatus as raw from orders")
def sanitize_values(t: Tables) -> DataFrame:
    return cl.sanitize(t.orders.select("o_orderkey", "o_orderdate", F.encode("o_orderstatus", "UTF-8").alias("raw")))


@query("C14", "select doc_id as record_id, text as chunk_text, 'd' as document_type from documents")
def preferred_payload(t: Tables) -> DataFrame:
    rows = t.documents.select(F.lit(1).alias("extra"), F.lit("d").alias("document_type"), F.col("text").alias("chunk_text"), F.col("doc_id").alias("record_id"))
    return cl.preferred_payload(rows)


@query("T2 T3 T4 T5 T7 T8 T9 T10 T12 T13")
def inferred_types(t: Tables) -> DataFrame:
    """Types guessed from the texts of five tables."""
    parts = []
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"), ("customer", "c_custkey"), ("events", "event_id"), ("part", "p_partkey")):
        text = as_text(t.spread(name, key))
        guesses = inf.infer(text)
        parts.append(inf.schema_report(text, guesses).withColumn("table", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table", "column", "inferred", "row_count", "null_count", "distinct_count")


def int_type_sql(column: str) -> str:
    return (f"case when min({column}) >= -128 and max({column}) <= 127 then 'tinyint' when min({column}) >= -32768 and max({column}) <= 32767 then 'smallint' "
            f"when min({column}) >= -2147483648 and max({column}) <= 2147483647 then 'int' else 'bigint' end")


@query("T3 T14", " union all ".join(
    f"select '{c}' as \"column\", {int_type_sql(c)} as inferred, count(*) as row_count, count(distinct {c}) as distinct_count from lineitem"
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")))
def narrowest_integers(t: Tables) -> DataFrame:
    keys = as_text(t.spread("lineitem", "l_orderkey").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    return inf.schema_report(keys, inf.infer(keys)).select("column", "inferred", "row_count", "distinct_count")


@query("T4", """select 'l_quantity' as "column", case when bool_and(l_quantity = round(l_quantity)) then 'tinyint' else 'double' end as inferred from lineitem
union all select 'l_discount', case when bool_and(abs(l_discount * 100 - round(l_discount * 100)) <= 1e-6) then 'decimal(' || greatest(length(cast(cast(floor(max(l_discount)) as integer) as varchar)) + 2, 4) || ',2)' else 'double' end from lineitem
union all select 'l_extendedprice', case when bool_and(abs(l_extendedprice * 100 - round(l_extendedprice * 100)) <= 1e-6 + 1e-5 * abs(l_extendedprice * 100)) then 'decimal(' || greatest(length(cast(cast(floor(max(l_extendedprice)) as integer) as varchar)) + 2, 4) || ',2)' else 'double' end from lineitem""")
def float_types(t: Tables) -> DataFrame:
    numbers = t.lineitem.select("l_quantity", "l_discount", "l_extendedprice")
    return t.spark.createDataFrame([(g.column, g.kind) for g in inf.infer(numbers)], "column string, inferred string")


NOISY = """with n as (select l_orderkey, case l_linenumber % 4 when 0 then '$' || cast(cast(l_quantity as integer) as varchar) when 1 then '(' || cast(cast(l_quantity as integer) as varchar) || ')'
   when 2 then cast(cast(l_quantity as integer) as varchar) || '%' else ' ' || cast(cast(l_quantity as integer) as varchar) || ' ' end as price,
   case when l_returnflag = 'A' then 'Yes' when l_returnflag = 'N' then 'off' else 'maybe' end as flag, l_quantity, l_linenumber from lineitem)"""


@query("T8 T11 T2", NOISY + """
select l_orderkey, cast(case when l_linenumber % 4 = 1 then -l_quantity else l_quantity end as double) as price,
  case flag when 'Yes' then true when 'off' then false end as flag from n""")
def cast_noisy_text(t: Tables) -> DataFrame:
    q = F.col("l_quantity").cast("int").cast("string")
    step = F.col("l_linenumber") % 4
    price = (F.when(step == 0, F.concat(F.lit("$"), q)).when(step == 1, F.concat(F.lit("("), q, F.lit(")")))
             .when(step == 2, F.concat(q, F.lit("%"))).otherwise(F.concat(F.lit(" "), q, F.lit(" "))))
    flag = F.when(F.col("l_returnflag") == "A", "Yes").when(F.col("l_returnflag") == "N", "off").otherwise("maybe")
    return t.lineitem.select("l_orderkey", inf.as_number(price).alias("price"), inf.as_boolean(flag).alias("flag"))


@query("T9 T10 T11", """select o_orderkey, cast(o_orderdate as date) as day from orders""")
def cast_dates(t: Tables) -> DataFrame:
    text = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd").alias("day"))
    guesses = [g for g in inf.infer(text) if g.column == "day"]
    return text.select("o_orderkey", inf.cast(text, guesses[0]).alias("day"))


@query("T12", """select count(*) as total0, count(*) filter (try_cast(case when event_id % 50 = 0 then 'x' else cast(value as varchar) end as double) is null) as failed0 from events""")
def cast_failure_rate(t: Tables) -> DataFrame:
    text = t.events.select(F.when(F.col("event_id") % 50 == 0, "x").otherwise(F.col("value").cast("string")).alias("value"))
    return inf.cast_failures(text, [inf.Guess("value", "double")])


@query("T5 T6 T7", """select round(avg(case when regexp_full_match(md5(cast(event_id as varchar)), '[0-9a-f]{32}') then 1 else 0 end), 6) as hex,
  round(avg(case when json_valid(props) then 1 else 0 end), 6) as json, round(avg(case when regexp_matches(lpad(cast(user_id as varchar), 3, '0'), '^0[0-9]') then 1 else 0 end), 6) as zero_led from events""")
def text_shapes(t: Tables) -> DataFrame:
    def share(test):
        return F.round(F.avg(test.cast("double")), 6)

    return t.events.agg(share(F.md5(F.col("event_id").cast("string")).rlike("^[0-9a-f]{32}$")).alias("hex"),
                        share(F.try_parse_json("props").isNotNull()).alias("json"),
                        share(F.lpad(F.col("user_id").cast("string"), 3, "0").rlike(r"^0\d")).alias("zero_led"))


@query("T15 T17 T18", """select event_id, case when event_id % 3 = 0 then 'array' when event_id % 3 = 1 then 'integer' else 'object' end as tag,
  case when event_id % 3 = 0 then 2 else null end as size from events""")
def native_values(t: Tables) -> DataFrame:
    from gristmill.operators.vectors import parse_vector

    step = F.col("event_id") % 3
    cell = (F.when(step == 0, F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(", 1.5]")))
            .when(step == 1, F.col("user_id").cast("string")).otherwise(F.col("props")))
    size = F.when(parse_vector(F.col("cell")).isNotNull(), F.size(parse_vector(F.col("cell"))))
    return t.events.select("event_id", cell.alias("cell")).select("event_id", pf.value_tag(cl.native(F.col("cell"))).alias("tag"), size.alias("size"))


@query("S4 S11", "select r_regionkey, r_name from region order by r_regionkey limit 3")
def preview_table(t: Tables) -> DataFrame:
    return tables.preview(readers.read_table_file(t.spark, t.path("region")).orderBy("r_regionkey"), 3)


@query("S12 S17", "select o_orderstatus, count(*) as n from orders where o_totalprice > 50000 and o_orderpriority = '1-URGENT' group by o_orderstatus")
def parameterised_sql(t: Tables) -> DataFrame:
    return tables.run_sql(t.spark, "select o_orderstatus, count(*) as n from {orders} where o_totalprice > :low and o_orderpriority = :level group by o_orderstatus",
                          {"low": 50000, "level": "1-URGENT"}, orders=t.orders)


@query("S8", """with u as (select c_custkey, c_name, c_acctbal, 1 as version, 0 as fresh from customer union all
  select c_custkey, 'new ' || c_name, c_acctbal + 1, 2, 1 from customer where c_nationkey = 3)
select c_custkey, c_name, c_acctbal, version from u qualify row_number() over (partition by c_custkey order by version desc, fresh desc) = 1""")
def upsert_rows(t: Tables) -> DataFrame:
    stored = t.customer.select("c_custkey", "c_name", "c_acctbal", F.lit(1).alias("version"))
    changes = t.customer.filter(F.col("c_nationkey") == 3).select(
        "c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(2).alias("version"))
    return tables.upsert(stored, changes, ["c_custkey"], "version")


@query("S20", "select (select count(distinct doc_id) from documents) as expected, (select count(distinct doc_id) from labels) as stored, false as complete")
def reconcile_stage(t: Tables) -> DataFrame:
    return tables.reconcile(t.documents, t.labels, ["doc_id"])


@query("S1 S2 S14", "select n_nationkey, n_name, n_regionkey from nation")
def csv_round_trip(t: Tables) -> DataFrame:
    folder = shared_path(t.spark, "csv")
    writers.write_splits({"nation": t.nation}, folder, "csv")
    return inf.typed(readers.read_csv(t.spark, f"{folder}/nation", infer=False)).select(
        F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


def point_rows(t: Tables) -> DataFrame:
    """Embeddings as points whose key repeats every label and whose text is the document's."""
    docs = t.documents.select(F.col("doc_id").alias("vec_id"), "text")
    return t.embeddings.join(docs, "vec_id", "left").select("vec_id", F.concat(F.lit("k"), F.col("vec_id") % 97).alias("key"), F.col("text"), "embedding")


@query("S18 S21 E1 X26")
def point_accounting(t: Tables) -> DataFrame:
    return writers.accounting(writers.points(point_rows(t), "vec_id", "embedding", 64, ["key"]))


@query("E1 S18", "with f as (select text, min(doc_id) as doc_id from documents group by text) select doc_id from f")
def first_of_equal_texts(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("text_hash"))
    return dedup.keep_first(rows, "text_hash", "doc_id").select("doc_id")


@query("E1 X25", """select min(l_orderkey * 1000000 + n) as row_id from (select l_orderkey, l_returnflag, l_linestatus, l_quantity, l_discount, l_tax,
  row_number() over (partition by l_orderkey order by l_extendedprice, l_partkey, l_suppkey, l_linenumber) as n from lineitem) group by l_returnflag, l_linestatus, l_quantity, l_discount, l_tax""")
def first_of_equal_payloads(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    inner = Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber")
    rows = t.lineitem.withColumn("row_id", F.col("l_orderkey") * 1000000 + F.row_number().over(inner))
    names = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax"]
    return dedup.keep_first(rows, "composite_payload_hash", "row_id", names).select("row_id")


@query("E1", """with recursive e as (select row_number() over (order by event_id) as n, event_id, user_id as a, event_type || cast(event_id % 40 as varchar) as b from events),
 k(n, ids, hashes, event_id, keep) as (
  select 0::bigint, []::bigint[], []::varchar[], -1::bigint, false
  union all
  select e.n, case when list_contains(k.ids, e.a) or list_contains(k.hashes, e.b) then k.ids else list_append(k.ids, e.a) end,
    case when list_contains(k.ids, e.a) or list_contains(k.hashes, e.b) then k.hashes else list_append(k.hashes, e.b) end,
    e.event_id, not (list_contains(k.ids, e.a) or list_contains(k.hashes, e.b)) from k join e on e.n = k.n + 1)
select event_id from k where keep""")
def first_by_id_or_hash(t: Tables) -> DataFrame:
    """A row goes if its user or its type-and-number was kept before."""
    rows = t.events.select("event_id", F.col("user_id").alias("point_id"),
                           F.concat("event_type", (F.col("event_id") % 40).cast("string")).alias("text_hash"))
    return dedup.keep_first(rows, "primary_key_or_hash", "event_id").select("event_id")

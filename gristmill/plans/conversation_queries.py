"""Conversations, request metrics and streams run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import conversation as cv
from gristmill.operators import metrics as me
from gristmill.plans.registry import Tables, query
from gristmill.session import shared_path
from gristmill.streaming import ingest, memory, rates

SIZE = "greatest(length(text) // 4, 1)"


@query("W7", "select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 3")
def last_messages(t: Tables) -> DataFrame:
    return cv.last_messages(t.conversations, 3).select("conv_id", "turn", "role")


@query("W8 X3", f"""with s as (select conv_id, turn, sum({SIZE}) over (partition by conv_id order by turn desc) as used, row_number() over (partition by conv_id order by turn desc) as n from conversations)
select conv_id, turn from s where used <= 300 or n = 1""")
def messages_within_budget(t: Tables) -> DataFrame:
    return cv.within_budget(t.conversations, 300).select("conv_id", "turn")


@query("W9", "select conv_id, string_agg(upper(role[1:1]) || role[2:] || ': ' || text, chr(10) order by turn) as transcript from conversations group by conv_id")
def transcripts(t: Tables) -> DataFrame:
    return cv.transcript(t.conversations)


@query("W10", f"""with q as (select conv_id, max(turn) filter (role = 'user') as asked from conversations group by conv_id),
 s as (select c.conv_id, coalesce(sum({SIZE}) filter (role = 'system'), 0) as a, coalesce(sum({SIZE}) filter (role <> 'system' and turn = asked), 0) as b,
   coalesce(sum({SIZE}) filter (role <> 'system' and turn is distinct from asked), 0) as c from conversations c join q on c.conv_id = q.conv_id group by c.conv_id)
select conv_id, cast(a as bigint) as system_tokens, cast(b as bigint) as question_tokens, cast(c as bigint) as history_tokens,
  cast(2048 - (a + b + c + 512) as bigint) as available, 2048 - (a + b + c + 512) < 0 as over_budget from s""")
def budget_report(t: Tables) -> DataFrame:
    out = cv.budget_report(t.conversations, F.lit(0), 2048, 512)
    return out.select("conv_id", "system_tokens", "question_tokens", "history_tokens", "available", "over_budget")


@query("W11", """with f as (select user_id, props, min(event_id) as first, arg_max(value, event_id) as value from events group by all)
select user_id, props, value from f qualify row_number() over (partition by user_id order by first desc, props) <= 5""")
def latest_values(t: Tables) -> DataFrame:
    return cv.latest_values(t.events, "props", "value", 5, "user_id", "event_id").select("user_id", "props", "value")


@query("A18", """select event_type, count(*) as total_runs, count(*) filter (value < 20) as success_count, count(*) filter (value >= 20) as failure_count,
  round(avg(case when value < 20 then 1.0::double else 0 end), 4) as success_rate, round(avg(value), 2) as avg_latency from events group by event_type""")
def run_metrics(t: Tables) -> DataFrame:
    return me.run_metrics(t.events, "event_type", F.col("value") < 20, "value")


@query("A19", """with r as (select value from events order by ts desc, event_id desc limit 1000)
select count(*) as samples, round(avg(value), 6) as avg, min(value) as min, max(value) as max, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from r""")
def latency_summary(t: Tables) -> DataFrame:
    out = me.latency_summary(t.events, "value", [F.desc("ts"), F.desc("event_id")], 1000)
    return out.select("samples", F.round("avg", 6).alias("avg"), "min", "max", F.round("p95", 6).alias("p95"), F.round("p99", 6).alias("p99"))


@query("A20", "select round(count(*) filter (event_type = 'view') / count(*), 6) as ratio, round(avg(case when event_type = 'click' then value end), 4) as mean_wait from events")
def hit_ratio(t: Tables) -> DataFrame:
    return t.events.agg(F.round(me.ratio(F.col("event_type") == "view"), 6).alias("ratio"),
                        F.round(F.avg(F.when(F.col("event_type") == "click", F.col("value"))), 4).alias("mean_wait"))


@query("M4", """select event_id, count(*) over (partition by event_type order by epoch_us(ts) range between 3600000000 preceding and current row) as recent from events""")
def trailing_hour(t: Tables) -> DataFrame:
    return me.trailing_count(t.events, "event_type", "ts", 3600).select("event_id", "recent")


@query("M5", """select date_trunc('day', ts) as start, event_type, count(*) as requests, round(avg(value), 6) as mean, round(avg(case when value < 20 then 1.0::double else 0 end), 6) as success_rate from events group by all""")
def rolling_metrics(t: Tables) -> DataFrame:
    out = me.rolling_metrics(t.events, "event_type", "ts", "value", F.col("value") < 20)
    return out.select("start", "event_type", "requests", F.round("mean", 6).alias("mean"), F.round("success_rate", 6).alias("success_rate"))


def scratch(name: str) -> str:
    return shared_path(SparkSession.active(), name)


@query("M4", """with w as (select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as requests from events group by all)
select start, event_type, requests from w where start + interval 1 hour <= (select max(ts) - interval 10 minutes from events)""")
def stream_request_rate(t: Tables) -> DataFrame:
    """Hourly counts of a stream; windows the watermark has not closed are not out yet."""
    source = ingest.stream_table(t.spark, t.path("events"), t.events.schema)
    counts = rates.request_rate(source, "ts", "event_type", "1 hour", None, "10 minutes")
    out = scratch("rate")
    ingest.run_to_end(counts, f"{out}/data", f"{out}/state")
    return t.spark.read.parquet(f"{out}/data").select("start", "event_type", "requests")


@query("M5", """with w as (select date_trunc('day', ts) as start, event_type, count(*) as requests, round(avg(value), 6) as mean from events group by all)
select start, event_type, requests, mean from w where start + interval 1 day <= (select max(ts) - interval 10 minutes from events)""")
def stream_latency(t: Tables) -> DataFrame:
    source = ingest.stream_table(t.spark, t.path("events"), t.events.schema)
    out = scratch("latency")
    ingest.run_to_end(rates.latency(source, "ts", "event_type", "value", F.col("value") < 20, "1 day", "10 minutes"), f"{out}/data", f"{out}/state")
    return t.spark.read.parquet(f"{out}/data").select("start", "event_type", "requests", F.round("mean", 6).alias("mean"))


@query("M1 M2 S3", "select event_id, event_type, value from events")
def stream_ingest(t: Tables) -> DataFrame:
    """Ingests, then runs again from the same checkpoint, which must add nothing."""
    out = scratch("ingest")
    for _ in range(2):
        source = ingest.stream_table(t.spark, t.path("events"), t.events.schema)
        ingest.run_to_end(source.select("event_id", "event_type", "value"), f"{out}/data", f"{out}/state")
    return t.spark.read.parquet(f"{out}/data")


@query("M3 M7 E1", "select min(doc_id) as doc_id, sha256(text) as text_hash from documents where n_chars >= 100 group by text")
def stream_deduplicate(t: Tables) -> DataFrame:
    """Stores each text once; short texts go to the rejects."""
    out = scratch("dedup")
    source = ingest.stream_table(t.spark, t.path("documents"), t.documents.schema)
    rows = source.select("doc_id", F.sha2("text", 256).alias("text_hash"), "n_chars")
    ingest.deduplicate(rows, f"{out}/data", f"{out}/rejects", f"{out}/state", "doc_id", ["text_hash"], F.col("n_chars") >= 100)
    return t.spark.read.parquet(f"{out}/data").select("doc_id", "text_hash")


@query("M6", f"""with b as (select * from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 50),
 s as (select conv_id, turn, {SIZE} as n, sum({SIZE}) over (partition by conv_id order by turn desc) as used, row_number() over (partition by conv_id order by turn desc) as r from b)
select conv_id, count(*) as messages, cast(sum(n) as bigint) as tokens from s where used <= 400 or r = 1 group by conv_id""")
def stream_memory(t: Tables) -> DataFrame:
    out = scratch("memory")
    source = ingest.stream_table(t.spark, t.path("conversations"), t.conversations.schema)
    ingest.run_to_end(memory.bounded_memory(source, 50, 400), f"{out}/data", f"{out}/state")
    kept = t.spark.read.parquet(f"{out}/data")
    return kept.groupBy("conv_id").agg(F.max_by("messages", "version").alias("messages"), F.max_by("tokens", "version").alias("tokens"))


@query("W7 W8 M6", f"""with b as (select * from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 5),
 s as (select conv_id, turn, sum({SIZE}) over (partition by conv_id order by turn desc) as used, row_number() over (partition by conv_id order by turn desc) as r from b)
select conv_id, turn from s where used <= 400 or r = 1""")
def remember_messages(t: Tables) -> DataFrame:
    return cv.remember(t.conversations, 5, 400).select("conv_id", "turn")

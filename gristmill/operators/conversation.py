"""Bounded conversation memory as window operations over message tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import tokens_by_chars
from gristmill.operators.ordered import running_total

def last_messages(df: DataFrame, n: int, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Newest ``n`` messages per conversation; only ``n`` rows per
    conversation and task reach the shuffle (for n below Spark's limit of 1000)."""
    place = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))
    return df.withColumn("__n", place).filter(F.col("__n") <= n).drop("__n")


def within_budget(df: DataFrame, budget: int, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Newest messages whose tokens fit the budget; the newest always stays."""
    newest = df.groupBy(conv).agg(F.max(turn).alias(turn), F.lit(True).alias("__newest"))
    totals = running_total(df, [conv], [turn], tokens_by_chars(F.col(text)), "__used", descending=True)
    kept = totals.join(newest, [conv, turn], "left").filter((F.col("__used") <= budget) | F.coalesce("__newest", F.lit(False)))
    return kept.drop("__used", "__newest")


def remember(df: DataFrame, messages: int, tokens: int) -> DataFrame:
    return within_budget(last_messages(df, messages), tokens)


def transcript(df: DataFrame, messages: int | None = None, conv: str = "conv_id") -> DataFrame:
    """``Role: text`` lines of each conversation, or of its newest ``messages``."""
    line = F.concat(F.initcap("role"), F.lit(": "), F.col("text"))
    listed = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return (df if messages is None else last_messages(df, messages)).groupBy(conv).agg(
        F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("transcript"))


def budget_report(df: DataFrame, context: Column, limit: int = 32_768, reserved: int = 1024, conv: str = "conv_id") -> DataFrame:
    """Tokens per part of each conversation: system, question (newest user
    message), history (all other), context; and what is left."""
    size = tokens_by_chars(F.col("text"))
    asked = df.filter(F.col("role") == "user").groupBy(conv).agg(F.max("turn").alias("turn"), F.lit(True).alias("__asked"))
    rows = df.join(asked, [conv, "turn"], "left")
    part = F.when(F.col("role") == "system", "system").when(F.col("__asked"), "question").otherwise("history")
    sums = rows.groupBy(conv).agg(
        *[F.coalesce(F.sum(F.when(part == p, size)), F.lit(0)).alias(f"{p}_tokens") for p in ("system", "question", "history")],
        F.coalesce(F.sum(context), F.lit(0)).alias("context_tokens"))
    used = F.col("system_tokens") + F.col("question_tokens") + F.col("history_tokens") + F.col("context_tokens") + reserved
    return sums.withColumn("available", F.lit(limit) - used).withColumn("over_budget", F.col("available") < 0)


def latest_values(df: DataFrame, key: str, value: str, most: int | None = None, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Newest value per conversation and key, for all keys or the ``most`` that
    were first named last."""
    named = df.groupBy(conv, key).agg(F.min(turn).alias("__first"), F.max_by(value, turn).alias(value))
    if most is None:
        return named.drop("__first")
    place = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc("__first"), key))
    return named.withColumn("__n", place).filter(F.col("__n") <= most).drop("__n", "__first")

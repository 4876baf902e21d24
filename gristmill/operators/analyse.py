"""Spec-driven analytics: joins along edges, grouped metrics, shares, trends."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators import filters as flt
from gristmill.operators.ordered import join_same, most_frequent, percentiles

_ALL = "*"

#: Metrics that one hash aggregation answers together.
_SIMPLE = {
    "COUNT": lambda c: F.count("*") if c is None else F.count(c),
    "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max,
    "STDDEV": F.stddev_samp, "VARIANCE": F.var_samp,
    "COUNT_DISTINCT": F.count_distinct,
}
_NUMERIC = {"SUM", "AVG", "STDDEV", "VARIANCE"}


def number(name: str) -> Column:
    return F.col(name).try_cast("double")


def clean_alias(text: str) -> str:
    """Lower-case alias of letters, digits and single underscores."""
    words = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in text.lower()).split()
    return "_".join(words)


def join_edges(tables: dict[str, DataFrame], start: str, edges: list[tuple[str, str, str, str]]) -> DataFrame:
    """Inner equi-joins along (from_table, from_column, to_table, to_column).

    The strategy is left to Catalyst and AQE. A column whose name an earlier
    table has already is named ``<table>_<column>`` in the result (with more
    underscores if that is taken).
    """
    joined, seen = tables[start], {start}
    names = {(start, c): c for c in joined.columns}
    for left, left_col, right, right_col in edges:
        if left not in seen:
            left, left_col, right, right_col = right, right_col, left, left_col
        if left not in seen or right in seen:
            raise ValueError(f"edge {left}.{left_col} - {right}.{right_col} does not extend the join")
        added = tables[right]
        taken = {*joined.columns, *added.columns}
        for column in added.columns:
            name = column
            if column in joined.columns:
                name = f"{right}_{column}"
                while name in taken:
                    name += "_"
                taken.add(name)
            names[right, column] = name
        added = added.withColumnsRenamed({c: names[right, c] for c in added.columns if names[right, c] != c})
        joined = joined.join(added, F.col(names[left, left_col]) == F.col(names[right, right_col]), "inner")
        seen.add(right)
    return joined


def rate(column: str, contains: str | None = None) -> Column:
    """Percentage of rows whose flag is true, or whose text contains a value."""
    hit = F.col(column) if contains is None else flt.predicate(column, "contains", contains)
    return F.lit(100.0) * F.count_if(hit) / F.nullif(F.count("*"), F.lit(0))


def aggregate(df: DataFrame, dims: list[str], metrics: list[dict[str, Any]],
              rates: list[dict[str, Any]] | None = None) -> DataFrame:
    """Grouped metrics ``{"fn", "column", "alias", "p"}`` and derived rates.

    MEDIAN, PERCENTILE and MODE keep a group's values and are therefore
    computed by operators that spread them, then joined to the groups.
    """
    plain, ordered = [], []
    for m in metrics:
        fn, column = m["fn"].upper(), m.get("column")
        alias = clean_alias(m.get("alias") or f"{fn}_{column or 'rows'}")
        if fn in ("MEDIAN", "PERCENTILE", "MODE"):
            ordered.append((fn, column, alias, m.get("p", 0.5)))
            continue
        source = None if column is None else (number(column) if fn in _NUMERIC else F.col(column))
        plain.append(_SIMPLE[fn](source).alias(alias))
    plain += [rate(r["column"], r.get("contains")).alias(clean_alias(r["alias"])) for r in rates or []]
    base = df.groupBy(*dims).agg(*plain, *([F.count("*").alias("__rows")] if not plain else []))
    for fn, column, alias, p in ordered:
        part = (most_frequent(df, dims, column, alias) if fn == "MODE"
                else percentiles(df, dims, column, {alias: p}))
        if dims:
            base = join_same(base, part, dims, "left")
        else:
            # Both sides are the single row of a global aggregate.
            base = base.withColumn("__one", F.lit(1)).join(part.withColumn("__one", F.lit(1)), "__one", "left").drop("__one")
    return base.drop("__rows")


def analyse(tables: dict[str, DataFrame], spec: dict[str, Any]) -> DataFrame:
    """Runs a plain dict: table, joins, where, dimensions, metrics, rates,
    having [(alias, operator, value)], sort [(name, "asc"|"desc")], limit."""
    df = join_edges(tables, spec["table"], spec.get("joins", []))
    if spec.get("where"):
        df = df.filter(flt.from_spec(df, spec["where"]))
    dims = list(spec.get("dimensions", []))
    if spec.get("metrics") or spec.get("rates"):
        df = aggregate(df, dims, spec.get("metrics", []), spec.get("rates"))
        for alias, operator, value in spec.get("having", []):
            df = df.filter(flt.predicate(alias, flt.OPERATOR_ALIASES[operator], value))
    elif dims:
        df = df.select(*dims).distinct()
    else:
        raise ValueError("the spec names neither metrics nor dimensions")
    if spec.get("sort"):
        df = order(df, spec["sort"])
    return df.limit(spec["limit"]) if spec.get("limit") else df


def order(df: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    return df.orderBy(*[F.col(n).desc() if d == "desc" else F.col(n).asc() for n, d in fields])


def measure(df: DataFrame, fn: str, column: str, group: str | None = None) -> DataFrame:
    """One aggregate of the rows whose value is a number, alias ``fn_column``."""
    alias = f"{fn.lower()}_{column}"
    rows = df.filter(number(column).isNotNull()).withColumn("__m", number(column))
    dims = [group] if group else []
    out = aggregate(rows, dims, [{"fn": fn, "column": "__m", "alias": alias}])
    return order(out, [(alias, "desc")]) if group else out


def count_rows(df: DataFrame, group: str | None = None, name: str = "row_count") -> DataFrame:
    counted = df.groupBy(*([group] if group else [])).agg(F.count("*").alias(name))
    return order(counted, [(name, "desc"), (group, "asc")]) if group else counted


def distinct_values(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    values = df.select(column).distinct().orderBy(column)
    return values.limit(limit) if limit else values


def share(df: DataFrame, group: str, limit: int | None = None) -> DataFrame:
    """Rows per group and their percentage; the window runs over the groups."""
    counts = df.groupBy(group).agg(F.count("*").alias("row_count"))
    out = counts.withColumn(
        "percentage",
        F.round(F.lit(100.0) * F.col("row_count") / F.sum("row_count").over(Window.partitionBy()), 2),
    )
    out = order(out, [("percentage", "desc"), (group, "asc")])
    return out.limit(limit) if limit else out


def ranked(df: DataFrame, column: str, tie: str, limit: int, descending: bool = True) -> DataFrame:
    """Top or bottom rows by a number; rows without one are left out."""
    rows = df.filter(number(column).isNotNull())
    key = number(column).desc() if descending else number(column).asc()
    return rows.orderBy(key, F.col(tie)).limit(limit)


# --- time -------------------------------------------------------------------


def bucket(column: Column, granularity: str) -> Column:
    """Text label of the period a time falls into; weeks start on Monday and
    days before the first Monday are week 00."""
    week = F.floor((F.dayofyear(column) + 6 - F.weekday(column)) / 7)
    year = F.date_format(column, "yyyy")
    labels = {
        "hour": F.date_format(column, "yyyy-MM-dd HH:'00'"),
        "day": F.date_format(column, "yyyy-MM-dd"),
        "week": F.concat(year, F.lit("-"), F.lpad(week.cast("string"), 2, "0")),
        "month": F.date_format(column, "yyyy-MM"),
        "quarter": F.concat(year, F.lit("-Q"), F.quarter(column).cast("string")),
        "year": year,
    }
    return labels[granularity]


def granularity_of(first: Column, last: Column) -> Column:
    """Granularity that suits the span between two times."""
    days = F.floor((F.unix_seconds(last.cast("timestamp")) - F.unix_seconds(first.cast("timestamp"))) / 86400)
    return (
        F.when(days.isNull(), "month").when(days <= 3, "hour").when(days <= 90, "day")
        .when(days <= 730, "week").when(days <= 2920, "month").when(days <= 10950, "quarter")
        .otherwise("year")
    )


def trend(df: DataFrame, time: str, granularity: str, value: str | None = None,
          moving_average: int | None = None, change: bool = False) -> DataFrame:
    """Totals per period with optional moving average and change in percent.

    The windows see one row per period, never the input rows.
    """
    name = "period_value" if value else "row_count"
    total = F.sum(number(value)) if value else F.count("*")
    out = df.groupBy(bucket(F.col(time), granularity).alias("period")).agg(total.alias(name))
    by_period = Window.orderBy("period")
    previous = F.lag(name).over(by_period)
    if moving_average:
        out = out.withColumn("moving_average", F.avg(name).over(by_period.rowsBetween(1 - moving_average, 0)))
    if change:
        out = out.withColumn("pct_change", F.round(F.lit(100.0) * (F.col(name) - previous) / F.nullif(previous, F.lit(0)), 2))
    return out.orderBy("period")

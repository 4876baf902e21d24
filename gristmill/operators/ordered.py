"""Whole-table order operators that never gather one group in one task.

A row number over a whole table, a running total within a key that may own a
third of the rows, or an exact percentile cannot use a plain window: one task
would sort the whole group. Here the leading order key is cut into pieces, as
many as the number of rows asks for: first at approximate quantiles, from a
sketch that tasks merge, then evenly between two quantiles. Any cuts give the
same result, they only set the balance. Each piece is ordered by itself, and
sums over pieces are added up per quantile range first, then inside each range,
so no table of offsets meets in one task either.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a piece should hold, and the most quantile ranges.
PIECE_ROWS, RANGES = 100_000, 512


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on equally named keys where null equals null."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    condition = reduce(
        lambda a, b: a & b,
        [left[k].eqNullSafe(renamed[f"__right_{k}"]) for k in keys],
    )
    return left.join(renamed, condition, how).drop(*[f"__right_{k}" for k in keys])


def _as_number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    raise ValueError(f"order key {name} must lead with a number, date or timestamp, not {kind.simpleString()}")


@dataclass(frozen=True)
class Cuts:
    """Where the pieces of an order key begin: quantile ranges, each in ``steps`` even steps."""

    least: float
    inner: list[float]
    most: float
    steps: int

    @property
    def pieces(self) -> int:
        return (len(self.inner) + 1) * self.steps


def cut_points(df: DataFrame, name: str, piece_rows: int = PIECE_ROWS, around: tuple[float, ...] = ()) -> Cuts:
    """Cuts for pieces of about ``piece_rows`` rows; two more ranges close in on each rank of ``around``."""
    keys = df.select(_as_number(df, name).alias("k"))
    pieces = max(1, -(-df.count() // piece_rows))
    ranges = min(pieces, RANGES)
    marks, error = [i / ranges for i in range(1, ranges)], 0.25 / ranges
    if around:
        error = min(error, 0.0005)
        marks += [m for p in around for m in (p - 2 * error, p + 2 * error) if 0 < m < 1]
    found = keys.stat.approxQuantile("k", [0.0, *marks, 1.0], error) or [0.0, 0.0]
    return Cuts(min(found), sorted(set(found[1:-1])), max(found), -(-pieces // ranges))


def with_piece(df: DataFrame, number: Column, cuts: Cuts) -> DataFrame:
    """Adds ``__range`` and ``__piece``, into which a number falls (null: the first of each)."""

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN __key <= {_literal(cuts.inner[mid])} THEN {tree(lo, mid)} ELSE {tree(mid + 1, hi)} END"

    out = df.withColumn("__key", number).withColumn("__range", F.expr(f"CASE WHEN __key IS NULL THEN 0 ELSE {tree(0, len(cuts.inner))} END"))
    if cuts.steps == 1:
        return out.withColumn("__piece", F.col("__range")).drop("__key")
    edges = [cuts.least, *cuts.inner, cuts.most]
    low, high = (F.element_at(F.lit(e), F.col("__range") + 1) for e in (edges[:-1], edges[1:]))
    share = (F.col("__key") - low) / F.nullif(high - low, F.lit(0.0))
    step = F.when(F.isnan(share), cuts.steps - 1).otherwise(F.least(F.greatest(F.floor(share * cuts.steps), F.lit(0)), F.lit(cuts.steps - 1)))
    return out.withColumn("__piece", F.col("__range") * cuts.steps + F.coalesce(F.when(F.col("__key").isNotNull(), step), F.lit(0)).cast("int")).drop("__key")


def _literal(number: float) -> str:
    return f"{number!r}D" if math.isfinite(number) else f"double('{number!r}')"


def _sums_before(sums: DataFrame, keys: list[str], name: str, descending: bool = False) -> DataFrame:
    """``__before``: per key the sum of ``name`` over the pieces before each piece.

    Ranges are added up first, pieces then inside their range.
    """
    def before(over: list[str], by: str) -> Window:
        window = Window.partitionBy(*over) if over else Window
        return window.orderBy(*_ordering([by], descending)).rowsBetween(Window.unboundedPreceding, -1)

    ranges = sums.groupBy(*keys, "__range").agg(F.sum(name).alias("__s")).withColumn("__past", F.sum("__s").over(before(keys, "__range"))).drop("__s")
    inside = sums.withColumn("__here", F.sum(name).over(before([*keys, "__range"], "__piece")))
    # null where nothing that counts came before
    total = F.when(F.col("__past").isNull(), F.col("__here")).otherwise(F.col("__past") + F.coalesce("__here", F.lit(0)))
    return join_same(inside, ranges, [*keys, "__range"]).withColumn("__before", total).drop("__here", "__past")


def _ordering(order: list[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def dense_index(df: DataFrame, order: list[str], name: str, start: int = 0,
                descending: bool = False, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Consecutive numbers by a total order over the whole table.

    The columns of ``order`` should identify a row, else ties are numbered
    arbitrarily; the first one must be numeric or temporal.
    """
    tagged = with_piece(df, _as_number(df, order[0]), cut_points(df, order[0], piece_rows))
    sizes = tagged.groupBy("__range", "__piece").agg(F.count("*").alias("__n"))
    offsets = _sums_before(sizes, [], "__n", descending).select("__piece", F.coalesce("__before", F.lit(0)).alias("__before"))
    within = Window.partitionBy("__piece").orderBy(*_ordering(order, descending))
    return (
        tagged.withColumn("__place", F.row_number().over(within)).join(offsets, "__piece")
        .withColumn(name, (F.col("__place") + F.col("__before") + (start - 1)).cast("long"))
        .drop("__range", "__piece", "__place", "__before")
    )


def page(df: DataFrame, order: list[str], number: int, size: int, descending: bool = False) -> DataFrame:
    """One page (from 1) of at most 1000 rows by a total order."""
    if number < 1 or not 1 <= size <= 1000:
        raise ValueError("page starts at 1 and page_size is 1 to 1000")
    first = (number - 1) * size
    return (
        dense_index(df, order, "__at", descending=descending)
        .filter(F.col("__at").between(first, first + size - 1)).drop("__at")
    )


def running_total(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str,
                  descending: bool = False, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Sum of ``value`` over the rows of the same key up to and with this one."""
    tagged = with_piece(df.withColumn("__value", value), _as_number(df, order[0]), cut_points(df, order[0], piece_rows))
    sums = tagged.groupBy(*keys, "__range", "__piece").agg(F.sum("__value").alias("__sum"))
    before = _sums_before(sums, keys, "__sum", descending).drop("__sum", "__range")
    within = (
        Window.partitionBy(*keys, "__piece").orderBy(*_ordering(order, descending))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = tagged.withColumn("__local", F.sum("__value").over(within))
    return (
        join_same(local, before, [*keys, "__piece"])
        .withColumn(name, F.coalesce(F.col("__before"), F.lit(0)) + F.col("__local"))
        .drop("__value", "__range", "__piece", "__before", "__local")
    )


def most_frequent(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Mode per key (smallest value on ties) from a table of counts, so that a
    group's distinct values are spread over the cluster and never in one buffer."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    best = F.min_by("__v", F.struct((-F.col("__n")).alias("n"), F.col("__v").alias("v")))
    return counts.groupBy(*keys).agg(best.alias(name))


def percentiles(df: DataFrame, keys: list[str], value: str, marks: dict[str, float], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Exact linear-interpolated percentiles per key.

    The values are counted, cut into pieces, and only the pieces that hold a
    wanted rank are ordered; no buffer ever holds a group's values.
    """
    data = df.select(*keys, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    cuts = cut_points(data, "__v", piece_rows, tuple(marks.values()))
    counts = (
        with_piece(data, F.col("__v"), cuts).groupBy(*keys, "__range", "__piece", "__v")
        .agg(F.count("*").alias("__n"))
    )
    sizes = counts.groupBy(*keys, "__range", "__piece").agg(F.sum("__n").alias("__size"))
    totals = sizes.groupBy(*keys).agg(F.sum("__size").alias("__total"))
    sizes = _sums_before(sizes, keys, "__size").drop("__range").withColumn("__before", F.coalesce("__before", F.lit(0)))
    sizes = join_same(sizes, totals, keys) if keys else sizes.withColumn("__one", F.lit(1)).join(totals.withColumn("__one", F.lit(1)), "__one").drop("__one")
    last = F.col("__total") - 1
    lower = {n: F.floor(last * p) for n, p in marks.items()}
    upper = {n: F.ceil(last * p) for n, p in marks.items()}
    wanted = [t for n in marks for t in (lower[n], upper[n])]
    holds = reduce(lambda a, b: a | b, [t.between(F.col("__before"), F.col("__before") + F.col("__size") - 1) for t in wanted])
    within = Window.partitionBy(*keys, "__piece").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        join_same(counts.drop("__range"), sizes.filter(holds), [*keys, "__piece"])
        .withColumn("__hi", F.col("__before") + F.sum("__n").over(within) - 1)
        .withColumn("__lo", F.col("__hi") - F.col("__n") + 1)
    )

    def at(rank: Column) -> Column:
        return F.max(F.when(rank.between(F.col("__lo"), F.col("__hi")), F.col("__v")))

    picked = ranked.groupBy(*keys).agg(
        *[at(lower[n]).alias(f"__a_{n}") for n in marks], *[at(upper[n]).alias(f"__b_{n}") for n in marks],
        F.max("__total").alias("__total"),
    )
    return picked.select(*keys, *[
        (F.col(f"__a_{n}") + (F.col(f"__b_{n}") - F.col(f"__a_{n}")) * (last * p - F.floor(last * p))).alias(n)
        for n, p in marks.items()
    ])

"""Types of untyped columns: one aggregation tests all candidates at once.

Short texts are tested once for each distinct value of a column, weighted by
their rows; longer ones are tested row by row and never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.operators import profile as pf
from gristmill.session import shared_path

# Tokens, patterns, formats and limits of the inference.
TRUE_TOKENS = ["true", "t", "yes", "y", "1", "on", "enabled", "active"]
FALSE_TOKENS = ["false", "f", "no", "n", "0", "off", "disabled", "inactive"]
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
CURRENCY = "$€£¥₹"
_FRACTION = ".[SSSSSS][SSSSS][SSSS][SSS][SS][S]"
#: Pattern in Spark's letters, shape of a text that may fit, whether it is a date only.
TIME_FORMATS = [
    ("yyyy-M-d", r"\d{4}-\d{1,2}-\d{1,2}", True),
    ("yyyy/M/d", r"\d{4}/\d{1,2}/\d{1,2}", True),
    ("M/d/yyyy", r"\d{1,2}/\d{1,2}/\d{4}", True),
    ("d/M/yyyy", r"\d{1,2}/\d{1,2}/\d{4}", True),
    ("d-M-yyyy", r"\d{1,2}-\d{1,2}-\d{4}", True),
    ("M-d-yyyy", r"\d{1,2}-\d{1,2}-\d{4}", True),
    ("yyyy-M-d'T'H:m:s", r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}", False),
    ("yyyy-M-d'T'H:m:s" + _FRACTION, r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}", False),
    ("yyyy-M-d H:m:s", r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}", False),
    ("yyyy-M-d H:m:s" + _FRACTION, r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}", False),
    ("M/d/yyyy H:m:s", r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}", False),
    ("d/M/yyyy H:m:s", r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}", False),
    ("yyyyMMdd", r"\d{8}", True),
    ("d MMM yyyy", r"\d{1,2} [A-Za-z]{3} \d{4}", True),
    ("MMMM d, yyyy", r"[A-Za-z]+ \d{1,2}, \d{4}", True),
    ("d MMM yyyy H:m:s", r"[A-Za-z]{3}, \d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{1,2}:\d{1,2}", False),
]
_SHAPES = {pattern: shape for pattern, shape, _ in TIME_FORMATS}
#: Shape of a text the flexible parser may accept.
_ANY_TIME = r"\d{4}-\d{1,2}(-\d{1,2}([T ].*)?)?"
TOLERANCE = 0.02
#: Number columns tested together.
COLUMNS_PER_PASS = 8


@dataclass(frozen=True)
class Guess:
    """Inferred type of a column and how to reach it."""

    column: str
    kind: str
    format: str | None = None
    notes: tuple[str, ...] = field(default_factory=tuple)


def narrowest_integer(low: int, high: int) -> str:
    for name, bits in (("tinyint", 8), ("smallint", 16), ("int", 32), ("bigint", 64)):
        if -(2 ** (bits - 1)) <= low and high < 2 ** (bits - 1):
            return name
    return "decimal(38,0)" if -(10 ** 38) < low and high < 10 ** 38 else "string"


def unsigned_text(cell: Column) -> Column:
    """Number text without currency, separators, percent and accounting brackets."""
    bare = F.regexp_replace(F.trim(cell), rf"[,%\s{CURRENCY}]", "")
    return F.regexp_replace(bare, r"^\((.*)\)$", "-$1")


def as_number(cell: Column) -> Column:
    return unsigned_text(cell).try_cast("double")


def as_boolean(cell: Column) -> Column:
    low = F.lower(F.trim(cell.cast("string")))
    return F.when(low.isin(TRUE_TOKENS), True).when(low.isin(FALSE_TOKENS), False)


def as_time(cell: Column, pattern: str | None) -> Column:
    """Time of a text in one format, or in any ISO-like one. The shape is
    tested first: a failed parse costs far more than a failed match."""
    text = F.trim(cell)
    if pattern is None:
        return F.when(text.rlike(f"^({_ANY_TIME})$"), text.try_cast("timestamp_ntz"))
    bare = F.regexp_replace(text, r"^[A-Za-z]{3}, ", "")
    parsed = F.try_to_timestamp(bare, F.lit(pattern)).cast("timestamp_ntz")
    return F.when(text.rlike(f"^({_SHAPES[pattern]})$"), parsed)


def _values(df: DataFrame, names: list[str]) -> DataFrame:
    """column, value, rows: the filled texts of these columns. Short ones are counted once and
    stored; texts of more than ``DIGEST_OVER`` characters stay rows of their own."""
    every = pf.cells(df.select(*[F.col(f"`{n}`") for n in names])).where(F.col("value").isNotNull())
    short = F.length("value") <= pf.DIGEST_OVER
    path = shared_path(df.sparkSession, "values")
    counted = every.where(short).groupBy("column", "value").agg(F.count("*").alias("rows"))
    counted.write.parquet(path)
    return df.sparkSession.read.schema(counted.schema).parquet(path).unionByName(every.where(~short).withColumn("rows", F.lit(1).cast("long")))


def _rows(test: Column) -> Column:
    """Rows of the values for which the test is true."""
    return F.coalesce(F.sum(F.when(test, F.col("rows"))), F.lit(0))


def _views(values: DataFrame) -> DataFrame:
    """Derived columns of the values, in layers, each computed once."""
    out = values.withColumn("text", F.nullif(F.trim("value"), F.lit("")))
    out = out.withColumn("bare", unsigned_text(F.col("text")))
    out = out.withColumn("numeric", F.col("bare").rlike(r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"))
    return out.withColumn("number", F.when(F.col("numeric"), F.col("bare").try_cast("double")))


def _tests() -> dict[str, Column]:
    """Aggregates that settle every kind but dates and times."""
    text, bare, numeric, value = [F.col(n) for n in ("text", "bare", "numeric", "number")]
    fraction = F.when(numeric, F.length(F.nullif(F.regexp_extract(bare, r"\.(\d+)$", 1), F.lit(""))))
    json_text = text.rlike(r"^[{\[]")
    return {
        "filled": F.sum("rows"), "n": _rows(text.isNotNull()), "other_tokens": _rows(~F.lower(text).isin(TRUE_TOKENS + FALSE_TOKENS)),
        "uuids": _rows(text.rlike(UUID)), "json_like": _rows(json_text),
        "json_ok": _rows(json_text & F.try_parse_json(text).isNotNull()),
        "zero_led": _rows(text.rlike(r"^0\d")), "numbers": _rows(numeric),
        "not_whole": _rows(value != F.round(value)), "low": F.min(value), "high": F.max(value),
        "scale": F.max(fraction), # One bit per number of decimals seen.
        "scales": F.bit_or(F.pow(F.lit(2.0), F.least(fraction, F.lit(40))).cast("long")),
        "digits": F.max(F.when(numeric, F.length(F.regexp_extract(bare, r"^[+-]?(\d+)", 1)))),
        "currency": _rows(text.rlike(f"[{CURRENCY}]")), "percent": _rows(text.endswith("%")),
    }


def _time_tests() -> dict[str, Column]:
    """Hits per format, and of the flexible parser."""
    text = F.nullif(F.trim("value"), F.lit(""))
    flexible = as_time(text, None)
    tests = {f"format{k}": _rows(as_time(text, pattern).isNotNull()) for k, (pattern, _, _) in enumerate(TIME_FORMATS)}
    return {**tests, "flexible": _rows(flexible.isNotNull()), "timed": _rows(flexible != F.date_trunc("day", flexible))}


def _by_column(values: DataFrame, tests: dict[str, Column]) -> dict[str, dict]:
    """Results of the tests for each column with a filled value."""
    found = values.groupBy("column").agg(*[c.alias(n) for n, c in tests.items()]).collect()
    return {r["column"]: r.asDict() for r in found}


def _decide_text(name: str, r: dict) -> Guess | None:
    """The kind, or None where only dates and times are left."""
    n = r["n"]
    if not n:
        return Guess(name, "string", notes=("only empty values",))
    if not r["other_tokens"]:
        return Guess(name, "boolean")
    if r["uuids"] / n >= 0.98:
        return Guess(name, "uuid")
    if r["json_like"] / n >= 0.9 and r["json_ok"] / r["json_like"] >= 0.95:
        return Guess(name, "json")
    if r["zero_led"] / n > TOLERANCE:
        return Guess(name, "string", notes=("leading zeros kept",))
    if r["numbers"] / n >= 0.95:
        notes = tuple(text for count, text in ((r["currency"], "currency stripped"), (r["percent"], "percent stripped")) if count)
        if not r["not_whole"] and max(abs(r["low"]), abs(r["high"])) < 1e15:
            return Guess(name, narrowest_integer(int(r["low"]), int(r["high"])), notes=notes)
        if not r["scale"] and not r["not_whole"] and r["digits"] <= 38:  # beyond what a double can count
            return Guess(name, "bigint" if r["digits"] <= 18 else "decimal(38,0)", notes=notes)
        if r["scale"] and r["scale"] <= 12 and r["scales"].bit_count() <= 3:
            size = min((r["digits"] or 1) + r["scale"], 38)
            return Guess(name, f"decimal({max(size, r['scale'] + 1)},{r['scale']})", notes=notes)
        return Guess(name, "double", notes=notes)
    return None


def _decide_time(name: str, n: int, r: dict) -> Guess:
    for i, (pattern, _, date_only) in enumerate(TIME_FORMATS):
        if r[f"format{i}"] / n >= 0.9:
            return Guess(name, "date" if date_only else "timestamp_ntz", pattern)
    if r["flexible"] / n >= 0.9:
        return Guess(name, "timestamp_ntz" if r["timed"] else "date", notes=("mixed formats",))
    return Guess(name, "string")


def _number_tests(col: Column) -> dict[str, Column]:
    value = col.cast("double")
    finite = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    cents = finite * 100
    return {"n": F.count(finite), "low": F.min(finite), "high": F.max(finite), "not_whole": F.count_if(finite != F.round(finite)),
            "not_cents": F.count_if(F.abs(cents - F.round(cents)) > F.lit(1e-6) + 1e-5 * F.abs(F.round(cents))), "top": F.max(F.abs(finite))}


def _decide_number(name: str, kind: T.DataType, r: dict) -> Guess:
    if not r["n"]:
        return Guess(name, "double" if not isinstance(kind, T.IntegralType) else kind.simpleString())
    if not r["not_whole"]:
        return Guess(name, narrowest_integer(int(r["low"]), int(r["high"])))
    if not r["not_cents"]:
        return Guess(name, f"decimal({min(max(len(str(int(r['top']))) + 2, 4), 38)},2)", notes=("two decimals",))
    return Guess(name, "double")


def _measure(sample: DataFrame, tests: dict[int, dict[str, Column]]) -> dict[int, dict]:
    """Results of the tests, a few columns per aggregation."""
    results: dict[int, dict] = {}
    for start in range(0, len(tests), COLUMNS_PER_PASS):
        block = list(tests)[start:start + COLUMNS_PER_PASS]
        row = sample.agg(*[c.alias(f"{n}_{i}") for i in block for n, c in tests[i].items()]).first()
        results.update({i: {n: row[f"{n}_{i}"] for n in tests[i]} for i in block})
    return results


def infer(df: DataFrame, tolerance: float = TOLERANCE) -> list[Guess]:
    """One guess per column from all its values; a cast that fails on more than
    ``tolerance`` of the filled ones falls back to text."""
    tests: dict[int, dict[str, Column]] = {}
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    for i, f in enumerate(df.schema.fields):
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegralType, T.DoubleType, T.FloatType)):
            tests[i] = _number_tests(col)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            tests[i] = {"timed": F.count_if(col != F.date_trunc("day", col))}
    results = _measure(df, tests)
    values = _values(df, texts) if texts else None
    found = {n: {"filled": 0, "n": 0} for n in texts} | (_by_column(_views(values), _tests()) if texts else {})
    settled = {n: _decide_text(n, found[n]) for n in texts}
    unsettled = [n for n in texts if settled[n] is None]
    times = _by_column(values.where(F.col("column").isin(unsettled)), _time_tests()) if unsettled else {}
    guesses = []
    for i, f in enumerate(df.schema.fields):
        if isinstance(f.dataType, T.StringType):
            guesses.append(settled[f.name] or _decide_time(f.name, found[f.name]["n"], times[f.name]))
        elif isinstance(f.dataType, (T.IntegralType, T.DoubleType, T.FloatType)):
            guesses.append(_decide_number(f.name, f.dataType, results[i]))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            stays = results[i]["timed"] or isinstance(f.dataType, T.TimestampType)
            guesses.append(Guess(f.name, f.dataType.simpleString() if stays else "date"))
        else:
            guesses.append(Guess(f.name, f.dataType.simpleString()))
    return _downgrade(df, guesses, tolerance, values, found)


def cast(df: DataFrame, guess: Guess) -> Column:
    """Expression of the guessed type; a value that does not fit is null."""
    col = F.col(f"`{guess.column}`")
    text = isinstance(df.schema[guess.column].dataType, T.StringType)
    if not text:
        return col.cast("string") if guess.kind == "string" else col.try_cast(guess.kind)
    return _cast_text(col, guess)


def _cast_text(col: Column, guess: Guess) -> Column:
    if guess.kind == "string":
        return col
    if guess.kind == "boolean":
        return as_boolean(col)
    if guess.kind == "uuid":
        return F.when(F.trim(col).rlike(UUID), F.lower(F.trim(col)))
    if guess.kind == "json":
        return F.try_parse_json(col)
    if guess.kind in ("date", "timestamp_ntz"):
        return as_time(col, guess.format).cast(guess.kind)
    if guess.kind == "double":
        return as_number(col)
    if guess.kind.startswith("decimal"):
        return unsigned_text(col).try_cast(guess.kind)
    # whole numbers straight from their text: a double rounds beyond 2 ** 53
    return F.coalesce(unsigned_text(col).try_cast("bigint").try_cast(guess.kind), as_number(col).try_cast(guess.kind))


def cast_failures(df: DataFrame, guesses: list[Guess]) -> DataFrame:
    """One row: filled and failed values per guess, all columns in one pass."""
    parts = []
    for i, g in enumerate(guesses):
        col = F.col(f"`{g.column}`")
        parts += [F.count(col).alias(f"total{i}"), F.count_if(col.isNotNull() & cast(df, g).isNull()).alias(f"failed{i}")]
    return df.agg(*parts)


def _downgrade(df: DataFrame, guesses: list[Guess], tolerance: float, values: DataFrame | None, found: dict[str, dict]) -> list[Guess]:
    others = [g for g in guesses if g.column not in found]
    row: Row | None = cast_failures(df, others).first() if others else None
    counts = {g.column: (row[f"total{i}"], row[f"failed{i}"]) for i, g in enumerate(others)}
    typed_texts = [g for g in guesses if g.column in found and g.kind != "string"]
    if typed_texts:
        failed = values.agg(*[_rows((F.col("column") == g.column) & _cast_text(F.col("value"), g).isNull()).alias(f"failed{i}") for i, g in enumerate(typed_texts)]).first()
        counts |= {g.column: (found[g.column]["filled"], failed[f"failed{i}"]) for i, g in enumerate(typed_texts)}
    out = []
    for g in guesses:
        total, failures = counts.get(g.column, (0, 0))
        if g.kind != "string" and total and failures / total > tolerance:
            out.append(Guess(g.column, "string", notes=(*g.notes, f"{g.kind} failed on {failures / total:.1%}")))
        else:
            out.append(replace(g))
    return out


def typed(df: DataFrame, guesses: list[Guess] | None = None, **options) -> DataFrame:
    """The table with every column cast to its guessed type."""
    guesses = guesses if guesses is not None else infer(df, **options)
    return df.select(*[cast(df, g).alias(g.column) for g in guesses])


def schema_report(df: DataFrame, guesses: list[Guess]) -> DataFrame:
    """column, dtype, row_count, null_count, distinct_count, inferred type, notes."""
    rows = [(g.column, g.kind, "; ".join(g.notes)) for g in guesses]
    kinds = df.sparkSession.createDataFrame(rows, "column string, inferred string, notes string")
    stats = pf.value_profile(df, "input").select("column", "dtype", "row_count", "null_count", "distinct_count")
    return stats.join(kinds, "column")

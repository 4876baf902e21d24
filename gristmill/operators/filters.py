"""Filter specifications compiled to one boolean Column."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted spellings of every operator.
OPERATOR_ALIASES = {
    "gt": "gt", ">": "gt",
    "gte": "gte", ">=": "gte", "min": "gte",
    "lt": "lt", "<": "lt",
    "lte": "lte", "<=": "lte", "max": "lte",
    "eq": "eq", "=": "eq", "==": "eq", "equals": "eq",
    "neq": "neq", "!=": "neq", "ne": "neq", "not_equals": "neq",
    "between": "between", "range": "between",
    "in": "in_list", "in_list": "in_list", "one_of": "in_list",
    "contains": "contains", "like": "contains",
    "startswith": "startswith", "starts_with": "startswith",
    "endswith": "endswith", "ends_with": "endswith",
}

#: Spellings of ``predicate``'s other operators.
OTHER_OPERATORS = {
    "not_in": "not_in", "nin": "not_in", "is_null": "is_null", "is_not_null": "is_not_null", "ilike": "ilike",
    "array_contains": "array_contains",
}

_ORDERED = {"gt", "gte", "lt", "lte", "between"}


def both(conditions: Iterable[Column]) -> Column:
    """Conjunction; true when there is nothing to test."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def predicate(column: str | Column, operator: str, value: Any = None, upper: Any = None,
              numeric: bool = False) -> Column:
    """One comparison. ``numeric`` compares as double, a value that is not a
    number then never matches. Text patterns are literal and ignore case."""
    col = F.col(column) if isinstance(column, str) else column
    number = col.try_cast("double") if numeric else col
    text = F.lower(col.cast("string"))
    tests = {
        "gt": lambda: number > value,
        "gte": lambda: number >= value,
        "lt": lambda: number < value,
        "lte": lambda: number <= value,
        "between": lambda: number.between(value, upper),
        "in_list": lambda: col.isin(list(value)),
        "not_in": lambda: ~col.isin(list(value)),
        "eq": lambda: col == value,
        "neq": lambda: col != value,
        "contains": lambda: text.contains(str(value).lower()),
        "startswith": lambda: text.startswith(str(value).lower()),
        "endswith": lambda: text.endswith(str(value).lower()),
        "is_null": lambda: col.isNull(),
        "is_not_null": lambda: col.isNotNull(),
        "like": lambda: col.like(value),
        "ilike": lambda: col.ilike(value),
        "array_contains": lambda: F.array_contains(col, value),
    }
    if operator not in tests:
        raise ValueError(f"unknown operator {operator}")
    return tests[operator]()


def _is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def from_spec(df: DataFrame, filters: dict[str, Any] | None = None,
              entities: dict[str, Any] | None = None) -> Column:
    """``{"price": {">=": 3}, "kind": {"in": [..]}, "brand": "x"}`` plus exact
    entity values. ``is_null`` and ``is_not_null`` take true, or false for their
    opposite. An unknown operator or a malformed value is an error: a filter
    that vanished would return too many rows."""
    tests = []
    for name, spec in (filters or {}).items():
        if not isinstance(spec, dict):
            tests.append(predicate(name, "eq", spec))
            continue
        for spelled, value in spec.items():
            spelling = str(spelled).lower()
            operator = OPERATOR_ALIASES.get(spelling) or OTHER_OPERATORS.get(spelling)
            if operator is None:
                raise ValueError(f"unknown operator {spelled!r} for {name}")
            numeric = operator in _ORDERED and _is_numeric(df, name)
            if operator == "between":
                if not isinstance(value, (list, tuple)) or len(value) != 2:
                    raise ValueError(f"between needs two values for {name}, not {value!r}")
                tests.append(predicate(name, operator, *value, numeric=numeric))
            elif operator in ("in_list", "not_in"):
                many = list(value) if isinstance(value, (list, tuple, set)) else [value]
                tests.append(predicate(name, operator, many))
            elif operator in ("is_null", "is_not_null"):
                if not isinstance(value, bool):
                    raise ValueError(f"{operator} needs true or false for {name}, not {value!r}")
                missing = (operator == "is_null") == value
                tests.append(predicate(name, "is_null" if missing else "is_not_null"))
            else:
                tests.append(predicate(name, operator, value, numeric=numeric))
    tests += [predicate(name, "eq", value) for name, value in (entities or {}).items()]
    return both(tests)


def for_role(column: str, value: Any, role: str) -> Column | None:
    """Condition for an entity value, chosen by the column's role."""
    if value is None:
        return None
    if isinstance(value, dict):
        if "start" in value or "end" in value:
            start, end = value.get("start"), value.get("end")
            sides = [F.col(column) >= start] if start is not None else []
            return both(sides + ([F.col(column) <= end] if end is not None else []))
        for operator in ("gte", "gt", "lte", "lt"):
            if operator in value:
                return predicate(column, operator, value[operator])
        if "year" in value and role == "temporal":
            year = int(value["year"])
            return F.to_date(F.col(column)).between(F.make_date(F.lit(year), F.lit(1), F.lit(1)),
                                                    F.make_date(F.lit(year), F.lit(12), F.lit(31)))
        return None
    if isinstance(value, (list, tuple, set)):
        return predicate(column, "in_list", list(value))
    if role == "textual" and isinstance(value, str):
        return predicate(column, "ilike", f"%{value}%")
    return predicate(column, "eq", value)


def equal_text(column: str, value: Any) -> Column:
    """Equality of the texts, ignoring case."""
    return F.lower(F.col(column).cast("string")) == str(value).lower()


# --- payload filter trees -------------------------------------------------

_RANGE = ("gt", "gte", "lt", "lte")
_CLAUSES = ("must", "should", "must_not")


def _field_type(schema: T.StructType, path: str) -> tuple[T.DataType | None, bool]:
    """Type of a dotted field and whether an array lies on or at it."""
    kind: T.DataType = schema
    if path in schema.fieldNames():
        kind = schema[path].dataType
    else:
        for part in path.split("."):
            while isinstance(kind, T.ArrayType):
                kind = kind.elementType
            if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
                return None, False
            kind = kind[part].dataType
    if isinstance(kind, T.ArrayType):
        return kind.elementType, True
    return kind, False


def _comparable(kind: T.DataType, value: Any) -> bool:
    if isinstance(kind, T.BooleanType) or isinstance(value, bool):
        return isinstance(kind, T.BooleanType) and isinstance(value, bool)
    if isinstance(kind, T.NumericType):
        return isinstance(value, (int, float))
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    return isinstance(value, (str, dt.date, dt.datetime))


def _condition(df: DataFrame, path: str, value: Any) -> Column | None:
    if value is None:
        return None
    kind, is_array = _field_type(df.schema, path)
    if kind is None:
        return F.lit(False)
    field = F.col(f"`{path}`") if path in df.columns else F.col(path)

    def literal(v: Any) -> Column:
        return F.lit(v).cast(kind) if isinstance(v, str) else F.lit(v)

    def test(item: Column) -> Column:
        if isinstance(value, dict):
            if set(value) & set(_RANGE):
                return both([predicate(item, op, literal(value[op])) for op in _RANGE
                             if value.get(op) is not None])
            if "any" in value:
                return any_of([item == literal(v) for v in value["any"] if _comparable(kind, v)])
            if "except" in value:
                return ~any_of([item == literal(v) for v in value["except"] if _comparable(kind, v)])
            raise ValueError(f"unsupported filter on {path}: {value!r}")
        if isinstance(value, tuple) and len(value) == 2:
            return both([predicate(item, op, literal(v)) for op, v in zip(("gte", "lte"), value) if v is not None])
        if isinstance(value, (list, set)):
            return any_of([item == literal(v) for v in value if v is not None and _comparable(kind, v)])
        return item == literal(value) if _comparable(kind, value) else F.lit(False)

    if isinstance(value, (list, set)) and not [v for v in value if v is not None]:
        return None
    matched = F.exists(field, test) if is_array else test(field)
    return F.coalesce(matched, F.lit(False))


def _clauses(df: DataFrame, raw: Any) -> list[Column]:
    found = []
    for clause in raw if isinstance(raw, list) else [raw]:
        if any(k in clause for k in _CLAUSES):
            found.append(tree(df, clause))
        else:
            found += [c for name, value in clause.items() if (c := _condition(df, name, value)) is not None]
    return found


def tree(df: DataFrame, filters: dict[str, Any] | None) -> Column:
    """Payload filter: flat ``{field: value}`` or must / should / must_not,
    nested at will.

    A list means any of its values, a two-tuple a closed range, a dict a range,
    ``any`` or ``except``. An array field matches if one element does, and a
    missing field never matches (so it passes ``must_not``).
    """
    if not filters:
        return F.lit(True)
    if not any(k in filters for k in _CLAUSES):
        return both(_clauses(df, filters))
    tests = []
    if filters.get("must"):
        tests += _clauses(df, filters["must"])
    if filters.get("should"):
        options = _clauses(df, filters["should"])
        if options:
            tests.append(any_of(options))
    if filters.get("must_not"):
        tests += [~c for c in _clauses(df, filters["must_not"])]
    return both(tests)


def best_text_column(df: DataFrame) -> str:
    """The text column with the longest values on average, the first on ties."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        raise ValueError("no text column to search")
    sizes = df.agg(*[F.avg(F.length(f"`{n}`")).alias(n) for n in names]).first()
    return max(names, key=lambda n: (sizes[n] or 0.0, -names.index(n)))


def keyword_search(df: DataFrame, keyword: str, column: str | None = None) -> DataFrame:
    """Rows whose ``column``, or best text column, holds the keyword, ignoring case."""
    return df.filter(predicate(column or best_text_column(df), "contains", keyword))

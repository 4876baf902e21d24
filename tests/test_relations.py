"""Keys found in values, and joins along them."""

import pytest

from gristmill.operators import analyse, relations as rel


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "shop": spark.createDataFrame([(1, "a", 7), (2, "b", 8), (3, "b", None)], "id int, town string, boss long"),
        "sale": spark.createDataFrame([(10, 1, "a", 1.5), (11, 1, "b", 2.5), (12, 3, None, 0.5), (13, None, "a", 1.0)], "id long, shop_id long, note string, price double"),
        "staff": spark.createDataFrame([(7, "x", None), (8, "y", 7), (9, "z", 7)], "boss int, name string, chief int"),
    }


def test_inclusions_equal_brute_force(tables):
    values = {}
    for name, df in tables.items():
        for row in df.collect():
            for column, value in row.asDict().items():
                if not isinstance(value, float):
                    values.setdefault((name, column), []).append(value)
    values.pop(("sale", "price"), None)
    want = set()
    for (t, c), mine in values.items():
        for (u, d), other in values.items():
            a, b = {str(v) for v in mine if v is not None}, {str(v) for v in other if v is not None}
            alike = {type(v) for v in mine if v is not None} == {type(v) for v in other if v is not None}
            if t != u and a & b and alike:
                unique = len(b) == sum(v is not None for v in other)
                want.add((t, c, u, d, len(a), len(a & b), len(a & b) / len(a), unique))
    assert {tuple(r) for r in rel.inclusions(tables).collect()} == want and len(want) >= 4


def test_joins_follow_found_keys(tables):
    keys = rel.foreign_keys(rel.inclusions(tables))
    path = rel.join_path(keys, "sale", ["shop", "staff"])
    assert path == [("sale", "shop_id", "shop", "id"), ("shop", "boss", "staff", "boss")]
    joined = analyse.join_edges(tables, "sale", path)
    assert joined.columns == ["id", "shop_id", "note", "price", "shop_id_", "town", "boss", "staff_boss", "name", "chief"]
    assert {(r["id"], r["town"], r["name"]) for r in joined.collect()} == {(10, "a", "x"), (11, "a", "x")}
    with pytest.raises(ValueError):
        rel.join_path(keys, "sale", ["nowhere"])

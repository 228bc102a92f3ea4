"""Scans and lookups on nulls, ties and many keys."""

import pytest
from pyspark.sql import functions as F

from freshet.operators import store


def test_a_box_takes_points_and_any_vertex(spark):
    schema = "id int, city_id string, asset_type string, x double, y double, vertices array<struct<x: double, y: double>>"
    rows = [(1, "a", "road", 0.5, 0.5, None), (2, "a", "road", 9.0, 9.0, [(5.0, 5.0), (1.0, 1.0)]), (3, "a", "road", None, 0.5, []), (4, "a", "road", 9.0, 9.0, [(None, 0.5), None]), (5, "b", "road", 0.0, 0.0, None), (6, None, None, 0.0, 1.0, None), (7, "a", "school", 0.1, 0.1, None)]
    df = spark.createDataFrame(rows, schema)
    ids = lambda **k: [r.id for r in store.asset_page(df, "id", **k).collect()]
    box = (0.0, 0.0, 1.0, 1.0)
    assert ids(box=box) == [1, 2, 5, 6, 7] and ids(box=box, city="a") == [1, 2, 7] and ids(box=box, city="a", kind="road") == [1, 2]
    assert ids() == [1, 2, 3, 4, 5, 6, 7] and ids(limit=2, offset=3) == [4, 5] and ids(limit=9, most=3) == [1, 2, 3] and ids(offset=99) == []


@pytest.mark.parametrize("most", [100_000, 0])
def test_lookups_find_the_last_put(spark, monkeypatch, most):
    monkeypatch.setattr(store, "BROADCAST_KEYS", most)
    puts = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", None, "z"), ("b", None, "n"), ("c", 5, "p"), ("c", 5, "q"), (None, 9, "r")], "k string, at int, v string")
    wanted = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",), (None,)], "k string")
    assert sorted(tuple(r) for r in store.lookup(puts, wanted, "k", ["at"]).select("k", "found", "at", "v").collect()) == [("a", True, 2, "y"), ("b", True, None, "n"), ("c", True, 5, "q"), ("d", False, None, None)]
    assert store.lookup(puts.limit(0), wanted, "k", ["at"]).where(F.col("found")).count() == 0
    assert {r.k: r.v for r in store.last_puts(puts, ["k"], ["at"]).collect()} == {"a": "y", "b": "n", "c": "q", None: "r"}

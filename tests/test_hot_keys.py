"""Ordered operators: a key in ranges of its order gives what one window gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from freshet.operators import hot, platform, temporal

DAY = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)


@pytest.fixture
def rows(spark):
    rng = random.Random(11)
    days = sorted(rng.sample(range(4000), 900))
    out = [("hot", i, DAY(d), DAY(d + rng.choice([0, 3, 90])), rng.choice([True, False, None])) for i, d in enumerate(days)]
    out += [(k, 1000 + i, DAY(9 * i), DAY(9 * i + 2), i % 3 == 0) for i, k in enumerate(["a", "b", None] * 30)] + [("one", 5000, DAY(1), DAY(2), True)]
    rng.shuffle(out)
    return spark.createDataFrame(out, "k string, id int, s date, e date, v boolean").repartition(6)


OPERATORS = {
    "gap_clusters": lambda r: temporal.gap_clusters(r, "k", "s", 5),
    "interval_clusters": lambda r: temporal.interval_clusters(r, "k", "s", "e", "id", 2),
    "adjacent_pairs": lambda r: temporal.adjacent_pairs(r, "k", "s", ["id", "v"]),
    "as_of": lambda r: temporal.as_of(r.where("id % 2 = 0"), r.where("id % 2 = 1"), "k", "s", ["id", "v"]),
    "alert_transitions": lambda r: platform.alert_transitions(r, "k", "s", F.col("v")),
    "rate_limited": lambda r: platform.rate_limited(r, ["k"], "s", 20),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ranges_give_what_one_window_gives(spark, rows, many_ranges, monkeypatch, name):
    whole = OPERATORS[name](rows)
    want = sorted(map(str, whole.collect()))
    for most in (0, 100):  # all keys in ranges, or only the hot one
        monkeypatch.setattr(hot, "TASK_ROWS", most)
        got = OPERATORS[name](rows)
        assert hot.Ranges(rows, ["k"], ["s"]).rows.select(hot.PART).distinct().count() > 4
        assert got.columns == whole.columns and sorted(map(str, got.collect())) == want
    assert OPERATORS[name](rows.limit(0)).count() == 0

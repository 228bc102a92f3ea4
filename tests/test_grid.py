"""Grid operators against plain versions."""

import random

from pyspark.sql import functions as F

from freshet.operators import events, grid, prefix, resample, times


def test_more_anchors_than_a_block(spark):
    p = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 11).cast("double").alias("y"))
    a = spark.range(1500).select((F.col("id") % 50 + 0.25).alias("x"), (F.col("id") % 37 + 0.5).alias("y"), (F.col("id") % 5).alias("v"))
    points, anchors = p.collect(), a.collect()
    d2 = {r.id: [((r.x - s.x) ** 2 + (r.y - s.y) ** 2, s.v) for s in anchors] for r in points}
    near = grid.to_anchors(p, a)
    assert near.count() == 60 * 1500
    assert {r.id: r.d for r in near.groupBy("id").agg(F.min("d2").alias("d")).collect()} == {k: min(d for d, _ in v) for k, v in d2.items()}
    for r in grid.idw(near, "id").collect():
        w = [(1 / max(d, 1e-12), v) for d, v in d2[r.id]]
        assert abs(r.value - sum(x * v for x, v in w) / sum(x for x, _ in w)) < 2e-6


def test_nearest_against_all_pairs(spark):
    rng = random.Random(3)
    for spread in (1.0, 400.0):
        a = [(rng.gauss(0, 1) ** 3 * spread, rng.gauss(0, 1)) for _ in range(300)] + [(0.0, None), (float("nan"), 1.0), (float("inf"), 0.0)]
        p = [(i, rng.uniform(-50, 50), rng.gauss(0, 3)) for i in range(200)] + [(200, 1e6, -1e6), (201, None, 0.0), (202, float("nan"), 0.0), (203, a[0][0], a[0][1])]
        got = {r.id: r.d2 for r in grid.nearest(spark.createDataFrame(p, "id int, x double, y double"), spark.createDataFrame(a, "x double, y double"), "id").collect()}
        want = {i: min((x - ax) ** 2 + (y - ay) ** 2 for ax, ay in a[:300]) for i, x, y in p if i not in (201, 202)}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) <= 1e-12 * want[i] for i in want)
    one = spark.createDataFrame([(1, 5.0, 5.0), (2, 7.0, 1.0)], "id int, x double, y double")
    assert {r.id: r.d2 for r in grid.nearest(one, spark.createDataFrame([(5.0, 5.0)] * 3, "x double, y double"), "id").collect()} == {1: 0.0, 2: 20.0}
    assert grid.nearest(one, one.limit(0), "id").count() == 0 == grid.nearest(one.limit(0), one, "id").count()


def test_smoothing_with_absent_and_null_cells(spark):
    rng = random.Random(8)
    v = {(i, j): (None if rng.random() < 0.1 else float(rng.randrange(50))) for i in range(7) for j in range(5) if rng.random() < 0.7}
    got = {(r.i, r.j): r.smoothed for r in grid.smooth3x3(spark.createDataFrame([(*k, x) for k, x in v.items()], "i int, j int, v double"), "i", "j", "v", 7, 5).collect()}
    assert got.keys() == v.keys()
    for i, j in v:
        seen = [v.get((min(max(i + a, 0), 6), min(max(j + b, 0), 4))) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        seen = [x for x in seen if x is not None]
        assert got[i, j] is None if not seen else abs(got[i, j] - sum(seen) / len(seen)) < 1e-9


def test_group_quantiles_of_hot_and_odd_groups(spark, many_ranges):
    rng = random.Random(5)
    rows = [("hot", rng.randrange(400) / 4) for _ in range(3000)] + [("one", 3.0), ("none", None), (None, 1.0), (None, 2.0), ("odd", float("inf")), ("odd", float("nan")), ("odd", 7.0)] + [(f"g{i}", float(i * k)) for i in range(30) for k in range(1, 5)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.n, r.q25, r.median, r.q75) for r in events.numeric_summary(df, ["g"], "v").collect()}
    import numpy as np

    for g in {g for g, _ in rows}:
        known = [v for k, v in rows if k == g and v is not None and abs(v) < float("inf")]
        want = tuple(np.quantile(known, [0.25, 0.5, 0.75]).round(6)) if known else (None, None, None)
        assert got[g] == (len(known), *want)
    assert prefix.quantiles(df.where("g = 'none'"), "v", [0.5]) == [None]


def test_reversed_intervals_minutes_and_infinities(spark):
    import datetime as dt

    day = lambda n: dt.date(2020, 3, 1) + dt.timedelta(days=n)
    df = spark.createDataFrame([(day(5), day(0), day(-9), day(-3), 3), (day(0), day(5), day(8), day(20), 3), (day(0), day(5), day(9), day(20), 3), (None, day(5), day(9), day(20), 3)], "a date, b date, c date, d date, k int")
    assert [r[0] for r in df.select(times.overlaps(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 3)).collect()] == [True, True, False, None]
    assert spark.range(1).select(times.hour_key(F.lit("2024-01-31 05:30:59").cast("timestamp_ntz"))).first()[0] == "2024-01-31T05:30:00"
    xy = [("g", float(i), float(i * i)) for i in range(6)] + [("g", float("inf"), 1.0), ("g", 1.0, float("nan")), ("g", None, 1.0), ("h", 1.0, 2.0)]
    got = {r.k: (r.n, r.pearson) for r in events.pearson(spark.createDataFrame(xy, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert got == {"g": (6, 0.959883), "h": (1, None)}


def test_pearson_where_a_value_does_not_vary(spark):
    """Groups of equal values, over several partitions, have no correlation; they once failed by a division by zero."""
    rows = [("x", 0.1, float(i)) for i in range(9)] + [("y", float(i), 0.1) for i in range(9)] + [("both", 7.0, 7.0)] * 9 + [("line", float(i), -2.0 * i) for i in range(9)] + [("few", float(i), float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    for parts in (1, 7):
        got = {r.k: (r.n, r.pearson) for r in events.pearson(df.repartition(parts), ["k"], "x", "y").collect()}
        assert got == {"x": (9, None), "y": (9, None), "both": (9, None), "line": (9, -1.0), "few": (4, None)}


def test_cell_centres_continue_the_last_slope(spark):
    cells = spark.createDataFrame([(i, j, 10.0 * i + j) for i in range(4) for j in range(3)], "i int, j int, v double")
    got = {(r.i, r.j): r.v for r in resample.bilinear(cells, "v", (4, 3), (5, 2), centres=True, reach=(1.2, 1.0)).collect()}
    assert all(abs(got[i, j] - (10 * (i + 0.5) * 1.2 / 5 * 3 + (j + 0.5) / 2 * 2)) < 1e-9 for i in range(5) for j in range(2))

"""Leakage rules, model runs, result times, lattices, inventories and logistic steps on odd rows."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import causality, inventory, lattice, logistic, metrics

NAN, INF = float("nan"), float("inf")


def test_unknown_values_break_no_rule(spark):
    row = "lookback int, complete double, split string, kinds array<string>, forecast double, issued double, issue double, valid double"
    df = spark.createDataFrame([(None, None, None, None, None, None, None, None), (24, 0.1, "train", ["OBSERVED", None], 1.0, None, 0.0, 86400.0), (23, 0.1, "candidate", ["FORECAST"], 1.0, 5.0, 0.0, 86400.0), (24, 1.0, "test", [], None, 9.0, 0.0, 0.0)], row)
    rules = causality.tabular_rules(*[F.col(c) for c in ("lookback", "complete", "split", "kinds", "forecast", "issued", "issue", "valid")], F.lit(24.0), {"discharge_at_valid": F.lit(None).cast("boolean")})
    got = [r[0] for r in df.select(causality.broken(rules)).collect()]
    assert got == [[], ["lookback_incomplete", "unexpected_kind", "forecast_without_issue"], ["lookback_length", "forecast_as_observed", "unexpected_kind", "forecast_after_issue"], ["valid_not_issue_plus_horizon"]]


def test_spatial_rules_forgive_only_a_lattice_cube(spark):
    df = spark.createDataFrame([(None, 0.5, 0.6, "OBSERVED", "train"), (["sar_at_issue", "pixel_iid_split"], 0.5, 0.4, "OBSERVED", "val"), (["nothing"], 0.5, 0.6, None, "test"), ([], 0.5, None, "REANALYSIS", "candidate")], "flags array<string>, complete double, cube double, rain string, split string")
    rules = causality.spatial_rules(F.col("flags"), F.array(F.lit("OBSERVED")), F.lit(0.0), F.lit(192 * 3600.0), F.lit(192.0), F.col("complete"), F.col("cube"), F.col("rain"), F.col("split"))
    assert [r[0] for r in df.select(causality.broken(rules)).collect()] == [[], ["satellite_as_input", "pixel_split", "lookback_incomplete"], ["lookback_incomplete"], []]


def test_model_runs_at_the_edges_of_cycles(spark):
    h = 3600
    asked = [6 * h - 1, 6 * h, 12 * h - 0.5, 12 * h, 23 * h, 30 * h - 1, 30 * h]
    df = spark.createDataFrame([(float(s),) for s in asked] + [(None,)], "s double")
    got = [r[0] for r in df.select(causality.last_model_run(F.col("s"))).collect()]
    assert got == [-6 * h, 0, 0, 6 * h, 12 * h, 18 * h, 24 * h, None]
    assert [r[0] for r in df.select(causality.last_model_run(F.col("s"), (12,), 0.0)).collect()][:4] == [-12 * h, -12 * h, -12 * h, 12 * h]


def test_times_are_found_within_the_tolerance_only(spark):
    held = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 1.0), ("a", 1.0 + 5e-10), ("a", NAN), ("a", -1.0), ("b", 7200.0), (None, 3.0)], "k string, t double")
    asked = [("a", 0.0), ("a", 1.0 + 9e-10), ("a", 1.0 + 3e-9), ("a", NAN), ("a", -1.0), ("a", INF), ("a", None), ("b", 7200.0), ("c", 0.0), (None, 3.0)]
    got = causality.at_times(spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "i int, k string, t double"), held, ["k"], "t")
    found = {r.i: r.time_key for r in got.collect()}
    assert found == {0: 0.0, 1: 1.0, 2: None, 3: None, 4: None, 5: None, 6: None, 7: 7200.0, 8: None, 9: None}


def test_results_without_a_grid_are_not_compared(spark):
    grid = "struct<city_id: string, crs: string, nx: int, ny: int, cells: int>"
    good = ("x", None, 2, 3, 6)
    pairs = [(good, good), (good, ("x", "c", 2, 3, 6)), (("x", None, None, 3, 6), ("x", None, None, 3, 6)), (good, ("x", None, 2, 3, 5)), (("y", None, 2, 3, 6), ("x", "c", 1, 3, 6))]
    df = spark.createDataFrame(pairs, f"a {grid}, b {grid}")
    assert [r[0] for r in df.select(causality.incompatibility(F.col("a"), F.col("b"), ["city_id", "crs", "nx", "ny"])).collect()] == [None, "CRS_MISMATCH", "ARRAY_SHAPE_MISMATCH", "ARRAY_SHAPE_MISMATCH", "CITY_ID_MISMATCH"]


def test_lattice_sums_need_half_of_their_hours(spark):
    readings = [("a", 0, h, 1.0) for h in range(100)] + [("a", 0, 99, 5.0)] + [("a", 1, h, 2.0) for h in range(88, 100)] + [("a", 2, h, 3.0) for h in range(90, 100)] + [("a", 3, 99, None), ("a", 3, 98, NAN), ("b", 0, 99, 1.0)]
    df = spark.createDataFrame(readings, "area string, point int, hour long, v double")
    issues = spark.createDataFrame([("a", 100), ("a", 100), ("b", 100), ("c", 100)], "area string, issue long")
    sums = lattice.accumulations(df, issues, "area", "point", "hour", "v", "issue")
    got = {(r.area, r.point): tuple(r)[3:] for r in sums.collect()}
    assert got == {("a", 0): (28.0, 76.0, 5.0, 72), ("a", 1): (24.0, None, 2.0, 12), ("a", 2): (None, None, 3.0, 10), ("a", 3): (None, None, None, 0), ("b", 0): (None, None, 1.0, 1)}
    areas = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0), ("b", 0.0, 0.0, 1.0, 1.0)], "area string, west double, south double, east double, north double")
    points = lattice.lattice_points(areas, "area", 2)
    assert {(r.point, r.lat, r.lon) for r in points.where("area = 'a'").collect()} == {(0, 0.0, 0.0), (1, 0.0, 1.0), (2, 1.0, 0.0), (3, 1.0, 1.0)}
    cells = spark.createDataFrame([("a", 0, 0, 0.0, 0.0), ("a", 0, 1, 0.5, 0.5), ("b", 0, 0, 0.0, 0.0)], "area string, i int, j int, lat double, lon double")
    maps = {(r.area, r.i, r.j): r for r in lattice.maps_at_issue(sums, points, cells, "area", "issue", "point", ["sum_24", "sum_72"]).collect()}
    assert set(maps) == {("a", 0, 0), ("a", 0, 1)} and maps["a", 0, 1].sum_24 == 26.0 and abs(maps["a", 0, 0].sum_24 - 28.0) < 1e-9 and maps["a", 0, 1].sum_72 == 76.0
    assert abs(maps["a", 0, 0].completeness - 94 / 288) < 1e-12


def test_inventories_of_nothing_and_of_unknown_names(spark):
    schema = "city string, day date, event string, episode string, split string, flood long, dry long, dark long"
    rows = [("x", dt.date(2020, 1, 1), None, None, "train", 0, None, 5), (None, None, "e", "c", None, 3, 1, None), ("x", dt.date(2020, 1, 2), "e", "c", "test", 0, 2, 0)]
    args = ("city", "day", "event", "episode", "split", "flood", "dry", "dark")
    one = inventory.inventory(spark.createDataFrame(rows, schema), *args, least_events=1, least_wet_events=1).first()
    assert (one.n_tiles, one.n_train, one.n_val, one.n_test, one.n_events, one.n_wet_events, one.n_days, one.n_cities, one.n_episodes) == (3, 1, 0, 1, 1, 1, 2, 1, 1)
    assert (one.flood, one.dry, one.unknown, one.prevalence, one.unknown_fraction, one.verdict) == (3, 3, 5, 0.5, round(5 / 11, 6), "SUFFICIENT FOR VALIDATION")
    none = inventory.inventory(spark.createDataFrame([], schema), *args).first()
    assert (none.n_tiles, none.n_events, none.flood, none.prevalence, none.verdict) == (0, 0, 0, None, "INSUFFICIENT FOR VALIDATION")
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    ev = spark.createDataFrame([("a", day(0), day(5)), ("b", day(50), day(40)), ("c", day(96), None), ("d", day(96), day(97)), ("e", None, day(1))], "id string, s date, e date")
    assert tuple(inventory.independence(ev, "id", "s", "e").first()) == (4, 2, False)
    assert tuple(inventory.independence(ev.limit(0), "id", "s", "e").first()) == (0, 0, True)


def test_rank_correlation_of_ties_and_unknown_values(spark, many_ranges):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 20, 500).astype(float), rng.integers(0, 5, 500).astype(float)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    ranks = lambda v: np.argsort(np.argsort(v, kind="stable"), kind="stable")
    odd = [(900, None, 1.0), (901, NAN, 1.0), (902, 1.0, INF)]
    got = metrics.rank_correlation(spark.createDataFrame(rows + odd, "id int, x double, y double"), "x", "y", "id").first()
    assert got.n == 500 and got.rank_correlation == round(float(np.corrcoef(ranks(x), ranks(y))[0, 1]), 6) and not got.informative
    few = metrics.rank_correlation(spark.createDataFrame(rows[:2], "id int, x double, y double"), "x", "y", "id").first()
    assert tuple(few) == (2, None, False)


def test_logistic_against_plain_steps(spark):
    rng = np.random.default_rng(5)
    x, w = rng.integers(-3, 4, size=(400, 2)) / 3, rng.integers(1, 4, 400).astype(float)
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(float)
    xb, c = np.c_[np.ones(400), x], np.zeros(3)
    for _ in range(40):
        g = xb.T @ (w / w.sum() * (1 / (1 + np.exp(-xb @ c)) - y))
        g[1:] += 2e-3 * c[1:]
        c = c - 0.4 * g
    rows = [(float(a), float(b), float(t), float(v)) for (a, b), t, v in zip(x, y, w, strict=True)] + [(None, 1.0, 1.0, 1.0), (1.0, NAN, 1.0, 1.0), (1.0, 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, y double, w double")
    model = logistic.fit(df, ["a", "b"], "y", "w", steps=40)
    assert np.allclose(model.coef, c)
    p = {(r.a, r.b): r.p for r in df.select("a", "b", model.probability([F.col("a"), F.col("b")]).alias("p")).collect() if r.a is not None and not math.isnan(r.b)}
    assert all(abs(v - 1 / (1 + math.exp(-(c[0] + c[1] * a + c[2] * b)))) < 1e-9 for (a, b), v in p.items())
    assert logistic.fit(df.limit(0), ["a", "b"], "y").coef == (0.0, 0.0, 0.0)
    with pytest.raises(ValueError, match="scale"):
        logistic.fit(df.withColumn("a", F.col("a") * 1e300), ["a", "b"], "y", steps=60, rate=1e10)

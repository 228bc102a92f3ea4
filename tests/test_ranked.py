"""Histories, baselines, rankings, frozen splits and validation on ties, nulls and hot keys."""

import random

from pyspark.sql import functions as F

from freshet.operators import ranking, validation

NAN, INF = float("nan"), float("inf")


def test_capped_histories_of_hot_owners(spark):
    rng = random.Random(2)
    rows = [("hot", rng.choice([None, *range(300)]), i) for i in range(4000)] + [("one", 5, 9000), (None, 1, 9001), (None, None, 9002)]
    got = {}
    for r in ranking.history(spark.createDataFrame(rows, "owner string, made int, id int").repartition(9), "owner", "made", "id", 25).collect():
        got.setdefault(r.owner, []).append((r.place, r.id))
    for owner in ("hot", "one", None):
        own = sorted((r for r in rows if r[0] == owner), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))[:25]
        assert [i for _, i in sorted(got[owner])] == [r[2] for r in own]


def test_baselines_prefer_plain_rain_then_the_last(spark):
    schema = "city string, id int, kind string, status string, artifact_id string, multiplier double, completed_at int, created_at int"
    done = ("scenario", "completed", "a")
    rows = [("a", 1, *done, 1.0, 5, 1), ("a", 2, *done, 1.5, 9, 9), ("a", 3, *done, None, None, 6), ("a", 4, "scenario", "running", "a", 1.0, 99, 99), ("a", 5, "report", "completed", "a", 1.0, 99, 99), ("a", 6, "scenario", "completed", None, 1.0, 99, 99), ("b", 7, *done, 2.0, None, None), ("b", 8, *done, 2.0, 1, None), ("c", 9, *done, 1.0, 4, 4), ("c", 10, *done, 1.0, 4, 4)]
    df = spark.createDataFrame(rows, schema)
    assert {r.city: r.job_id for r in ranking.baseline(df, "city").collect()} == {"a": 3, "b": 8, "c": 10}
    assert {r.city: r.job_id for r in ranking.last_completed(df, "city").collect()} == {"a": 5, "b": 8, "c": 10}


def test_rankings_with_unknown_scores(spark):
    ev = spark.createDataFrame([("x", 1, 1, 0, 1), ("x", 2, 0, 0, 0), ("y", 1, 3, 1, 0), ("z", 1, 0, 0, 0), ("w", 1, 3, 1, 0)], "model string, event int, tp int, fp int, fn int")
    got = {r.model: (r.place, r.n_events, r.macro_iou, r.micro_iou, r.micro_dice) for r in ranking.model_ranking(ev, "model").collect()}
    assert got == {"w": (1, 1, 0.75, 0.75, 6 / 7), "y": (2, 1, 0.75, 0.75, 6 / 7), "x": (3, 2, 0.5, 0.5, 2 / 3), "z": (4, 1, None, None, None)}
    s = spark.createDataFrame([("m", 3, 0.5), ("m", 1, 0.5), ("m", 2, 0.1), ("m", 4, 0.1), ("m", 5, NAN), ("m", 6, INF), ("m", 7, None), ("n", 1, None)], "model string, event int, iou double")
    assert {r.model: tuple(r)[1:] for r in ranking.best_worst(s, "model", "event", "iou").collect()} == {"m": (1, 0.5, 2, 0.1), "n": (None, None, None, None)}
    a = spark.createDataFrame([(1, 0.5), (2, None), (3, NAN), (4, 0.2), (5, 0.9)], "event int, iou double")
    b = spark.createDataFrame([(1, 0.5), (2, 0.0), (3, 0.1), (4, None), (6, 0.3)], "event int, iou double")
    assert sorted((r.event, r.a_dominates) for r in ranking.dominance(a, b, "event", "iou").collect()) == [(1, True), (2, True), (3, False)]


def test_drift_of_a_frozen_split(spark):
    frozen = spark.createDataFrame([("a", "train"), ("b", "val"), ("c", "test"), ("d", "test")], "event string, split string")
    same = spark.createDataFrame([("a", "train")] * 5 + [("b", "val"), ("c", "test"), ("d", "test"), (None, "test"), ("d", None)], "event string, split string")
    assert ranking.split_drift(same, frozen, "event", "split").count() == 0
    drift = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "test"), ("e", "val"), ("d", "test")], "event string, split string")
    assert {r.event: r.problem for r in ranking.split_drift(drift, frozen, "event", "split").collect()} == {"a": "LEAK", "b": "MOVED", "c": "MISSING", "e": "UNEXPECTED"}
    assert ranking.rain_threshold(spark.createDataFrame([], "rain double"), "rain") == 50.0
    assert abs(ranking.rain_threshold(spark.createDataFrame([(None,), (10.0,)], "rain double"), "rain") - 7.0) < 1e-12


def test_surfaces_must_be_whole_and_finite(spark):
    whole = lambda name, **odd: [(name, i, j, odd.get(f"v{i}{j}", 1.0 * i + j)) for i in range(2) for j in range(3)]
    rows = whole("good") + whole("nan", v01=NAN) + whole("inf", v11=-INF) + whole("null", v00=None) + whole("short")[:-1] + whole("more") + [("more", 5, 0, 1.0)] + whole("twice")[:-1] + [("twice", 0, 0, 9.0)] + [("moved", i + 1, j, v) for _, i, j, v in whole("x")]
    got = {r.s: (r.n_null, r.n_nan, r.n_inf, r.least, r.most, r.error) for r in validation.surface_audit(spark.createDataFrame(rows, "s string, i int, j int, v double"), ["s"], "i", "j", "v", F.lit(3), F.lit(2)).collect()}
    assert got["good"] == (0, 0, 0, 0.0, 3.0, None) and got["nan"] == (0, 1, 0, 0.0, 3.0, "NON_FINITE") and got["inf"] == (0, 0, 1, 0.0, 3.0, "NON_FINITE") and got["null"] == (1, 0, 0, 1.0, 3.0, "NON_FINITE")
    assert {got[s][-1] for s in ("short", "more", "twice", "moved")} == {"SHAPE"}


def test_checks_never_take_null_as_right(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first()[0]
    none = lambda kind: F.lit(None).cast(kind)
    assert one(validation.run_errors(none("double"), F.lit(NAN), F.lit(1.0), F.lit(0.0))) == ["negative_rain", "domain_not_positive", "step_not_positive"]
    assert one(validation.run_errors(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(0.5))) == []
    assert one(validation.covers(none("date"), F.lit("2020-01-01").cast("date"), F.lit("2019-01-01").cast("date"), F.lit("2021-01-01").cast("date"))) is False
    grid = lambda **v: F.struct(*[F.lit(x).alias(k) for k, x in ({"crs": "EPSG:4326", "cell_center": "cell_center", "origin_x": 1.0, "origin_y": 2.0, "nx": 3, "ny": 4} | v).items()])
    why = lambda **v: one(validation.grid_error(grid(**v), F.lit(1.0), F.lit(2.0)))
    assert [why(), why(crs=None), why(cell_center="edge"), why(origin_x=1.0 + 1e-8), why(origin_y=None), why(nx=0)] == [None, "UNSUPPORTED_CRS", "UNSUPPORTED_CELL_CENTER", "ORIGIN_OFF_BOUNDS", "ORIGIN_OFF_BOUNDS", "EMPTY_GRID"]
    record = lambda **v: F.struct(*[F.lit(x).cast("string").alias(k) for k, x in ({"provider": "p", "checksum": "", "source_url": "u"} | v).items()])
    assert one(validation.missing_provenance(record(), ["provider"])) == [] and one(validation.missing_provenance(record(provider=" ", source_url=None), ["provider"])) == ["provider", "checksum|source_url"]
    refusal = lambda *a: one(validation.share_refusal(*[F.lit(x).cast(k) for x, k in zip(a, ("string", "string", "int", "int", "boolean"), strict=True)]))
    assert [refusal(None, None, 1, 1, None), refusal(None, None, 1, None, True), refusal(None, "organization", 1, 2, None), refusal(None, "public", 1, 2, False), refusal("t", "public", 1, 1, True), refusal(None, "private", None, None, None)] == [None, "PRIVATE", "SIGN_IN", None, "REVOKED", None]
    assert [one(validation.wet_from_fraction(F.lit(x).cast("double"))) for x in (None, NAN, 0.0, 0.1)] == [None, None, 0, 1]
    px = spark.createDataFrame([("a", 255, None), ("a", 255, NAN), ("a", 1, 0.5), ("b", None, 0.0), ("b", 255, 0.5)], "s string, code int, p double")
    assert {r.s: tuple(r)[1:] for r in validation.unknown_scored(px, ["s"], F.col("code"), F.col("p")).collect()} == {"a": (2, 0, True), "b": (2, 2, False)}
    label = lambda *a, track="A": one(validation.sample_label(*[F.lit(x).cast(k) for x, k in zip(a, ("double", "int", "boolean", "int"), strict=True)], track=track))
    assert [label(0.8, 1, None, None), label(0.79, 1, None, None), label(None, 1, None, None), label(0.9, None, True, 1), label(0.9, None, True, 1, track="B"), label(0.9, 1, None, 1, track="B")] == [1, None, None, None, 1, None]

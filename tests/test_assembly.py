"""Samples, feature vectors and causal pairs on gaps, ties and unknown values."""

import math

from pyspark.sql import functions as F

from freshet.operators import assembly


def test_scenes_with_gaps_ties_and_states_at_the_edge(spark):
    hours = [("a", h, 1.0) for h in range(0, 200) if h not in range(60, 70)] + [("a", 30, 9.0), ("b", 5, 1.0), ("a", 31, None)]
    rain = spark.createDataFrame(hours, "city string, hour long, mm double")
    states = spark.createDataFrame([("a", 0, 5.0), ("a", 1, 6.0), ("a", 1, 7.0), ("a", 2, None), ("a", 3, 8.0)], "city string, day long, q double")
    scenes = spark.createDataFrame([("a", 1, 58), ("a", 2, 80), ("a", 3, 90), ("a", 4, 106), ("a", 5, 106), ("a", 6, 140), ("b", 7, 60), (None, 8, 60), ("a", 9, None)], "city string, id int, at long")
    got = {r.id: r for r in assembly.assemble(scenes, rain, states, "city", "id", "at", "hour", "mm", "day", "q", horizon=10).collect()}
    assert set(got) == {1, 4, 5, 6}  # scenes 2 and 3 look back on the gap, 7 on no rain at all
    assert got[1].issue == 48 and sum(got[1].precip) == 24 + 8 and got[1].precip[6] == 9.0 and (got[1].state_day, got[1].state) == (1, 7.0)
    assert (got[4].persistence, got[5].persistence, got[6].persistence, got[1].persistence) == (1, None, 5, None)  # 4 was valid with 5, after its issue
    assert (got[4].state_day, got[6].state_day) == (3, 3) and got[4].complete == 1.0
    assert assembly.assemble(scenes.limit(0), rain, states, "city", "id", "at", "hour", "mm", "day", "q").count() == 0


def test_feature_vectors_of_unknown_values(spark):
    none = lambda k: F.lit(None).cast(k)
    empty = assembly.feature_vector(none("array<double>"), none("double"), none("double"), none("double"), none("struct<min: double, mean: double, p10: double>"), none("double"), {}, F.lit(3), F.lit(24))
    row = spark.range(1).select(*[c.alias(k) for k, c in empty.items()]).first().asDict()
    assert len(row) == 42 and list(row)[24:32] == ["antecedent_24h", "antecedent_72h", "forecast_to_h", "forecast_present", "dem_min", "dem_mean", "dem_p10", "dem_present"]
    assert {k for k, v in row.items() if v} == {"month_sin", "month_cos", "horizon_hours"} or abs(row["month_cos"]) < 1e-12
    long = assembly.feature_vector(F.array(*[F.lit(float(k)) for k in range(30)]), F.lit(1.0), F.lit(72.0), F.lit(0.0), F.struct(F.lit(1.0).alias("min"), F.lit(2.0).alias("mean"), F.lit(3.0).alias("p10")), F.lit(-4.0), {48: F.lit(50.0), 1: F.lit(None)}, F.lit(12), F.lit(192))
    row = spark.range(1).select(*[c.alias(k) for k, c in long.items()]).first()
    assert (row.precip_h23, row.precip_1h, row.precip_3h, row.precip_48h, row.forecast_present, row.q_last, row.q_present, row.dem_p10) == (23.0, 23.0, 66.0, 50.0, 1.0, 0.0, 1.0, 3.0)


def test_pixels_without_maps_fall_back_on_the_sample(spark):
    sample = {"p24": F.lit(5.0), "p72": F.lit(None).cast("double"), "p6": F.lit(float("nan")), "q_last": F.lit(math.e - 1), "month": F.lit(6), "precip": F.array(F.lit(1.0)), "is_point": F.lit(None).cast("boolean"), "is_cell": F.lit(True)}
    bare = assembly.pixel_features(F.lit(0), F.lit(2), 1, 5, sample, {})
    row = spark.range(1).select(*[c.alias(k) for k, c in bare.items()]).first()
    assert len(row) == 18 and (row.p24_local, row.p72_local, row.p6, row.persistence, row.persistence_known, row["row"], row["col"], row.recent_rain, row.rain_is_point, row.q_is_cell) == (5.0, 0.0, 0.0, 0.5, 0.0, 0.0, 0.5, 0.0, 0.0, 1.0)
    assert abs(row.q_log - 1) < 1e-12


def test_states_join_once_and_hindsight_shows(spark):
    pairs = spark.createDataFrame([("p", 10.0, 3.0, None), ("q", 10.0, None, "OBSERVED"), ("r", 10.0, 12.0, None), (None, 10.0, 1.0, None)], "pair string, t0 double, state_time double, hydrology_status string")
    hydro = spark.createDataFrame([("p", 5.0, 5.0, "OK", "M"), ("p", 9.0, 1.0, None, None), ("p", None, 0.0, "X", "X"), ("q", 11.0, -1.0, "OLD", "M")], "pair string, state_time double, lag_hours double, staleness string, status string")
    joined = assembly.attach_states(pairs, hydro, "pair")
    got = {r.pair: (r.state_time, r.hydro_lag_hours, r.hydro_staleness, r.hydrology_status) for r in joined.collect()}
    assert got == {"p": (9.0, 1.0, None, "MODELLED_STATE"), "q": (11.0, -1.0, "OLD", "OBSERVED"), "r": (12.0, None, None, "MODELLED_STATE"), None: (1.0, None, None, "MODELLED_STATE")}
    made = assembly.causal_pairs(joined, F.col("t0"), F.col("state_time"), F.when(F.col("pair") == "p", 11.0).when(F.col("pair") == "q", 10.0), F.lit(1.0), F.lit(None).cast("int"), F.lit(12), F.lit(24))
    assert {r.pair: (r.state_ok, r.forecast_coverage, r.antecedent_coverage, r.eligibility, r.hindsight) for r in made.collect()} == {
        "p": (True, 0.0, 0.5, "STATE_ONLY", ["forecast_after_t0"]), "q": (False, 1.0, 0.5, "UNAVAILABLE", ["state_after_t0"]), "r": (False, 1.0, 0.5, "UNAVAILABLE", ["state_after_t0"]), None: (True, 1.0, 0.5, "FULL", []),
    }

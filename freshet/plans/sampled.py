"""Samples, feature vectors, pixel features and causal pairs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators import assembly
from freshet.plans.registry import query
from freshet.sources.tables import epoch_hour, epoch_seconds, table

_HOUR = "(epoch(date_trunc('hour', ts)) // 3600)::BIGINT"
HORIZON = 48


@query(f"""WITH e AS (SELECT *, (user_id % 5)::INT AS city, {_HOUR} AS hour FROM events), r AS (SELECT city, hour, max(value) AS v FROM e WHERE value >= 15 GROUP BY ALL), d AS (SELECT city, hour // 24 AS day, max(value) AS q FROM e WHERE event_type = 'purchase' GROUP BY ALL),
    s AS (SELECT event_id, city, hour AS valid, hour - {HORIZON} AS issue FROM e WHERE event_id % 23 = 0), h AS (SELECT s.*, b, v FROM s CROSS JOIN (SELECT unnest(range(1, 25)) AS b) LEFT JOIN r ON r.city = s.city AND r.hour = s.issue - b),
    k AS (SELECT event_id, city, valid, issue, round(sum(v), 6) AS rain, round(count(v) / 24, 6) AS complete, arg_min(v, b) FILTER (b = 1) AS last_hour FROM h GROUP BY ALL HAVING count(v) >= 0.8 * 24),
    p AS (SELECT *, lag({{'s': event_id, 'v': valid}}) OVER (PARTITION BY city ORDER BY valid, event_id) AS b4 FROM k)
    SELECT p.event_id, p.city, issue, rain, complete, last_hour, CASE WHEN b4.v < issue THEN b4.s END AS persistence, max(d.day) AS state_day, round(arg_max(d.q, d.day), 6) AS state FROM p LEFT JOIN d ON d.city = p.city AND (d.day + 1) * 24 <= issue GROUP BY ALL""")
def scene_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 23rd event as a scene of one of five cities."""
    e = table(spark, sf_dir, "events").withColumns({"city": (F.col("user_id") % 5).cast("int"), "hour": epoch_hour(F.col("ts"))})
    rain = e.select("city", "hour", F.when(F.col("value") >= 15, F.col("value")).alias("v"))
    states = e.where("event_type = 'purchase'").select("city", F.floor(F.col("hour") / 24).alias("day"), F.col("value").alias("q"))
    out = assembly.assemble(e.where("event_id % 23 = 0"), rain, states, "city", "event_id", "hour", "hour", "v", "day", "q", horizon=HORIZON)
    total = F.aggregate("precip", F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    return out.select("event_id", "city", "issue", F.round(total, 6).alias("rain"), F.round("complete", 6).alias("complete"), F.get("precip", F.lit(23)).alias("last_hour"), "persistence", "state_day", F.round("state", 6).alias("state"))


_P = [f"CASE WHEN event_id % 7 = 0 AND {k} > 20 THEN 0 WHEN (event_id + {k}) % 5 = 0 THEN 0 ELSE value / {k + 1} END" for k in range(24)]
_SUMS = {n: "(" + " + ".join(f"precip_h{k:02}" for k in range(24 - n, 24)) + ")" for n in (1, 3, 6, 12)}


@query(f"""WITH h AS (SELECT event_id, value, month(ts) AS m, {", ".join(f"({p})::DOUBLE AS precip_h{k:02}" for k, p in enumerate(_P))} FROM events)
    SELECT event_id, {", ".join(f"round(precip_h{k:02}, 6) AS precip_h{k:02}" for k in range(24))}, CASE WHEN event_id % 3 > 0 THEN round(value, 6) ELSE 0 END AS antecedent_24h, round(2 * value, 6) AS antecedent_72h, CASE WHEN event_id % 4 > 0 THEN round(value / 3, 6) ELSE 0 END AS forecast_to_h, (event_id % 4 > 0)::INT::DOUBLE AS forecast_present,
    CASE WHEN event_id % 5 > 0 THEN 1.5::DOUBLE ELSE 0 END AS dem_min, CASE WHEN event_id % 5 > 0 THEN round(value / 10, 6) ELSE 0 END AS dem_mean, 0::DOUBLE AS dem_p10, (event_id % 5 > 0)::INT::DOUBLE AS dem_present, CASE WHEN event_id % 6 > 0 THEN round(ln(1 + greatest(value - 30, 0)), 6) ELSE 0 END AS q_last, (event_id % 6 > 0)::INT::DOUBLE AS q_present,
    round(sin(2 * {math.pi!r} * m / 12), 6) AS month_sin, round(cos(2 * {math.pi!r} * m / 12), 6) AS month_cos, 192::DOUBLE AS horizon_hours, {", ".join(f"round({c}, 6) AS precip_{n}h" for n, c in _SUMS.items() if n != 6)}, round(CASE WHEN event_id % 2 = 0 THEN value ELSE {_SUMS[6]} END, 6) AS precip_6h, round(2 * value, 6) AS precip_48h FROM h""")
def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 42 features of samples made of the events; every seventh has 21 hours only."""
    i, v = F.col("event_id"), F.col("value")
    hours = F.array(*[F.when((i + k) % 5 != 0, v / (k + 1)) for k in range(24)])
    dem = F.when(i % 5 > 0, F.struct(F.lit(1.5).alias("min"), (v / 10).alias("mean"), F.lit(None).cast("double").alias("p10")))
    made = assembly.feature_vector(
        F.when(i % 7 == 0, F.slice(hours, 1, 21)).otherwise(hours), F.when(i % 3 > 0, v), 2 * v, F.when(i % 4 > 0, v / 3), dem, F.when(i % 6 > 0, v - 30), {6: F.when(i % 2 == 0, v)}, F.month("ts"), F.lit(192),
    )
    return table(spark, sf_dir, "events").select("event_id", *[F.round(c, 6).alias(k) for k, c in made.items()])


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey % 20)::INT AS i, (l_suppkey % 10)::INT AS j, l_quantity AS q, l_tax AS t, l_discount AS d, month(l_shipdate) AS m FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round(q, 6) AS p24, round(2 * q, 6) AS p72, CASE WHEN l_partkey % 3 > 0 THEN round(q / 2, 6) ELSE round(q, 6) END AS p24_local, round(2 * q, 6) AS p72_local, CASE WHEN l_partkey % 2 > 0 THEN round(q / 4, 6) ELSE 0 END AS p6, round(ln(1 + greatest(q - 10, 0)), 6) AS q_log, round(sin(2 * {math.pi!r} * m / 12), 6) AS month_sin, round(cos(2 * {math.pi!r} * m / 12), 6) AS month_cos,
    CASE WHEN l_linenumber % 4 > 0 THEN round(t, 6) ELSE 0.5 END AS persistence, (l_linenumber % 4 > 0)::INT::DOUBLE AS persistence_known, round(i / 19, 6) AS "row", round(j / 9, 6) AS col, CASE WHEN l_partkey % 5 > 0 THEN round(d, 6) ELSE 0 END AS dem, 0::DOUBLE AS slope, round(t, 6) AS river_distance, 1::DOUBLE AS rain_is_point, 0::DOUBLE AS q_is_cell, round((q + 5 * d) / 6, 6) AS recent_rain FROM p""")
def pixel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 18 features of line items as pixels of a grid of 20 by 10."""
    q, t, d, k, n = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount"), F.col("l_partkey"), F.col("l_linenumber")
    sample = {"p24": q, "p72": 2 * q, "p6": F.when(k % 2 > 0, q / 4), "q_last": q - 10, "month": F.month("l_shipdate"), "precip": F.array(F.lit(9.0), d, d, d, F.lit(None).cast("double"), d + d, q), "is_point": F.lit(True), "is_cell": F.lit(None).cast("boolean")}
    maps = {"p24": F.when(k % 3 > 0, q / 2), "persistence": F.when(n % 4 > 0, t).otherwise(float("nan")), "dem": F.when(k % 5 > 0, d).otherwise(float("inf")), "river": t}
    made = assembly.pixel_features(F.col("l_partkey") % 20, F.col("l_suppkey") % 10, 20, 10, sample, maps)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(c, 6).alias(name) for name, c in made.items()])


@query("""WITH e AS (SELECT event_id, user_id, event_type, epoch(ts) AS t0, CASE WHEN event_id % 4 > 0 THEN epoch(ts) + value - 80 END AS own_state, CASE WHEN event_id % 9 = 0 THEN 'OBSERVED_STATE' END AS own_status, CASE WHEN event_id % 5 > 0 THEN epoch(ts) + value - 60 END AS issue, CASE WHEN event_id % 3 > 0 THEN least(1, value / 50) END AS coverage, event_id % 2 AS observed, (event_id % 30)::INT AS rain FROM events),
    h AS (SELECT event_id, epoch(ts) + value - 100 AS state_time, 100 - value AS lag_hours, CASE WHEN value > 50 THEN 'FRESH' END AS staleness, 'MODELLED' AS status FROM events WHERE event_id % 3 = 0),
    j AS (SELECT e.*, coalesce(h.state_time, own_state) AS state_time, h.lag_hours, h.staleness, coalesce(own_status, h.status, 'MODELLED_STATE') AS hydrology_status FROM e LEFT JOIN h USING (event_id)),
    c AS (SELECT *, coalesce(state_time <= t0, false) AS state_ok, CASE WHEN issue IS NULL OR issue <= t0 THEN coalesce(coverage, 0) ELSE 0 END AS cov FROM j)
    SELECT event_id, round(lag_hours, 6) AS hydro_lag_hours, staleness AS hydro_staleness, hydrology_status, state_ok, round(cov, 6) AS forecast_coverage, round(rain / 24, 6) AS antecedent_coverage, CASE WHEN state_ok AND cov >= 0.999 THEN 'FULL' WHEN state_ok AND cov > 0 THEN 'PARTIAL' WHEN state_ok THEN 'STATE_ONLY' WHEN observed > 0 THEN 'OBSERVED_ONLY' ELSE 'UNAVAILABLE' END AS eligibility,
    array_to_string(list_filter([CASE WHEN issue > t0 THEN 'forecast_after_t0' END, CASE WHEN state_time > t0 THEN 'state_after_t0' END], lambda x: x IS NOT NULL), ',') AS hindsight FROM c""")
def causal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as pairs of scenes with states, forecasts and rain."""
    e = table(spark, sf_dir, "events")
    i, v, s = F.col("event_id"), F.col("value"), epoch_seconds(F.col("ts"))
    pairs = e.select(
        "event_id", s.alias("t0"), F.when(i % 4 > 0, s + v - 80).alias("state_time"), F.when(i % 9 == 0, "OBSERVED_STATE").alias("hydrology_status"), F.when(i % 5 > 0, s + v - 60).alias("issue"),
        F.when(i % 3 > 0, F.least(F.lit(1.0), v / 50)).alias("coverage"), (i % 2).alias("observed"), (i % 30).cast("int").alias("rain"),
    )
    hydro = e.where("event_id % 3 = 0").select("event_id", (s + v - 100).alias("state_time"), (100 - v).alias("lag_hours"), F.when(v > 50, "FRESH").alias("staleness"), F.lit("MODELLED").alias("status"))
    joined = assembly.attach_states(pairs, hydro, "event_id")
    out = assembly.causal_pairs(joined, *[F.col(c) for c in ("t0", "state_time", "issue", "coverage", "observed", "rain")], F.lit(24))
    return out.select("event_id", F.round("hydro_lag_hours", 6).alias("hydro_lag_hours"), "hydro_staleness", "hydrology_status", "state_ok", F.round("forecast_coverage", 6).alias("forecast_coverage"), F.round("antecedent_coverage", 6).alias("antecedent_coverage"), "eligibility", F.array_join("hindsight", ",").alias("hindsight"))

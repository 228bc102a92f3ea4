"""Leakage rules, vintages, model runs, result times and compatibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators import causality
from freshet.plans.registry import query
from freshet.sources.tables import epoch_seconds, table


def _listed(rules: dict[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in rules.items()) + "], lambda x: x IS NOT NULL), ',')"


_KIND = "CASE event_type WHEN 'view' THEN 'OBSERVED' WHEN 'click' THEN 'SIMULATED' WHEN 'error' THEN 'FORECAST' WHEN 'signup' THEN 'UNAVAILABLE' ELSE 'GUESSED' END"
_SAMPLES = f"""SELECT event_id, 24 - (event_id % 40 = 7)::INT AS lookback, (event_id % 20) / 20.0 AS complete, CASE WHEN event_id % 3 = 0 THEN 'candidate' ELSE 'train' END AS split, {_KIND} AS kind, CASE WHEN event_id % 2 = 0 THEN value END AS forecast,
    CASE WHEN event_id % 8 > 0 THEN epoch(ts) + value - 95 END AS issued, epoch(ts) AS issue, epoch(ts) + 3600 * (24 + (event_id % 50 = 0)::INT) AS valid, event_id % 13 = 0 AS era5, event_id % 17 = 0 AS discharge, event_id % 19 = 0 AS physics, event_id % 23 = 0 AS emsr FROM events"""
_TABULAR = _listed({
    "lookback_length": "lookback <> 24", "lookback_incomplete": "complete < 0.8 AND split IN ('train', 'val', 'test')", "forecast_as_observed": "kind = 'FORECAST'", "unexpected_kind": "kind IN ('FORECAST', 'GUESSED')", "forecast_without_issue": "forecast IS NOT NULL AND issued IS NULL",
    "forecast_after_issue": "forecast IS NOT NULL AND issued > issue", "reanalysis_as_forecast": "forecast IS NOT NULL AND era5", "discharge_at_valid": "discharge", "physics_at_valid": "physics", "map_after_issue": "emsr", "valid_not_issue_plus_horizon": "abs((valid - issue) / 3600.0 - 24) > 0.01",
})


def _kind() -> F.Column:
    named = F.lit("GUESSED")
    for k, v in {"view": "OBSERVED", "click": "SIMULATED", "error": "FORECAST", "signup": "UNAVAILABLE"}.items():
        named = F.when(F.col("event_type") == k, v).otherwise(named)
    return named


@query(f"SELECT event_id, {_TABULAR} AS errors FROM ({_SAMPLES})")
def tabular_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s = F.col("event_id"), epoch_seconds(F.col("ts"))
    flags = {"reanalysis_as_forecast": i % 13 == 0, "discharge_at_valid": i % 17 == 0, "physics_at_valid": i % 19 == 0, "map_after_issue": i % 23 == 0}
    rules = causality.tabular_rules(
        24 - (i % 40 == 7).cast("int"), i % 20 / 20, F.when(i % 3 == 0, "candidate").otherwise("train"), F.array(_kind()), F.when(i % 2 == 0, F.col("value")), F.when(i % 8 > 0, s + F.col("value") - 95), s,
        s + 3600 * (24 + (i % 50 == 0).cast("int")), F.lit(24.0), flags,
    )
    return table(spark, sf_dir, "events").select("event_id", F.array_join(causality.broken(rules), ",").alias("errors"))


_ADMITS = {name: " OR ".join(f"list_contains(flags, '{f}')" for f in flags) for name, flags in causality.SPATIAL_FLAGS.items()}
_FLAGS = [f for flags in causality.SPATIAL_FLAGS.values() for f in flags]
_SPATIAL = _listed(_ADMITS | {
    "forecast_as_observed": "kind = 'FORECAST'", "issue_not_before_valid": "issue >= valid", "valid_not_issue_plus_horizon": "abs((valid - issue) / 3600.0 - 192) > 1.0",
    "lookback_incomplete": "complete < 0.8 AND NOT (coalesce(cube, 0) >= 0.5 AND coalesce(rain IN ('OBSERVED', 'REANALYSIS'), false)) AND split IN ('train', 'val', 'test')",
})


@query(f"""SELECT event_id, {_SPATIAL} AS errors FROM (SELECT event_id, [{", ".join(f"'{f}'" for f in _FLAGS)}][(event_id % 14)::INT + 1:(event_id % 14)::INT + (event_id % 3)::INT] AS flags, {_KIND} AS kind, epoch(ts) AS issue, epoch(ts) + 3600 * (CASE WHEN event_id % 31 = 0 THEN 0 ELSE 191.5 + (event_id % 9) / 4.0 END) AS valid,
    (event_id % 20) / 20.0 AS complete, CASE WHEN event_id % 5 > 0 THEN (event_id % 10) / 10.0 END AS cube, CASE event_id % 4 WHEN 0 THEN 'REANALYSIS' WHEN 1 THEN 'FORECAST' WHEN 2 THEN 'OBSERVED' END AS rain, CASE WHEN event_id % 3 = 0 THEN 'candidate' ELSE 'val' END AS split FROM events)""")
def spatial_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s = F.col("event_id"), epoch_seconds(F.col("ts"))
    flags = F.slice(F.array(*[F.lit(f) for f in _FLAGS]), (i % 14 + 1).cast("int"), (i % 3).cast("int"))
    rain = F.when(i % 4 == 0, "REANALYSIS").when(i % 4 == 1, "FORECAST").when(i % 4 == 2, "OBSERVED")
    rules = causality.spatial_rules(
        flags, F.array(_kind()), s, s + 3600 * F.when(i % 31 == 0, 0.0).otherwise(191.5 + i % 9 / 4), F.lit(192.0), i % 20 / 20, F.when(i % 5 > 0, i % 10 / 10), rain, F.when(i % 3 == 0, "candidate").otherwise("val"),
    )
    return table(spark, sf_dir, "events").select("event_id", F.array_join(causality.broken(rules), ",").alias("errors"))


@query("""WITH e AS (SELECT event_id, ts, (SELECT max(c) FROM (SELECT unnest([date_trunc('day', ts) - INTERVAL 1 DAY + INTERVAL 12 HOUR, date_trunc('day', ts) - INTERVAL 1 DAY + INTERVAL 18 HOUR, date_trunc('day', ts), date_trunc('day', ts) + INTERVAL 6 HOUR, date_trunc('day', ts) + INTERVAL 12 HOUR, date_trunc('day', ts) + INTERVAL 18 HOUR]) AS c) WHERE c + INTERVAL 6 HOUR <= ts) AS run,
    CASE event_id % 4 WHEN 0 THEN 'FORECAST_AVAILABLE' WHEN 1 THEN 'OBSERVED_AVAILABLE' WHEN 2 THEN 'POST_T0_OBSERVATION' ELSE 'UNKNOWN' END AS availability, CASE WHEN event_id % 5 > 0 THEN ts + to_seconds(value - 50) END AS issue FROM events)
    SELECT event_id, epoch(run)::BIGINT AS run_s, CASE availability WHEN 'FORECAST_AVAILABLE' THEN coalesce(issue <= ts, false) WHEN 'OBSERVED_AVAILABLE' THEN coalesce(issue <= ts, true) ELSE true END AS vintage_ok FROM e""")
def model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last model run that is out at each event, and whether its forcing is of a vintage that may be used."""
    i, s = F.col("event_id"), epoch_seconds(F.col("ts"))
    availability = F.when(i % 4 == 0, "FORECAST_AVAILABLE").when(i % 4 == 1, "OBSERVED_AVAILABLE").when(i % 4 == 2, "POST_T0_OBSERVATION").otherwise("UNKNOWN")
    issue = F.when(i % 5 > 0, s + F.col("value") - 50)
    return table(spark, sf_dir, "events").select("event_id", causality.last_model_run(s).cast("long").alias("run_s"), causality.vintage_ok(availability, issue, s).alias("vintage_ok"))


@query("""WITH a AS (SELECT o_orderkey, o_custkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey % 50 + 4e-10::DOUBLE WHEN 1 THEN o_orderkey % 50 - 4e-10::DOUBLE WHEN 2 THEN o_orderkey % 50 + 3e-9::DOUBLE WHEN 3 THEN -1.0::DOUBLE WHEN 4 THEN (o_orderkey % 50)::DOUBLE END AS t FROM orders), r AS (SELECT DISTINCT o_custkey, (o_orderkey % 20)::DOUBLE AS t FROM orders)
    SELECT a.o_orderkey, min(r.t) AS time_key FROM a LEFT JOIN r ON r.o_custkey = a.o_custkey AND a.t >= 0 AND abs(r.t - a.t) <= 1e-9 GROUP BY 1""")
def result_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked times, some a little off, some invalid, against the times that each customer's results hold."""
    o = table(spark, sf_dir, "orders")
    kind, base = F.col("o_orderkey") % 6, (F.col("o_orderkey") % 50).cast("double")
    asked = o.select("o_orderkey", "o_custkey", F.when(kind == 0, base + 4e-10).when(kind == 1, base - 4e-10).when(kind == 2, base + 3e-9).when(kind == 3, -1.0).when(kind == 4, base).alias("t"))
    return causality.at_times(asked, o.select("o_custkey", (F.col("o_orderkey") % 20).cast("double").alias("t")), ["o_custkey"], "t").select("o_orderkey", "time_key")


_GRIDS = """SELECT c_custkey AS id, c_nationkey AS city_id, CASE WHEN c_custkey % 11 > 0 THEN 'EPSG:' || (4326 + (c_custkey % 13 = 0)::INT) END AS crs, (20 + (c_custkey % 17 = 0)::INT)::INT AS nx, 30 AS ny, 1.5 + (c_custkey % 19 = 0)::INT AS dx, 2.0 AS dy, CASE WHEN c_custkey % 23 = 0 THEN 'up' ELSE 'down' END AS row_orientation, (20 + (c_custkey % 17 = 0)::INT) * 30 - (c_custkey % 29 = 0)::INT AS cells FROM customer"""


@query(f"""WITH g AS ({_GRIDS}), p AS (SELECT a.*, b.id AS other, b.city_id AS city2, b.crs AS crs2, b.nx AS nx2, b.ny AS ny2, b.dx AS dx2, b.dy AS dy2, b.row_orientation AS row2, b.cells AS cells2 FROM g a JOIN g b ON b.id = a.id + 25)
    SELECT id, other, CASE WHEN city_id <> city2 THEN 'CITY_ID_MISMATCH' WHEN crs IS DISTINCT FROM crs2 THEN 'CRS_MISMATCH' WHEN nx <> nx2 THEN 'NX_MISMATCH' WHEN ny <> ny2 THEN 'NY_MISMATCH' WHEN dx <> dx2 THEN 'DX_MISMATCH' WHEN dy <> dy2 THEN 'DY_MISMATCH' WHEN row_orientation <> row2 THEN 'ROW_ORIENTATION_MISMATCH'
        WHEN cells <> nx * ny OR cells2 <> nx2 * ny2 THEN 'ARRAY_SHAPE_MISMATCH' END AS code FROM p""")
def result_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as result grids, each against the one 25 ids on."""
    k = F.col("c_custkey")
    odd = lambda n: (k % n == 0).cast("int")
    nx = 20 + odd(17)
    grid = F.struct(
        F.col("c_nationkey").alias("city_id"), F.when(k % 11 > 0, F.concat(F.lit("EPSG:"), (4326 + odd(13)).cast("string"))).alias("crs"), nx.alias("nx"), F.lit(30).alias("ny"), (1.5 + odd(19)).alias("dx"), F.lit(2.0).alias("dy"),
        F.when(k % 23 == 0, "up").otherwise("down").alias("row_orientation"), (nx * 30 - odd(29)).alias("cells"),
    )
    g = table(spark, sf_dir, "customer").select(k.alias("id"), grid.alias("a"))
    pairs = g.join(g.select((F.col("id") - 25).alias("id"), F.col("id").alias("other"), F.col("a").alias("b")), "id")
    fields = ["city_id", "crs", "nx", "ny", "dx", "dy", "row_orientation"]
    return pairs.select("id", "other", causality.incompatibility(F.col("a"), F.col("b"), fields).alias("code"))

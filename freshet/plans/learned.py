"""Boosted stumps and permutation importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators import boosting, importance
from freshet.plans.registry import query
from freshet.sources.tables import table

ROUNDS = 5
_FEATURES = ("quantity", "price", "discount", "tax")


def _stumps_sql(rate: float = 0.08, least: int = 8) -> str:
    """Each round searches all cuts of all features over all rows; stages stand in CTEs of their own."""
    value = lambda alias: "CASE {}.f ".format(alias) + " ".join(f"WHEN {k} THEN p.{name}" for k, name in enumerate(_FEATURES)) + " END"
    parts = [
        """x AS MATERIALIZED (SELECT l_quantity AS quantity, round(l_extendedprice) AS price, round(l_discount * 100) AS discount, round(l_tax * 100) AS tax, (l_extendedprice > 1500 * l_quantity OR (l_quantity > 40 AND l_tax > 0.04))::INT AS y FROM lineitem)""",
        "c AS MATERIALIZED (" + " UNION ".join(f"SELECT {k} AS f, unnest(quantile_cont({name}, {list(boosting.CUTS)})) AS t FROM x" for k, name in enumerate(_FEATURES)) + ")",
        "p0 AS MATERIALIZED (SELECT *, ln(s / (1 - s)) AS raw FROM x, (SELECT least(greatest(avg(y), 0.001), 0.999) AS s FROM x))",
    ]
    for k in range(ROUNDS):
        parts.append(f"g{k} AS MATERIALIZED (SELECT *, y - q AS g, q * (1 - q) AS h FROM (SELECT *, 1 / (1 + exp(-greatest(-40, least(40, raw)))) AS q FROM p{k}))")
        parts.append(f"e{k} AS MATERIALIZED (SELECT c.f, c.t, {value('c')} <= c.t AS low, sum(g) AS g, sum(h) + 1 AS h, count(*) AS n FROM g{k} p, c GROUP BY ALL)")
        parts.append(f"s{k} AS MATERIALIZED (SELECT a.f, a.t, a.g / a.h AS lft, b.g / b.h AS rgt, a.g * a.g / a.h + b.g * b.g / b.h AS gain FROM e{k} a JOIN e{k} b ON a.f = b.f AND a.t = b.t AND a.low AND NOT b.low WHERE least(a.n, b.n) >= {least} ORDER BY gain DESC, a.f, a.t LIMIT 1)")
        parts.append(f"p{k + 1} AS MATERIALIZED (SELECT p.* EXCLUDE (raw), raw + {rate} * CASE WHEN {value('s')} <= s.t THEN lft ELSE rgt END AS raw FROM p{k} p, s{k} s)")
    found = " UNION ALL ".join(f'SELECT {k} AS round, f::INT AS feature, round(t::DOUBLE, 6) AS threshold, round(lft, 6) AS "left", round(rgt, 6) AS "right", round(gain, 4) AS gain FROM s{k}' for k in range(ROUNDS))
    return f"WITH {', '.join(parts)} {found}"


@query(_stumps_sql())
def boosted_stumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stumps that the rounds choose."""
    li = table(spark, sf_dir, "lineitem")
    wet = (F.col("l_extendedprice") > 1500 * F.col("l_quantity")) | ((F.col("l_quantity") > 40) & (F.col("l_tax") > 0.04))
    rows = li.select(F.col("l_quantity").alias("quantity"), F.round("l_extendedprice").alias("price"), F.round(F.col("l_discount") * 100).alias("discount"), F.round(F.col("l_tax") * 100).alias("tax"), wet.cast("int").alias("y"))
    model = boosting.fit(rows, _FEATURES, "y", rounds=ROUNDS)
    found = [(k, s.feature, s.threshold, s.left, s.right, s.gain) for k, s in enumerate(model.stumps)]
    out = spark.createDataFrame(found, "round int, feature int, threshold double, left double, right double, gain double")
    return out.select("round", "feature", F.round("threshold", 6).alias("threshold"), F.round("left", 6).alias("left"), F.round("right", 6).alias("right"), F.round("gain", 4).alias("gain"))


SEED = 42
_COLUMNS = ("value", "hour", "weekday")


def _logit(x: Sequence[Column]) -> Column:
    return 1.0 / (1.0 + F.exp(-(0.04 * x[0] + 0.15 * x[1] - 0.02 * x[2] - 3.5)))


def _importance_sql() -> str:
    x = {c: f"CASE WHEN r.f = {k} THEN s.{c} ELSE r.{c} END" for k, c in enumerate(_COLUMNS)}
    step = f"CASE WHEN r.size > 1 THEN 1 + ({SEED * 7919} + r.f * 104729) % (r.size - 1) ELSE 0 END"
    p = "1 / (1 + exp(-(0.04 * {} + 0.15 * {} - 0.02 * {} - 3.5)))"
    return f"""WITH e AS (SELECT event_id, user_id, event_type, value, hour(ts)::DOUBLE AS hour, (dayofweek(ts) + 1)::DOUBLE AS weekday, (value + 4 * hour(ts) > 90)::DOUBLE AS y FROM events),
    r AS (SELECT e.*, f, row_number() OVER (PARTITION BY user_id, f ORDER BY md5('{SEED}:' || f || ':' || event_id)) - 1 AS rank, count(*) OVER (PARTITION BY user_id, f) AS size FROM e, (SELECT unnest([{", ".join(map(str, range(len(_COLUMNS))))}]) AS f)),
    t AS (SELECT r.f, r.event_type, avg(pow({p.format(*x.values())} - r.y, 2)) AS b FROM r JOIN r s ON s.user_id = r.user_id AND s.f = r.f AND s.rank = (r.rank + {step}) % r.size GROUP BY ALL),
    b AS (SELECT avg(b) AS base FROM (SELECT avg(pow({p.format(*_COLUMNS)} - y, 2)) AS b FROM e GROUP BY event_type))
    SELECT {list(_COLUMNS)}[f + 1] AS feature, round(avg(t.b), 9) AS event_macro_brier, round(avg(t.b) - any_value(base), 9) AS delta_brier FROM t, b GROUP BY f"""


@query(_importance_sql())
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are the maps; the events are of five types."""
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", "user_id", "event_type", "value", F.hour("ts").cast("double").alias("hour"), F.dayofweek("ts").cast("double").alias("weekday"), (F.col("value") + 4 * F.hour("ts") > 90).cast("int").alias("y"))
    return importance.importance(rows.withColumn("map", F.col("user_id")), "map", "event_type", "event_id", _COLUMNS, "y", _logit, SEED)

"""Platform queries: risk, freshness, forecasts, alerts, limits, search, splits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators import events, platform
from freshet.plans.registry import query
from freshet.sources.tables import epoch_seconds, table

_RISK = "(c_acctbal + 1000) / 11000 AS p, (c_custkey % 10) / 10.0 AS e, (c_nationkey + 1) / 25.0 AS s"


@query(f"""WITH r AS (SELECT c_custkey, {_RISK} FROM customer), x AS (SELECT c_custkey, CASE WHEN p BETWEEN 0 AND 1 AND e BETWEEN 0 AND 1 AND s BETWEEN 0 AND 1 THEN p * e * s END AS r FROM r)
    SELECT c_custkey, round(r::DOUBLE, 6) AS risk, CASE WHEN r >= 0.6 THEN 'SEVERE' WHEN r >= 0.3 THEN 'HIGH' WHEN r >= 0.1 THEN 'MODERATE' WHEN r >= 0 THEN 'LOW' END AS category FROM x""")
def risk_pes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    risk = platform.risk_score((F.col("c_acctbal") + 1000) / 11000, F.col("c_custkey") % 10 / 10, (F.col("c_nationkey") + 1) / 25)
    return c.select("c_custkey", risk.alias("r")).select("c_custkey", F.round("r", 6).alias("risk"), platform.risk_category(F.col("r")).alias("category"))


@query("""WITH l AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1), a AS (SELECT user_id, (epoch(TIMESTAMP '2024-01-30 00:00:00') - epoch(ts)) / 3600.0 AS age FROM l)
    SELECT user_id, CASE WHEN age < 0 THEN 'UNAVAILABLE' WHEN age <= 24 THEN 'FRESH' WHEN age <= 72 THEN 'STALE' ELSE 'EXPIRED' END AS freshness FROM a""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    now = F.datediff(F.lit("2024-01-30").cast("date"), F.lit("1970-01-01").cast("date")) * 86400.0
    return last.select("user_id", platform.freshness((now - epoch_seconds(F.col("ts"))) / 3600.0).alias("freshness"))


@query("""SELECT c_custkey, hours, round(least(b + least(0.35, hours / 72.0 * 0.35), 0.95)::DOUBLE, 6) AS probability, round(greatest(0.45, 0.9 - hours / 200.0)::DOUBLE, 6) AS confidence
    FROM (SELECT c_custkey, (c_custkey % 100) / 100.0 AS b, unnest([6, 24, 48, 72]) AS hours FROM customer)""")
def horizon_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 100 / 100).alias("b"), F.explode(F.array(*[F.lit(h) for h in (6, 24, 48, 72)])).alias("hours"))
    return c.select("c_custkey", "hours", F.round(platform.horizon_probability(F.col("b"), F.col("hours")), 6).alias("probability"), F.round(platform.horizon_confidence(F.col("hours")), 6).alias("confidence"))


@query("""WITH v AS (SELECT event_id, user_id, ts, value > 70 AS v FROM events WHERE event_type <> 'error'), c AS (SELECT *, lag(v, 1, false) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM v)
    SELECT event_id, user_id, CASE WHEN v THEN 'TRIGGERED' ELSE 'RESET' END AS transition FROM c WHERE v <> b""")
def alert_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reading of type error has no verdict, and holds the state."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    found = platform.alert_transitions(e, "user_id", "ts", F.when(F.col("event_type") != "error", F.col("value") > 70))
    return found.select("event_id", "user_id", "transition")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) <= 10 AS allowed FROM events")
def rate_limit_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return platform.rate_limited(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", 10).select("event_id", "allowed")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_type), 'small') AND contains(lower(p_name || ' ' || p_type), 'bolt') ORDER BY (lower(p_name) = 'small bolt' OR lower(p_type) = 'small bolt') DESC, p_partkey LIMIT 20")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return platform.search(table(spark, sf_dir, "part"), ["p_name", "p_type"], "small bolt", "p_partkey", 20).select("p_partkey", "p_name")


@query("SELECT vec_id, label FROM embeddings WHERE embedding[1]::DOUBLE BETWEEN -0.5 AND 0.5 AND embedding[2]::DOUBLE BETWEEN -0.25 AND 1")
def bbox_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return platform.within(e, "x", "y", -0.5, -0.25, 0.5, 1.0).select("vec_id", "label")


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_size >= 20 AND p_retailprice < 1500 AND p_brand IN ('Brand#11', 'Brand#22', 'Brand#1', 'Brand#2')")
def catalog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where((F.col("p_size") >= 20) & (F.col("p_retailprice") < 1500) & F.col("p_brand").isin("Brand#11", "Brand#22", "Brand#1", "Brand#2"))
    return p.select("p_partkey", "p_brand", "p_size")


_SPLIT = "SELECT o_orderkey, o_custkey, CASE WHEN year(o_orderdate) <= 1995 THEN 'train' WHEN year(o_orderdate) = 1996 THEN 'val' ELSE 'test' END AS split FROM orders"


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", events.temporal_split(F.year("o_orderdate"), 1995, 1996).alias("split"))


@query(f"SELECT split, count(*) AS n, count(DISTINCT o_custkey) AS n_customers FROM ({_SPLIT}) GROUP BY 1")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_customers"))


@query(f"SELECT o_custkey, count(DISTINCT split) AS n_splits FROM ({_SPLIT}) GROUP BY 1 HAVING count(DISTINCT split) > 1")
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units in more than one split."""
    return events.straddling(_split(spark, sf_dir), "o_custkey", "split")


@query("SELECT c_custkey, 'never ordered' AS state FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'ordered' FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    never, some = c.join(o, "c_custkey", "left_anti"), c.join(o, "c_custkey", "left_semi")
    return never.withColumn("state", F.lit("never ordered")).unionByName(some.withColumn("state", F.lit("ordered")))

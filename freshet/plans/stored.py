"""Scans and lookups of kept records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators import store
from freshet.plans.registry import query
from freshet.sources.tables import table

_ASSETS = "SELECT vec_id, 'city' || (vec_id % 4) AS city_id, CASE WHEN vec_id % 3 > 0 THEN 'road' ELSE 'school' END AS asset_type, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, CASE WHEN vec_id % 3 > 0 THEN [embedding[3]::DOUBLE, embedding[5]::DOUBLE, embedding[7]::DOUBLE] END AS vx, [embedding[4]::DOUBLE, embedding[6]::DOUBLE, embedding[8]::DOUBLE] AS vy FROM embeddings"
_IN = "({x} BETWEEN -0.1 AND 0.0 AND {y} BETWEEN 0.05 AND 0.3)"


@query(f"SELECT vec_id, city_id, asset_type FROM ({_ASSETS}) WHERE city_id = 'city1' AND asset_type = 'road' AND ({_IN.format(x='x', y='y')} OR " + " OR ".join(_IN.format(x=f"vx[{k}]", y=f"vy[{k}]") for k in (1, 2, 3)) + ") ORDER BY vec_id LIMIT 40 OFFSET 2")
def asset_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of roads that touch a box with their point or any of three vertices: the page is the feature."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda k: F.col("embedding")[k].cast("double")
    vertices = F.when(F.col("vec_id") % 3 > 0, F.array(*[F.struct(at(k).alias("x"), at(k + 1).alias("y")) for k in (2, 4, 6)]))
    assets = e.select("vec_id", F.concat(F.lit("city"), (F.col("vec_id") % 4).cast("string")).alias("city_id"), F.when(F.col("vec_id") % 3 > 0, "road").otherwise("school").alias("asset_type"), at(0).alias("x"), at(1).alias("y"), vertices.alias("vertices"))
    return store.asset_page(assets, "vec_id", "city1", "road", (-0.1, 0.05, 0.0, 0.3), limit=40, offset=2).select("vec_id", "city_id", "asset_type")


@query("""WITH r AS (SELECT o_custkey % 40 AS city, o_orderdate, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
    SELECT city, o_orderkey AS run, o_orderstatus AS status FROM r WHERE n = 1""")
def latest_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as forecast runs of forty cities; each city's last issued."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("city"), F.col("o_orderdate").alias("issued"), F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("status"))
    return store.last_puts(o, ["city"], ["issued", "run"]).select("city", "run", "status")


@query("""WITH l AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
    SELECT c_custkey, o_orderkey IS NOT NULL AS found, o_orderkey, o_totalprice FROM (SELECT c_custkey FROM customer WHERE c_nationkey = 3) LEFT JOIN l ON o_custkey = c_custkey AND n = 1""")
def scenario_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer of one nation, by key."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "o_orderdate")
    asked = store.scan(table(spark, sf_dir, "customer"), {"c_nationkey": 3, "c_mktsegment": None})
    return store.lookup(o, asked, "c_custkey", ["o_orderdate", "o_orderkey"]).select("c_custkey", "found", "o_orderkey", "o_totalprice")


@query("""WITH s AS (SELECT event_id % 500 AS id, user_id % 6 AS city, CASE event_type WHEN 'view' THEN 6 WHEN 'click' THEN 12 ELSE 24 END AS horizon, value, row_number() OVER (PARTITION BY event_id % 500 ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT id, city, horizon, value FROM s WHERE n = 1 AND city = 2 AND horizon = 24""")
def flood_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States put under 500 ids, the last put of each, of one city and horizon."""
    horizon = F.when(F.col("event_type") == "view", 6).when(F.col("event_type") == "click", 12).otherwise(24)
    puts = table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("id"), (F.col("user_id") % 6).alias("city"), horizon.alias("horizon"), "value", "ts", "event_id")
    return store.scan(store.last_puts(puts, ["id"], ["ts", "event_id"]), {"city": 2, "horizon": 24}).select("id", "city", "horizon", "value")

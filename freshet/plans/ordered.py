"""Ordered-sequence queries: spines, trailing sums, clusters, as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators import temporal
from freshet.plans.registry import query
from freshet.sources.tables import epoch_hour, epoch_seconds, table

HOUR = "CAST(floor(epoch(ts) / 3600) AS BIGINT)"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", epoch_hour(F.col("ts")).alias("hour")).agg(F.round(F.sum("value"), 6).alias("total"), F.count("*").alias("n"))


@query(f"SELECT event_type, {HOUR} AS hour, round(sum(value), 6) AS total, count(*) AS n FROM events GROUP BY ALL")
def rain_hourly_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir)


WIDTHS = (1, 3, 6, 12, 24, 48, 72)
_SUMS = ", ".join(f"CASE WHEN count(total) OVER w{w} >= 0.8 * {w} THEN round(sum(total) OVER w{w}, 4) END AS sum_{w}h" for w in WIDTHS)
_FRAMES = ", ".join(f"w{w} AS (PARTITION BY event_type ORDER BY hour RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING)" for w in WIDTHS)


@query(f"""WITH h AS (SELECT event_type, {HOUR} AS hour, round(sum(value), 6) AS total FROM events GROUP BY ALL),
    s AS (SELECT event_type, unnest(range(min(hour), max(hour) + 1)) AS hour FROM h GROUP BY 1)
    SELECT event_type, hour, total, {_SUMS} FROM s LEFT JOIN h USING (event_type, hour) WINDOW {_FRAMES}""")
def trailing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = temporal.hour_spine(hourly(spark, sf_dir), "event_type", "hour", "total")
    out = temporal.trailing_sums(spine, "event_type", "hour", "total", WIDTHS)
    return out.select("event_type", "hour", "total", *[F.round(f"sum_{w}h", 4).alias(f"sum_{w}h") for w in WIDTHS])


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS d, CASE WHEN o_orderdate::DATE - lag(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE) > 45 THEN 1 ELSE 0 END AS starts FROM orders)
    SELECT o_custkey, o_orderkey, sum(starts) OVER (PARTITION BY o_custkey ORDER BY d)::BIGINT AS cluster FROM s""")
def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"))
    return temporal.gap_clusters(o, "o_custkey", "d").select("o_custkey", "o_orderkey", "cluster")


@query("""WITH i AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE + (o_orderkey % 60)::INT AS z FROM orders),
    s AS (SELECT *, CASE WHEN a - max(z) OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 45 THEN 1 ELSE 0 END AS starts FROM i)
    SELECT o_custkey, o_orderkey, sum(starts) OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM s""")
def interval_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("a"))
    o = o.withColumn("z", F.date_add("a", (F.col("o_orderkey") % 60).cast("int")))
    return temporal.interval_clusters(o, "o_custkey", "a", "z", "o_orderkey").select("o_custkey", "o_orderkey", "cluster")


@query("""SELECT * FROM (SELECT event_id, lead(event_id) OVER w AS next_event_id, round(epoch(lead(ts) OVER w) - epoch(ts), 3) AS gap_s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE next_event_id IS NOT NULL""")
def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", epoch_seconds(F.col("ts")).alias("s"))
    pairs = temporal.adjacent_pairs(e, "user_id", "ts", ["event_id", "s"])
    return pairs.select("event_id", "next_event_id", F.round(F.col("next_s") - F.col("s"), 3).alias("gap_s"))


@query("""WITH r AS (SELECT user_id, value, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events),
    p AS (SELECT user_id, max(CASE WHEN n = 1 THEN value END) AS v1, max(CASE WHEN n = 2 THEN value END) AS v2, max(CASE WHEN n = 1 THEN s END) AS s1, max(CASE WHEN n = 2 THEN s END) AS s2 FROM r WHERE n <= 2 GROUP BY 1)
    SELECT user_id, CASE WHEN s1 > s2 THEN round((v1 - v2) / ((s1 - s2) / 3600.0), 4) END AS rate_per_hour FROM p""")
def rate_of_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    out = temporal.rate_of_change(e, "user_id", epoch_seconds(F.col("ts")), "value", ["ts"])
    return out.select("user_id", F.round("rate_per_hour", 4).alias("rate_per_hour"))


@query("""SELECT p.event_id, c.event_id AS prior_event_id, c.value AS prior_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts > c.ts""")
def asof_prior_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    left, right = e.where("event_type = 'purchase'"), e.where("event_type = 'click'")
    return temporal.as_of(left, right, "user_id", "ts", ["event_id", "value"]).select("event_id", "prior_event_id", "prior_value")


@query(f"""WITH e AS (SELECT event_id, user_id, event_type, {HOUR} AS h FROM events),
    need AS (SELECT event_id, user_id, unnest(range(h - 5, h + 1)) AS hour FROM e WHERE event_type = 'purchase'),
    have AS (SELECT DISTINCT user_id, unnest(range(h - 1, h + 1)) AS hour FROM e WHERE event_type = 'view')
    SELECT event_id, count(*) AS n_required, count(have.hour) AS n_covered FROM need LEFT JOIN have ON need.user_id = have.user_id AND need.hour = have.hour GROUP BY 1""")
def interval_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", epoch_hour(F.col("ts")).alias("h"))
    windows = e.where("event_type = 'purchase'").select("event_id", "user_id", (F.col("h") - 6).alias("a"), F.col("h").alias("z"))
    covers = e.where("event_type = 'view'").select("user_id", (F.col("h") - 2).alias("a"), F.col("h").alias("z"))
    return temporal.interval_cover(windows, covers, "event_id", "user_id", "a", "z", "a", "z")


@query(f"""WITH h AS (SELECT DISTINCT user_id, {HOUR} AS hour FROM events), g AS (SELECT user_id, hour - lag(hour) OVER (PARTITION BY user_id ORDER BY hour) - 1 AS gap FROM h)
    SELECT user_id, coalesce(max(gap), 0)::BIGINT AS longest_gap FROM g GROUP BY 1""")
def longest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "events").select("user_id", epoch_hour(F.col("ts")).alias("hour")).distinct()
    return temporal.longest_gap(h, "user_id", "hour")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"])


@query("""WITH RECURSIVE k(user_id, t, n, first) AS (SELECT user_id, min(ts), 1, min(ts) FROM events GROUP BY 1
    UNION ALL SELECT * FROM (SELECT k.user_id, (SELECT min(ts) FROM events e WHERE e.user_id = k.user_id AND e.ts >= k.t + INTERVAL 1 DAY) AS t, k.n + 1, k.first FROM k) WHERE t IS NOT NULL)
    SELECT user_id, max(n)::INT AS n_kept, round(epoch(min(first)), 3) AS first_kept FROM k GROUP BY 1""")
def greedy_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, the event times at least a day after the last one kept."""
    e = table(spark, sf_dir, "events").select("user_id", epoch_seconds(F.col("ts")).alias("s"))
    return temporal.greedy_spacing(e, "user_id", "s", 86400.0).select("user_id", "n_kept", F.round("first_kept", 3).alias("first_kept"))

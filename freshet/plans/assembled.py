"""Lattice maps, inventories of samples, rank correlation and logistic steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators import inventory, lattice, logistic, metrics
from freshet.plans.registry import query
from freshet.sources.tables import epoch_hour, table

_HOUR = "(epoch(date_trunc('hour', ts)) // 3600)::BIGINT"
_LATTICE = f"""WITH k AS (SELECT event_type AS area, (user_id % 9)::INT AS point, {_HOUR} AS hour, max(value) AS v FROM events WHERE value >= 20 GROUP BY ALL), every AS (SELECT DISTINCT event_type AS area, (user_id % 9)::INT AS point FROM events),
    iss AS (SELECT DISTINCT event_type AS area, {_HOUR} - {_HOUR} % 48 AS issue FROM events), b AS (SELECT unnest(range(1, 73)) AS back),
    h AS (SELECT iss.area, iss.issue, k.point, back, v FROM iss CROSS JOIN b JOIN k ON k.area = iss.area AND k.hour = iss.issue - back),
    s AS (SELECT area, issue, point, CASE WHEN count(*) FILTER (back <= 24) * 2 >= 24 THEN sum(v) FILTER (back <= 24) END AS sum_24, CASE WHEN count(*) * 2 >= 72 THEN sum(v) END AS sum_72, max(v) FILTER (back <= 24) AS peak_24, count(*) AS n_known FROM h GROUP BY ALL),
    t AS (SELECT iss.area, iss.issue, every.point, sum_24, sum_72, peak_24, coalesce(n_known, 0) AS n_known FROM iss JOIN every USING (area) LEFT JOIN s USING (area, issue, point))"""


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("area"), (F.col("user_id") % 9).cast("int").alias("point"), epoch_hour(F.col("ts")).alias("hour"), F.when(F.col("value") >= 20, F.col("value")).alias("v"))
    return lattice.accumulations(e, e.select("area", (F.col("hour") - F.col("hour") % 48).alias("issue")), "area", "point", "hour", "v", "issue")


@query(_LATTICE + " SELECT area, issue, point, round(sum_24, 6) AS sum_24, round(sum_72, 6) AS sum_72, peak_24, n_known FROM t")
def lattice_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rain of nine points an event type in the 24 and 72 hours before every second midnight."""
    return _sums(spark, sf_dir).select("area", "issue", "point", F.round("sum_24", 6).alias("sum_24"), F.round("sum_72", 6).alias("sum_72"), "peak_24", "n_known")


@query(_LATTICE + """, p AS (SELECT *, point // 3 / 2.0::DOUBLE AS plat, point % 3 / 2.0::DOUBLE AS plon FROM t), u AS (SELECT area, issue, sum(n_known) / (count(*) * 72.0::DOUBLE) AS completeness FROM p GROUP BY ALL HAVING count(*) >= 4 AND count(peak_24) > 0),
    c AS (SELECT a::INT AS i, b::INT AS j, 1 - a / 3.0::DOUBLE AS lat, b / 3.0::DOUBLE AS lon FROM (SELECT unnest(range(4)) AS a), (SELECT unnest(range(4)) AS b)),
    w AS (SELECT p.*, completeness, i, j, 1 / greatest((plat - lat) * (plat - lat) + (plon - lon) * (plon - lon), 1e-12) AS w FROM p JOIN u USING (area, issue), c)
    SELECT area, issue, i, j, round(coalesce(sum(w * peak_24) / sum(w) FILTER (peak_24 IS NOT NULL), 0), 6) AS peak_24, round(coalesce(sum(w * sum_72) / sum(w) FILTER (sum_72 IS NOT NULL), 0), 6) AS sum_72, round(any_value(completeness), 6) AS completeness FROM w GROUP BY ALL""")
def lattice_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks and sums spread over four by four cells of a unit square."""
    sums = _sums(spark, sf_dir)
    areas = table(spark, sf_dir, "events").select(F.col("event_type").alias("area")).distinct().select("area", *[F.lit(v).alias(k) for k, v in {"west": 0.0, "south": 0.0, "east": 1.0, "north": 1.0}.items()])
    points = lattice.lattice_points(areas, "area", 3)
    cells = areas.select("area", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("c")).select("area", F.floor(F.col("c") / 4).cast("int").alias("i"), (F.col("c") % 4).alias("j"))
    cells = cells.withColumns({"lat": 1 - F.col("i") / 3, "lon": F.col("j") / 3})
    maps = lattice.maps_at_issue(sums, points, cells, "area", "issue", "point", ["peak_24", "sum_72"])
    return maps.select("area", "issue", "i", "j", *[F.round(c, 6).alias(c) for c in ("peak_24", "sum_72", "completeness")])


_TILES = """SELECT l_orderkey AS sample, (l_suppkey % 12)::VARCHAR AS city, l_shipdate::DATE AS day, CASE WHEN l_partkey % 9 > 0 THEN 'e' || (l_partkey % 40) END AS event, 'c' || (l_suppkey % 70) AS episode, CASE l_linenumber % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'test' ELSE 'candidate' END AS split, CASE WHEN l_partkey % 50 > 0 THEN l_partkey END AS scene,
    CASE WHEN l_returnflag = 'R' AND l_partkey % 40 > 20 THEN l_quantity::BIGINT ELSE 0 END AS flood, (50 - l_quantity)::BIGINT AS dry, CASE WHEN l_linenumber <> 3 THEN (l_tax * 100)::BIGINT END AS dark FROM lineitem"""


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    wet = F.when((F.col("l_returnflag") == "R") & (p % 40 > 20), F.col("l_quantity")).otherwise(0.0)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sample"), (s % 12).cast("string").alias("city"), F.to_date("l_shipdate").alias("day"), F.when(p % 9 > 0, F.concat(F.lit("e"), (p % 40).cast("string"))).alias("event"), F.concat(F.lit("c"), (s % 70).cast("string")).alias("episode"),
        F.when(n % 4 == 0, "train").when(n % 4 == 1, "val").when(n % 4 == 2, "test").otherwise("candidate").alias("split"), F.when(p % 50 > 0, p).alias("scene"), wet.cast("long").alias("flood"), (50 - F.col("l_quantity")).cast("long").alias("dry"), F.when(n != 3, F.round(F.col("l_tax") * 100).cast("long")).alias("dark"),
    )


_SHARES = "CASE WHEN {0} > 0 THEN round({1} / {0}, 6) END"


@query(f"""WITH t AS ({_TILES}), w AS (SELECT count(*) AS n_tiles, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test, sum(flood)::BIGINT AS flood, sum(dry)::BIGINT AS dry, sum(dark)::BIGINT AS unknown,
        count(DISTINCT event) AS n_events, count(DISTINCT event) FILTER (flood > 0) AS n_wet_events, count(DISTINCT day) AS n_days, count(DISTINCT city) AS n_cities, count(DISTINCT episode) AS n_episodes FROM t)
    SELECT *, {_SHARES.format("(flood + dry)", "flood")} AS prevalence, {_SHARES.format("(flood + dry + unknown)", "unknown")} AS unknown_fraction, CASE WHEN n_events >= 20 AND n_wet_events >= 3 THEN 'SUFFICIENT FOR VALIDATION' ELSE 'INSUFFICIENT FOR VALIDATION' END AS verdict FROM w""")
def sample_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.inventory(_tiles(spark, sf_dir), "city", "day", "event", "episode", "split", "flood", "dry", "dark")


@query(f"""WITH t AS ({_TILES}), w AS (SELECT city, count(DISTINCT event) AS n_events, count(DISTINCT scene) AS n_scenes, count(DISTINCT episode) AS n_tiles, count(DISTINCT day) AS n_days, min(day) AS first_day, max(day) AS last_day, sum(flood)::BIGINT AS flood, sum(dry)::BIGINT AS dry, sum(dark)::BIGINT AS unknown FROM t GROUP BY city)
    SELECT * REPLACE (first_day::VARCHAR AS first_day, last_day::VARCHAR AS last_day), {_SHARES.format("(flood + dry + unknown)", "unknown")} AS unknown_fraction FROM w""")
def region_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inventory.coverage(_tiles(spark, sf_dir), "city", "event", "scene", "episode", "day", "flood", "dry", "dark")
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query(f"""WITH t AS ({_TILES}) SELECT event, count(*) AS n_pairs, count(DISTINCT city) AS n_regions, sum(flood)::BIGINT AS n_newly_flooded, coalesce(sum(dark), 0)::BIGINT AS n_receding, sum(dry)::BIGINT AS n_persistent_wet, sum(dry + flood)::BIGINT AS n_valid,
    {_SHARES.format("sum(dry + flood)", "(sum(flood) + coalesce(sum(dark), 0))")} AS change_rate, sum(flood) + coalesce(sum(dark), 0) > 0 AS has_signal FROM t WHERE event IS NOT NULL GROUP BY event""")
def event_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.event_summaries(_tiles(spark, sf_dir).withColumn("valid", F.col("dry") + F.col("flood")), "event", "city", "flood", "dark", "dry", "valid")


@query("""WITH e AS (SELECT o_custkey, min(o_orderdate)::DATE AS a, min(o_orderdate)::DATE + (o_custkey % 7)::INT - 1 AS z FROM orders WHERE o_orderpriority = '2-HIGH' AND o_custkey % 50 = 0 GROUP BY o_custkey),
    o AS (SELECT *, max(greatest(a, z)) OVER (ORDER BY least(a, z), o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e)
    SELECT count(*) AS n_events, count(*) FILTER (least(a, z) - reach <= 45) AS n_dependent, count(*) FILTER (least(a, z) - reach <= 45) = 0 AS independent FROM o""")
def event_independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fiftieth customer's first high-priority order as an event of some days."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '2-HIGH' AND o_custkey % 50 = 0").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("a"))
    return inventory.independence(o.withColumn("z", F.date_add("a", (F.col("o_custkey") % 7).cast("int") - 1)), "o_custkey", "a", "z")


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS a, row_number() OVER (ORDER BY o_totalprice / 2 + o_orderkey % 1000 * 200, o_orderkey) AS b FROM orders WHERE o_orderkey % 7 > 0)
    SELECT count(*) AS n, round(corr(a, b), 6) AS rank_correlation, corr(a, b) > 0.1 AS informative FROM r""")
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice") / 2 + F.col("o_orderkey") % 1000 * 200).alias("width"))
    return metrics.rank_correlation(o, "o_totalprice", "width", "o_orderkey")


STEPS = 6


def _logistic_sql(rate: float = 0.4, l2: float = 2e-3) -> str:
    parts = ["x AS MATERIALIZED (SELECT l_quantity / 50 AS a, round(l_discount * 100) / 10 AS b, (l_extendedprice > 1500 * l_quantity)::INT AS y, count(*) AS w FROM lineitem GROUP BY ALL)", "c0 AS (SELECT 0::DOUBLE AS k, 0::DOUBLE AS p, 0::DOUBLE AS q)"]
    for s in range(STEPS):
        g = "w * (1 / (1 + exp(-(k + p * a + q * b))) - y)"
        parts.append(f"c{s + 1} AS MATERIALIZED (SELECT any_value(k) - {rate} * sum({g}) / sum(w) AS k, any_value(p) - {rate} * (sum({g} * a) / sum(w) + {l2} * any_value(p)) AS p, any_value(q) - {rate} * (sum({g} * b) / sum(w) + {l2} * any_value(q)) AS q FROM x, c{s})")
    return f"WITH {', '.join(parts)} SELECT round(k, 9) AS intercept, round(p, 9) AS quantity, round(q, 9) AS discount FROM c{STEPS}"


@query(_logistic_sql())
def logistic_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = li.select((F.col("l_quantity") / 50).alias("a"), (F.round(F.col("l_discount") * 100) / 10).alias("b"), (F.col("l_extendedprice") > 1500 * F.col("l_quantity")).cast("int").alias("y"))
    coef = logistic.fit(rows, ["a", "b"], "y", steps=STEPS).coef
    return spark.createDataFrame([tuple(round(c, 9) for c in coef)], "intercept double, quantity double, discount double")

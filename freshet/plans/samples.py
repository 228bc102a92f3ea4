"""Times, events, samples and splits over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators import events, temporal, times
from freshet.plans.ordered import HOUR, hourly
from freshet.plans.registry import query
from freshet.sources.tables import epoch_hour, epoch_seconds, table

MICROS = 1e6


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, epoch(date_trunc('second', ts))::BIGINT AS s_zulu, (epoch(date_trunc('second', ts)) - 7200)::BIGINT AS s_offset, epoch(date_trunc('second', ts))::BIGINT AS s_naive FROM events")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", times.iso_utc(F.col("ts")).alias("iso"))
    bare, whole = F.substring("iso", 1, 19), lambda c: F.floor(times.parse_utc(c) / MICROS).cast("long")
    return e.select("event_id", "iso", whole(F.col("iso")).alias("s_zulu"), whole(F.concat(bare, F.lit("+02:00"))).alias("s_offset"), whole(bare).alias("s_naive"))


@query("SELECT strftime(ts, '%Y-%m-%dT%H:%M:00') AS hour, count(*) AS n, round(min(epoch(ts)) - 192 * 3600, 3) AS first_issue_s FROM events GROUP BY 1")
def hour_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(times.hour_key(F.col("ts")).alias("hour"), epoch_seconds(F.col("ts")).alias("s"))
    return e.groupBy("hour").agg(F.count("*").alias("n"), F.round(times.issue_seconds(F.min("s")), 3).alias("first_issue_s"))


@query("""WITH p AS (SELECT epoch(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) - epoch(o_orderdate) AS s FROM orders)
    SELECT CASE WHEN s < 86400 THEN '0-1 days' WHEN s < 259200 THEN '1-3 days' WHEN s < 518400 THEN '3-6 days' WHEN s < 1036800 THEN '6-12 days' ELSE '12+ days' END AS bucket, count(*) AS n FROM p WHERE s IS NOT NULL GROUP BY 1""")
def delta_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", epoch_seconds(F.col("o_orderdate")).alias("s"))
    pairs = temporal.adjacent_pairs(o.withColumn("at", F.struct("o_orderdate", "o_orderkey")), "o_custkey", "at", ["s"])
    return pairs.groupBy(times.delta_bucket(times.hours_between(F.col("next_s"), F.col("s")), (0, 1, 3, 6, 12)).alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT month(o_orderdate)::INT AS month, CASE WHEN month(o_orderdate) IN (4, 5) THEN 'haor_premonsoon_flash' WHEN month(o_orderdate) IN (6, 7, 8, 9) THEN coalesce(p, 'monsoon_riverine') WHEN month(o_orderdate) IN (1, 2) THEN 'winter_or_early' ELSE coalesce(p, 'unspecified') END AS mechanism,
    round(sin(2 * pi() * month(o_orderdate) / 12), 9) AS sin_month, round(cos(2 * pi() * month(o_orderdate) / 12), 9) AS cos_month, count(*) AS n
    FROM (SELECT o_orderdate, CASE WHEN c_nationkey < 5 THEN 'urban_pluvial' END AS p FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY ALL""")
def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sin, cos = times.seasonality(F.col("month"))
    rows = o.select(F.month("o_orderdate").alias("month"), F.when(F.col("c_nationkey") < 5, "urban_pluvial").alias("p")).groupBy("month", times.mechanism(F.col("month"), F.col("p")).alias("mechanism")).agg(F.count("*").alias("n"))
    return rows.select("month", "mechanism", F.round(sin, 9).alias("sin_month"), F.round(cos, 9).alias("cos_month"), "n")


_KINDS = {"view": "OBSERVED", "click": "FORECAST", "purchase": "REANALYSIS", "error": "UNAVAILABLE"}
_KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " ELSE 'SIMULATED' END"


@query(f"""WITH e AS (SELECT {_KIND_SQL} AS kind, CASE WHEN event_id % 2 = 0 THEN 'pre_t0' WHEN event_id % 5 > 0 THEN 'in_horizon' ELSE 'other' END AS w, CASE WHEN event_id % 3 > 0 THEN value END AS issue FROM events),
    c AS (SELECT CASE WHEN kind = 'UNAVAILABLE' THEN 'UNAVAILABLE' WHEN kind = 'SIMULATED' THEN 'UNKNOWN'
        WHEN w = 'in_horizon' THEN CASE WHEN kind <> 'FORECAST' THEN 'POST_T0_OBSERVATION' WHEN issue <= 50 THEN 'FORECAST_AVAILABLE' WHEN issue > 50 THEN 'POST_T0_OBSERVATION' ELSE 'UNAVAILABLE' END
        WHEN w = 'pre_t0' THEN CASE WHEN kind <> 'FORECAST' THEN 'OBSERVED_AVAILABLE' WHEN issue <= 50 THEN 'FORECAST_AVAILABLE' ELSE 'UNAVAILABLE' END ELSE 'UNKNOWN' END AS precip_class FROM e)
    SELECT precip_class, count(*) AS n FROM c GROUP BY 1""")
def precip_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit("SIMULATED")
    for k, v in _KINDS.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    window = F.when(F.col("event_id") % 2 == 0, "pre_t0").when(F.col("event_id") % 5 > 0, "in_horizon").otherwise("other")
    e = table(spark, sf_dir, "events").select(times.precip_class(window, kind, F.when(F.col("event_id") % 3 > 0, F.col("value")), F.lit(50.0)).alias("precip_class"))
    return e.groupBy("precip_class").agg(F.count("*").alias("n"))


_ELIGIBLE = """SELECT user_id, event_type, coverage, CASE WHEN ok AND coverage >= 0.999 THEN 'FULL' WHEN ok AND coverage > 0 THEN 'PARTIAL' WHEN ok THEN 'STATE_ONLY' WHEN obs THEN 'OBSERVED_ONLY' ELSE 'UNAVAILABLE' END AS eligibility
    FROM (SELECT user_id, event_type, greatest(0, least(1, (value - 20) / 60.0))::DOUBLE AS coverage, event_id % 4 > 0 AS ok, event_id % 8 = 0 AS obs FROM events)"""


def _eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("coverage", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") - 20) / 60.0)))
    return e.select("user_id", "event_type", "coverage", times.eligibility(F.col("event_id") % 4 > 0, F.col("coverage"), F.col("event_id") % 8 == 0).alias("eligibility"))


@query(f"SELECT eligibility, count(*) AS n FROM ({_ELIGIBLE}) GROUP BY 1")
def eligibility_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _eligible(spark, sf_dir).groupBy("eligibility").agg(F.count("*").alias("n"))


@query(f"""SELECT event_type, count(*) AS n_pairs, count(DISTINCT user_id) AS n_events, count(*) FILTER (eligibility = 'FULL') AS n_full, count(*) FILTER (eligibility = 'PARTIAL') AS n_partial, count(*) FILTER (eligibility = 'STATE_ONLY') AS n_state_only,
    count(*) FILTER (coverage <= 0) AS n_coverage_zero, round(count(*) FILTER (coverage <= 0) / count(*), 6) AS zero_coverage_rate, round(avg(coverage), 6) AS mean_coverage FROM ({_ELIGIBLE}) GROUP BY 1""")
def missingness_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.missingness(_eligible(spark, sf_dir), "event_type", "user_id", "eligibility", "coverage")


@query("SELECT event_type, count(v) AS n, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.25), 6) AS q25, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75 FROM (SELECT event_type, CASE WHEN value >= 10 THEN value END AS v FROM events) GROUP BY 1")
def grouped_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.when(F.col("value") >= 10, F.col("value")).alias("v"))
    return events.numeric_summary(e, ["event_type"], "v")


@query("WITH p AS (SELECT o_custkey, o_totalprice AS x, CASE WHEN o_orderkey % 31 = 5 THEN NULL WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 1000)::DOUBLE END AS y FROM orders) SELECT o_custkey, count(x) FILTER (y IS NOT NULL) AS n, CASE WHEN count(y) >= 5 AND stddev_pop(y) > 0 THEN round(corr(x, y), 6) END AS pearson FROM p GROUP BY 1")
def pearson_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").alias("x"), F.when(F.col("o_orderkey") % 31 == 5, float("inf")).when(F.col("o_orderkey") % 3 > 0, (F.col("o_orderkey") % 1000).cast("double")).alias("y"))
    return events.pearson(o, ["o_custkey"], "x", "y")


_PIXELS = "SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 0 END AS y, l_quantity / 10 AS rain FROM lineitem"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = times.coded(F.col("l_returnflag"), {"R": 1, "A": 0})
    return table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(y != 255, y).alias("y"), (F.col("l_quantity") / 10).alias("rain"))


@query(f"""WITH s AS (SELECT l_suppkey, count(*) AS n, count(y) AS known, count(*) FILTER (y = 1) AS wet, max(rain) AS rain FROM ({_PIXELS}) GROUP BY 1)
    SELECT l_suppkey, wet BETWEEN 1 AND 20 AS weak_flood, wet BETWEEN 1 AND 50 AS small_flood, (n - known) >= 0.5 * n AS nodata_heavy, rain < 5.0 AS low_rainfall, wet > 0 AND wet < 0.05 * greatest(known, 1) AS rare_event FROM s""")
def hard_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.hard_cases(_pixels(spark, sf_dir), ["l_suppkey"], "y", "rain")


@query(f"SELECT l_suppkey, count(*) FILTER (y = 1) AS n_wet, count(*) FILTER (y = 0) AS n_dry, count(*) - count(y) AS n_unknown, round(count(*) FILTER (y = 1) / count(y), 6) AS prevalence FROM ({_PIXELS}) GROUP BY 1")
def prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.prevalence(_pixels(spark, sf_dir), ["l_suppkey"], "y")


@query("""SELECT user_id, round(min(epoch(ts)), 3) AS first_s, round(arg_max(epoch(ts), {'v': value, 't': -epoch(ts)}), 3) AS peak_s, round(max(epoch(ts)), 3) AS last_s, count(*) AS n_scenes, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS regions FROM events GROUP BY 1""")
def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "value", "event_type", epoch_seconds(F.col("ts")).alias("s"))
    return events.records(e, "user_id", "s", "value", "event_type").withColumns({c: F.round(c, 3) for c in ("first_s", "peak_s", "last_s")})


@query("""WITH p AS (SELECT user_id, CASE WHEN value >= 20 THEN value > 60 END AS b, CASE WHEN lead(value) OVER w >= 20 THEN lead(value) OVER w > 60 END AS a, lead(event_id) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    k AS (SELECT * FROM p WHERE nxt IS NOT NULL)
    SELECT user_id, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_known, CASE WHEN count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) > 0 THEN round(count(*) FILTER (a <> b) / count(*) FILTER (a IS NOT NULL AND b IS NOT NULL), 6) END AS turnover,
    CASE WHEN count(*) FILTER ((a OR b) AND a IS NOT NULL AND b IS NOT NULL) > 0 THEN round(count(*) FILTER (a AND b) / count(*) FILTER ((a OR b) AND a IS NOT NULL AND b IS NOT NULL), 6) END AS iou FROM k GROUP BY 1""")
def pair_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.when(F.col("value") >= 20, F.col("value") > 60).alias("wet"))
    return events.pair_statistics(temporal.adjacent_pairs(e, "user_id", "ts", ["wet"]), ["user_id"], "wet", "next_wet")


_CHANNELS = ("l_quantity", "l_tax", "l_linenumber", "flat")


@query("WITH r AS (SELECT *, 1.0::DOUBLE AS flat FROM lineitem) " + " UNION ALL ".join(f"SELECT '{c}' AS channel, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, max({c}) = min({c}) AS constant FROM r" for c in _CHANNELS))
def channel_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.channel_audit(table(spark, sf_dir, "lineitem").withColumn("flat", F.lit(1.0)), _CHANNELS)


_SPLITS = "SELECT o_orderkey, o_custkey, CASE WHEN year(o_orderdate) <= 1995 THEN 'train' WHEN year(o_orderdate) = 1996 THEN 'val' ELSE 'test' END AS split FROM orders"


@query(f"SELECT o_custkey, CASE WHEN max((split = 'train')::INT) = 1 AND max((split <> 'train')::INT) = 1 THEN 'mixed' WHEN max((split = 'train')::INT) = 1 THEN 'train_only' ELSE 'test_only' END AS exposure FROM ({_SPLITS}) GROUP BY 1")
def split_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", events.temporal_split(F.year("o_orderdate"), 1995, 1996).alias("split"))
    return events.split_exposure(o, "o_custkey", "split")


@query("SELECT CASE WHEN c_nationkey IN (3, 7, 11) THEN 'test' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT c_nationkey) AS n_regions FROM customer GROUP BY 1")
def geographic_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("split", events.held_out_split(F.col("c_nationkey"), [3, 7, 11]))
    return c.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("c_nationkey").alias("n_regions"))


@query(f"""WITH s AS (SELECT event_id, (20 + event_id % 5)::INT AS lookback, (event_id % 10) / 10.0 AS complete, {_KIND_SQL} AS kind, epoch(ts) AS issue, epoch(ts) + value - 95 AS issued, epoch(ts) + 3600 * (24 + (event_id % 50 = 0)::INT) AS valid FROM events)
    SELECT event_id, array_to_string(list_filter([CASE WHEN lookback <> 24 THEN 'lookback_length' END, CASE WHEN complete < 0.8 THEN 'lookback_incomplete' END, CASE WHEN kind = 'FORECAST' THEN 'forecast_as_observed' END,
    CASE WHEN kind NOT IN ('OBSERVED', 'SIMULATED', 'UNAVAILABLE', 'FORECAST') THEN 'unexpected_kind' END, CASE WHEN issued > issue THEN 'issued_after_issue' END, CASE WHEN abs((valid - issue) / 3600.0 - 24) > 0.01 THEN 'valid_not_issue_plus_horizon' END], lambda x: x IS NOT NULL), ',') AS errors FROM s""")
def sample_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit("SIMULATED")
    for k, v in _KINDS.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    s, i = epoch_seconds(F.col("ts")), F.col("event_id")
    errors = events.sample_errors(20 + i % 5, i % 10 / 10, kind, s + F.col("value") - 95, s, s + 3600 * (24 + (i % 50 == 0).cast("int")), F.lit(24.0))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(errors, ",").alias("errors"))


@query("""WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 > 0 THEN o_orderdate::DATE END AS d, CASE WHEN o_custkey % 11 > 0 THEN o_custkey % 3 > 0 END AS inside, CASE o_orderkey % 7 WHEN 0 THEN 'India; Bangladesh' WHEN 1 THEN 'Nigeria and Bangladesh' WHEN 2 THEN NULL ELSE 'BANGLADESH' END AS country, o_totalprice AS area, CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 0 END AS dead, (o_orderkey % 20) * 1000 AS displaced, o_orderpriority AS cause FROM orders),
    r AS (SELECT *, CASE WHEN d IS NULL THEN 'missing_event_dates' WHEN country IS NULL OR contains(lower(country), 'nigeria') THEN 'country_not_useful' WHEN NOT coalesce(inside, true) AND area < 100000 THEN 'centroid_outside' WHEN area < 1000 AND dead = 0 AND displaced < 10000 THEN 'tiny_or_unconfirmed_extent' WHEN month(d) IN (1, 2) AND dead = 0 AND displaced < 10000 THEN 'winter_residual_water_cluster' END AS rejection FROM e)
    SELECT coalesce(rejection, CASE WHEN month(d) IN (4, 5) THEN 'haor_premonsoon' WHEN month(d) IN (6, 7, 8, 9, 10) THEN 'monsoon_riverine' ELSE 'ok' END) AS verdict, count(*) AS n FROM r GROUP BY 1""")
def secondary_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    country = F.when(k % 7 == 0, "India; Bangladesh").when(k % 7 == 1, "Nigeria and Bangladesh").when(k % 7 > 2, "BANGLADESH")
    inside = F.when(F.col("o_custkey") % 11 > 0, F.col("o_custkey") % 3 > 0)
    quality, rejection = events.secondary_rules(F.when(k % 17 > 0, F.to_date("o_orderdate")), country, inside, F.col("o_totalprice"), F.when(k % 5 == 0, 3).otherwise(0), k % 20 * 1000, F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").groupBy(F.coalesce(rejection, quality).alias("verdict")).agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE + (o_orderkey % 30)::INT - 5 AS z FROM orders), l AS (SELECT * FROM o WHERE o_orderkey % 2 = 0), w AS (SELECT * FROM o WHERE o_orderkey % 2 = 1),
    m AS (SELECT l.o_custkey, l.o_orderkey, arg_min(w.o_orderkey, {'a': least(w.a, w.z), 'k': w.o_orderkey}) AS matched FROM l LEFT JOIN w ON l.o_custkey = w.o_custkey AND least(w.a, w.z) - greatest(l.a, l.z) <= 45 AND least(l.a, l.z) - greatest(w.a, w.z) <= 45 GROUP BY 1, 2) SELECT * FROM m""")
def first_window_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("start"))
    o = o.withColumn("end", F.date_add("start", (F.col("o_orderkey") % 30 - 5).cast("int")))
    return events.first_match(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey", "o_orderkey")


@query(f"""WITH r AS (SELECT event_type, user_id % 9 AS point, {HOUR} AS hour, CASE WHEN value >= 20 THEN value END AS v FROM events), n AS (SELECT event_type, count(DISTINCT point) AS n FROM r GROUP BY 1),
    h AS (SELECT event_type, hour, avg(v) AS mean, count(DISTINCT point) AS k FROM r WHERE v IS NOT NULL GROUP BY ALL)
    SELECT event_type, hour, round(mean, 6) AS mean_mm, k >= greatest(1, ceil(0.5 * n)) AS present FROM h JOIN n USING (event_type)""")
def lattice_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 9).alias("point"), epoch_hour(F.col("ts")).alias("hour"), F.when(F.col("value") >= 20, F.col("value")).alias("v"))
    return events.lattice_hours(r, "event_type", "point", "hour", "v")


@query("""WITH r AS (SELECT l_orderkey, l_returnflag AS source, round(l_discount * 10, 6) AS coverage, l_linestatus = 'F' OR l_quantity > 10 AS ok FROM lineitem)
    SELECT l_orderkey, max(coverage) FILTER (ok) AS coverage, arg_max(source, {'c': coverage, 's': -ascii(source)}) FILTER (ok) AS selected_source FROM r GROUP BY 1""")
def best_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("source"), F.round(F.col("l_discount") * 10, 6).alias("coverage"), ((F.col("l_linestatus") == "F") | (F.col("l_quantity") > 10)).alias("ok"))
    return events.best_source(r, "l_orderkey", "source", "coverage", F.col("ok"))


@query(f"""WITH h AS (SELECT event_type, {HOUR} AS hour, round(sum(value), 6) AS total FROM events GROUP BY ALL), s AS (SELECT event_type, unnest(range(min(hour), max(hour) + 1)) AS hour FROM h GROUP BY 1),
    w AS (SELECT event_type, hour, round(sum(total) OVER p, 4) AS rain, count(total) OVER p / 24 AS complete, (max(total) OVER f > 150)::INT AS y FROM s LEFT JOIN h USING (event_type, hour)
    WINDOW p AS (PARTITION BY event_type ORDER BY hour RANGE BETWEEN 24 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY event_type ORDER BY hour RANGE BETWEEN 24 FOLLOWING AND 24 FOLLOWING))
    SELECT event_type, hour, rain, round(complete, 6) AS complete, y FROM w WHERE complete >= 0.8""")
def lookback_and_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = temporal.hour_spine(hourly(spark, sf_dir), "event_type", "hour", "total")
    return events.lookback_and_label(spine, "event_type", "hour", "total", 24, 24, 150.0)


@query(f"SELECT user_id, max(hour) AS latest_hour FROM (SELECT DISTINCT user_id, {HOUR} AS hour FROM events WHERE event_type = 'view') JOIN (SELECT DISTINCT user_id, {HOUR} AS hour FROM events WHERE event_type = 'click') USING (user_id, hour) GROUP BY 1")
def latest_shared_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", epoch_hour(F.col("ts")).alias("hour"))
    return events.latest_shared(e.where("event_type = 'view'"), e.where("event_type = 'click'"), ["user_id"], "hour")


@query("""WITH o AS (SELECT user_id, min(epoch(ts)) AS a FROM events WHERE event_type = 'error' GROUP BY 1), p AS (SELECT user_id, min(epoch(ts)) AS b FROM events WHERE event_type = 'purchase' AND value > 60 GROUP BY 1)
    SELECT user_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'COMPUTED_AT_SCENE_RESOLUTION' ELSE 'UNAVAILABLE' END AS status, round(b - a, 3) AS onset_shift_s FROM o FULL JOIN p USING (user_id)""")
def onset_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", epoch_seconds(F.col("ts")).alias("s"))
    return events.onset_error(e.where("event_type = 'error'"), e.where("event_type = 'purchase' AND value > 60"), "user_id", "s")


@query("""WITH t AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_tax) AS mt, stddev_pop(l_tax) AS st FROM lineitem WHERE l_returnflag = 'N') SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) AS l_quantity, round((l_tax - mt) / st, 6) AS l_tax FROM lineitem, t""")
def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag")
    out = events.scaled(rows, ["l_quantity", "l_tax"], F.col("l_returnflag") == "N")
    return out.select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_tax", 6).alias("l_tax"))


@query("""SELECT n_nationkey, sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '","region":' || CASE WHEN n_regionkey > 1 THEN n_regionkey::VARCHAR ELSE 'null' END || '}') AS config_hash FROM nation""")
def config_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"name": F.col("n_name"), "key": F.col("n_nationkey"), "region": F.when(F.col("n_regionkey") > 1, F.col("n_regionkey"))}
    return table(spark, sf_dir, "nation").select("n_nationkey", events.fingerprint(columns).alias("config_hash"))

"""Validation of samples, grids, records and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators import times, validation
from freshet.plans.registry import query
from freshet.sources import tables
from freshet.sources.tables import table


@query("""WITH e AS (SELECT event_id, (event_id % 10) / 10.0 AS c, CASE WHEN event_id % 3 > 0 THEN (value > 50)::INT END AS a, CASE WHEN event_id % 4 > 0 THEN event_id % 4 > 1 END AS av, CASE WHEN event_id % 5 > 0 THEN (value > 20)::INT END AS b FROM events)
    SELECT event_id, CASE WHEN c >= 0.8 THEN a END AS track_a, CASE WHEN c >= 0.8 AND coalesce(av, false) THEN b END AS track_b FROM e""")
def sample_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    parts = (i % 10 / 10, F.when(i % 3 > 0, (v > 50).cast("int")), F.when(i % 4 > 0, i % 4 > 1), F.when(i % 5 > 0, (v > 20).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", *[validation.sample_label(*parts, track=t).alias(f"track_{t.lower()}") for t in "AB"])


@query("""WITH p AS (SELECT l_suppkey, CASE WHEN l_returnflag = 'N' THEN 255 WHEN l_returnflag = 'R' THEN 1 WHEN l_linenumber < 7 THEN 0 END AS code, CASE WHEN l_returnflag <> 'N' OR (l_suppkey % 9 = 0 AND l_quantity > 45) THEN l_quantity / 50 WHEN l_quantity < 5 THEN 'nan'::DOUBLE END AS score FROM lineitem)
    SELECT l_suppkey, count(*) FILTER (coalesce(code, 255) = 255) AS n_unknown, count(*) FILTER (coalesce(code, 255) = 255 AND score IS NOT NULL AND NOT isnan(score)) AS n_scored, count(*) FILTER (coalesce(code, 255) = 255 AND score IS NOT NULL AND NOT isnan(score)) = 0 AS kept FROM p GROUP BY 1""")
def unknown_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, q = F.col("l_returnflag"), F.col("l_quantity")
    code = F.when(flag == "N", 255).when(flag == "R", 1).when(F.col("l_linenumber") < 7, 0)
    score = F.when((flag != "N") | ((F.col("l_suppkey") % 9 == 0) & (q > 45)), q / 50).when(q < 5, float("nan"))
    return validation.unknown_scored(table(spark, sf_dir, "lineitem"), ["l_suppkey"], code, score)


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN o_orderdate::DATE END AS a, o_orderdate::DATE + (o_orderkey % 40)::INT AS z FROM orders)
    SELECT coalesce(a >= DATE '1996-03-01' AND z <= DATE '1999-08-31', false) AS covered, count(*) AS n FROM o GROUP BY 1""")
def lattice_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    first, last = (F.lit(d).cast("date") for d in ("1996-03-01", "1999-08-31"))
    return table(spark, sf_dir, "orders").groupBy(validation.covers(F.when(k % 9 > 0, day), F.date_add(day, (k % 40).cast("int")), first, last).alias("covered")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS provider, CASE WHEN p_partkey % 7 > 0 THEN p_type ELSE '  ' END AS license, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS checksum, CASE WHEN p_partkey % 2 > 0 THEN '' ELSE p_name END AS source_url FROM part)
    SELECT p_partkey, array_to_string(list_filter([CASE WHEN coalesce(trim(provider), '') = '' THEN 'provider' END, CASE WHEN trim(license) = '' THEN 'license' END, CASE WHEN coalesce(trim(checksum), '') = '' AND trim(source_url) = '' THEN 'checksum|source_url' END], lambda x: x IS NOT NULL), ',') AS missing FROM r""")
def provenance_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    record = F.struct(F.when(k % 5 > 0, F.col("p_brand")).alias("provider"), F.when(k % 7 > 0, F.col("p_type")).otherwise("  ").alias("license"), F.when(k % 3 > 0, F.col("p_name")).alias("checksum"), F.when(k % 2 > 0, "").otherwise(F.col("p_name")).alias("source_url"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(validation.missing_provenance(record, ["provider", "license"]), ",").alias("missing"))


@query("""WITH g AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 > 0 THEN 'EPSG:' || (4326 + (c_custkey % 13 = 0)::INT) END AS crs, CASE WHEN c_custkey % 17 > 0 THEN 'cell_center' ELSE 'corner' END AS cc, c_acctbal + CASE c_custkey % 19 WHEN 0 THEN 1e-6::DOUBLE WHEN 1 THEN 1e-10::DOUBLE ELSE 0 END AS ox, c_acctbal AS west, c_custkey % 23 AS nx FROM customer)
    SELECT k AS c_custkey, CASE WHEN coalesce(crs <> 'EPSG:4326', true) THEN 'UNSUPPORTED_CRS' WHEN cc <> 'cell_center' THEN 'UNSUPPORTED_CELL_CENTER' WHEN abs(ox - west) > 1e-9 THEN 'ORIGIN_OFF_BOUNDS' WHEN nx <= 0 THEN 'EMPTY_GRID' END AS error FROM g""")
def grid_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, west = F.col("c_custkey"), F.col("c_acctbal")
    grid = F.struct(
        F.when(k % 11 > 0, F.concat(F.lit("EPSG:"), (4326 + (k % 13 == 0).cast("int")).cast("string"))).alias("crs"), F.when(k % 17 > 0, "cell_center").otherwise("corner").alias("cell_center"),
        (west + F.when(k % 19 == 0, 1e-6).when(k % 19 == 1, 1e-10).otherwise(0.0)).alias("origin_x"), F.lit(0.0).alias("origin_y"), (k % 23).alias("nx"), F.lit(1).alias("ny"),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", validation.grid_error(grid, west, F.lit(0.0)).alias("error"))


_CELLS = "SELECT l_suppkey AS surface, (l_partkey % 3) AS i, (l_linenumber - 1) AS j, CASE WHEN l_suppkey % 5 = 1 AND l_quantity > 49 THEN 'inf'::DOUBLE WHEN l_suppkey % 5 = 2 AND l_quantity > 49 THEN NULL WHEN l_suppkey % 5 = 3 AND l_quantity > 49 THEN 'nan'::DOUBLE ELSE l_quantity END AS v FROM lineitem WHERE l_suppkey % 2 = 0 OR l_linenumber > 0"


@query(f"""WITH c AS ({_CELLS}), d AS (SELECT surface, i, j, max(v) FILTER (NOT isnan(v)) AS hi, bool_or(v IS NULL) AS missing, bool_or(coalesce(isnan(v), false)) AS isnan_ FROM c GROUP BY ALL),
    w AS (SELECT surface, count(*) AS n_cells, count(*) FILTER (missing) AS n_null, count(*) FILTER (NOT missing AND isnan_) AS n_nan, count(*) FILTER (NOT missing AND NOT isnan_ AND isinf(hi)) AS n_inf, min(hi) FILTER (NOT missing AND NOT isnan_ AND NOT isinf(hi)) AS least, max(hi) FILTER (NOT missing AND NOT isnan_ AND NOT isinf(hi)) AS most FROM d GROUP BY surface)
    SELECT surface, n_cells, n_null, n_nan, n_inf, least, most, CASE WHEN n_cells <> 21 THEN 'SHAPE' WHEN n_null + n_nan + n_inf > 0 THEN 'NON_FINITE' END AS error FROM w""")
def surface_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's three by seven cells, the greatest value at each place, some of them damaged."""
    s, q = F.col("l_suppkey"), F.col("l_quantity")
    v = F.when((s % 5 == 1) & (q > 49), float("inf")).when((s % 5 == 2) & (q > 49), None).when((s % 5 == 3) & (q > 49), float("nan")).otherwise(q)
    c = table(spark, sf_dir, "lineitem").select(s.alias("surface"), (F.col("l_partkey") % 3).alias("i"), (F.col("l_linenumber") - 1).alias("j"), v.alias("v"))
    worst = F.when(F.bool_or(F.col("v").isNull()), None).when(F.bool_or(F.isnan("v")), float("nan")).otherwise(F.max("v"))
    return validation.surface_audit(c.groupBy("surface", "i", "j").agg(worst.alias("v")), ["surface"], "i", "j", "v", F.lit(7), F.lit(3))


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 7 > 0 THEN value - 20 END AS rain, value - 5 AS lx, CASE WHEN event_id % 11 > 0 THEN 1.0 ELSE -1.0 END AS ly, CASE event_id % 13 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 0 ELSE 0.5 END AS dt FROM events)
    SELECT event_id, array_to_string(list_filter([CASE WHEN coalesce(rain < 0, true) THEN 'negative_rain' END, CASE WHEN lx <= 0 OR ly <= 0 THEN 'domain_not_positive' END, CASE WHEN isnan(dt) OR dt <= 0 THEN 'step_not_positive' END], lambda x: x IS NOT NULL), ',') AS errors FROM r""")
def run_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    found = validation.run_errors(F.when(i % 7 > 0, v - 20), v - 5, F.when(i % 11 > 0, 1.0).otherwise(-1.0), F.when(i % 13 == 0, float("nan")).when(i % 13 == 1, 0.0).otherwise(0.5))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(found, ",").alias("errors"))


@query("""WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'then' END AS revoked, CASE c_custkey % 4 WHEN 0 THEN 'private' WHEN 1 THEN 'organization' WHEN 2 THEN 'public' END AS vis, CASE WHEN c_custkey % 5 > 0 THEN c_nationkey END AS owner, CASE WHEN c_custkey % 6 > 0 THEN c_nationkey + c_custkey % 2 END AS asker, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 3 = 0 END AS known FROM customer)
    SELECT c_custkey, CASE WHEN revoked IS NOT NULL THEN 'REVOKED' WHEN coalesce(vis, 'private') = 'private' AND owner IS NOT NULL AND asker IS DISTINCT FROM owner THEN 'PRIVATE' WHEN vis = 'organization' AND NOT coalesce(known, false) THEN 'SIGN_IN' END AS refusal FROM s""")
def share_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    parts = (F.when(k % 9 == 0, "then"), F.when(k % 4 == 0, "private").when(k % 4 == 1, "organization").when(k % 4 == 2, "public"), F.when(k % 5 > 0, n), F.when(k % 6 > 0, n + k % 2), F.when(k % 7 > 0, k % 3 == 0))
    return table(spark, sf_dir, "customer").select("c_custkey", validation.share_refusal(*parts).alias("refusal"))


@query("""WITH w AS (SELECT event_id, ts, date_trunc('day', ts) AS a, CASE WHEN event_id % 4 > 0 THEN date_trunc('day', ts) + INTERVAL 12 HOUR END AS z, value / 100 AS f FROM events)
    SELECT event_id, ts >= a AND coalesce(ts <= z, true) AS inside, ts > a AND ts <= z AS in_half_open, CASE WHEN event_id % 3 > 0 THEN (f > 0.25)::INT END AS wet FROM w""")
def window_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the first half of their day, of an open end for some, and fractions as wet or dry."""
    i, ts = F.col("event_id"), F.col("ts")
    day = F.date_trunc("day", ts).cast("timestamp_ntz")
    end = F.when(i % 4 > 0, day + F.expr("INTERVAL 12 HOURS"))
    return table(spark, sf_dir, "events").select("event_id", times.in_window(ts, day, end).alias("inside"), times.half_open(ts, day, end).alias("in_half_open"), validation.wet_from_fraction(F.when(i % 3 > 0, F.col("value") / 100), 0.25).alias("wet"))


@query("""WITH s AS (SELECT user_id, list(epoch_us(ts) ORDER BY event_id) AS us, list(CASE WHEN value >= 20 THEN value END ORDER BY event_id) AS v FROM events GROUP BY user_id) SELECT user_id, unnest(us) AS us, unnest(v) AS value FROM s""")
def columnar_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's readings as two parallel arrays, and back; small groups here, a feed has one array a file."""
    e = table(spark, sf_dir, "events")
    pair = F.struct("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.when(F.col("value") >= 20, F.col("value")).alias("v"))
    packed = e.groupBy("user_id").agg(F.array_sort(F.collect_list(pair)).alias("p")).select("user_id", F.col("p.us").alias("at"), F.col("p.v").alias("values"))
    return tables.columnar_series(packed, "user_id", "at", "values").select("user_id", F.col("time").alias("us"), "value")

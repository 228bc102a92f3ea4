"""Histories, baselines, rankings, frozen splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators import ranking
from freshet.plans.registry import query
from freshet.sources.tables import table

_JOBS = """SELECT o_orderkey AS id, o_custkey % 60 AS city, CASE o_orderkey % 5 WHEN 0 THEN 'simulation' WHEN 1 THEN 'scenario' WHEN 2 THEN 'physics_forecast' ELSE 'report' END AS kind, CASE WHEN o_orderstatus = 'O' THEN 'running' ELSE 'completed' END AS status, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey END AS artifact_id,
    CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1.5 END AS multiplier, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate END AS completed_at, CASE WHEN o_orderkey % 9 > 0 THEN o_orderdate END AS created_at FROM orders"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    kind = F.when(k % 5 == 0, "simulation").when(k % 5 == 1, "scenario").when(k % 5 == 2, "physics_forecast").otherwise("report")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), (F.col("o_custkey") % 60).alias("city"), kind.alias("kind"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed").alias("status"), F.when(k % 7 > 0, k).alias("artifact_id"),
        F.when(k % 3 == 0, 1.0).when(k % 3 == 1, 1.5).alias("multiplier"), F.when(k % 4 > 0, day).alias("completed_at"), F.when(k % 9 > 0, day).alias("created_at"),
    )


@query(f"WITH j AS ({_JOBS}), r AS (SELECT city, id, row_number() OVER (PARTITION BY city ORDER BY created_at DESC NULLS LAST, id) AS place FROM j) SELECT * FROM r WHERE place <= 20")
def job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty latest jobs of each city: the cap is the feature."""
    return ranking.history(_jobs(spark, sf_dir), "city", "created_at", "id", 20).select("city", "id", "place")


@query(f"""WITH j AS ({_JOBS} WHERE o_orderstatus <> 'O' AND o_orderkey % 5 < 3 AND o_orderkey % 7 > 0), r AS (SELECT city, id, row_number() OVER (PARTITION BY city ORDER BY coalesce(multiplier, 1) = 1 DESC, coalesce(completed_at, created_at) DESC NULLS LAST, id DESC) AS place FROM j) SELECT city, id AS job_id FROM r WHERE place = 1""")
def scenario_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.baseline(_jobs(spark, sf_dir), "city")


@query(f"""WITH j AS ({_JOBS} WHERE o_orderstatus <> 'O' AND o_orderkey % 7 > 0), r AS (SELECT city, id, row_number() OVER (PARTITION BY city ORDER BY created_at DESC NULLS LAST, id DESC) AS place FROM j) SELECT city, id AS job_id FROM r WHERE place = 1""")
def last_completed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.last_completed(_jobs(spark, sf_dir), "city")


_SCORES = """SELECT event_type AS model, user_id AS event, count(*) FILTER (value > 50 AND event_id % 3 = 0) AS tp, count(*) FILTER (value > 50 AND event_id % 3 > 0) AS fp, count(*) FILTER (value <= 20 AND event_id % 3 = 0) AS fn FROM events GROUP BY ALL"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    wet, hit = F.col("event_id") % 3 == 0, F.col("value") > 50
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model"), F.col("user_id").alias("event")).agg(F.count_if(hit & wet).alias("tp"), F.count_if(hit & ~wet).alias("fp"), F.count_if((F.col("value") <= 20) & wet).alias("fn"))


@query(f"""WITH s AS ({_SCORES}), r AS (SELECT model, count(*) AS n_events, avg(tp / (tp + fp + fn)) FILTER (tp + fp + fn > 0) AS macro_iou, sum(tp) / sum(tp + fp + fn) AS micro_iou, 2 * sum(tp) / (2 * sum(tp) + sum(fp + fn)) AS micro_dice FROM s GROUP BY model)
    SELECT model, n_events, round(macro_iou, 9) AS macro_iou, round(micro_iou, 9) AS micro_iou, round(micro_dice, 9) AS micro_dice, row_number() OVER (ORDER BY macro_iou DESC NULLS LAST, model)::INT AS place FROM r""")
def model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.model_ranking(_scores(spark, sf_dir), "model")
    return out.select("model", "n_events", *[F.round(c, 9).alias(c) for c in ("macro_iou", "micro_iou", "micro_dice")], "place")


_IOU = f"SELECT *, CASE WHEN tp + fp + fn > 0 THEN round(tp / (tp + fp + fn), 9) END AS iou FROM ({_SCORES})"


def _iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    any_ = F.col("tp") + F.col("fp") + F.col("fn")
    return _scores(spark, sf_dir).withColumn("iou", F.when(any_ > 0, F.round(F.col("tp") / any_, 9)))


@query(f"""WITH s AS ({_IOU}), b AS (SELECT model, event, iou, row_number() OVER (PARTITION BY model ORDER BY iou DESC, event) AS i, row_number() OVER (PARTITION BY model ORDER BY iou, event) AS j FROM s WHERE iou IS NOT NULL)
    SELECT model, max(event) FILTER (i = 1) AS best_event, max(iou) FILTER (i = 1) AS best, max(event) FILTER (j = 1) AS worst_event, max(iou) FILTER (j = 1) AS worst FROM b GROUP BY model""")
def best_worst_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_worst(_iou(spark, sf_dir), "model", "event", "iou")


@query(f"""WITH s AS ({_IOU}) SELECT a.event, coalesce(a.iou, 0) AS a, b.iou AS b, coalesce(a.iou, 0) >= b.iou AS a_dominates FROM s a JOIN s b ON a.event = b.event AND a.model = 'view' AND b.model = 'click' AND b.iou IS NOT NULL""")
def persistence_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The views as persistence, the clicks as the model."""
    s = _iou(spark, sf_dir)
    return ranking.dominance(s.where("model = 'view'"), s.where("model = 'click'"), "event", "iou")


@query("""WITH o AS (SELECT DISTINCT o_custkey AS event, CASE WHEN o_custkey % 7 = 3 AND o_orderkey % 2 = 0 THEN 'train' WHEN o_custkey % 3 = 0 THEN 'val' WHEN o_custkey % 3 = 1 THEN 'train' ELSE 'test' END AS split FROM orders),
    g AS (SELECT event, list_sort(list(split)) AS got FROM o GROUP BY 1), f AS (SELECT c_custkey AS event, [CASE WHEN c_custkey % 3 = 0 THEN 'val' WHEN c_custkey % 3 = 1 AND c_custkey % 10 > 0 THEN 'train' ELSE 'test' END] AS want FROM customer WHERE c_custkey % 13 > 0),
    p AS (SELECT event, CASE WHEN len(got) > 1 THEN 'LEAK' WHEN got IS NULL THEN 'MISSING' WHEN want IS NULL THEN 'UNEXPECTED' WHEN got <> want THEN 'MOVED' END AS problem FROM g FULL JOIN f USING (event)) SELECT * FROM p WHERE problem IS NOT NULL""")
def split_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers as events, their split by id, some orders moved to train."""
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    got = table(spark, sf_dir, "orders").select(c.alias("event"), F.when((c % 7 == 3) & (o % 2 == 0), "train").when(c % 3 == 0, "val").when(c % 3 == 1, "train").otherwise("test").alias("split"))
    k = F.col("c_custkey")
    frozen = table(spark, sf_dir, "customer").where(k % 13 > 0).select(k.alias("event"), F.when(k % 3 == 0, "val").when((k % 3 == 1) & (k % 10 > 0), "train").otherwise("test").alias("split"))
    return ranking.split_drift(got, frozen, "event", "split")


@query("SELECT round(quantile_cont(coalesce(r, 0), 0.7), 6) AS threshold FROM (SELECT CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS r FROM orders)")
def rain_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")).alias("rain"))
    return spark.createDataFrame([(round(ranking.rain_threshold(o, "rain"), 6),)], "threshold double")

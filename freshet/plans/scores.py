"""Evaluation queries: scores of labelled documents, macro and micro means, thresholds, bootstraps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators import metrics
from freshet.plans.registry import query
from freshet.sources.tables import table

_SCORED = """WITH m AS (SELECT max(n_chars) AS most FROM documents), s AS (SELECT doc_id, lang, source, quality AS label, n_chars / (SELECT most FROM m)::DOUBLE AS score FROM documents JOIN labels USING (doc_id)) """


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    most = docs.agg(F.max("n_chars").alias("most"))  # one row
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id").crossJoin(F.broadcast(most))
    return rows.select("doc_id", "lang", "source", "label", (F.col("n_chars") / F.col("most")).alias("score"))


_COUNTS = "count(*) FILTER (score >= 0.05 AND label = 1) AS tp, count(*) FILTER (score >= 0.05 AND label = 0) AS fp, count(*) FILTER (score < 0.05 AND label = 1) AS fn, count(*) FILTER (score < 0.05 AND label = 0) AS tn"


@query(_SCORED + f", c AS (SELECT {_COUNTS} FROM s) SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall, CASE WHEN tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) END AS f1, CASE WHEN tp + fp + fn > 0 THEN round(tp / (tp + fp + fn), 6) END AS iou FROM c")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rates(metrics.confusion(scored(spark, sf_dir), 0.05))


@query(_SCORED + ", a AS (SELECT avg((score - label) * (score - label)) AS b, avg(label::DOUBLE) AS p FROM s) SELECT round(b, 6) AS brier, round(p * (1 - p), 6) AS brier_base, CASE WHEN p * (1 - p) > 0 THEN round(1 - b / (p * (1 - p)), 6) END AS skill FROM a")
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.brier(scored(spark, sf_dir))


@query(_SCORED + ", r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s) SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auroc FROM r")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auroc(scored(spark, sf_dir))


@query(_SCORED + ", g AS (SELECT score, count(*) AS n, sum(label) AS pos FROM s GROUP BY 1), c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM g WINDOW w AS (ORDER BY score DESC)) SELECT round((sum(pos * tp / seen) / sum(pos))::DOUBLE, 6) AS average_precision FROM c")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(scored(spark, sf_dir))


@query(_SCORED + "SELECT least(floor(score * 10), 9)::INT AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label::DOUBLE), 6) AS observed FROM s GROUP BY 1")
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.reliability(scored(spark, sf_dir))


@query(_SCORED + ", b AS (SELECT least(floor(score * 10), 9) AS b, count(*) AS n, avg(score) AS s, avg(label::DOUBLE) AS y FROM s GROUP BY 1), e AS (SELECT sum(n * abs(s - y)) / sum(n) AS e FROM b) SELECT round(e, 6) AS ece, CASE WHEN e <= 0.1 THEN 'CALIBRATED' WHEN e > 0.1 THEN 'NOT CALIBRATED' END AS status FROM e")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.calibration_error(scored(spark, sf_dir))


@query(_SCORED + f", c AS (SELECT {_COUNTS} FROM s WHERE lang = 'en') SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall, CASE WHEN tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) END AS f1, CASE WHEN tp + fp + fn > 0 THEN round(tp / (tp + fp + fn), 6) END AS iou FROM c")
def subset_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.subset(scored(spark, sf_dir), F.col("lang") == "en", 0.05)


@query(_SCORED + ", q AS (SELECT quantile_cont(abs(label - score), 0.8) AS q80, quantile_cont(abs(label - score), 0.1) AS q10, quantile_cont(abs(label - score), 0.9) AS q90 FROM s) SELECT round(q80, 6) AS q80, round(q10, 6) AS q10, round(q90, 6) AS q90, round((SELECT avg(CASE WHEN label BETWEEN greatest(score - q80, 0) AND least(score + q80, 1) THEN 1.0 ELSE 0.0 END) FROM s), 6) AS coverage FROM q")
def conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.conformal(scored(spark, sf_dir))


_BY_EVENT = _SCORED + f", e AS (SELECT source, {_COUNTS} FROM s GROUP BY 1), r AS (SELECT *, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) END AS iou FROM e) "


@query(_BY_EVENT + "SELECT count(iou) AS n_events, round(avg(iou), 6) AS macro_iou, round(stddev_pop(iou), 6) AS std_iou, round(median(iou), 6) AS median_iou, round((sum(tp) / sum(tp + fp + fn))::DOUBLE, 6) AS micro_iou FROM r")
def event_macro_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro_micro(scored(spark, sf_dir), "source", 0.05)


@query(_SCORED + ", t AS (SELECT unnest(CASE WHEN lang IS NULL THEN ['unknown'] ELSE [lang, source] END) AS token, label, score FROM s) SELECT token, count(*) AS n, round(avg(label::DOUBLE), 6) AS rate, round(avg(score), 6) AS mean_score FROM t GROUP BY 1")
def group_by_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).withColumn("tokens", F.when(F.col("lang").isNotNull(), F.array("lang", "source")))
    return metrics.by_tokens(s, "tokens", "label", "score")


@query(_SCORED + ", t AS (SELECT unnest(range(1, 20)) * 0.05 AS threshold), c AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp, count(*) FILTER (score < threshold AND label = 1) AS fn FROM s, t GROUP BY 1), f AS (SELECT threshold, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c) SELECT round(threshold, 2)::DOUBLE AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, threshold LIMIT 1")
def choose_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.choose_threshold(scored(spark, sf_dir), [i * 0.05 for i in range(1, 20)])


@query(_SCORED + ", k AS (SELECT 'miss' AS kind, doc_id, score, row_number() OVER (ORDER BY score, doc_id) AS n FROM s WHERE label = 1 AND score < 0.05 UNION ALL SELECT 'false_alarm', doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) FROM s WHERE label = 0 AND score >= 0.05) SELECT kind, doc_id, round(score, 6) AS score FROM k WHERE n <= 5")
def topk_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five worst misses and false alarms; the limit is the report."""
    s = scored(spark, sf_dir)
    misses = s.where("label = 1 AND score < 0.05").orderBy("score", "doc_id").limit(5).withColumn("kind", F.lit("miss"))
    alarms = s.where("label = 0 AND score >= 0.05").orderBy(F.col("score").desc(), "doc_id").limit(5).withColumn("kind", F.lit("false_alarm"))
    return misses.unionByName(alarms).select("kind", "doc_id", F.round("score", 6).alias("score"))


@query("SELECT nation, round(median(top), 4) AS threshold, count(*) AS n_years FROM (SELECT c_nationkey AS nation, year(o_orderdate) AS y, max(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) GROUP BY 1")
def annual_max_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    yearly = o.groupBy(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("y")).agg(F.max("o_totalprice").alias("top"))
    return yearly.groupBy("nation").agg(F.round(F.median("top"), 4).alias("threshold"), F.count("*").alias("n_years"))


@query("""WITH o AS (SELECT c_mktsegment AS segment, month(o_orderdate)::INT AS month, (o_totalprice > 200000)::INT AS y FROM orders JOIN customer ON o_custkey = c_custkey),
    own AS (SELECT segment, month, count(*) AS n, avg(y) AS p FROM o GROUP BY ALL), wide AS (SELECT month, avg(y) AS p FROM o GROUP BY 1)
    SELECT segment, own.month, n, round(CASE WHEN n >= 30 THEN own.p ELSE wide.p END, 6) AS climatology FROM own JOIN wide ON own.month = wide.month""")
def climatology_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(F.col("c_mktsegment").alias("segment"), F.month("o_orderdate").alias("month"), (F.col("o_totalprice") > 200000).cast("int").alias("y"))
    return metrics.climatology(rows, "segment", "month", "y", 30)


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile interval of the event-mean IoU over 500 hashed resamples of the events."""
    return metrics.bootstrap(metrics.event_iou(scored(spark, sf_dir), "source", 0.05).where("iou IS NOT NULL"), "source", "iou", 500)

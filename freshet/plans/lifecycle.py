"""Alerts, token buckets, aligned entities, checked lines and upserts over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators import alerts, alignment, buckets
from freshet.plans.registry import query
from freshet.sources import json_lines
from freshet.sources.tables import table

_THRESHOLDS = "CASE user_id % 5 WHEN 0 THEN 'gt' WHEN 1 THEN 'gte' WHEN 2 THEN 'lt' WHEN 3 THEN 'lte' ELSE 'eq' END"
_STATUS = f"""SELECT event_id, user_id, ts, CASE WHEN event_type = 'click' THEN 'ACKNOWLEDGE' WHEN event_type = 'signup' THEN 'UNAVAILABLE' WHEN v IS NULL THEN 'ERROR' WHEN NOT hit THEN 'CURRENTLY_FALSE' WHEN stale THEN 'STALE' ELSE 'CURRENTLY_TRUE' END AS status
    FROM (SELECT *, CASE op WHEN 'gt' THEN v > 40 WHEN 'gte' THEN v >= 40 WHEN 'lt' THEN v < 40 WHEN 'lte' THEN v <= 40 ELSE v = 40 END AS hit FROM (SELECT *, {_THRESHOLDS} AS op, CASE WHEN event_type <> 'error' THEN floor(value / 10) * 10 END AS v, value > 90 AS stale FROM events))"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of tens, compared by each user's own operator; clicks acknowledge, signups know nothing, errors have no value."""
    e = table(spark, sf_dir, "events")
    op = F.element_at(F.array(*[F.lit(x) for x in ("gt", "gte", "lt", "lte", "eq")]), (F.col("user_id") % 5 + 1).cast("int"))
    v = F.when(F.col("event_type") != "error", F.floor(F.col("value") / 10) * 10)
    read = alerts.condition(F.col("event_type") != "signup", alerts.compares(v, op, F.lit(40)), F.col("value") > 90)
    return e.select("event_id", "user_id", "ts", F.when(F.col("event_type") == "click", alerts.ACK).otherwise(read).alias("status"))


@query(f"""WITH RECURSIVE s AS ({_STATUS}), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM s),
    w AS (SELECT 0::BIGINT AS n, user_id, NULL::BIGINT AS event_id, NULL::VARCHAR AS status, 'ARMED' AS state, NULL::VARCHAR AS transition FROM (SELECT DISTINCT user_id FROM o) UNION ALL
        SELECT o.n, o.user_id, o.event_id, o.status, CASE WHEN o.status = 'CURRENTLY_FALSE' THEN 'ARMED' WHEN o.status = 'CURRENTLY_TRUE' AND w.state = 'ARMED' THEN 'TRIGGERED' WHEN o.status = 'ACKNOWLEDGE' AND w.state = 'TRIGGERED' THEN 'ACKNOWLEDGED' ELSE w.state END,
        CASE WHEN o.status = 'CURRENTLY_FALSE' AND w.state <> 'ARMED' THEN w.state || '->RESET->ARMED' WHEN o.status = 'CURRENTLY_TRUE' AND w.state = 'ARMED' THEN 'ARMED->TRIGGERED' WHEN o.status = 'ACKNOWLEDGE' AND w.state = 'TRIGGERED' THEN 'TRIGGERED->ACKNOWLEDGED' END
        FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1)
    SELECT event_id, user_id, status, state, transition FROM w WHERE n > 0""")
def alert_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.lifecycle(_status(spark, sf_dir), "user_id", ["ts", "event_id"], "status").drop("ts")


@query("""WITH c AS (SELECT event_id, CASE WHEN value < 25 THEN 'low' WHEN value < 50 THEN 'MODERATE' WHEN value < 100 THEN 'High' WHEN value < 150 THEN 'CRITICAL' ELSE 'SEVERE' END AS category, ['gt', 'gte', 'lt', 'lte', 'eq', 'ne'][event_id % 6 + 1] AS op FROM events),
    r AS (SELECT *, list_position(['LOW', 'MODERATE', 'HIGH', 'CRITICAL'], upper(category)) AS p FROM c)
    SELECT event_id, CASE WHEN p IS NULL THEN CASE WHEN op = 'eq' THEN false END ELSE CASE op WHEN 'gt' THEN p > 2 WHEN 'gte' THEN p >= 2 WHEN 'lt' THEN p < 2 WHEN 'lte' THEN p <= 2 WHEN 'eq' THEN p = 2 END END AS matched FROM r""")
def category_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    category = F.when(v < 25, "low").when(v < 50, "MODERATE").when(v < 100, "High").when(v < 150, "CRITICAL").otherwise("SEVERE")
    op = F.element_at(F.array(*[F.lit(x) for x in ("gt", "gte", "lt", "lte", "eq", "ne")]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", alerts.compares_category(category, op, F.lit("moderate")).alias("matched"))


BUCKET = buckets.Bucket(3.0, 1 / 21600)


@query(f"""WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS us, CASE WHEN value > 60 THEN 2.0 ELSE 1.0 END AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    w AS (SELECT 0::BIGINT AS n, user_id, NULL::BIGINT AS event_id, {BUCKET.capacity}::DOUBLE AS tokens, us AS last, NULL::BOOLEAN AS allowed FROM o WHERE n = 1 UNION ALL
        SELECT n, user_id, event_id, CASE WHEN filled >= cost THEN filled - cost ELSE filled END, us, filled >= cost FROM (SELECT o.*, least({BUCKET.capacity}, w.tokens + greatest(0, o.us - w.last) / 1e6 * {BUCKET.per_second!r}) AS filled FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1))
    SELECT user_id, event_id, allowed, round(tokens, 6) AS tokens FROM w WHERE n > 0""")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tokens a user, one more every six hours; large requests cost two."""
    e = table(spark, sf_dir, "events").withColumn("cost", F.when(F.col("value") > 60, 2.0).otherwise(1.0))
    return buckets.admitted(e, BUCKET, "user_id", "ts", "event_id", "cost").withColumn("tokens", F.round("tokens", 6))


_REPORTS = """SELECT o_orderkey AS report, o_custkey % 40 AS region, CASE WHEN o_orderkey % 101 <> 0 THEN o_orderdate::DATE END AS start, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE + ((o_orderkey % 9)::INT - 2) END AS stop,
    CASE WHEN o_orderkey % 50 = 3 THEN 'primary' || (o_orderkey % 13) END AS matched FROM orders WHERE o_orderpriority = '1-URGENT'"""


@query(f"""WITH r AS (SELECT *, least(start, coalesce(stop, start)) AS s, greatest(start, coalesce(stop, start)) AS e FROM ({_REPORTS})),
    o AS (SELECT *, max(e) OVER (PARTITION BY region ORDER BY s, report ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r WHERE start IS NOT NULL),
    g AS (SELECT *, sum((reach IS NULL OR s - reach > 2)::INT) OVER (PARTITION BY region ORDER BY s, report) AS c FROM o),
    i AS (SELECT *, min(matched) OVER x AS m, min(report) OVER x AS least_report, count(*) OVER x AS n FROM g WINDOW x AS (PARTITION BY region, c))
    SELECT region, report, coalesce(m, 'r' || least_report) AS entity, m AS matched, m IS NULL AS independent, n AS n_reports FROM i UNION ALL SELECT region, report, coalesce(matched, 'r' || report), matched, matched IS NULL, 1 FROM r WHERE start IS NULL""")
def aligned_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders as flood reports by region; every fiftieth is matched to a primary event."""
    key = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    rows = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(
        key.alias("report"), (F.col("o_custkey") % 40).alias("region"), F.when(key % 101 != 0, day).alias("start"), F.when(key % 7 != 0, F.date_add(day, (key % 9).cast("int") - 2)).alias("stop"),
        F.when(key % 50 == 3, F.concat(F.lit("primary"), (key % 13).cast("string"))).alias("matched"),
    )
    # Ids are ordered as numbers: the least report gives its name to an entity without a primary event.
    found = alignment.align(rows, ["region"], "report", "start", "stop", "matched", pad_days=2)
    return found.withColumn("entity", F.when(F.col("matched").isNull(), F.concat(F.lit("r"), "entity")).otherwise(F.col("entity")))


_LINES = """SELECT event_id, CASE event_id % 11 WHEN 0 THEN props || '}}' WHEN 1 THEN '[' || props || ']' WHEN 2 THEN replace(props, '"k": ', '"k": "x') || '' WHEN 3 THEN '{"other": 1}' WHEN 4 THEN '{"k": null, "name": 5}' WHEN 5 THEN '{"k": 1.5}' WHEN 6 THEN '{"k": 7, "name": "a", "more": [1]}' ELSE props END AS line FROM events"""


@query(f"""WITH l AS ({_LINES}), j AS (SELECT *, json_valid(line) AS ok FROM l), t AS (SELECT *, CASE WHEN ok THEN json_type(line) END AS kind, CASE WHEN ok THEN json_type(line, '$.k') END AS k_kind FROM j),
    r AS (SELECT *, CASE WHEN NOT ok THEN 'not_json' WHEN kind <> 'OBJECT' THEN 'not_an_object' WHEN k_kind IS NULL OR k_kind = 'NULL' THEN 'missing:k' WHEN k_kind NOT IN ('UBIGINT', 'BIGINT') THEN 'type:k' END AS reason FROM t)
    SELECT event_id, reason, CASE WHEN reason IS NULL THEN (line->>'$.k')::BIGINT END AS k, CASE WHEN reason IS NULL THEN line->>'$.name' END AS name FROM r""")
def checked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' properties as JSON lines, some of them damaged."""
    kind, props = F.col("event_id") % 11, F.col("props")
    line = (
        F.when(kind == 0, F.concat(props, F.lit("}}"))).when(kind == 1, F.concat(F.lit("["), props, F.lit("]"))).when(kind == 2, F.replace(props, F.lit('"k": '), F.lit('"k": "x')))
        .when(kind == 3, '{"other": 1}').when(kind == 4, '{"k": null, "name": 5}').when(kind == 5, '{"k": 1.5}').when(kind == 6, '{"k": 7, "name": "a", "more": [1]}').otherwise(props)
    )
    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType().add("k", LongType()).add("name", StringType())
    rows = json_lines.checked(table(spark, sf_dir, "events").select("event_id", line.alias("line")), "line", schema, ["k"])
    return rows.select("event_id", "reason", "parsed.k", "parsed.name")

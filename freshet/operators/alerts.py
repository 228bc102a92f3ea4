"""Alert conditions and the alert state machine, over ranges of the order.

States: ARMED turns TRIGGERED when its condition holds; TRIGGERED and
ACKNOWLEDGED go back to ARMED when it does not; an acknowledgement turns
TRIGGERED into ACKNOWLEDGED. A condition that is UNAVAILABLE, an ERROR, or true
of a STALE reading only, changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.graph import cut

#: The order of the risk categories.
CATEGORIES = ("LOW", "MODERATE", "HIGH", "CRITICAL")

TRUE, FALSE, STALE, UNAVAILABLE, ERROR, ACK = "CURRENTLY_TRUE", "CURRENTLY_FALSE", "STALE", "UNAVAILABLE", "ERROR", "ACKNOWLEDGE"


def compares(value: Column, operator: Column, threshold: Column) -> Column:
    """gt, gte, lt, lte or eq of two numbers; null if either is unknown, NaN, or the operator is no such one."""
    known = ~F.isnan(value.cast("double")) & ~F.isnan(threshold.cast("double"))
    found = F.lit(None).cast("boolean")
    for name, verdict in {"gt": value > threshold, "gte": value >= threshold, "lt": value < threshold, "lte": value <= threshold, "eq": value == threshold}.items():
        found = F.when(operator == name, verdict).otherwise(found)
    return F.when(known, found)


def compares_category(value: Column, operator: Column, threshold: Column) -> Column:
    """The same for categories in their order; those outside it can only be equal."""
    place = lambda c: F.nullif(F.array_position(F.array(*[F.lit(x) for x in CATEGORIES]), F.upper(c)), F.lit(0))
    left, right = place(value), place(threshold)
    same = F.when(operator == "eq", F.upper(value) == F.upper(threshold))
    return F.when(value.isNull() | threshold.isNull(), F.lit(None).cast("boolean")).when(left.isNull() | right.isNull(), same).otherwise(compares(left, operator, right))


def condition(available: Column, matched: Column, stale: Column) -> Column:
    """The status of a reading: a reading that is not there is UNAVAILABLE, one without a verdict an ERROR, a stale one may still say no."""
    return (
        F.when(~F.coalesce(available, F.lit(False)), UNAVAILABLE).when(matched.isNull(), ERROR)
        .when(~matched, FALSE).when(F.coalesce(stale, F.lit(False)), STALE).otherwise(TRUE)
    )


def lifecycle(rows: DataFrame, key: str, order: Sequence[str], status: str) -> DataFrame:
    """``rows`` with ``state`` after each and its ``transition`` (null: none), by key in ``order``.

    ``status`` is a condition's, or ACKNOWLEDGE. Since FALSE brings every state
    back to ARMED, a row's state follows from the rows since the last FALSE. The
    order is dealt out in ranges, each summed up by what it makes of each
    state, so a key of any size is spread over tasks. A row without a key takes
    no part; equal orders must not change the result, or be told apart.
    """
    ranged = cut(rows.where(F.col(key).isNotNull()).repartitionByRange(key, *order).withColumn("__part", F.spark_partition_id()))
    own = Window.partitionBy(key, "__part").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    r = ranged.withColumns({"__pos": F.row_number().over(own), "__seg": F.count_if(F.col(status) == FALSE).over(upto)})
    since = Window.partitionBy(key, "__part", "__seg").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumns({"__true": F.min(F.when(F.col(status) == TRUE, F.col("__pos"))).over(since), "__ack": F.max(F.when(F.col(status) == ACK, F.col("__pos"))).over(since)})
    from_armed = F.when(F.col("__true").isNull(), "ARMED").when(F.col("__ack") > F.col("__true"), "ACKNOWLEDGED").otherwise("TRIGGERED")
    r = r.withColumn("__armed", from_armed)
    parts = r.groupBy(key, "__part").agg(F.max("__seg").alias("falses"), F.max_by("__armed", "__pos").alias("end"), F.count_if(F.col(status) == ACK).alias("acks"))
    listed = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__part", "falses", "end", "acks"))).alias("p")).where(F.size("p") > 1)  # a row a range at most
    after = lambda s, p: F.when((p["falses"] > 0) | (s == "ARMED"), p["end"]).when((s == "TRIGGERED") & (p["acks"] == 0), s).otherwise("ACKNOWLEDGED")
    start = F.struct(F.lit("ARMED").alias("s"), F.array().cast("array<struct<__part: int, __start: string>>").alias("all"))
    step = lambda a, p: F.struct(after(a["s"], p).alias("s"), F.concat(a["all"], F.array(F.struct(p["__part"].alias("__part"), a["s"].alias("__start")))).alias("all"))
    starts = listed.select(key, F.inline(F.aggregate("p", start, step)["all"]))
    r = r.join(F.broadcast(starts), [key, "__part"], "left").withColumn("__start", F.coalesce("__start", F.lit("ARMED")))
    held = F.when(F.col("__start") == "ARMED", F.col("__armed")).when((F.col("__start") == "TRIGGERED") & F.col("__ack").isNull(), "TRIGGERED").otherwise("ACKNOWLEDGED")
    r = r.withColumn("state", F.when(F.col("__seg") > 0, F.col("__armed")).otherwise(held))
    r = r.withColumn("__was", F.coalesce(F.lag("state").over(own), F.col("__start")))
    moved = (
        F.when((F.col(status) == TRUE) & (F.col("__was") == "ARMED"), "ARMED->TRIGGERED").when((F.col(status) == ACK) & (F.col("__was") == "TRIGGERED"), "TRIGGERED->ACKNOWLEDGED")
        .when((F.col(status) == FALSE) & (F.col("__was") != "ARMED"), F.concat("__was", F.lit("->RESET->ARMED")))
    )
    return r.select(*rows.columns, "state", moved.alias("transition"))


def next_state(state: str, status: str) -> tuple[str, str | None]:
    """(state, transition) of one step, as a stream takes it."""
    if status == TRUE and state == "ARMED":
        return "TRIGGERED", "ARMED->TRIGGERED"
    if status == ACK and state == "TRIGGERED":
        return "ACKNOWLEDGED", "TRIGGERED->ACKNOWLEDGED"
    if status == FALSE and state != "ARMED":
        return "ARMED", f"{state}->RESET->ARMED"
    return state, None

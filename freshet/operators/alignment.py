"""One id for each real event that several sources report: reports whose days overlap are aligned, transitively."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def align(rows: DataFrame, keys: Sequence[str], event: str, start: str, end: str, matched: str, pad_days: int = 45) -> DataFrame:
    """(keys, event, entity, matched, independent, n_reports): reports of one key that overlap, or lie ``pad_days`` apart at most, share an entity.

    The entity is the primary event that any of them is matched to (the least
    if they differ), else the least event id; ``independent`` says that none is
    matched. Reports are first summed up by start day, and a sweep over the
    days closes the overlaps, so the windows hold days, however many reports
    fall on one. Ids come back as text. A reversed interval is turned round, an unknown end is the
    start; a report without a key or start stands alone.
    """
    last = F.coalesce(end, start)
    known = rows.select("*", F.least(F.col(start), last).alias("__s"), F.greatest(F.col(start), last).alias("__e"))
    usable = F.col(start).isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    days = known.where(usable).groupBy(*keys, "__s").agg(F.max("__e").alias("__e"), F.min(event).alias("__id"), F.min(matched).alias("__m"), F.count("*").alias("__n"))
    order = Window.partitionBy(*keys).orderBy("__s")
    reach = F.max("__e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (reach.isNull() | (F.datediff("__s", reach) > pad_days)).cast("int")
    days = days.withColumn("__fresh", fresh).withColumn("__c", F.sum("__fresh").over(order))
    whole = Window.partitionBy(*keys, "__c")
    ids = days.select(*keys, "__s", F.min("__m").over(whole).alias("__m"), F.min("__id").over(whole).alias("__id"), F.sum("__n").over(whole).alias("__n"))
    own = known.select(*keys, event, F.col(matched).alias("__own"), F.when(F.col(start).isNotNull(), F.col("__s")).alias("__s"))
    met = own.join(ids, [*keys, "__s"], "left")
    found = F.coalesce("__m", "__own")
    return met.select(*keys, event, F.coalesce(found.cast("string"), F.col("__id").cast("string"), F.col(event).cast("string")).alias("entity"), found.alias("matched"), found.isNull().alias("independent"), F.coalesce("__n", F.lit(1)).alias("n_reports"))

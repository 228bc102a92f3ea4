"""Inventories of samples: what events, regions and pixels a set holds, and whether it is enough to validate on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pixels(flood: str, dry: str, unknown: str) -> dict[str, Column]:
    wet, clear, dark = (F.coalesce(F.sum(c), F.lit(0)) for c in (flood, dry, unknown))
    return {"flood": wet, "dry": clear, "unknown": dark}


def _shares(rows: DataFrame) -> DataFrame:
    valid, total = F.col("flood") + F.col("dry"), F.col("flood") + F.col("dry") + F.col("unknown")
    return rows.withColumns({"prevalence": F.when(valid > 0, F.round(F.col("flood") / valid, 6)), "unknown_fraction": F.when(total > 0, F.round(F.col("unknown") / total, 6))})


def inventory(samples: DataFrame, city: str, day: str, event: str, episode: str, split: str, flood: str, dry: str, unknown: str, splits: Sequence[str] = ("train", "val", "test"), least_events: int = 20, least_wet_events: int = 3) -> DataFrame:
    """One row on a set of samples with pixel counts: tiles, days, cities, independent events and city episodes, wet events, pixels, splits, and the verdict.

    A null event, day, city or episode is counted as none. Events are summed
    up first, so the distinct counts are over a row an event or a value.
    """
    by_event = samples.where(F.col(event).isNotNull()).groupBy(event).agg(F.max(flood).alias("wet")).agg(F.count("*").alias("n_events"), F.count_if(F.col("wet") > 0).alias("n_wet_events"))
    whole = samples.agg(F.count("*").alias("n_tiles"), *[F.count_if(F.col(split) == s).alias(f"n_{s}") for s in splits], *[c.alias(k) for k, c in _pixels(flood, dry, unknown).items()])
    out = whole.crossJoin(by_event)  # one row each
    for name, c in {"n_days": day, "n_cities": city, "n_episodes": episode}.items():
        out = out.crossJoin(samples.where(F.col(c).isNotNull()).select(c).distinct().agg(F.count("*").alias(name)))
    enough = (F.col("n_events") >= least_events) & (F.col("n_wet_events") >= least_wet_events)
    return _shares(out).withColumn("verdict", F.when(enough, "SUFFICIENT FOR VALIDATION").otherwise("INSUFFICIENT FOR VALIDATION"))


def coverage(samples: DataFrame, region: str, event: str, scene: str, tile: str, day: str, flood: str, dry: str, unknown: str) -> DataFrame:
    """Per region: events, scenes, tiles and days covered, from when to when, and its pixels; null names are counted as none."""
    distinct = {"n_events": event, "n_scenes": scene, "n_tiles": tile, "n_days": day}
    out = samples.groupBy(region).agg(*[F.countDistinct(c).alias(k) for k, c in distinct.items()], F.min(day).alias("first_day"), F.max(day).alias("last_day"), *[c.alias(k) for k, c in _pixels(flood, dry, unknown).items()])
    return _shares(out).drop("prevalence")


def event_summaries(pairs: DataFrame, event: str, region: str, newly: str, receding: str, wet: str, valid: str) -> DataFrame:
    """Per event: pairs, regions, pixels that turned wet or dry, those wet on both dates, the rate of change of the valid ones, and whether it shows any signal."""
    total = {"n_newly_flooded": newly, "n_receding": receding, "n_persistent_wet": wet, "n_valid": valid}
    out = pairs.where(F.col(event).isNotNull()).groupBy(event).agg(F.count("*").alias("n_pairs"), F.countDistinct(region).alias("n_regions"), *[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in total.items()])
    changed = F.col("n_newly_flooded") + F.col("n_receding")
    return out.withColumns({"change_rate": F.when(F.col("n_valid") > 0, F.round(changed / F.col("n_valid"), 6)), "has_signal": changed > 0})


def independence(events: DataFrame, event: str, start: str, end: str, gap_days: int = 45) -> DataFrame:
    """One row: events, those that lie within ``gap_days`` of the one before, and whether all are independent. Events are ordered by start through a range of days each, pre-aggregated, so repeated days cost one row."""
    from pyspark.sql import Window

    days = events.where(F.col(start).isNotNull()).groupBy(F.least(F.col(start), F.coalesce(end, start)).alias("s")).agg(F.max(F.greatest(F.col(start), F.coalesce(end, start))).alias("e"), F.countDistinct(event).alias("c"))
    reach = F.max("e").over(Window.partitionBy(F.lit(0)).orderBy("s").rowsBetween(Window.unboundedPreceding, -1))  # a row a day
    close = F.coalesce((F.datediff("s", reach) <= gap_days).cast("int"), F.lit(0))
    out = days.withColumn("n_close", F.col("c") - 1 + close).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_events"), F.coalesce(F.sum("n_close"), F.lit(0)).alias("n_dependent"))
    return out.withColumn("independent", F.col("n_dependent") == 0)

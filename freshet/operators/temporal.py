"""Ordered-sequence operators: spines, trailing windows, clusters, as-of and interval joins.

All windows are partitioned by a key; none spans a whole table, and clusters,
pairs and as-of joins go through a large key in ranges. Missing hours
stay missing: sums skip them and completeness counts them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.hot import PART, Ranges, split_by_size


def hour_spine(series: DataFrame, key: str, hour: str, *values: str, most: int = 1_000_000) -> DataFrame:
    """Every hour from a key's first to its last, with the values of the hours that are there.

    A key that spans more than ``most`` hours (a century) fails: one stray date
    would make a spine of nothing but gaps.
    """
    ends = series.groupBy(key).agg(F.min(hour).alias("lo"), F.max(hour).alias("hi"))
    too_long = F.raise_error(F.concat(F.lit("a spine of too many hours: "), (F.col("hi") - F.col("lo")).cast("string"))).cast("bigint")
    last = F.when(F.col("hi") - F.col("lo") <= most, F.col("hi")).when(F.col("hi").isNotNull(), too_long)
    spine = ends.select(key, F.explode(F.sequence(F.col("lo").cast("bigint"), last)).alias(hour))
    return spine.join(series.select(key, hour, *values), [key, hour], "left")


def trailing_sums(series: DataFrame, key: str, hour: str, value: str, widths: Sequence[int], complete: float = 0.8) -> DataFrame:
    """``sum_<w>h`` over the w hours that end before each hour; null below the completeness."""
    for w in widths:
        frame = Window.partitionBy(key).orderBy(hour).rangeBetween(-w, -1)
        series = series.withColumn(f"sum_{w}h", F.when(F.count(value).over(frame) >= complete * w, F.sum(value).over(frame)))
    return series


def _numbered(r: Ranges, rows: DataFrame, starts: Column) -> DataFrame:
    """``cluster``: how many rows start one up to each, counted on over the ranges."""
    counted = r.carry(rows.withColumn("starts", F.coalesce(starts.cast("int"), F.lit(0))), {"__sum": F.sum("starts")}, {"__sum": F.sum})
    upto = r.own.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return counted.withColumn("cluster", F.sum("starts").over(upto) + F.coalesce("__sum", F.lit(0))).drop("starts", "__sum")


def gap_clusters(rows: DataFrame, key: str, day: str, gap: int = 45) -> DataFrame:
    """``cluster``: a new one begins where more than ``gap`` days have passed."""

    def plain(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy(key).orderBy(day)
        starts = F.coalesce((F.datediff(day, F.lag(day).over(order)) > gap).cast("int"), F.lit(0))
        return rows.withColumn("starts", starts).withColumn("cluster", F.sum("starts").over(order)).drop("starts")

    def ranged(rows: DataFrame) -> DataFrame:
        r = Ranges(rows, [key], [day])
        before = r.carry(r.rows, {"__last": F.max(day)}, {"__last": F.max})
        last = F.coalesce(F.lag(day).over(r.own), F.col("__last"))
        return _numbered(r, before.withColumn("__last", last), F.datediff(day, "__last") > gap).drop("__last", PART)

    return split_by_size(rows, [key], plain, ranged)


def interval_clusters(rows: DataFrame, key: str, start: str, end: str, order_by: str, pad: int = 45) -> DataFrame:
    """``cluster``: intervals within ``pad`` days of what the cluster has spanned so far belong together."""

    def plain(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy(key).orderBy(start, order_by)
        reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
        starts = F.coalesce((F.datediff(start, reach) > pad).cast("int"), F.lit(0))
        return rows.withColumn("starts", starts).withColumn("cluster", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")

    def ranged(rows: DataFrame) -> DataFrame:
        r = Ranges(rows, [key], [start, order_by])
        before = r.carry(r.rows, {"__reach": F.max(end)}, {"__reach": F.max})
        reach = F.greatest(F.max(end).over(r.own.rowsBetween(Window.unboundedPreceding, -1)), "__reach")
        return _numbered(r, before.withColumn("__reach", reach), F.datediff(start, "__reach") > pad).drop("__reach", PART)

    return split_by_size(rows, [key], plain, ranged)


def adjacent_pairs(rows: DataFrame, key: str, order_by: str, keep: Sequence[str]) -> DataFrame:
    """Each row with ``next_<column>`` of its key's next row; last rows have no pair and go."""
    nxt = F.struct(*keep)

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumn("nxt", F.lead(nxt).over(Window.partitionBy(key).orderBy(order_by)))

    def ranged(rows: DataFrame) -> DataFrame:
        r = Ranges(rows, [key], [order_by])
        found = r.carry(r.rows, {"__next": F.min_by(nxt, F.struct(F.col(order_by).isNotNull(), order_by))}, {"__next": F.first}, after=True)
        return found.withColumn("nxt", F.coalesce(F.lead(nxt).over(r.own), F.col("__next"))).drop("__next", PART)

    return split_by_size(rows, [key], plain, ranged).where("nxt IS NOT NULL").select("*", *[F.col(f"nxt.{c}").alias(f"next_{c}") for c in keep]).drop("nxt")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, carry: Sequence[str]) -> DataFrame:
    """``left`` with ``prior_<column>`` of the last ``right`` row of its key strictly before it, by one union and window."""
    values = F.struct(*carry)
    both = left.select(key, at, F.struct("*").alias("row"), F.lit(None).cast(right.select(values.alias("v")).schema["v"].dataType).alias("v"), F.lit(0).alias("side"))
    both = both.unionByName(right.select(key, at, F.lit(None).cast(both.schema["row"].dataType).alias("row"), values.alias("v"), F.lit(1).alias("side")))

    def plain(both: DataFrame) -> DataFrame:
        return both.withColumn("prior", F.last("v", ignorenulls=True).over(Window.partitionBy(key).orderBy(at, "side").rowsBetween(Window.unboundedPreceding, -1)))

    def ranged(both: DataFrame) -> DataFrame:
        r = Ranges(both, [key], [at, "side"])
        latest_v = F.max_by("v", F.when(F.col("v").isNotNull(), F.struct(F.col(at).isNotNull(), at)))
        before = r.carry(r.rows, {"__v": latest_v}, {"__v": lambda c: F.last(c, ignorenulls=True)})
        own = F.last("v", ignorenulls=True).over(r.own.rowsBetween(Window.unboundedPreceding, -1))
        return before.withColumn("prior", F.coalesce(own, F.col("__v"))).drop("__v", PART)

    return split_by_size(both, [key], plain, ranged).where("side = 0").select("row.*", *[F.col(f"prior.{c}").alias(f"prior_{c}") for c in carry])


def interval_cover(windows: DataFrame, covers: DataFrame, window_id: str, key: str, start: str, end: str, cover_from: str, cover_to: str) -> DataFrame:
    """How many of a window's hours in (start, end] any cover (from, to] of its key holds; hours are exploded, so the join is on equality."""
    need = windows.select(window_id, key, F.explode(F.sequence(F.col(start) + 1, F.col(end))).alias("hour"))
    have = covers.select(key, F.explode(F.sequence(F.col(cover_from) + 1, F.col(cover_to))).alias("hour")).distinct().withColumn("has", F.lit(1))
    return need.join(have, [key, "hour"], "left").groupBy(window_id).agg(F.count("*").alias("n_required"), F.count("has").alias("n_covered"))


def longest_gap(present: DataFrame, key: str, hour: str) -> DataFrame:
    """The most missing hours between two present ones; 0 for one hour or none missing."""
    step = F.col(hour) - F.lag(hour).over(Window.partitionBy(key).orderBy(hour)) - 1
    return present.select(key, step.alias("gap")).groupBy(key).agg(F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"))


def latest(rows: DataFrame, key: str, order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """The last row of each key; pre-aggregated, so a hot key costs no more."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*carry), F.struct(*order)).alias("r")).select(key, "r.*")


def greedy_spacing(rows: DataFrame, key: str, at: str, gap: float) -> DataFrame:
    """(key, n_kept, first_kept, last_kept) of the times that stand at least ``gap`` after the last one kept.

    A key's times stream in order through one task, which remembers three
    numbers; null times take no part.
    """
    kind = rows.schema[key].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            done = []
            for k, own in batch.groupby(key, sort=False, dropna=False):
                times, i = own[at].to_numpy(), 0
                if state is None or k != now:
                    done += [] if state is None else [(now, *state)]
                    now, state, i = k, (1, times[0], times[0]), 1
                while (i := max(i, int(np.searchsorted(times, state[2] + gap)))) < len(times):
                    state = (state[0] + 1, state[1], times[i])
            yield pd.DataFrame(done, columns=[key, "n_kept", "first_kept", "last_kept"])
        if state is not None:
            yield pd.DataFrame([(now, *state)], columns=[key, "n_kept", "first_kept", "last_kept"])

    sorted_ = rows.where(F.col(at).isNotNull()).select(key, F.col(at).cast("double").alias(at)).repartition(key).sortWithinPartitions(key, at)
    return sorted_.mapInPandas(fold, f"`{key}` {kind}, n_kept int, first_kept double, last_kept double")


def rate_of_change(rows: DataFrame, key: str, at: Column, value: str, order: Sequence[str]) -> DataFrame:
    """Per hour, from the last two values of each key; null with fewer than two or no time between."""
    recent = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    two = rows.withColumn("n", F.row_number().over(recent)).where("n <= 2").withColumn("s", at)
    pick = lambda c, n: F.max(F.when(F.col("n") == n, F.col(c)))
    hours = (pick("s", 1) - pick("s", 2)) / 3600.0
    return two.groupBy(key).agg(F.when(hours > 0, (pick(value, 1) - pick(value, 2)) / hours).alias("rate_per_hour"))

"""Firsts and lasts: capped histories, baselines, model rankings, frozen splits. Hot keys are reduced before they meet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.prefix import quantiles


def top_per(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, parts: int = 64) -> DataFrame:
    """``rows`` with ``place`` from 1, the first ``k`` of each key in ``order``.

    Each of ``parts`` shares of a key is cut to its first k before these meet,
    so no task gets more than its share of a hot key. ``order`` tells all rows
    of a key apart, or equal ones are interchangeable.
    """
    dealt = rows.withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
    first = dealt.withColumn("__own", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))).where(F.col("__own") <= k).drop("__own", "__part")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


def history(rows: DataFrame, owner: str, created: str, key: str, cap: int) -> DataFrame:
    """The ``cap`` latest rows of each owner, latest first, undated ones last, equal dates by ``key``; a null owner is an owner."""
    return top_per(rows, [owner], [F.col(created).desc_nulls_last(), F.col(key).asc_nulls_last()], cap)


def baseline(jobs: DataFrame, city: str, kinds: Sequence[str] = ("simulation", "scenario", "physics_forecast")) -> DataFrame:
    """(city, job_id) of each city's baseline: of its completed jobs of these kinds with an artifact the last finished, those with a rainfall multiplier of one, or none, ahead of the others.

    ``jobs`` have id, kind, status, artifact_id, multiplier, completed_at and
    created_at; without an end the begin counts, without both a job comes
    first; of equal times the greatest id is taken. Cities without any such
    job are left out.
    """
    usable = jobs.where(F.col("kind").isin(*kinds) & (F.col("status") == "completed") & F.col("artifact_id").isNotNull())
    plain = F.coalesce(F.col("multiplier") == 1, F.lit(True))
    stamp = F.coalesce("completed_at", "created_at")
    return usable.groupBy(city).agg(F.max(F.struct(plain, stamp.isNotNull(), stamp, "id")).getField("id").alias("job_id"))


def last_completed(jobs: DataFrame, city: str) -> DataFrame:
    """(city, job_id) of each city's last created completed job with an artifact; an undated one only where no other is, of equal times the greatest id."""
    usable = jobs.where((F.col("status") == "completed") & F.col("artifact_id").isNotNull())
    return usable.groupBy(city).agg(F.max(F.struct(F.col("created_at").isNotNull(), F.col("created_at"), F.col("id"))).getField("id").alias("job_id"))


def model_ranking(events: DataFrame, model: str) -> DataFrame:
    """Per model, from its events' tp, fp and fn: events, macro IoU over those that have one, pooled IoU and dice, and ``place`` by macro IoU; models without one come last, equal ones by name."""
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    any_ = F.col("tp") + F.col("fp") + F.col("fn")
    each = events.withColumn("iou", F.when(any_ > 0, F.col("tp") / any_))
    out = each.groupBy(model).agg(F.count("*").alias("n_events"), F.avg("iou").alias("macro_iou"), F.when(tp + fp + fn > 0, tp / (tp + fp + fn)).alias("micro_iou"), F.when(tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).alias("micro_dice"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("macro_iou").desc_nulls_last(), model))  # a row a model
    return out.withColumn("place", place)


def best_worst(events: DataFrame, model: str, event: str, metric: str) -> DataFrame:
    """Per model the events of the greatest and least finite ``metric``, the first by id of equals; null where none is finite."""
    v = F.when(~F.isnan(metric) & (F.abs(F.col(metric)) < float("inf")), F.col(metric))
    best, worst = F.min(F.when(v.isNotNull(), F.struct((-v).alias("v"), F.col(event).alias("e")))), F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), F.col(event).alias("e"))))
    found = events.groupBy(model).agg(best.alias("b"), worst.alias("w"))
    return found.select(model, F.col("b.e").alias("best_event"), (-F.col("b.v")).alias("best"), F.col("w.e").alias("worst_event"), F.col("w.v").alias("worst"))


def dominance(a: DataFrame, b: DataFrame, event: str, metric: str) -> DataFrame:
    """(event, a, b, a_dominates) of the events that both score: whether a is at least as good; an unknown score of a counts as 0, events that b leaves unknown are left out."""
    left = a.select(event, F.coalesce(F.nanvl(F.col(metric), F.lit(None).cast("double")), F.lit(0.0)).alias("a"))
    right = b.where(F.col(metric).isNotNull() & ~F.isnan(metric)).select(event, F.col(metric).alias("b"))
    return left.join(right, event).withColumn("a_dominates", F.col("a") >= F.col("b"))


def split_drift(observed: DataFrame, frozen: DataFrame, event: str, split: str) -> DataFrame:
    """(event, problem) of what stands against a frozen split: MISSING, UNEXPECTED, MOVED, and LEAK for an event in several splits; no rows where all is as frozen.

    Rows are reduced to an event's set of splits, a few names, first. Null
    events and splits take no part.
    """
    known = lambda t: t.where(F.col(event).isNotNull() & F.col(split).isNotNull()).groupBy(event).agg(F.array_sort(F.collect_set(split)).alias("s"))
    both = known(observed).withColumnRenamed("s", "got").join(known(frozen).withColumnRenamed("s", "want"), event, "full")
    problem = F.when(F.size("got") > 1, "LEAK").when(F.col("got").isNull(), "MISSING").when(F.col("want").isNull(), "UNEXPECTED").when(F.col("got") != F.col("want"), "MOVED")
    return both.select(event, problem.alias("problem")).where("problem IS NOT NULL")


def rain_threshold(rows: DataFrame, rain: str, q: float = 0.7, default: float = 50.0) -> float:
    """The exact quantile of the rain, unknown rain as none; the default without rows."""
    found = quantiles(rows.select(F.coalesce(F.col(rain).cast("double"), F.lit(0.0)).alias("rain")), "rain", [q])[0]
    return default if found is None else found

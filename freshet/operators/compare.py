"""Scenario comparison: cell differences, extents, transitions. Unknown (null) is never dry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scenario_diff(a: DataFrame, b: DataFrame, cell: Sequence[str], value: str) -> DataFrame:
    """(cell, depth_a, depth_b, diff) of the cells that both scenarios have."""
    left, right = a.select(*cell, F.col(value).alias("depth_a")), b.select(*cell, F.col(value).alias("depth_b"))
    return left.join(right, list(cell)).withColumn("diff", F.col("depth_a") - F.col("depth_b"))


def difference_stats(diff: DataFrame) -> DataFrame:
    d = F.col("diff")
    stats = {"n_cells": F.count("*"), "min_diff": F.min(d), "max_diff": F.max(d), "mean_diff": F.round(F.avg(d), 6), "mean_abs": F.round(F.avg(F.abs(d)), 6), "rmse": F.round(F.sqrt(F.avg(d * d)), 6), "max_abs": F.max(F.abs(d))}
    return diff.agg(*[v.alias(k) for k, v in stats.items()])


def extent_category(a: Column, b: Column, wet: float) -> Column:
    """1 wet in both, 2 only in the first, 3 only in the second, 0 in neither; null if either is unknown."""
    wa, wb = a > wet, b > wet
    return F.when(wa & wb, 1).when(wa & ~wb, 2).when(~wa & wb, 3).when(~wa & ~wb, 0)


def transition_class(before: Column, after: Column) -> Column:
    """1 new, 2 receding, 3 persistent wet, 4 persistent dry, 255 unknown."""
    return F.when(before.isNull() | after.isNull(), 255).when(~before & after, 1).when(before & ~after, 2).when(before & after, 3).otherwise(4)

"""Ordered operators over keys of any size: keys that fit a task go through one window each, larger ones in ranges of their order.

A range is summed up (its last value, its count, its greatest end), the
summaries of the ranges before are carried over, and windows run within
ranges. Which keys are large is counted first; both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from freshet.operators.graph import cut

#: Most rows of a key in one task's window.
TASK_ROWS = 2_000_000

PART = "__part"


class Ranges:
    """``rows`` in the order of (keys, order), cut into ranges that are written once."""

    def __init__(self, rows: DataFrame, keys: Sequence[str], order: Sequence[str]):
        self.keys, self.order = list(keys), list(order)
        self.rows = cut(rows.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()))

    @property
    def own(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, PART).orderBy(*self.order)

    def carry(self, rows: DataFrame, summaries: Mapping[str, Column], over: Mapping[str, Callable[[Column], Column]], after: bool = False) -> DataFrame:
        """``rows`` with each summary of a range, taken ``over`` the key's ranges before (or ``after``) its own; null where there are none.

        Only keys that span ranges have any, so there are no more such rows than twice the ranges.
        """
        parts = rows.groupBy(*self.keys, PART).agg(*[c.alias(n) for n, c in summaries.items()])
        line = Window.partitionBy(*self.keys).orderBy(PART)
        beside = line.rowsBetween(1, Window.unboundedFollowing) if after else line.rowsBetween(Window.unboundedPreceding, -1)
        several = F.count("*").over(Window.partitionBy(*self.keys)) > 1
        held = parts.withColumn("__several", several).select(*[F.col(k).alias(f"__k_{k}") for k in self.keys], F.col(PART).alias("__p"), "__several", *[f(F.col(n)).over(beside).alias(n) for n, f in over.items()])
        held = held.where("__several").drop("__several")
        same = F.col(PART) == F.col("__p")
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        return rows.join(F.broadcast(held), same, "left").drop("__p", *[f"__k_{k}" for k in self.keys])


def split_by_size(rows: DataFrame, keys: Sequence[str], plain: Callable[[DataFrame], DataFrame], ranged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``plain`` of the rows whose key fits a task, and ``ranged`` of the others."""
    large = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > TASK_ROWS).select(*[F.col(k).alias(f"__k_{k}") for k in keys])
    large = cut(large)  # a row for each two million at most
    if large.isEmpty():
        return plain(rows)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return plain(rows.join(F.broadcast(large), same, "left_anti")).unionByName(ranged(rows.join(F.broadcast(large), same, "left_semi")))

"""Running totals and exact quantiles over an order, in two levels: ranges of the order, then windows within each."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.graph import cut


def running(rows: DataFrame, order: str, sums: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``rows`` (one a value of ``order``, by ``keys``) with ``before_<column>``, the total over all rows of a smaller value, and ``total_<column>``.

    The rows are written once, in ranges of the order that grow in number with
    them, so a key, or all rows without one, may be of any size. Only the
    ranges' totals meet, those of a key in one task.
    """
    by = list(keys)
    dealt = cut(rows.repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id()))
    totals = dealt.groupBy(*by, "__part").agg(*[F.sum(c).alias(c) for c in sums])
    own = Window.partitionBy(*(by or [F.lit(0)]))
    ahead = own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__part", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"__o_{c}") for c in sums], *[F.sum(c).over(own).alias(f"total_{c}") for c in sums])
    within = Window.partitionBy(*by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumns({f"__w_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums})
    same = F.col("a.__part") == F.col("b.__part")
    for k in by:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    out = placed.alias("a").join(offsets.alias("b") if by else F.broadcast(offsets).alias("b"), same)  # without keys: a row a range
    return out.select(*[F.col(f"a.{c}") for c in rows.columns], *[(F.col(f"__o_{c}") + F.col(f"__w_{c}")).alias(f"before_{c}") for c in sums], *[F.col(f"total_{c}") for c in sums])


def group_quantiles(rows: DataFrame, keys: Sequence[str], value: Column, at: Sequence[float]) -> DataFrame:
    """(keys, q0, q1, ...): each group's exact quantiles of its known values, with linear interpolation; groups without any are left out."""
    counts = rows.select(*keys, value.cast("double").alias("__v")).where("__v IS NOT NULL").groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    ranked = running(counts, "__v", ["__n"], keys)
    place = lambda q: F.lit(float(q)) * (F.col("total___n") - 1)
    holds = lambda rank: (rank >= F.col("before___n")) & (rank < F.col("before___n") + F.col("__n"))
    wanted, ends = F.lit(False), []
    for k, q in enumerate(at):
        low, high = F.floor(place(q)), F.ceil(place(q))
        wanted = wanted | holds(low) | holds(high)
        ends += [F.max(F.when(holds(low), F.col("__v"))).alias(f"__lo{k}"), F.max(F.when(holds(high), F.col("__v"))).alias(f"__hi{k}"), F.max(place(q) - low).alias(f"__f{k}")]
    found = ranked.where(wanted).groupBy(*keys).agg(*ends)  # two rows a quantile of each group
    return found.select(*keys, *[(F.col(f"__lo{k}") + (F.col(f"__hi{k}") - F.col(f"__lo{k}")) * F.col(f"__f{k}")).alias(f"q{k}") for k in range(len(at))])


def quantiles(rows: DataFrame, value: str, at: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation; nulls without any known value."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ranked = running(counts, "v", ["n"])
    places = [F.lit(float(q)) * (F.col("total_n") - 1) for q in at]
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in places for f in (F.floor, F.ceil)]))
    hit = F.filter(ranks, lambda r: (r >= F.col("before_n")) & (r < F.col("before_n") + F.col("n")))
    got = ranked.select("v", "total_n", F.explode(hit).alias("rank")).collect()  # two numbers a quantile
    if not got:
        return [None for _ in at]
    found, total = {r.rank: r.v for r in got}, got[0].total_n
    out = []
    for q in at:
        p = q * (total - 1)
        low, high = found[math.floor(p)], found[math.ceil(p)]
        out.append(low + (high - low) * (p - math.floor(p)))
    return out

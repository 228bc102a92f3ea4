"""Grid operators: points to cells, block reduction, distances, neighbours."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.graph import cut


def cell_of(x: Column, lo: float, hi: float, n: int) -> Column:
    """The cell index of x in n cells over [lo, hi]; the closed upper edge is in the last cell, points outside are null."""
    i = F.floor((x - lo) / ((hi - lo) / n)).cast("int")
    return F.when((x >= lo) & (x <= hi), F.least(i, F.lit(n - 1)))


def block_reduce(cells: DataFrame, keys: Sequence[str], wet: Column, least: int, share: float = 0.25) -> DataFrame:
    """Per block: n, valid, wet fraction, and label: null with fewer than ``least`` valid, else whether the fraction reaches ``share``."""
    out = cells.groupBy(*keys).agg(F.count("*").alias("n"), F.count(wet).alias("n_valid"), F.count_if(wet).alias("n_wet"))
    frac = F.when(F.col("n_valid") > 0, F.round(F.col("n_wet") / F.col("n_valid"), 6))
    return out.withColumn("fraction", frac).withColumn("label", F.when(F.col("n_valid") >= least, (F.col("n_wet") >= share * F.col("n_valid")).cast("int")))


def to_anchors(points: DataFrame, anchors: DataFrame, block: int = 1000, parts: int = 32) -> DataFrame:
    """Points with every anchor and the squared distance ``d2``; beyond ``block`` anchors the pairs are dealt out by blocks of anchors and ``parts`` of points.

    Any number of anchors is compared; sums and minima over ``d2`` are combined from each block's partial ones.
    """
    sides = anchors.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("v").alias("av"))
    n = anchors.count()
    if n <= block:
        joined = points.crossJoin(F.broadcast(sides))
    else:
        blocks = -(-n // block)
        every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
        dealt = sides.withColumn("__block", F.pmod(F.xxhash64("ax", "ay", "av"), F.lit(blocks))).withColumn("__part", every(parts))
        asked = points.withColumn("__part", F.pmod(F.xxhash64("x", "y"), F.lit(parts))).withColumn("__block", every(blocks))
        joined = asked.join(dealt, ["__block", "__part"]).drop("__block", "__part")
    return joined.withColumn("d2", (F.col("x") - F.col("ax")) * (F.col("x") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("y") - F.col("ay")))


def nearest(points: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """(key, d2): the squared distance from each point (key, x, y) to its nearest anchor (x, y).

    Anchors lie in square cells, about one in each. A point looks at the three
    by three cells around it; an anchor within one cell's side cannot be
    missed, so a point that has found one so near is done, and the others look
    again in cells of twice the side. Any spread takes a logarithmic number of
    rounds, and every join is on a cell. A point or anchor without coordinates
    takes no part; without anchors no point has a nearest.
    """
    known = lambda t: t.where((F.abs(F.col("x")) < float("inf")) & (F.abs(F.col("y")) < float("inf")))
    sides = cut(known(anchors).select(F.col("x").cast("double").alias("ax"), F.col("y").cast("double").alias("ay")).distinct())
    left = known(points).select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    b = sides.agg(F.count("*").alias("n"), F.min("ax").alias("x0"), F.max("ax").alias("x1"), F.min("ay").alias("y0"), F.max("ay").alias("y1")).first()
    if not b.n:
        return left.select(key, F.lit(None).cast("double").alias("d2")).limit(0)
    p = left.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    side = max(b.x1 - b.x0, b.y1 - b.y0) / math.sqrt(b.n) or 1.0
    whole = max([side, *(abs(v - w) for v in (p.x0, p.x1) if v is not None for w in (b.x0, b.x1)), *(abs(v - w) for v in (p.y0, p.y1) if v is not None for w in (b.y0, b.y1))])
    around, done = F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)]), []
    while True:
        at = lambda c, w=side: F.floor(F.col(c) / w)
        asked = left.withColumn("cx", F.explode(F.transform(around, lambda d: d + at("x")))).withColumn("cy", F.explode(F.transform(around, lambda d: d + at("y"))))
        met = asked.join(sides.select("ax", "ay", at("ax").alias("cx"), at("ay").alias("cy")), ["cx", "cy"], "left")
        dx, dy = F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
        found = cut(met.groupBy(key, "x", "y").agg(F.min(dx * dx + dy * dy).alias("d2")))
        near = F.coalesce(F.col("d2") <= side * side, F.lit(False)) if side <= 2 * whole else F.lit(True)
        done.append(found.where(near).select(key, "d2"))
        left = found.where(~near).select(key, "x", "y")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        side *= 2


def idw(near: DataFrame, key: str) -> DataFrame:
    """Inverse-distance weighting of the anchors' values, weights 1 / max(d2, 1e-12)."""
    w = 1.0 / F.greatest(F.col("d2"), F.lit(1e-12))
    return near.groupBy(key).agg(F.round(F.sum(w * F.col("av")) / F.sum(w), 6).alias("value"))


def smooth3x3(cells: DataFrame, i: str, j: str, value: str, ni: int, nj: int) -> DataFrame:
    """Edge-padded 3x3 mean, first along rows, then along columns: each pass sends a cell's sums to itself and its two neighbours.

    Beyond an edge stands the edge cell. An absent or null cell counts for
    nothing, so the mean is that of the present ones; only the cells of
    ``cells`` come back, null where none of the nine is known.
    """

    def along(rows: DataFrame, c: str, other: str, n: int) -> DataFrame:
        step = lambda to, own: F.struct(F.lit(to).alias("to"), F.lit(own).alias("own"))
        # An edge cell stands for the one beyond it, too, so it counts once more for itself.
        steps = F.concat(F.array(step(-1, 0), step(0, 1), step(1, 0)), F.when(F.col(c) == 0, F.array(step(0, 0))).otherwise(F.array()), F.when(F.col(c) == n - 1, F.array(step(0, 0))).otherwise(F.array()))
        sent = rows.withColumn("d", F.explode(steps)).withColumn(c, F.col(c) + F.col("d.to")).where(F.col(c).between(0, n - 1))
        return sent.groupBy(c, other).agg(F.sum("s").alias("s"), F.sum("k").alias("k"), F.max(F.when(F.col("d.own") == 1, F.col("own")).otherwise(0)).alias("own"))

    rows = cells.select(i, j, F.col(value).cast("double").alias("s"), F.col(value).isNotNull().cast("int").alias("k"), F.lit(1).alias("own"))
    out = along(along(rows, j, i, nj), i, j, ni).where("own = 1")
    return out.select(i, j, F.when(F.col("k") > 0, F.col("s") / F.col("k")).alias("smoothed"))


def slope(cells: DataFrame, i: str, j: str, value: str) -> DataFrame:
    """Gradient magnitude: central differences, one-sided at the edges; 0 along an axis of one cell."""
    total = F.lit(0.0)
    for line, along in ((j, i), (i, j)):
        order = Window.partitionBy(line).orderBy(along)
        before, after, own = F.lag(value).over(order), F.lead(value).over(order), F.col(value)
        width = F.when(before.isNull() | after.isNull(), 1.0).otherwise(2.0)
        d = (F.coalesce(after, own) - F.coalesce(before, own)) / width
        total = total + d * d
    return cells.select("*", F.sqrt(total).alias("slope"))

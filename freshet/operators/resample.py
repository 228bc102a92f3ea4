"""Grids at other sizes: bilinear and nearest values of the cells of a target grid.

The corner cells of both grids lie on each other, or, with ``centres``, the
target's cell centres are laid over the source's nodes. A target cell asks for at
most four source cells, so one equi-join on the cell's place brings its values
together, whatever the sizes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _place(target: Column, n_source: int, n_target: int) -> Column:
    """Where a target index lies on the source axis, in source cells."""
    return target * float(n_source - 1) / float(n_target - 1) if n_target > 1 else F.lit(0.0)


def _target(cells: DataFrame, ni: int, nj: int) -> DataFrame:
    ids = cells.sparkSession.range(ni * nj)
    return ids.select(F.floor(F.col("id") / nj).cast("int").alias("ti"), (F.col("id") % nj).cast("int").alias("tj"))


def _centre(target: Column, n_source: int, n_target: int, reach: float) -> Column:
    """The same for a target cell's centre, over an extent ``reach`` times the source's."""
    return (target + 0.5) * reach / float(n_target) * float(n_source - 1)


def bilinear(cells: DataFrame, value: str, size: tuple[int, int], target: tuple[int, int], centres: bool = False, reach: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(i, j, value) of each target cell: the weighted mean of its source cells ``i``, ``j``; null if one that has a weight is absent or null.

    With ``centres`` the target covers ``reach`` times the source's extent, and
    centres beyond the last node continue its last slope.
    """
    spot = (lambda t, n, m, k: _centre(t, n, m, reach[k])) if centres else (lambda t, n, m, k: _place(t, n, m))

    def ends(at: Column, n: int) -> Column:
        low = F.least(F.floor(at).cast("int"), F.lit(max(n - 2, 0)))
        both = F.array(F.struct(low.alias("at"), (1.0 - (at - low)).alias("w")), F.struct((low + 1).alias("at"), (at - low).alias("w")))
        return F.filter(both, lambda e: e["w"] != 0)

    (ni, nj), (mi, mj) = size, target
    asked = _target(cells, mi, mj).withColumn("a", F.explode(ends(spot(F.col("ti"), ni, mi, 0), ni))).withColumn("b", F.explode(ends(spot(F.col("tj"), nj, mj, 1), nj)))
    asked = asked.select("ti", "tj", F.col("a.at").alias("i"), F.col("b.at").alias("j"), (F.col("a.w") * F.col("b.w")).alias("w"))
    found = asked.join(cells.select("i", "j", F.col(value).cast("double").alias("v")), ["i", "j"], "left")
    whole = F.when(F.count("v") == F.count("*"), F.sum(F.col("w") * F.col("v")))
    return found.groupBy(F.col("ti").alias("i"), F.col("tj").alias("j")).agg(whole.alias(value))


def nearest(cells: DataFrame, value: str, size: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """(i, j, value) of each target cell: its nearest source cell's value, halves to the even cell; null if that is absent."""
    (ni, nj), (mi, mj) = size, target
    asked = _target(cells, mi, mj).select("ti", "tj", F.bround(_place(F.col("ti"), ni, mi)).cast("int").alias("i"), F.bround(_place(F.col("tj"), nj, mj)).cast("int").alias("j"))
    found = asked.join(cells.select("i", "j", value), ["i", "j"], "left")
    return found.select(F.col("ti").alias("i"), F.col("tj").alias("j"), value)

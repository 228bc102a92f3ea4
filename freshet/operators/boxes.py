"""Box containment: points joined to the boxes they lie in, by equality of cells at several levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.operators.graph import cut

#: Most (box, cell) rows that are broadcast.
BROADCAST_CELLS = 100_000

WORLD = 360.0  #: the width of a cell of level 0
FINER = 2  #: levels below the one that fits a box: more cells a box, fewer points that share a cell but not the box


def level_of(extent: Column) -> Column:
    """The finest level whose cells are as wide as ``extent`` or wider: negative beyond the world's width, 40 at most."""
    exact = F.floor(F.log2(F.lit(WORLD) / F.greatest(extent, F.lit(1e-9)))).cast("int")
    return F.least(exact, F.lit(40))


def cell_at(v: Column, level: Column) -> Column:
    return F.floor(v / (F.lit(WORLD) / F.pow(F.lit(2.0), level))).cast("long")


def several(rows: DataFrame, key: str) -> DataFrame | None:
    """The values of ``key`` in more than one row of ``rows``; None if there are none."""
    found = cut(rows.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(F.col(key).alias("__key")))
    return None if found.isEmpty() else found


def met(asked: DataFrame, covered: DataFrame) -> DataFrame:
    """(__point, __box) once for each row of a point and row of a box that holds it."""
    # Beyond the broadcast both sides are dealt out: a small file of points may have very many pairs.
    side = F.broadcast(covered) if covered.count() <= BROADCAST_CELLS else covered.hint("merge")
    inside = (F.col("x") >= F.col("west")) & (F.col("x") <= F.col("east")) & (F.col("y") >= F.col("south")) & (F.col("y") <= F.col("north"))
    return asked.join(side, ["level", "cx", "cy"]).where(inside).select("__point", "__box")


def contained(points: DataFrame, boxes: DataFrame, point: str, box: str, x: str = "x", y: str = "y") -> DataFrame:
    """(point, box) for each point within a box, edges included; ``boxes`` have west, south, east and north.

    A box is covered by cells ``FINER`` levels below the one that fits its longer side, five
    by five at most (six by six where rounding falls on an edge), and a point asks its one cell of each level that any box has,
    so the join is on equality, and the edges are compared after it. Several
    vertices of one feature give its box once; only the pairs of ids in several rows go through a distinct. A box that is empty, or has an
    unknown or infinite edge, holds nothing, and so does an unknown point.
    """
    edges = ["west", "south", "east", "north"]
    finite = F.lit(True)
    for e in edges:
        finite = finite & F.col(e).isNotNull() & (F.abs(F.col(e)) < float("inf"))
    own = boxes.where(finite & (F.col("west") <= F.col("east")) & (F.col("south") <= F.col("north"))).select(F.col(box).alias("__box"), *[F.col(e).cast("double").alias(e) for e in edges])
    own = own.withColumn("level", level_of(F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"))) + FINER)
    span = lambda lo, hi: F.explode(F.sequence(cell_at(F.col(lo), F.col("level")), cell_at(F.col(hi), F.col("level"))))
    covered = own.withColumn("cx", span("west", "east")).withColumn("cy", span("south", "north"))
    levels = [r.level for r in own.select("level").distinct().collect()]  # some 50 at most
    if not levels:
        return points.select(point).join(boxes.select(box), F.lit(False))
    known = points.where((F.abs(F.col(x)) < float("inf")) & (F.abs(F.col(y)) < float("inf"))).select(F.col(point).alias("__point"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    asked = known.withColumn("level", F.explode(F.array(*[F.lit(v) for v in sorted(levels)])))
    asked = asked.withColumn("cx", cell_at(F.col("x"), F.col("level"))).withColumn("cy", cell_at(F.col("y"), F.col("level")))
    many_points, many_boxes = several(known, "__point"), several(own, "__box")
    once, again, rest = asked, covered, []
    if many_points is not None:
        same = F.col("__point").eqNullSafe(F.col("__key"))
        once = asked.join(many_points, same, "left_anti")
        rest.append(met(asked.join(many_points, same, "left_semi"), covered))
    if many_boxes is not None:
        same = F.col("__box").eqNullSafe(F.col("__key"))
        again = covered.join(many_boxes, same, "left_anti")
        rest.append(met(once, covered.join(many_boxes, same, "left_semi")))
    pairs = met(once, again)
    for more in rest:  # no pair is in two of the parts
        pairs = pairs.unionByName(more.distinct())
    return pairs.select(F.col("__point").alias(point), F.col("__box").alias(box))

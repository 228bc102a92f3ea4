"""Rain on a lattice of points: accumulations before an issue, spread over the cells of a grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lattice_points(areas: DataFrame, area: str, n: int) -> DataFrame:
    """(area, point, lat, lon): n by n points from edge to edge of each area's west, south, east and north; a single point is its south-west corner."""
    step = lambda lo, hi, k: F.col(lo) + (F.col(hi) - F.col(lo)) * k / float(max(n - 1, 1))
    each = areas.select(area, "west", "south", "east", "north", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("point"))
    return each.select(area, "point", step("south", "north", F.floor(F.col("point") / n)).alias("lat"), step("west", "east", F.col("point") % n).alias("lon"))


def accumulations(readings: DataFrame, issues: DataFrame, area: str, point: str, hour: str, value: str, issue: str, spans: Sequence[int] = (24, 72)) -> DataFrame:
    """(area, issue, point, sum_<hours>..., peak_<least hours>, n_known): each point's rain in the hours before an issue, the issue's own left out.

    A sum is null where fewer than half of its hours are known, the peak where
    none is. An issue takes its hours by equality, so readings of any length
    are joined once; a repeated hour of a point counts with its greatest value.
    Every point of an area is there for each of its issues.
    """
    longest = max(spans)
    known = readings.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(area, point, hour).agg(F.max(value).alias("v"))
    asked = issues.select(area, issue).distinct().withColumn("back", F.explode(F.sequence(F.lit(1), F.lit(longest)))).withColumn(hour, F.col(issue) - F.col("back"))
    sums = []
    for s in spans:
        inside = F.when(F.col("back") <= s, F.col("v"))
        sums.append(F.when(F.count(inside) * 2 >= s, F.sum(inside)).alias(f"sum_{s}"))
    peak = F.max(F.when(F.col("back") <= min(spans), F.col("v"))).alias(f"peak_{min(spans)}")
    held = asked.join(known, [area, hour]).groupBy(area, issue, point).agg(*sums, peak, F.count("v").alias("n_known"))
    every = issues.select(area, issue).distinct().join(readings.select(area, point).distinct(), area)  # an area's lattice, some dozens of points
    return every.join(held, [area, issue, point], "left").withColumn("n_known", F.coalesce("n_known", F.lit(0)))


def maps_at_issue(sums: DataFrame, points: DataFrame, cells: DataFrame, area: str, issue: str, point: str, values: Sequence[str], hours: int = 72, least: int = 4) -> DataFrame:
    """(area, issue, i, j, values..., completeness) on the cells (area, i, j, lat, lon), by inverse distance from the lattice's known points.

    A value that no point knows is 0 on the grid, as a map without rain; an
    issue whose first value no point knows, or an area of fewer than ``least``
    points, has no map. ``completeness`` is the known share of all points' ``hours``.
    """
    placed = sums.join(points, [area, point])
    usable = placed.groupBy(area, issue).agg(F.count("*").alias("n"), F.count(values[0]).alias("known"), (F.sum("n_known") / (F.count("*") * float(hours))).alias("completeness")).where((F.col("n") >= least) & (F.col("known") > 0))
    near = placed.join(usable.select(area, issue, "completeness"), [area, issue]).withColumnRenamed("lat", "plat").withColumnRenamed("lon", "plon")
    d2 = (F.col("plat") - F.col("lat")) * (F.col("plat") - F.col("lat")) + (F.col("plon") - F.col("lon")) * (F.col("plon") - F.col("lon"))
    met = near.join(cells.select(area, "i", "j", "lat", "lon"), area).withColumn("w", 1.0 / F.greatest(d2, F.lit(1e-12)))
    spread = lambda v: F.coalesce(F.sum(F.col("w") * F.col(v)) / F.sum(F.when(F.col(v).isNotNull(), F.col("w"))), F.lit(0.0)).alias(v)
    return met.groupBy(area, issue, "i", "j").agg(*[spread(v) for v in values], F.first("completeness").alias("completeness"))

"""Patches of flooded cells, boxes, and projected points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators import boxes, patches, projection
from freshet.plans.registry import query
from freshet.sources.tables import table

_STATES = """WITH c AS (SELECT l_linestatus AS map, l_partkey // 8 AS i, l_suppkey % 50 AS j, coalesce(sum(l_quantity) FILTER (l_discount < 0.05), 0) > 30 AS a, coalesce(sum(l_quantity) FILTER (l_discount >= 0.05), 0) > 30 AS b, max(l_tax) >= 0.08 AS dark FROM lineitem GROUP BY ALL),
    s AS (SELECT map, i, j, CASE WHEN NOT dark THEN a END AS wet0, b AS wet1 FROM c)"""
_WALK = """, n AS (SELECT map, i, j FROM s WHERE NOT wet0 AND wet1),
    walk AS (SELECT map, i, j, i AS li, j AS lj FROM n UNION SELECT w.map, n.i, n.j, w.li, w.lj FROM walk w JOIN n ON n.map = w.map AND abs(n.i - w.i) + abs(n.j - w.j) = 1),
    l AS (SELECT map, i, j, min((li, lj)) AS first FROM walk GROUP BY ALL)"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of two maps with their states before and after; a cell with a row of the highest tax is unknown before."""
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("l_quantity"))), F.lit(0.0)) > 30
    keys = [F.col("l_linestatus").alias("map"), F.floor(F.col("l_partkey") / 8).alias("i"), (F.col("l_suppkey") % 50).alias("j")]
    cells = table(spark, sf_dir, "lineitem").groupBy(*keys).agg(part(F.col("l_discount") < 0.05).alias("wet0"), part(F.col("l_discount") >= 0.05).alias("wet1"), (F.max("l_tax") >= 0.08).alias("dark"))
    return cells.withColumn("wet0", F.when(~F.col("dark"), F.col("wet0")))


@query(_STATES.replace("WITH c", "WITH RECURSIVE c") + _WALK + " SELECT map, i, j, first[1] AS label_i, first[2] AS label_j FROM l")
def flood_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _states(spark, sf_dir).where(~F.col("wet0") & F.col("wet1"))
    return patches.label_cells(new, ["map"], "i", "j", tile=16)


@query(_STATES.replace("WITH c", "WITH RECURSIVE c") + _WALK + """, z AS (SELECT map, first, count(*) AS c FROM l GROUP BY ALL), y AS (SELECT map, count(*) AS n_patches, round(max(c) / sum(c), 6) AS largest_share FROM z GROUP BY map),
    m AS (SELECT map, count(*) FILTER (NOT wet0 AND wet1) AS n_new, CASE WHEN least(count(*) FILTER (wet0), count(*) FILTER (wet0 IS NOT NULL AND wet1)) >= 10 THEN round(sqrt(pow(avg(i) FILTER (wet0 IS NOT NULL AND wet1) - avg(i) FILTER (wet0), 2) + pow(avg(j) FILTER (wet0 IS NOT NULL AND wet1) - avg(j) FILTER (wet0), 2)), 6) END AS centre_shift FROM s GROUP BY map)
    SELECT map, n_new, coalesce(n_patches, 0) AS n_patches, largest_share, centre_shift FROM m LEFT JOIN y USING (map)""")
def flood_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patches.expansion(_states(spark, sf_dir), ["map"], "i", "j", F.col("wet0"), F.col("wet1"), tile=16)


_BOXES = "SELECT s_suppkey, s_nationkey * 14.4::DOUBLE - 180 - w AS west, s_nationkey * 14.4::DOUBLE - 180 + w AS east, s_acctbal / 120.0::DOUBLE - w AS south, s_acctbal / 120.0::DOUBLE + w / 2 AS north FROM (SELECT *, (s_suppkey % 23 + 1) * 0.75::DOUBLE AS w FROM supplier)"
_PLACES = "SELECT c_custkey, (c_custkey * 7919 % 36000) / 100.0::DOUBLE - 180 AS x, c_acctbal / 120.0::DOUBLE AS y FROM customer"


@query(f"WITH b AS ({_BOXES}), p AS ({_PLACES}) SELECT c_custkey, s_suppkey FROM p JOIN b ON x BETWEEN west AND east AND y BETWEEN south AND north")
def box_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = (F.col("s_suppkey") % 23 + 1) * 0.75
    mid, up = F.col("s_nationkey") * 14.4 - 180, F.col("s_acctbal") / 120.0
    own = table(spark, sf_dir, "supplier").select("s_suppkey", (mid - w).alias("west"), (mid + w).alias("east"), (up - w).alias("south"), (up + w / 2).alias("north"))
    points = table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") * 7919 % 36000) / 100.0 - 180).alias("x"), (F.col("c_acctbal") / 120.0).alias("y"))
    return boxes.contained(points, own, "c_custkey", "s_suppkey")


_PLANE, _TILE = projection.Plane(), projection.TILES["E039N021T3"]
_SIN, _COS = (repr(f(math.radians(_PLANE.lat0))) for f in (math.sin, math.cos))


@query(f"""WITH p AS (SELECT vec_id, 24.0 + 2 * embedding[1]::DOUBLE AS lat, 90.0 + 2 * embedding[2]::DOUBLE AS lon FROM embeddings), r AS (SELECT *, radians(lat) AS f, radians(lon - {_PLANE.lon0}) AS t FROM p),
    c AS (SELECT *, acos(greatest(-1.0, least(1.0, {_SIN} * sin(f) + {_COS} * cos(f) * cos(t)))) AS c FROM r), k AS (SELECT *, CASE WHEN c < 1e-12 THEN 1.0 ELSE c / sin(c) END * {projection.RADIUS} AS k FROM c),
    xy AS (SELECT *, k * cos(f) * sin(t) + {_PLANE.east} AS x, k * ({_COS} * sin(f) - {_SIN} * cos(f) * cos(t)) + {_PLANE.north} AS y FROM k), a AS (SELECT *, ({_TILE.north} - y) / 20.0 AS r, (x - {_TILE.west}) / 20.0 AS q FROM xy)
    SELECT vec_id, round(x, 3) AS x, round(y, 3) AS y, round(r, 4) AS "row", round(q, 4) AS col, r >= 0 AND r < 15000 AND q >= 0 AND q < 15000 AS in_tile, round(lat, 9) AS lat, round(lon, 9) AS lon FROM a""")
def projected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on the plane, their pixels, and the coordinates that come back from the plane."""
    e = table(spark, sf_dir, "embeddings")
    p = e.select("vec_id", (24.0 + 2 * F.col("embedding")[0].cast("double")).alias("lat"), (90.0 + 2 * F.col("embedding")[1].cast("double")).alias("lon"))
    x, y = _PLANE.forward(F.col("lat"), F.col("lon"))
    on = p.select("vec_id", x.alias("x"), y.alias("y"))
    row, col = _TILE.address(F.col("x"), F.col("y"))
    lat, lon = _PLANE.inverse(F.col("x"), F.col("y"))
    return on.select("vec_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(row, 4).alias("row"), F.round(col, 4).alias("col"), _TILE.holds(row, col).alias("in_tile"), F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))

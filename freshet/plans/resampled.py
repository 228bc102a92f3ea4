"""Grids at other sizes over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators import resample
from freshet.plans.grids import _GRID, _quantity_grid
from freshet.plans.registry import query

SIZE, FINE, COARSE = (20, 10), (33, 15), (7, 19)
_AXES = "a AS (SELECT unnest(range({0}))::INT AS i), b AS (SELECT unnest(range({1}))::INT AS j)"


@query(f"""WITH g AS ({_GRID}), {_AXES.format(*FINE)},
    p AS (SELECT i, j, i * 19.0::DOUBLE / 32 AS y, j * 9.0::DOUBLE / 14 AS x FROM a, b),
    q AS (SELECT *, least(floor(y)::INT, 18) AS y0, least(floor(x)::INT, 8) AS x0 FROM p)
    SELECT q.i, q.j, round(sum((1 - abs(y - g.i)) * (1 - abs(x - g.j)) * g.v), 6) AS v FROM q JOIN g ON g.i IN (y0, y0 + 1) AND g.j IN (x0, x0 + 1) GROUP BY 1, 2""")
def bilinear_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.bilinear(_quantity_grid(spark, sf_dir), "v", SIZE, FINE).select("i", "j", F.round("v", 6).alias("v"))


@query(f"""WITH g AS ({_GRID}), {_AXES.format(*FINE)},
    p AS (SELECT i, j, (i + 0.5)::DOUBLE * 1.1 / 33 * 19 AS y, (j + 0.5)::DOUBLE / 15 * 9 AS x FROM a, b),
    q AS (SELECT *, least(floor(y)::INT, 18) AS y0, least(floor(x)::INT, 8) AS x0 FROM p)
    SELECT q.i, q.j, round(sum(CASE WHEN g.i = y0 THEN 1 - (y - y0) ELSE y - y0 END * CASE WHEN g.j = x0 THEN 1 - (x - x0) ELSE x - x0 END * g.v), 6) AS v FROM q JOIN g ON g.i IN (y0, y0 + 1) AND g.j IN (x0, x0 + 1) GROUP BY 1, 2""")
def centred_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell centres over an extent a tenth longer than the source: the last rows continue its slope."""
    return resample.bilinear(_quantity_grid(spark, sf_dir), "v", SIZE, FINE, centres=True, reach=(1.1, 1.0)).select("i", "j", F.round("v", 6).alias("v"))


@query(f"""WITH g AS ({_GRID}), {_AXES.format(*COARSE)}
    SELECT a.i, b.j, g.v::DOUBLE AS v FROM a, b LEFT JOIN g ON g.i = round_even(a.i * 19.0::DOUBLE / 6, 0)::INT AND g.j = round_even(b.j * 9.0::DOUBLE / 18, 0)::INT""")
def nearest_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.nearest(_quantity_grid(spark, sf_dir), "v", SIZE, COARSE).select("i", "j", F.col("v").cast("double").alias("v"))

"""Scenario comparison, grid and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators import compare, graph, grid
from freshet.plans.registry import query
from freshet.sources.tables import table

CELL = ["l_partkey", "l_linenumber"]
_DIFF = """WITH a AS (SELECT l_partkey, l_linenumber, sum(l_quantity) AS depth_a FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
    b AS (SELECT l_partkey, l_linenumber, sum(l_quantity) AS depth_b FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
    d AS (SELECT l_partkey, l_linenumber, depth_a, depth_b, depth_a - depth_b AS diff FROM a JOIN b USING (l_partkey, l_linenumber)) """


def _scenario(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    return rows.groupBy(*CELL).agg(F.sum("l_quantity").alias("depth"))


@query(_DIFF + "SELECT * FROM d")
def scenario_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.scenario_diff(_scenario(spark, sf_dir, "A"), _scenario(spark, sf_dir, "R"), CELL, "depth")


@query(_DIFF + "SELECT count(*) AS n_cells, min(diff) AS min_diff, max(diff) AS max_diff, round(avg(diff), 6) AS mean_diff, round(avg(abs(diff)), 6) AS mean_abs, round(sqrt(avg(diff * diff)), 6) AS rmse, max(abs(diff)) AS max_abs FROM d")
def difference_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.difference_stats(scenario_diff(spark, sf_dir))


@query(_DIFF + "SELECT CASE WHEN depth_a > 30 AND depth_b > 30 THEN 1 WHEN depth_a > 30 THEN 2 WHEN depth_b > 30 THEN 3 ELSE 0 END::INT AS category, count(*) AS n FROM d GROUP BY 1")
def extent_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = compare.extent_category(F.col("depth_a"), F.col("depth_b"), 30.0)
    return scenario_diff(spark, sf_dir).groupBy(category.alias("category")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, CASE WHEN value >= 20 THEN value > 60 END AS wet, lead(CASE WHEN value >= 20 THEN value > 60 END) OVER w AS nxt, lead(event_id) OVER w AS next_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
    SELECT CASE WHEN wet IS NULL OR nxt IS NULL THEN 255 WHEN NOT wet AND nxt THEN 1 WHEN wet AND NOT nxt THEN 2 WHEN wet AND nxt THEN 3 ELSE 4 END::INT AS class, count(*) AS n FROM e WHERE next_id IS NOT NULL GROUP BY 1""")
def transition_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.operators.temporal import adjacent_pairs

    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("value") >= 20, F.col("value") > 60).alias("wet"))
    pairs = adjacent_pairs(e, "user_id", "ts", ["wet"])
    return pairs.groupBy(compare.transition_class(F.col("wet"), F.col("next_wet")).alias("class")).agg(F.count("*").alias("n"))


_CELL_SQL = "CASE WHEN {x} BETWEEN -2 AND 2 THEN least(floor(({x} + 2.0) / 0.25)::INT, 15) END"
_POINTS = f"SELECT vec_id, label, {_CELL_SQL.format(x='embedding[1]::DOUBLE')} AS i, {_CELL_SQL.format(x='embedding[2]::DOUBLE')} AS j FROM embeddings"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query(_POINTS)
def point_to_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("vec_id", "label", grid.cell_of(F.col("x"), -2.0, 2.0, 16).alias("i"), grid.cell_of(F.col("y"), -2.0, 2.0, 16).alias("j"))


@query(f"""WITH p AS ({_POINTS}), w AS (SELECT i // 4 AS bi, j // 4 AS bj, CASE WHEN label <> 3 THEN label >= 5 END AS wet FROM p WHERE i IS NOT NULL AND j IS NOT NULL)
    SELECT bi::INT AS bi, bj::INT AS bj, count(*) AS n, count(wet) AS n_valid, count(*) FILTER (wet) AS n_wet, CASE WHEN count(wet) > 0 THEN round(count(*) FILTER (wet) / count(wet), 6) END AS fraction,
    CASE WHEN count(wet) >= 2 THEN (count(*) FILTER (wet) >= 0.25 * count(wet))::INT END AS label FROM w GROUP BY 1, 2""")
def block_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = point_to_cell(spark, sf_dir).where("i IS NOT NULL AND j IS NOT NULL").withColumn("bi", F.floor(F.col("i") / 4).cast("int")).withColumn("bj", F.floor(F.col("j") / 4).cast("int"))
    return grid.block_reduce(p, ["bi", "bj"], F.when(F.col("label") != 3, F.col("label") >= 5), 2)


_NEAR = """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings), a AS (SELECT label, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM p WHERE label IS NOT NULL GROUP BY label),
    d AS (SELECT p.vec_id, a.label AS v, (p.x - a.x) * (p.x - a.x) + (p.y - a.y) * (p.y - a.y) AS d2 FROM p, a) """


def _anchors(p: DataFrame) -> DataFrame:
    """The labels' centroids over the whole table."""
    centre = lambda c: F.round(F.avg(c), 6).alias(c)
    return p.where("label IS NOT NULL").groupBy(F.col("label").alias("v")).agg(centre("x"), centre("y"))


@query(_NEAR + "SELECT vec_id, round(sum(v / greatest(d2, 1e-12)) / sum(1.0 / greatest(d2, 1e-12)), 6) AS value FROM d GROUP BY 1")
def idw(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    return grid.idw(grid.to_anchors(p, _anchors(p)), "vec_id")


@query(_NEAR + "SELECT vec_id, round(sqrt(min(d2)), 6) AS distance FROM d GROUP BY 1")
def nearest_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    return grid.nearest(p, _anchors(p), "vec_id").select("vec_id", F.round(F.sqrt("d2"), 6).alias("distance"))


_GRID = "SELECT (l_partkey % 20)::INT AS i, (l_suppkey % 10)::INT AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2"


def _quantity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 20).cast("int").alias("i"), (F.col("l_suppkey") % 10).cast("int").alias("j")).agg(F.sum("l_quantity").alias("v"))


@query(f"""WITH g AS ({_GRID}), o AS (SELECT unnest([-1, 0, 1]) AS d)
    SELECT t.i, t.j, round(sum(s.v) / 9.0, 6) AS smoothed FROM g t, o a, o b JOIN g s ON s.i = least(greatest(t.i + a.d, 0), 19) AND s.j = least(greatest(t.j + b.d, 0), 9) GROUP BY 1, 2""")
def smooth3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.smooth3x3(_quantity_grid(spark, sf_dir), "i", "j", "v", 20, 10)
    return out.select("i", "j", F.round("smoothed", 6).alias("smoothed"))


@query(f"""WITH g AS ({_GRID}), n AS (SELECT i, j, v, lag(v) OVER x AS w, lead(v) OVER x AS e, lag(v) OVER y AS s, lead(v) OVER y AS n FROM g WINDOW x AS (PARTITION BY j ORDER BY i), y AS (PARTITION BY i ORDER BY j))
    SELECT i, j, round(sqrt(pow((coalesce(e, v) - coalesce(w, v)) / CASE WHEN e IS NULL OR w IS NULL THEN 1.0 ELSE 2.0 END, 2) + pow((coalesce(n, v) - coalesce(s, v)) / CASE WHEN n IS NULL OR s IS NULL THEN 1.0 ELSE 2.0 END, 2)), 6) AS slope FROM n""")
def slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.slope(_quantity_grid(spark, sf_dir), "i", "j", "v").select("i", "j", F.round("slope", 6).alias("slope"))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS src, ((n_nationkey * 7 + 3) % 25)::INT AS dst FROM nation UNION SELECT n_nationkey, ((n_nationkey * 3 + 1) % 25)::INT FROM nation),
    walk AS (SELECT 0 AS node, 0 AS depth UNION SELECT e.dst, walk.depth + 1 FROM walk JOIN e ON e.src = walk.node WHERE walk.depth < 6)
    SELECT node::INT AS node, min(depth)::INT AS depth FROM walk GROUP BY node""")
def graph_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    edge = lambda a, b: n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * a + b) % 25).cast("int").alias("dst"))
    return graph.frontier(edge(7, 3).union(edge(3, 1)).distinct(), 0, 6)

"""Components, patches of cells, and boxes against plain versions."""

import math
import random

from pyspark.sql import functions as F

from freshet.operators import boxes, exposure, graph, patches, projection


def plain_components(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        lo, hi = sorted((root(a), root(b)))
        up[hi] = lo
    return {x: root(x) for x in list(up)}


def test_components_of_chains_hubs_and_loops(spark):
    rng = random.Random(2)
    chain = list(range(1000, 1100))
    rng.shuffle(chain)
    pairs = [*zip(chain, chain[1:], strict=False), *[(5000, x) for x in range(5001, 5200)], *[(x, 9999) for x in range(6000, 6050)], (7, 7), (1, 2), (2, 1), (3, 4), (4, 5), (5, 3)]
    pairs += [(rng.randrange(20000, 20300), rng.randrange(20000, 20300)) for _ in range(150)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == plain_components(pairs)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_frontier_stops_at_its_depth(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4)], "src int, dst int")
    assert sorted(map(tuple, graph.frontier(edges, 0).collect())) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4)]
    assert sorted(map(tuple, graph.frontier(edges, 0, 2).collect())) == [(0, 0), (1, 1), (2, 2)]
    assert [tuple(r) for r in graph.frontier(edges, 9).collect()] == [(9, 0)]


def plain_patches(cells):
    label, out = {}, set(cells)
    for c in sorted(out):
        if c in label:
            continue
        label[c], open_ = c, [c]
        while open_:
            m, i, j = open_.pop()
            for n in ((m, i + 1, j), (m, i - 1, j), (m, i, j + 1), (m, i, j - 1)):
                if n in out and n not in label:
                    label[n] = c
                    open_.append(n)
    return {k: v[1:] for k, v in label.items()}


def snake(n):
    """One patch that winds through all columns of an n by n grid."""
    rows = [(i, j) for i in range(0, n, 2) for j in range(n)]
    return rows + [(i, (n - 1) if (i // 2) % 2 == 0 else 0) for i in range(1, n - 1, 2)]


def test_patches_over_many_tiles(spark):
    rng = random.Random(4)
    cells = [("snake", i, j) for i, j in snake(31)] + [("noise", rng.randrange(-20, 20), rng.randrange(-20, 20)) for _ in range(900)]
    cells += [("full", i, j) for i in range(12) for j in range(12)] + [("one", 5, -5), ("corners", 0, 0), ("corners", 1, 1)]
    df = spark.createDataFrame([*cells, cells[0], ("none", None, 3), (None, 3, 3), (None, 4, 3)], "map string, i int, j int")
    for tile in (4, 64):
        got = {(r.map, r.i, r.j): (r.label_i, r.label_j) for r in patches.label_cells(df, ["map"], "i", "j", tile).collect()}
        assert got == plain_patches(cells)
    sizes = {r.map: (r.n_patches, r.largest_share) for r in patches.patch_sizes(patches.label_cells(df, ["map"], "i", "j", 4), ["map"]).collect()}
    assert sizes["snake"] == sizes["full"] == sizes["one"] == (1, 1.0) and sizes["corners"] == (2, 0.5)


def test_expansion_with_unknown_and_dry_maps(spark):
    rows = [("a", i, j, i < 3, i < 6 and j != 2) for i in range(8) for j in range(5)] + [("dry", 0, 0, False, False), ("unknown", 0, 0, None, True), ("lost", 0, 0, True, None)]
    df = spark.createDataFrame(rows, "map string, i int, j int, w0 boolean, w1 boolean")
    got = {r.map: tuple(r)[1:] for r in patches.expansion(df, ["map"], "i", "j", F.col("w0"), F.col("w1"), tile=2).collect()}
    assert got["a"] == (12, 2, 0.5, 1.5)
    assert got["dry"] == got["unknown"] == got["lost"] == (0, 0, None, None)


def test_boxes_against_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    inf, nan = float("inf"), float("nan")
    pts = [(i, rng.uniform(-200, 200), rng.uniform(-95, 95)) for i in range(400)] + [(400, 0.0, 0.0), (401, None, 1.0), (402, nan, 1.0), (403, inf, 1.0), (404, 22.5, 22.5), (404, 5.0, 5.0), (405, -180.0, -90.0)]
    bxs = [(i, x, y, x + rng.choice([0.001, 1, 30, 500]), y + rng.choice([0.0, 2, 60])) for i in range(120) for x, y in [(rng.uniform(-190, 190), rng.uniform(-95, 95))]]
    bxs += [(200, 0.0, 0.0, 22.5, 22.5), (201, 0.0, 0.0, 0.0, 0.0), (202, 10.0, 0.0, -10.0, 5.0), (203, None, 0.0, 1.0, 1.0), (204, -inf, 0.0, inf, 1.0), (205, nan, 0.0, 1.0, 1.0), (206, -180.0, -90.0, 180.0, 90.0)]
    ok = lambda *v: all(x is not None and math.isfinite(x) for x in v)
    want = {(p, b) for p, x, y in pts if ok(x, y) for b, w, s, e, n in bxs if ok(w, s, e, n) and w <= x <= e and s <= y <= n}
    points, own = spark.createDataFrame(pts, "p long, x double, y double"), spark.createDataFrame(bxs, "b long, west double, south double, east double, north double")
    for most in (100_000, 0):
        monkeypatch.setattr(boxes, "BROADCAST_CELLS", most)
        got = [tuple(r) for r in boxes.contained(points, own, "p", "b").collect()]
        assert len(got) == len(want) and set(got) == want
    assert boxes.contained(points, own.limit(0), "p", "b").count() == 0 == boxes.contained(points.limit(0), own, "p", "b").count()


def test_boxes_of_repeated_ids(spark, monkeypatch):
    """Features of several vertices and boxes of several rows, null ids too, give each pair once; ids that stand once go through no distinct."""
    rng = random.Random(7)
    pts = [(rng.choice([None, *range(60)]), rng.uniform(0, 40), rng.uniform(0, 40)) for _ in range(200)]
    bxs = [(rng.choice([None, *range(30)]), x, y, x + rng.choice([1, 9, 25]), y + rng.choice([0.5, 3, 30])) for _ in range(60) for x, y in [(rng.uniform(0, 40), rng.uniform(0, 40))]]
    want = {(p, b) for p, x, y in pts for b, w, s, e, n in bxs if w <= x <= e and s <= y <= n}
    points, own = spark.createDataFrame(pts, "p long, x double, y double"), spark.createDataFrame(bxs, "b long, west double, south double, east double, north double")
    for most in (100_000, 0):
        monkeypatch.setattr(boxes, "BROADCAST_CELLS", most)
        got = [tuple(r) for r in boxes.contained(points, own, "p", "b").collect()]
        assert len(got) == len(want) and set(got) == want
        single = boxes.contained(points.dropDuplicates(["p"]), own.dropDuplicates(["b"]), "p", "b")
        plan = single._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan[: plan.index("Join")]


def test_neighbours_in_cells_and_of_several_ends(spark, monkeypatch):
    """Repeated and null rows, hot nodes, segments of several ends; segments of one row each go through no distinct."""
    rng = random.Random(9)
    pick = lambda n: rng.choice([None, 0, 0, *range(n)])
    simple = [(i, pick(9), pick(9)) for i in range(150)]
    for rows in (simple, simple + [(pick(40), pick(9), pick(9)) for _ in range(80)]):
        want = {(s, t) for s, _, z in rows for t, a, _ in rows if None not in (s, t, z) and z == a and s != t}
        df = spark.createDataFrame(rows, "k long, a int, z int")
        for most in (2048, 7):
            monkeypatch.setattr(exposure, "CELL_ROWS", most)
            found = exposure.neighbours(df, "k", "a", "z")
            got = [tuple(r) for r in found.collect()]
            assert len(got) == len(want) and set(got) == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert rows is not simple or "Aggregate" not in plan[: plan.index("Join")]


def test_neighbours_move_arrays_not_a_row_for_each_cell(spark, monkeypatch):
    """A node of many cells: each side crosses the shuffle as an array for each cell, and its pairs are made after."""
    df = spark.range(300).select(F.col("id").alias("k"), F.lit(0).alias("a"), (F.col("id") % 2).cast("int").alias("z"))
    monkeypatch.setattr(exposure, "CELL_ROWS", 10, raising=False)
    monkeypatch.setattr(exposure, "BLOCK_ROWS", 4, raising=False)
    found = exposure.neighbours(df, "k", "a", "z")
    got = [tuple(r) for r in found.collect()]
    assert len(got) == 150 * 299 and set(got) == {(s, t) for s in range(0, 300, 2) for t in range(300) if s != t}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join") :]
    assert "held" in below and "segment" not in below and below.count("RepartitionByExpression") == 2


def test_projection_round_trip_and_windows(spark):
    plane, tile = projection.Plane(), projection.TILES["E039N021T3"]
    rng = random.Random(8)
    rows = [(rng.uniform(-30, 80), rng.uniform(20, 170)) for _ in range(300)] + [(47.0, 94.0), (24.0, 90.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    x, y = plane.forward(F.col("lat"), F.col("lon"))
    on = df.select("lat", "lon", x.alias("x"), y.alias("y"))
    lat, lon = plane.inverse(F.col("x"), F.col("y"))
    for r in on.select("*", lat.alias("lat2"), lon.alias("lon2")).collect():
        if r.lat is None:
            assert r.x is None and r.lat2 is None
            continue
        assert abs(r.lat - r.lat2) < 1e-6 and abs(r.lon - r.lon2) < 1e-6
        a, b = math.radians(r.lat), math.radians(47.0)
        c = math.acos(max(-1, min(1, math.sin(a) * math.sin(b) + math.cos(a) * math.cos(b) * math.cos(math.radians(r.lon - 94.0)))))
        assert abs(math.hypot(r.x - plane.east, r.y - plane.north) - c * projection.RADIUS) < 0.2  # distances from the centre are kept; acos knows small ones to 0.1 m
    at = lambda r, c: (F.lit(r), F.lit(c))
    one = spark.range(1).select(tile.window([at(10.4, 3.0), at(20.5, 7.2)]).alias("a"), tile.window([at(14990.0, -50.0), at(14999.5, 4.0)]).alias("b"), tile.window([at(-90.0, 4.0), at(-20.0, 9.0)]).alias("c"), tile.holds(F.lit(0.0), F.lit(14999.9)).alias("d"), tile.holds(F.lit(-0.1), F.lit(0.0)).alias("e")).first()
    assert tuple(one.a) == (2, 29, 0, 16) and tuple(one.b) == (14982, 15000, 0, 12) and one.c is None and one.d and not one.e

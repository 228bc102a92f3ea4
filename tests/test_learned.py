"""Boosted stumps and permutation importance against plain versions."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from freshet.operators import boosting, importance


def plain_stumps(x, y, w, rounds, rate, least):
    p = float(np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3))
    base = float(np.log(p / (1 - p)))
    raw, found = np.full(len(y), base), []
    cuts = [np.unique(np.quantile(c[~np.isnan(c)], boosting.CUTS)) if (~np.isnan(c)).any() else [] for c in x.T]
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(raw, -40, 40)))
        g, h = w * (y - q), w * q * (1 - q)
        best = None
        for f, at in enumerate(cuts):
            for t in at:
                low = x[:, f] <= t
                if min(low.sum(), (~low).sum()) < least:
                    continue
                hl, hr = h[low].sum() + 1, h[~low].sum() + 1
                gain = g[low].sum() ** 2 / hl + g[~low].sum() ** 2 / hr
                if best is None or gain > best[4] + 1e-9:
                    best = (f, float(t), g[low].sum() / hl, g[~low].sum() / hr, gain)
        if best is None:
            break
        found.append(best)
        raw = raw + rate * np.where(x[:, best[0]] <= best[1], best[2], best[3])
    return base, found, 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def test_stumps_against_a_plain_fit(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 30, size=(600, 4)).astype(float)
    x[:, 2] = 7  # a constant
    x[::17, 3] = np.nan
    y = ((x[:, 0] > 12) & (x[:, 1] < 20)).astype(int) ^ (rng.random(600) < 0.1)
    w = rng.integers(1, 4, size=600).astype(float)
    rows = [(*map(float, r), int(b), float(c)) for r, b, c in zip(x, y, w, strict=True)] + [(1.0, 1.0, 1.0, 1.0, None, 1.0), (1.0, 1.0, 1.0, 1.0, 1, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y int, w double")
    model = boosting.fit(df, ["a", "b", "c", "d"], "y", "w", rounds=8)
    base, want, p = plain_stumps(x, y, w, 8, 0.08, 8)
    assert abs(model.base - base) < 1e-12 and len(model.stumps) == len(want) == 8
    for s, v in zip(model.stumps, want, strict=True):
        assert (s.feature, s.threshold) == v[:2] and np.allclose((s.left, s.right, s.gain), v[2:])
    got = df.where("y IS NOT NULL AND w IS NOT NULL").select(model.probability([F.col(c) for c in "abcd"]).alias("p")).toPandas()["p"]
    assert np.allclose(sorted(got), sorted(p))


def test_stumps_of_few_rows_and_unknown_features(spark):
    few = spark.createDataFrame([(float(i), None, i % 2) for i in range(10)], "a double, b double, y int")
    model = boosting.fit(few, ["a", "b"], "y")
    assert model.stumps == () and abs(model.base) < 1e-12
    assert boosting.fit(few.limit(0), ["a", "b"], "y").stumps == ()


def test_ranks_are_dealt_out_and_whole(spark):
    df = spark.range(5000).select(F.lit(1).alias("g"), F.col("id"))
    got = importance.ranked(df, ["g"], F.md5(F.col("id").cast("string")), digits=2).collect()
    want = {x: r for r, x in enumerate(sorted(range(5000), key=lambda x: hashlib.md5(str(x).encode()).hexdigest()))}
    assert {r.id: r["rank"] for r in got} == want and {r["size"] for r in got} == {5000}


def test_importance_shuffles_within_maps(spark):
    rng = random.Random(9)
    rows = [(i, f"m{min(i % 9, 2)}", "e" + "01"[min(i % 9, 2) > 1], float(rng.randrange(20)), float(rng.randrange(20)), None) for i in range(900)]
    rows = [(i, m, e, a, b, int(a > 9)) for i, m, e, a, b, _ in rows] + [(1000, "alone", "e0", 3.0, 3.0, 0), (1001, None, "e0", 1.0, 1.0, 1), (1002, "m0", "e0", 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, map string, event string, a double, b double, y int")
    moved = importance.permuted(df.where("map IS NOT NULL"), "map", "id", ["a", "b"], 5).collect()
    own = {r[0]: r for r in rows}
    for f in (0, 1):
        for m in ("m0", "m1", "m2", "alone"):
            before = sorted(r[3 + f] for r in rows if r[1] == m)
            after = [r for r in moved if r.f == f and r["map"] == m]
            assert sorted(r.x[f] for r in after) == before and all(r.x[1 - f] == own[r.id][3 + (1 - f)] for r in after)
    got = {r.feature: r for r in importance.importance(df, "map", "event", "id", ["a", "b"], "y", lambda x: F.when(x[0] > 9, 1.0).otherwise(0.0), 5).collect()}
    assert got["b"].delta_brier == 0 and got["a"].delta_brier > 0.3  # only the first feature counts

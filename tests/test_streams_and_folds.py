"""Streams against their batch forms, reachability, folds and resamples."""

import tempfile

from pyspark.sql import functions as F

from freshet.operators import graph
from freshet.plans import ordered, scores
from freshet.streaming import rain


def _stream(spark, sf_dir):
    """events.parquet alone in a folder of links."""
    import os

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    os.symlink(f"{sf_dir}/events.parquet", f"{folder}/events.parquet")
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(folder)


def test_alert_stream_equals_batch(spark, small):
    out = rain.drain(rain.alert_states(_stream(spark, small), "user_id", "ts", "value", 70.0), tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    from freshet.operators.platform import alert_transitions

    batch = alert_transitions(spark.read.parquet(f"{small}/events.parquet"), "user_id", "ts", F.col("value") > 70)
    assert sorted((r.key, r.at, r.transition) for r in out.collect()) == sorted((r.user_id, r.ts, r.transition) for r in batch.collect())


def test_window_sum_stream_is_within_batch(spark, small):
    sums = rain.window_sums(_stream(spark, small), "ts", ["event_type"], "value")
    out = {(r.event_type, r.start): r.n for r in rain.drain(sums, tempfile.mkdtemp(prefix="spark-", dir="/tmp")).collect()}
    batch = spark.read.parquet(f"{small}/events.parquet").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "6 hours").start.alias("start")).count()
    want = {(r.event_type, r.start): r["count"] for r in batch.collect()}
    assert out and all(want[k] == n for k, n in out.items()) and len(out) >= len(want) - 10


def test_window_sums_round_times_as_their_sql(spark):
    """Readings less than, at and more than half a second before an edge, and a last reading just before, at and after the one that closes a window."""
    import datetime as dt

    import duckdb

    from freshet.plans import streams
    from freshet.plans.registry import SQL

    edge = dt.datetime(2024, 1, 1, 6)
    at = lambda ms: edge + dt.timedelta(milliseconds=ms)
    for last in (3_599_400, 3_599_500, 3_599_999, 3_600_000, 3_600_001, 40_000_000):
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        rows = [(i, at(ms), "click", 2.0**i) for i, ms in enumerate((-9000, -501, -500, -499, -1, 0, 1, 499, 500, 21_599_499, 21_599_500, 21_599_501))] + [(99, at(last), "view", 1.0)]
        rows = [r for r in rows if r[1] <= at(last)]
        con = duckdb.connect()
        con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, event_type VARCHAR, value DOUBLE)")
        con.executemany("INSERT INTO events VALUES (?, ?, ?, ?)", rows)
        con.execute(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
        got = sorted(tuple(r) for r in streams.streamed_window_sums(spark, folder).collect())
        assert got == sorted(con.execute(SQL["streamed_window_sums"]).fetchall()), last


def test_a_spine_of_a_stray_date_fails(spark):
    import pytest

    from freshet.operators import temporal

    rows = spark.createDataFrame([("a", 5, 1.0), ("a", 8, 2.0), ("b", None, 1.0)], "k string, h long, v double")
    assert sorted((r.h, r.v) for r in temporal.hour_spine(rows, "k", "h", "v").collect()) == [(5, 1.0), (6, None), (7, None), (8, 2.0)]
    with pytest.raises(Exception, match="too many hours"):
        temporal.hour_spine(rows.union(spark.createDataFrame([("a", 10**7, 1.0)], rows.schema)), "k", "h", "v").collect()


def test_bootstrap_against_plain_weights(spark):
    """The Poisson weights of each draw, recomputed from the hashes."""
    import numpy as np

    from freshet.operators import metrics

    events = spark.range(40).select(F.col("id").alias("k"), ((F.col("id") * 7919 % 100) / 100).alias("v"))
    hashes = {(r.draw, r.k): r.h for r in events.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(30)))).select("draw", "k", F.xxhash64("draw", "k").alias("h")).collect()}
    steps, total, term = [], 0.0, np.exp(-1.0)
    for n in range(1, 9):
        total += term
        steps.append(total)
        term /= n
    values = {r.k: r.v for r in events.collect()}
    means = []
    for draw in range(1, 31):
        w = {k: sum(s <= (hashes[draw, k] % 2**53) / 2**53 for s in steps) for k in values}
        means.append(sum(w[k] * values[k] for k in values) / sum(w.values()))
    got = metrics.bootstrap(events, "k", "v", 30).first()
    assert got.n_events == 40 and abs(got["mean"] - np.mean(list(values.values()))) < 1e-12
    assert np.allclose((got.low, got.high), np.quantile(means, [0.025, 0.975]))


def test_reachability_with_cycles(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (5, 6)], "src int, dst int")
    assert sorted(map(tuple, graph.frontier(edges, 0).collect())) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert sorted(map(tuple, graph.frontier(edges, 0, 2).collect())) == [(0, 0), (1, 1), (2, 2)]


def test_greedy_spacing_against_a_loop(spark, small):
    by_user = {}
    for r in sorted(spark.read.parquet(f"{small}/events.parquet").collect(), key=lambda r: r.ts):
        kept = by_user.setdefault(r.user_id, [])
        if not kept or (r.ts - kept[-1]).total_seconds() >= 86400:
            kept.append(r.ts)
    assert {r.user_id: r.n_kept for r in ordered.greedy_spacing(spark, small).collect()} == {u: len(k) for u, k in by_user.items()}


def test_bootstrap_brackets_the_mean(spark, sf_dir):
    r = scores.bootstrap_ci(spark, sf_dir).first()
    assert r.low <= r.mean <= r.high and r.low < r.high and r.n_events > 5

"""Alerts, token buckets, alignment, upserts and checked lines: batch, stream and plain versions agree."""

import datetime as dt
import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from freshet.operators import alerts, alignment, buckets
from freshet.sources import json_lines
from freshet.streaming import keyed, upsert

EPOCH = dt.datetime(2024, 1, 1)
SEC = lambda s: EPOCH + dt.timedelta(seconds=s)


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def arriving(spark, batches, schema, name):
    """A stream that takes one file, so one micro-batch, of ``batches`` at a time."""
    path = folder()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in"), path


def drained(stream, path):
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start(f"{path}/rows")
    q.awaitTermination()
    return [tuple(r) for r in stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows").collect()]


def test_all_operators_and_statuses(spark):
    rows = [(v, op) for v in (39.0, 40.0, 41.0, None, float("nan")) for op in ("gt", "gte", "lt", "lte", "eq", "ne", None)]
    df = spark.createDataFrame(rows, "v double, op string")
    verdicts = {"gt": lambda v: v > 40, "gte": lambda v: v >= 40, "lt": lambda v: v < 40, "lte": lambda v: v <= 40, "eq": lambda v: v == 40}
    for r in df.select("v", "op", alerts.compares(F.col("v"), F.col("op"), F.lit(40.0)).alias("m")).collect():
        assert r.m == (verdicts[r.op](r.v) if r.op in verdicts and r.v is not None and r.v == r.v else None)
    status = lambda *a: spark.range(1).select(alerts.condition(*[F.lit(x).cast("boolean") for x in a])).first()[0]
    assert [status(*a) for a in ((False, True, False), (None, True, False), (True, None, True), (True, False, True), (True, True, True), (True, True, None))] == ["UNAVAILABLE", "UNAVAILABLE", "ERROR", "CURRENTLY_FALSE", "STALE", "CURRENTLY_TRUE"]


def plain_states(rows):
    state, out = {}, []
    for k, at, i, status in sorted(rows, key=lambda r: r[:3]):
        state[k], moved = alerts.next_state(state.get(k, "ARMED"), status)
        out.append((k, i, state[k], moved))
    return sorted(out)


def test_lifecycle_over_many_ranges(spark, many_ranges):
    rng = random.Random(1)
    kinds = [alerts.TRUE, alerts.STALE, alerts.UNAVAILABLE, alerts.ERROR, alerts.ACK]
    rows = [(1, i, i, rng.choices([*kinds, alerts.FALSE], [5, 2, 2, 2, 4, 0.2])[0]) for i in range(600)]  # one key over all ranges
    rows += [(2, i, i, rng.choice([alerts.STALE, alerts.TRUE, alerts.UNAVAILABLE])) for i in range(200)] + [(3, i, i, alerts.ACK) for i in range(50)]
    rows += [(k, i, i, rng.choice([*kinds, alerts.FALSE])) for k in range(10, 60) for i in range(rng.randint(1, 9))]
    df = spark.createDataFrame([*rows, (None, 1, 1, alerts.TRUE)], "key long, at long, id long, status string")
    got = alerts.lifecycle(df, "key", ["at", "id"], "status")
    assert sorted(tuple(r) for r in got.select("key", "id", "state", "transition").collect()) == plain_states(rows)
    assert {"TRIGGERED->RESET->ARMED", "ACKNOWLEDGED->RESET->ARMED", "TRIGGERED->ACKNOWLEDGED", "ARMED->TRIGGERED", None} == {r.transition for r in got.collect()}
    assert alerts.lifecycle(df.limit(0), "key", ["at", "id"], "status").count() == 0


def plain_tokens(rows, bucket):
    state, out = {}, []
    for k, at, i, cost in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        us = (at - EPOCH) // dt.timedelta(microseconds=1)
        tokens, last = state.get(k, (bucket.capacity, us))
        ok, tokens = bucket.take(tokens, last, us, cost)
        state[k] = (tokens, us)
        out.append((k, i, ok, round(tokens, 9)))
    return sorted(out)


@pytest.fixture(scope="module")
def requests():
    rng = random.Random(5)
    rows = [(k, SEC(rng.randrange(0, 4000) + rng.random()), i, float(rng.choice([0, 1, 1, 2, 9]))) for i, k in enumerate([1] * 300 + [2] * 60 + list(range(3, 40)))]
    return rows + [(50, SEC(5), 900, 1.0), (50, SEC(5), 901, 1.0), (50, SEC(5), 902, 1.0), (50, SEC(5 + 40), 903, 4.0)]


BUCKET = buckets.Bucket(4.0, 0.1)


def test_token_bucket_batch_and_stream_agree(spark, requests):
    schema = "k long, at timestamp, id long, cost double"
    want = plain_tokens(requests, BUCKET)
    df = spark.createDataFrame(requests, schema)
    odd = df.union(spark.createDataFrame([(None, SEC(1), 950, 1.0), (1, None, 951, 1.0), (1, SEC(1), 952, None)], schema))
    got = [tuple(r) for r in buckets.admitted(odd, BUCKET, "k", "at", "id", "cost").collect()]
    assert sorted((k, i, ok, round(t, 9)) for k, i, ok, t in got if i < 950) == want
    assert sorted((i, ok, t) for _, i, ok, t in got if i >= 950) == [(950, False, None), (951, False, None), (952, False, None)]
    ordered = sorted(requests, key=lambda r: (r[1], r[2]))
    stream, path = arriving(spark, [ordered[i : i + 150] for i in range(0, len(ordered), 150)], schema, "requests")
    seen = drained(keyed.token_bucket(stream, BUCKET, "k", "at", "id", "cost"), path)
    assert sorted((k, i, ok, round(t, 9)) for k, i, ok, t in seen) == want


def test_alert_stream_with_late_rows_and_timers(spark):
    schema = "k long, at timestamp, id long, status string"
    batches = [
        [(1, SEC(0), 1, alerts.TRUE), (1, SEC(10), 2, alerts.TRUE), (2, SEC(0), 3, alerts.FALSE)],
        [(1, SEC(20), 4, alerts.ACK), (1, SEC(5), 5, alerts.FALSE)],  # the second is late
        [(2, SEC(2000), 6, alerts.TRUE)],  # far on: the first key has gone stale
        [(1, SEC(2010), 7, alerts.FALSE), (1, SEC(2020), 8, alerts.TRUE)],
    ]
    stream, path = arriving(spark, batches, schema, "alerts")
    got = drained(keyed.alert_lifecycle(stream, "k", "at", "id", "status", stale_after=300), path)
    moved = sorted((k, at, s) for k, at, _, _, s in got if s)
    assert moved == [(1, SEC(0), "ARMED->TRIGGERED"), (1, SEC(20), "TRIGGERED->ACKNOWLEDGED"), (1, SEC(2010), "ACKNOWLEDGED->RESET->ARMED"), (1, SEC(2020), "ARMED->TRIGGERED"), (2, SEC(2000), "ARMED->TRIGGERED")]
    assert (1, SEC(320), alerts.STALE, "ACKNOWLEDGED", None) in got and (2, SEC(300), alerts.STALE, "ARMED", None) in got
    assert not [r for r in got if r[1] == SEC(5)]


def test_alignment_is_transitive_and_takes_the_primary_id(spark):
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    rows = [
        ("a", "e3", day(0), day(10), None), ("a", "e1", day(12), day(20), None), ("a", "e2", day(22), None, "p9"), ("a", "e4", day(26), day(24), "p7"),  # one after another, the last reversed
        ("a", "e5", day(60), day(61), None), ("a", "e6", day(61), day(61), None), ("a", "e7", None, day(3), "p1"), ("b", "e8", day(5), day(5), None), (None, "e9", day(5), day(5), None),
        ("c", "f1", day(0), day(90), None), ("c", "f2", day(1), day(2), None), ("c", "f3", day(80), day(81), "p3"), ("c", "f4", day(93), day(93), None),
    ]
    df = spark.createDataFrame(rows, "region string, event string, s date, e date, m string")
    got = {r.event: (r.entity, r.matched, r.independent, r.n_reports) for r in alignment.align(df, ["region"], "event", "s", "e", "m", pad_days=2).collect()}
    assert {got[e] for e in ("e1", "e2", "e3", "e4")} == {("p7", "p7", False, 4)}
    assert got["e5"] == got["e6"] == ("e5", None, True, 2) and got["e7"] == ("p1", "p1", False, 1)
    assert got["e8"] == ("e8", None, True, 1) and got["e9"] == ("e9", None, True, 1)
    assert {got[e] for e in ("f1", "f2", "f3")} == {("p3", "p3", False, 3)} and got["f4"] == ("f4", None, True, 1)


def test_upserts_keep_the_last_version_and_survive_replays(spark):
    path = folder()
    table = upsert.UpsertTable(spark, f"file://{path}/t", "id long, v long, x string", ["id"], "v")
    batch = lambda *rows: spark.createDataFrame(list(rows), "id long, v long, x string")
    state = lambda: sorted(map(tuple, table.read().collect()), key=str)
    assert state() == []
    first = batch((1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "a"), (3, None, "n"))
    table.merge(first, 0)
    assert state() == [(1, 3, "c"), (2, 1, "a"), (3, None, "n")]
    table.merge(batch((1, 2, "late"), (2, 1, "same version, later batch"), (3, 0, "known")), 1)
    second = [(1, 3, "c"), (2, 1, "same version, later batch"), (3, 0, "known")]
    assert state() == second
    table.merge(first, 0)  # a replay
    assert state() == second
    table.compact()
    table.merge(first, 0)  # a replay of what the base holds
    table.compact()
    assert state() == second
    table.merge(batch((4, 1, "new"), (1, 4, "d")), 2)
    assert state() == [(1, 4, "d"), *second[1:], (4, 1, "new")]
    spark.createDataFrame([(9, 9, "cut short")], "id long, v long, x string").withColumn("__batch", F.lit(3)).write.parquet(f"{path}/t/changes/batch=3")
    import os

    os.remove(f"{path}/t/changes/batch=3/_SUCCESS")
    assert (9, 9, "cut short") not in state()


def test_upserts_from_a_stream(spark):
    schema = "id long, v long, x string"
    stream, path = arriving(spark, [[(1, 1, "a"), (2, 5, "b")], [(1, 2, "c"), (2, 4, "late")]], schema, "upserts")
    table = upsert.UpsertTable(spark, f"file://{path}/t", schema, ["id"], "v")
    for _ in range(2):  # the second run finds nothing new
        upsert.upserts(stream, table, f"{path}/checkpoint")
        assert sorted(map(tuple, table.read().collect())) == [(1, 2, "c"), (2, 5, "b")]


def test_late_rows_and_repeats_are_dropped(spark):
    schema = "id long, at timestamp"
    batches = [[(1, SEC(0)), (1, SEC(0)), (2, SEC(100))], [(1, SEC(0)), (3, SEC(9000))], [(3, SEC(9100))], [(4, SEC(10)), (5, SEC(8990))]]
    stream, path = arriving(spark, batches, schema, "late")
    assert sorted(r[0] for r in drained(upsert.in_time(stream, "at", ["id"]), path)) == [1, 2, 3, 5]


def test_json_lines_with_reasons_and_back(spark):
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

    schema = StructType().add("city", StringType()).add("n", LongType()).add("rain", ArrayType(DoubleType())).add("split", StringType())
    lines = {
        '{"city": "x", "n": 1, "rain": [1.5, null], "split": "train"}': None, '{"city": "y", "n": 2, "extra": {}, "split": "test"}': None, '{"city": "z", "n": null}': "missing:n", "{": "not_json", "[1]": "not_an_object", "7": "not_an_object", '"t"': "not_an_object",
        '{"n": "3", "city": "x"}': "type:n", '{"n": 3.5}': "type:n,missing:city", '{"city": "x", "n": 1, "rain": [1, "a"]}': "type:rain", '{"city": "x", "n": 1, "rain": 5}': "type:rain", "null": "not_an_object", "not json at all": "not_json", '{"city": "x", "n": 1}}': "not_json", '{"city": "x", "n": 1} {"n": 2}': "not_json", '{"city": "x", "n": 1}, {"n": 2}': "not_json",
    }
    path = folder()
    with open(f"{path}/in.jsonl", "w") as f:
        f.write("\n\n".join(lines) + "\n   \n")
    got = json_lines.read(spark, f"{path}/in.jsonl", schema, ["city", "n"])
    assert {r.line: r.reason for r in got.where("reason IS NOT NULL").collect()} == {k: v for k, v in lines.items() if v}
    good = got.where("reason IS NULL").drop("reason", "line")
    assert sorted((r.city, r.n, r.rain, r.split) for r in good.collect()) == [("x", 1, [1.5, None], "train"), ("y", 2, None, "test")]
    meta = json_lines.write(good, f"{path}/out", "v1", "city", "split").collect()
    assert json.loads(json.dumps(meta[0].asDict(True))) == {"dataset_version": "v1", "n": 2, "format": "jsonl", "places": ["x", "y"], "splits": {"train": 1, "val": 0, "test": 1}}
    again = json_lines.read(spark, f"{path}/out/rows", schema, ["city", "n"])
    assert sorted(map(str, again.drop("reason", "line").collect())) == sorted(map(str, good.collect())) and again.where("reason IS NOT NULL").count() == 0

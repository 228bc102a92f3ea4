"""Keyed state: token buckets and the alert life cycle as rows arrive, with timers for readings that stay away."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from freshet.operators.alerts import STALE, next_state
from freshet.operators.buckets import Bucket

#: The state store that ``transformWithState`` needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _store(stream: DataFrame) -> None:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _sorted(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """A key's rows of one micro-batch, in order; the trigger bounds a batch."""
    return pd.concat(list(rows)).sort_values(list(by), kind="stable")


class _Buckets(StatefulProcessor):
    def __init__(self, bucket: Bucket):
        self.bucket = bucket

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("bucket", StructType().add("tokens", DoubleType()).add("updated", LongType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tokens, updated = self.kept.get() if self.kept.exists() else (self.bucket.capacity, None)
        out = []
        for r in _sorted(rows, "at", "id").itertuples():
            ok, tokens = self.bucket.take(tokens, r.at if updated is None else updated, r.at, r.cost)
            updated = r.at
            out.append((key[0], r.id, ok, tokens))
        self.kept.update((float(tokens), int(updated)))
        yield pd.DataFrame(out, columns=["key", "id", "allowed", "tokens"])

    def close(self) -> None:
        pass


def token_bucket(stream: DataFrame, bucket: Bucket, key: str, at: str, request: str, cost: str) -> DataFrame:
    """(key, id, allowed, tokens) as requests arrive; the same as ``buckets.admitted`` of all of them if batches come in order.

    A request that is earlier than the last one refills nothing; one without
    key, time or cost is left out.
    """
    _store(stream)
    rows = stream.select(F.col(key).cast("long").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(request).cast("long").alias("id"), F.col(cost).cast("double").alias("cost"))
    known = rows.where("key IS NOT NULL AND at IS NOT NULL AND cost IS NOT NULL")
    return known.groupBy("key").transformWithStateInPandas(_Buckets(bucket), "key long, id long, allowed boolean, tokens double", "Append", "None")


class _Alerts(StatefulProcessor):
    """``at`` of an update is the moment it is for: that of a reading, or when one became stale."""

    def __init__(self, stale_after_ms: int):
        self.stale_after_ms = stale_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("alert", StructType().add("state", StringType()).add("last", LongType()).add("timer", LongType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, last, timer = self.kept.get() if self.kept.exists() else ("ARMED", -1, -1)
        due, out = timer, []
        for r in _sorted(rows, "at", "id").itertuples():
            if r.at.value <= last:  # late: it changes nothing and fires no closed alert again
                continue
            if 0 <= due < r.at.value // 1_000_000:  # the silence before this row, if its timer has not told of it
                out.append((key[0], pd.Timestamp(due, unit="ms"), STALE, state, None))
            last, due = r.at.value, r.at.value // 1_000_000 + self.stale_after_ms
            state, moved = next_state(state, r.status)
            out.append((key[0], r.at, r.status, state, moved))
        if due != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.kept.update((state, int(last), int(due)))
        yield pd.DataFrame(out, columns=["key", "at", "status", "state", "transition"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, last, _ = self.kept.get()
        self.kept.update((state, last, -1))
        when = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame([(key[0], when, STALE, state, None)], columns=["key", "at", "status", "state", "transition"])

    def close(self) -> None:
        pass


def alert_lifecycle(stream: DataFrame, key: str, at: str, event: str, status: str, stale_after: float, late: str = "1 minute") -> DataFrame:
    """(key, at, status, state, transition) of each reading or acknowledgement as it arrives, and a STALE row that holds the state when none has come for ``stale_after`` seconds.

    The clock is the watermark, ``late`` behind the latest row. A row no later
    than the key's last one changes nothing.
    """
    _store(stream)
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(event).cast("long").alias("id"), F.col(status).alias("status"))
    timed = rows.where("key IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    schema = "key long, at timestamp, status string, state string, transition string"
    return timed.groupBy("key").transformWithStateInPandas(_Alerts(int(stale_after * 1000)), schema, "Append", "EventTime")

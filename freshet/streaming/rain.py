"""Streams: watermarked window sums and alert states over arriving readings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_sums(stream: DataFrame, at: str, keys: list[str], value: str, width: str = "6 hours", late: str = "1 hour", starts: str = "0 seconds") -> DataFrame:
    """Sums by key and tumbling window; rows later than ``late`` behind the watermark are left out, repeats of a row within it count once. ``starts`` moves all window edges."""
    rows = stream.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return rows.groupBy(*keys, F.window("__at", width, width, starts).alias("w")).agg(F.round(F.sum(value), 6).alias("total"), F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), "total", "n")


def alert_states(stream: DataFrame, key: str, at: str, value: str, threshold: float) -> DataFrame:
    """(key, at, transition) as readings arrive. A reading no later than the last one is late: it changes nothing and fires no closed alert again."""
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(value).cast("double").alias("value"))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        on, last = state.get if state.exists else (False, -1)
        got = pd.concat(list(batches)).sort_values("at")
        out = []
        for when, x in zip(got["at"], got["value"], strict=True):
            if pd.isna(x) or pd.isna(when) or when.value <= last:
                continue
            last = when.value
            if (x > threshold) != on:
                on = not on
                out.append((key[0], when, "TRIGGERED" if on else "RESET"))
        state.update((bool(on), int(last)))
        yield pd.DataFrame(out, columns=["key", "at", "transition"])

    return rows.groupBy("key").applyInPandasWithState(update, "key long, at timestamp, transition string", "on boolean, last long", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what has arrived, into Parquet under ``path``, and reads it back."""
    started = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start(f"{path}/rows")
    started.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")

"""Token buckets: continuous refill up to a capacity, one decision a request."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Bucket(NamedTuple):
    capacity: float
    per_second: float

    @property
    def full_after_us(self) -> int:
        """Microseconds in which an empty bucket fills."""
        return math.ceil(self.capacity / self.per_second * 1e6)

    def take(self, tokens: float, updated: int, at: int, cost: float) -> tuple[bool, float]:
        """(allowed, tokens left) of a request at ``at``; times in microseconds, an earlier one than the last refills nothing."""
        tokens = min(self.capacity, tokens + max(0, at - updated) / 1e6 * self.per_second)
        return (True, tokens - cost) if tokens >= cost else (False, tokens)


def admitted(requests: DataFrame, bucket: Bucket, key: str, at: str, request: str, cost: str) -> DataFrame:
    """(key, request, allowed, tokens): each request's verdict and the tokens left, in order of time, then request id.

    A key's requests fall apart where none comes for as long as the bucket
    takes to fill: what follows starts full, whatever came before. Such breaks
    are found over the key's distinct spans of that length, and each stretch
    between two is folded on its own, in a stream that holds one number. A
    request without key, time or cost is not allowed and takes nothing.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = requests.select(F.col(key).alias("k"), micros.alias("at"), F.col(request).alias("id"), F.col(cost).cast("double").alias("cost"))
    known = F.col("k").isNotNull() & F.col("at").isNotNull() & F.col("cost").isNotNull()
    timed = rows.where(known).withColumn("span", F.floor(F.col("at") / bucket.full_after_us))
    spans = timed.select("k", "span").distinct()
    stretches = spans.withColumn("stretch", F.col("span") - F.row_number().over(Window.partitionBy("k").orderBy("span")))
    ordered = timed.join(stretches, ["k", "span"]).repartition("k", "stretch").sortWithinPartitions("k", "stretch", "at", "id")
    kinds = {name: rows.schema[name].dataType.simpleString() for name in ("k", "id")}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tokens, updated = None, bucket.capacity, 0
        for b in batches:
            allowed, left = [], []
            for k, stretch, when, cost in zip(*(b.column(c).to_pylist() for c in ("k", "stretch", "at", "cost")), strict=True):
                if (k, stretch) != now:
                    now, tokens, updated = (k, stretch), bucket.capacity, when
                ok, tokens = bucket.take(tokens, updated, when, cost)
                updated = when
                allowed.append(ok)
                left.append(tokens)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("id"), pa.array(allowed, pa.bool_()), pa.array(left, pa.float64())], ["k", "id", "allowed", "tokens"])

    judged = ordered.select("k", "stretch", "at", "id", "cost").mapInArrow(fold, f"k {kinds['k']}, id {kinds['id']}, allowed boolean, tokens double")
    refused = rows.where(~known).select("k", "id", F.lit(False).alias("allowed"), F.lit(None).cast("double").alias("tokens"))
    return judged.unionByName(refused).select(F.col("k").alias(key), F.col("id").alias(request), "allowed", "tokens")

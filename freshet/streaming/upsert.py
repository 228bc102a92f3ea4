"""An idempotent upsert sink: each micro-batch is a change set of its own, the last version of a key wins, a replay changes nothing.

A batch costs what it holds, not what the table holds: it is written as
``changes/batch=N`` (a replay of N overwrites its own folder), and a reader
takes the last version of each key over the base and all changes since.
``compact`` folds the changes so far into a new base. A row that arrives late,
with an older version than its key has, never wins; of equal versions the later
batch wins (the last insert), within a batch the greatest row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def last_versions(rows: DataFrame, keys: Sequence[str], version: str, batch: str = "__batch") -> DataFrame:
    """One row a key: the greatest by (version, batch, the row itself); pre-aggregated, so a hot key costs no more. A null key is a key, a null version the least."""
    values = [c for c in rows.columns if c != batch and c not in keys]
    rank = F.struct(F.col(version).isNotNull(), F.col(version), F.col(batch), F.struct(*values))
    best = F.max(F.struct(rank.alias("rank"), F.struct(batch, *values).alias("row"))).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, "best.row.*")


class UpsertTable:
    """A table of last versions under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], version: str):
        self.spark, self.path, self.schema, self.keys, self.version = spark, path.rstrip("/"), schema, list(keys), version

    def _done(self, kind: str) -> list[int]:
        """The numbers of the written folders of a kind; one that was cut short has no _SUCCESS and does not count."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        files = top.getFileSystem(conf)
        if not files.exists(top):
            return []
        found = [s.getPath() for s in files.listStatus(top)]
        return sorted(int(p.getName().partition("=")[2]) for p in found if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def merge(self, batch: DataFrame, number: int) -> None:
        """Writes micro-batch ``number``, for foreachBatch; one that is in the base already is left alone."""
        if number <= max(self._done("base"), default=-1):
            return
        own = last_versions(batch.withColumn("__batch", F.lit(number).cast("long")), self.keys, self.version)
        own.write.mode("overwrite").parquet(f"{self.path}/changes/batch={number}")

    def _rows(self) -> tuple[DataFrame, int]:
        base = max(self._done("base"), default=-1)
        parts = [f"{self.path}/base/upto={base}"] if base >= 0 else []
        newer = [n for n in self._done("changes") if n > base]
        parts += [f"{self.path}/changes/batch={n}" for n in newer]
        full = f"{self.schema}, __batch long"
        tables = [self.spark.read.schema(full).parquet(*parts)] if parts else [self.spark.createDataFrame([], full)]
        return reduce(DataFrame.unionByName, tables), max([base, *newer])

    def read(self) -> DataFrame:
        """The last version of each key."""
        return last_versions(self._rows()[0], self.keys, self.version).drop("__batch")

    def compact(self) -> None:
        """Folds all changes so far into a new base; readers of the old one are not disturbed."""
        rows, upto = self._rows()
        if upto >= 0 and upto not in self._done("base"):
            last_versions(rows, self.keys, self.version).write.mode("overwrite").parquet(f"{self.path}/base/upto={upto}")


def in_time(stream: DataFrame, at: str, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """``stream`` without repeats of a key within ``late`` of each other, and without rows later than that behind the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def upserts(stream: DataFrame, table: UpsertTable, checkpoint: str, before: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> None:
    """Merges all that has arrived in ``stream`` into ``table``; ``before`` shapes a batch."""
    started = stream.writeStream.foreachBatch(lambda batch, number: table.merge(before(batch), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()

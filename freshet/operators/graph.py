"""Edge lists: breadth-first reachability, one join and one written table a step, and connected components by contraction."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session may go without the setting, and then gets one of its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="freshet-"))
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As ``cut``, but a table of columns, packed, whose shuffle files go when it is written."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}", spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def remove(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` returned; nothing may read them any more."""
    for table in tables:
        jvm, context = table.sparkSession._jvm, table.sparkSession.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(table.written_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def frontier(edges: DataFrame, start: int, most: int | None = None) -> DataFrame:
    """(node, depth) of the nodes that ``start`` reaches, within ``most`` steps if given; each step drops the nodes that were seen, so cycles end.

    Each step writes only the nodes that it adds.
    """
    levels = [edges.sparkSession.createDataFrame([(start, 0)], "node int, depth int")]
    while most is None or len(levels) <= most:
        found = levels[-1].join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, levels).select("node")
        fresh = cut(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(len(levels))))
        if fresh.isEmpty():
            break
        levels.append(fresh)
    return reduce(DataFrame.unionByName, levels)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of rows (a, b), the ends of undirected edges: each node's label is the least node of its component.

    A round points every node to its least neighbour, or itself, jumps the
    pointers to their ends by doubling, and contracts the edges to these. A
    chain of any length takes a logarithmic number of steps; a hub is a task's
    rows only where the join cannot be split, and AQE splits it. Nodes may be
    of any type that can be ordered; loops only name their node.
    """
    each = edges.select("a", "b").union(edges.select("b", "a"))
    live, labels = cut(each.distinct()), None
    while labels is None or not live.isEmpty():
        up = cut(live.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up")))
        while True:
            higher = up.where("node != up").select(F.col("node").alias("up"), F.col("up").alias("higher"))
            jumped = cut(up.join(higher, "up", "left").select("node", F.coalesce("higher", "up").alias("up"), F.col("higher").isNotNull().alias("moved")))
            up = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = up.withColumnRenamed("up", "label")
        else:
            labels = cut(labels.join(up.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("up", "label").alias("label")))
        ends = live.where("a != b").join(up.select(F.col("node").alias("a"), F.col("up").alias("to_a")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("to_b")), "b")
        live = cut(ends.where("to_a != to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct())
    return labels

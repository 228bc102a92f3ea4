"""What the operators of this subpackage share: table reads, scratch tables, text expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: \x20 and \x09-\x0D.
BLANKS = "\t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session may go without the setting; it then gets a folder of its own.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="freshet-"))
    return context.getCheckpointDir()


#: Spark's settings while a table is written: shuffle files go when the query has ended, and whole texts cross into
#: Python a thousand rows at a time, so that a task's Arrow buffers stay small beside the heap.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, fixes the rows for every later read, and survives
    the loss of executors. Its shuffle files go when it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``scratch`` returned; nothing may read them any more."""
    for table in tables:
        jvm, context = table.sparkSession._jvm, table.sparkSession.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def bounded_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows, one for each of the least values of ``key``, a column of evenly spread longs.

    About twice as many are drawn by a threshold first, so that no task sorts
    or takes in more; rows that share a key cannot crowd out the others.
    """
    distinct = rows.agg(F.approx_count_distinct(key)).first()[0]
    share = min(1.0, 2.0 * n / max(1, distinct))
    if share < 1:
        rows = rows.where(F.col(key) < int((2 * share - 1) * (1 << 63)))
    return rows.dropDuplicates([key]).orderBy(key).limit(n)


def hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """The keys that hold more than a thousandth of ``rows`` (a written table), a thousand at most, to be broadcast; None if there are none."""
    hot = rows.groupBy(key).count().where(F.col("count") * 1000 > rows.count()).select(key)
    found = hot.collect()
    return F.broadcast(rows.sparkSession.createDataFrame(found, hot.schema)) if found else None


def hottest(counts: DataFrame, keys: str | Sequence[str], n: str = "c") -> DataFrame | None:
    """As ``hot_keys``, from a written table of keys and their numbers of rows."""
    total = counts.agg(F.sum(n)).first()[0]
    hot = counts.where(F.col(n) * 1000 > total).select(*([keys] if isinstance(keys, str) else keys)) if total else None
    found = hot.collect() if total else []
    return F.broadcast(counts.sparkSession.createDataFrame(found, hot.schema)) if found else None


def join_hot(rows: DataFrame, few: DataFrame, key: str | Sequence[str], hot: DataFrame | None, more: Sequence[str] = ()) -> DataFrame:
    """The inner join of ``rows`` and ``few`` on ``key`` and the columns in ``more``; the ``hot_keys`` of ``rows`` are broadcast, so that no task gets all rows of one.

    ``few`` has one row for each of these, and few for one key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    on = [*keys, *more]
    if hot is None:
        return rows.join(few, on)
    return rows.join(F.broadcast(few.join(hot, keys)), on).unionByName(rows.join(hot, keys, "left_anti").join(few, on))


#: Most rows that are broadcast one by one; a filter, of bits, takes eight times as many.
FILTER_ROWS = 2_000_000

#: A filter's row has so many bits, and a key sets this many of them; all rows together have FILTER_BITS at most, 8 MB.
ROW_BITS, PROBES, FILTER_BITS = 1 << 15, 3, 1 << 26


def bit_filter(wanted: DataFrame, key: Column, n: int) -> tuple[DataFrame, int]:
    """A written table (__filter_row, __filter_words) with the bits that the values of ``key``, ``n`` evenly spread longs, set, and its number of rows.

    A key has 16 to 32 bits, fewer where FILTER_BITS is reached: the driver holds no row for a key.
    """
    rows = max(1, min(FILTER_BITS, 1 << max(0, 16 * n - 1).bit_length()) // ROW_BITS)
    key = key.alias("__key")
    places = F.array(*[place_in_row(F.col("__key"), i) for i in range(PROBES)])
    row_words = ROW_BITS // 64
    ones = wanted.select(key).where("__key IS NOT NULL").select(row_of(F.col("__key"), rows).alias("__filter_row"), F.explode(places).alias("p"))
    ones = ones.select("__filter_row", F.shiftrightunsigned("p", 6).alias("w"), F.expr("shiftleft(1L, p & 63)").alias("bits"))
    none = wanted.sparkSession.range(rows * row_words).select(F.expr(f"id DIV {row_words}").alias("__filter_row"), F.expr(f"int(id % {row_words})").alias("w"), F.lit(0).cast("long").alias("bits"))
    words = ones.union(none).groupBy("__filter_row", "w").agg(F.bit_or("bits").alias("bits"))
    packed = words.groupBy("__filter_row").agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("__filter_words"))
    return scratch(packed, "filter"), rows


def row_of(key: Column, rows: int) -> Column:
    """The row of a filter that holds the bits of ``key``; ``rows`` is a power of two."""
    return F.shiftrightunsigned(key, 15 * PROBES).bitwiseAND(F.lit(rows - 1).cast("long"))


def place_in_row(key: Column, i: int) -> Column:
    """The ``i``-th bit of ``key`` in its row."""
    return F.shiftrightunsigned(key, 15 * i).bitwiseAND(F.lit(ROW_BITS - 1).cast("long")).cast("int")


def may_hold(key: Column, rows: int) -> Column:
    """The condition of a join with a filter of ``rows`` rows: all bits of ``key`` are set."""
    held = F.col("__filter_row") == row_of(key, rows)
    for i in range(PROBES):
        place = place_in_row(key, i)
        held = held & (F.getbit(F.get("__filter_words", F.shiftrightunsigned(place, 6)), place.bitwiseAND(F.lit(63))) == 1)
    return held


def bits_of(filter_: DataFrame) -> np.ndarray:
    """The words of a filter, for ``held_in``."""
    found = filter_.toArrow().sort_by("__filter_row")["__filter_words"]
    return np.concatenate([c.flatten().to_numpy() for c in found.chunks]).view("<u8")


def held_in(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``keys`` (64 bits each) have all their bits set."""
    keys, row_words = keys.view("<u8"), ROW_BITS // 64
    rows, held = len(words) // row_words, np.ones(len(keys), dtype=bool)
    at = ((keys >> np.uint64(15 * PROBES)) & np.uint64(rows - 1)) * np.uint64(row_words)
    for i in range(PROBES):
        place = (keys >> np.uint64(15 * i)) & np.uint64(ROW_BITS - 1)
        held &= (words[at + (place >> np.uint64(6))] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return held


def only_near(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """``rows`` without most that cannot join ``wanted`` (a written table): a filter on the bits of hashes ahead of a join.

    It is broadcast only up to eight times FILTER_ROWS rows; beyond that the
    rows pass as they are and the join alone decides. Nothing that joins is
    lost; of the others one in a hundred or so passes. The keys are hashes.
    """
    n = wanted.count()
    if n > 8 * FILTER_ROWS:
        return rows
    bits, size = bit_filter(wanted, wanted_key, n)
    return rows.withColumn("__h", key).join(F.broadcast(bits), may_hold(F.col("__h"), size), "left_semi").drop("__h")


def join_few(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """The left join of ``rows`` and ``few`` (a written table) on ``key``; most rows that cannot join are not shuffled.

    The filter is broadcast only up to eight times FILTER_ROWS rows of
    ``few``; beyond that it is an ordinary join.
    """
    n = few.count()
    if n > 8 * FILTER_ROWS:
        return rows.join(few, key, "left")
    bits, size = bit_filter(few, F.xxhash64(key), n)
    hashed, held = rows.withColumn("__h", F.xxhash64(key)), may_hold(F.col("__h"), size)
    may = hashed.join(F.broadcast(bits), held, "left_semi").drop("__h").join(few, key, "left")
    rest = hashed.join(F.broadcast(bits), held, "left_anti").drop("__h")
    return may.unionByName(rest, allowMissingColumns=True)


def blanked(text: Column, blanks: str = BLANKS) -> Column:
    """The text with each of ``blanks`` as a space; null as the empty text."""
    out = F.coalesce(text, F.lit(""))
    for c in blanks:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space, in order; null text has none."""
    return F.array_remove(F.split(blanked(text), " "), "")


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 4; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % 4


def held_out(key: Column) -> Column:
    """Whether a row is in the held-out fold; rows without a key are not."""
    return F.coalesce(fold(key) == 2, F.lit(False))

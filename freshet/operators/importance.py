"""Permutation importance: how much worse a model scores when one feature is shuffled within each map, all features in one job.

A shuffle is an order by a seeded hash and a step: the row of rank r takes the
value of the row ``step`` ranks on. Ranks are counted in ranges of the hash,
so a map of any size is dealt out, and the join is on equality of ranks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Model = Callable[[Sequence[Column]], Column]


def ranked(rows: DataFrame, group: Sequence[str], order: Column, digits: int = 3) -> DataFrame:
    """``rows`` with ``rank`` from 0 by ``order``, a hash in hex digits that no two rows of a group share, and ``size``; ``digits`` of the hash cut a group into 16 ranges each."""
    dealt = rows.withColumn("__h", order).withColumn("__range", F.substring("__h", 1, digits))
    ranges = dealt.groupBy(*group, "__range").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.select(*group, "__range", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(*group)).alias("size"))
    own = F.row_number().over(Window.partitionBy(*group, "__range").orderBy("__h")) - 1
    return dealt.withColumn("__own", own).join(sizes, [*group, "__range"]).withColumn("rank", F.col("__before") + F.col("__own")).drop("__h", "__range", "__own", "__n", "__before")


def permuted(rows: DataFrame, map_key: str, id_key: str, features: Sequence[str], seed: int) -> DataFrame:
    """(f, map, id, x): each row once for each feature f, its vector with the value of f from another row of its map."""
    each = rows.select(F.col(map_key).alias("map"), F.col(id_key).alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))).alias("f"))
    placed = ranked(each, ["map", "f"], F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("f").cast("string"), F.col("id").cast("string"))))
    step = F.when(F.col("size") > 1, 1 + F.pmod(F.lit(seed * 7919) + F.col("f") * 104729, F.col("size") - 1)).otherwise(0)
    given = placed.select("map", "f", F.pmod(F.col("rank") - step, F.col("size")).alias("rank"), F.get("x", F.col("f")).alias("v"))
    return placed.join(given, ["map", "f", "rank"]).select("f", "map", "id", F.transform("x", lambda v, i: F.when(i == F.col("f"), F.col("v")).otherwise(v)).alias("x"))


def importance(rows: DataFrame, map_key: str, event: str, id_key: str, features: Sequence[str], label: str, model: Model, seed: int = 42) -> DataFrame:
    """(feature, event_macro_brier, delta_brier): the mean over events of the Brier score with the feature shuffled, and its rise over the plain one.

    ``id_key`` is unique. Rows with a null map, id, event or label take no part;
    a map lies in one event. A score that the model leaves unknown counts for
    neither.
    """
    known = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in {map_key, event, id_key, label}))
    facts = known.select(F.col(id_key).alias("id"), F.col(event).alias("event"), F.col(label).cast("double").alias("y"))
    plain = known.select(F.lit(-1).alias("f"), F.col(id_key).alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    tried = plain.unionByName(permuted(known, map_key, id_key, features, seed).drop("map")).join(facts, "id")
    error = (model([F.get("x", F.lit(k)) for k in range(len(features))]) - F.col("y")) ** 2
    by_event = tried.groupBy("f", "event").agg(F.avg(error).alias("brier")).groupBy("f").agg(F.avg("brier").alias("brier"))
    base = by_event.where("f = -1").select(F.col("brier").alias("base"))
    named = F.element_at(F.array(*[F.lit(c) for c in features]), F.col("f") + 1)
    return by_event.where("f >= 0").crossJoin(F.broadcast(base)).select(named.alias("feature"), F.round("brier", 9).alias("event_macro_brier"), F.round(F.col("brier") - F.col("base"), 9).alias("delta_brier"))

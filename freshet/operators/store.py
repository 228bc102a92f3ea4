"""Scans and lookups of kept records: by city and kind, by box over all vertices, by key, and the last of each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most keys of a lookup that are broadcast.
BROADCAST_KEYS = 100_000


def scan(rows: DataFrame, equal: Mapping[str, object]) -> DataFrame:
    """``rows`` with these values; a None asks for nothing. A null in a row equals no value."""
    for c, v in equal.items():
        if v is not None:
            rows = rows.where(F.col(c) == F.lit(v))
    return rows


def touches(x: Column, y: Column, vertices: Column, west: float, south: float, east: float, north: float) -> Column:
    """Whether a record's own point, or any of its vertices (structs of x and y), lies in the closed box; unknown coordinates do not."""
    inside = lambda a, b: F.coalesce(a.between(west, east) & b.between(south, north), F.lit(False))
    return inside(x, y) | F.coalesce(F.exists(vertices, lambda v: inside(v["x"], v["y"])), F.lit(False))


def asset_page(assets: DataFrame, key: str, city: str | None = None, kind: str | None = None, box: tuple[float, float, float, float] | None = None, limit: int = 200, offset: int = 0, most: int = 500) -> DataFrame:
    """A page of assets (city_id, asset_type, x, y, vertices) in order of ``key``: at most ``limit`` of them, and ``most`` in any case, from ``offset`` on."""
    found = scan(assets, {"city_id": city, "asset_type": kind})
    if box is not None:
        found = found.where(touches(F.col("x"), F.col("y"), F.col("vertices"), *box))
    return found.orderBy(key).offset(offset).limit(min(limit, most))


def last_puts(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key: the last put in ``order``, nulls first; pre-aggregated, so a hot key costs no more. Of equal orders the greatest row."""
    rest = [c for c in rows.columns if c not in keys]
    rank = F.struct(*[x for c in order for x in (F.col(c).isNotNull(), F.col(c))], F.struct(*rest))
    best = F.max(F.struct(rank.alias("rank"), F.struct(*rest).alias("row"))).alias("b")
    return rows.groupBy(*keys).agg(best).select(*keys, "b.row.*")


def lookup(rows: DataFrame, wanted: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Each distinct key of ``wanted`` with ``found`` and the columns of its last put, null where there is none.

    The keys go to the rows by broadcast up to BROADCAST_KEYS of them, so only
    rows that are asked for are reduced; beyond that it is an ordinary join.
    """
    asked = wanted.where(F.col(key).isNotNull()).select(key).distinct()
    side = F.broadcast(asked) if asked.count() <= BROADCAST_KEYS else asked
    held = last_puts(rows.join(side, key, "left_semi"), [key], order).withColumn("found", F.lit(True))
    return asked.join(held, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))

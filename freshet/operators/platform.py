"""Risk, freshness, forecasts, alerts, limits and search: column expressions and keyed windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.hot import PART, Ranges, split_by_size


def risk_score(probability: Column, exposure: Column, severity: Column) -> Column:
    """The product; null unless all three are within 0 and 1."""
    fine = probability.between(0, 1) & exposure.between(0, 1) & severity.between(0, 1)
    return F.when(fine, probability * exposure * severity)


def risk_category(score: Column) -> Column:
    """Fixed cuts: 0.10, 0.30, 0.60; an unknown score has no category."""
    return F.when(score >= 0.6, "SEVERE").when(score >= 0.3, "HIGH").when(score >= 0.1, "MODERATE").when(score >= 0, "LOW")


def freshness(age_hours: Column) -> Column:
    """Fixed cuts: fresh to 24 h, stale to 72 h, then expired; the future and the unknown are unavailable."""
    return F.when(age_hours.isNull() | (age_hours < 0), "UNAVAILABLE").when(age_hours <= 24, "FRESH").when(age_hours <= 72, "STALE").otherwise("EXPIRED")


def horizon_probability(base: Column, hours: Column) -> Column:
    """Base plus up to 0.35 over 72 hours, at most 0.95."""
    return F.least(base + F.least(F.lit(0.35), hours / 72.0 * 0.35), F.lit(0.95))


def horizon_confidence(hours: Column) -> Column:
    return F.greatest(F.lit(0.45), 0.9 - hours / 200.0)


def alert_transitions(readings: DataFrame, key: str, order_by: str, verdict: Column) -> DataFrame:
    """``transition``: TRIGGERED or RESET where the last known verdict changes; an unknown verdict holds the state."""

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__before", F.lag("__verdict", 1, False).over(Window.partitionBy(key).orderBy(order_by)))

    def ranged(rows: DataFrame) -> DataFrame:
        r = Ranges(rows, [key], [order_by])
        held = r.carry(r.rows, {"__last": F.max_by("__verdict", F.struct(F.col(order_by).isNotNull(), order_by))}, {"__last": F.last})
        return held.withColumn("__before", F.coalesce(F.lag("__verdict").over(r.own), "__last", F.lit(False))).drop("__last", PART)

    rows = split_by_size(readings.withColumn("__verdict", verdict).where("__verdict IS NOT NULL"), [key], plain, ranged)
    before = F.col("__before")
    change = F.when(F.col("__verdict") & ~before, "TRIGGERED").when(~F.col("__verdict") & before, "RESET")
    return rows.withColumn("transition", change).where("transition IS NOT NULL").drop("__verdict", "__before")


def rate_limited(rows: DataFrame, key: list[str], order_by: str, most: int) -> DataFrame:
    """``allowed``: whether the row is among its key's first ``most``."""

    def ranged(rows: DataFrame) -> DataFrame:
        r = Ranges(rows, key, [order_by])
        held = r.carry(r.rows, {"__n": F.count("*")}, {"__n": F.sum})
        return held.withColumn("allowed", F.row_number().over(r.own) + F.coalesce("__n", F.lit(0)) <= most).drop("__n", PART)

    return split_by_size(rows, key, lambda rows: rows.withColumn("allowed", F.row_number().over(Window.partitionBy(*key).orderBy(order_by)) <= most), ranged)


def search(rows: DataFrame, fields: list[str], text: str, key: str, most: int) -> DataFrame:
    """Rows that hold every token of ``text`` in any field, exact matches first; a report of ``most``."""
    whole = F.lower(F.concat_ws(" ", *fields))
    found = rows
    for token in text.lower().split():
        found = found.where(whole.contains(token))
    exact = F.lit(False)
    for f in fields:
        exact = exact | F.coalesce(F.lower(f) == text.lower(), F.lit(False))
    return found.withColumn("exact", exact).orderBy(F.col("exact").desc(), key).limit(most)


def within(rows: DataFrame, x: str, y: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows in the closed box; null coordinates are outside."""
    return rows.where(F.col(x).between(west, east) & F.col(y).between(south, north))

"""Readers: Parquet tables, hourly series from columnar JSON, and hour spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columnar_series(rows: DataFrame, key: str, times: str, values: str) -> DataFrame:
    """(key, time, value) from two parallel arrays a row; a missing value stays null."""
    pair = F.explode(F.arrays_zip(F.col(times).alias("time"), F.col(values).alias("value"))).alias("p")
    return rows.select(key, pair).select(key, "p.time", "p.value")


def epoch_hour(ts: Column) -> Column:
    """Whole hours since 1970, whatever the session's zone."""
    return (F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) * 24 + F.hour(ts)).cast("long")


def epoch_seconds(ts: Column) -> Column:
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) * 86400.0 + F.hour(ts) * 3600.0 + F.minute(ts) * 60.0 + F.date_part(F.lit("SECOND"), ts).cast("double")

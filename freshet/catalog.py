"""All queries of the flood engine over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from freshet.plans import assembled, causal, exposure, grids, learned, lifecycle, ordered, platform, ranked, registry, resampled, sampled, samples, scores, spatial, stored, streams, validated  # noqa: F401  each registers its queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)

"""Logistic regression by full gradients, one aggregation a step."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.operators.graph import cut


class Logistic(NamedTuple):
    coef: tuple[float, ...]  #: the intercept first

    def probability(self, features: Sequence[Column]) -> Column:
        raw = sum((f * c for f, c in zip(features, self.coef[1:], strict=True)), F.lit(self.coef[0]))
        return F.when(raw.isNotNull(), 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), raw)))))


def fit(rows: DataFrame, features: Sequence[str], label: str, weight: str | None = None, steps: int = 250, rate: float = 0.4, l2: float = 2e-3) -> Logistic:
    """Coefficients after ``steps`` steps from zero; weights are normed to one in sum, the intercept is not penalised.

    Rows with a null or NaN feature, label or weight take no part; equal rows
    are one from the start, with their weights' sum. Without rows all
    coefficients are zero.
    """
    names = [f"x{k}" for k in range(len(features))]
    known = rows.select(*[F.col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)], F.col(label).cast("double").alias("y"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"))
    for c in (*names, "y", "w"):
        known = known.where(F.col(c).isNotNull() & ~F.isnan(c))
    table = cut(known.groupBy(*names, "y").agg(F.sum("w").alias("w")))
    total = table.agg(F.sum("w")).first()[0]
    model = Logistic((0.0,) * (len(names) + 1))
    for _ in range(steps if total else 0):
        pull = F.col("w") * (model.probability([F.col(n) for n in names]) - F.col("y"))
        sums = table.withColumn("g", pull).agg(F.sum("g"), *[F.sum(F.col("g") * F.col(n)) for n in names]).first()
        model = Logistic(tuple(c - rate * (g / total + (l2 * c if k else 0.0)) for k, (c, g) in enumerate(zip(model.coef, sums, strict=True))))
    if not all(map(math.isfinite, model.coef)):
        raise ValueError("the steps diverge: scale the features")
    return model

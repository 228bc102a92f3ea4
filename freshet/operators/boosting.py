"""Boosted stumps: a distributed split search over merged gradient histograms, one aggregation a round.

Each feature is cut at its exact 20, 40, 60 and 80 per cent quantiles, once.
Rows that fall in the same bins with the same label are one from then on, so
a round scans at most 2 * 5^features rows, and its histogram (gradient,
hessian and rows by feature and bin) merges on the map side. The driver sees
five numbers a feature.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.operators.graph import cut
from freshet.operators.prefix import quantiles

CUTS = (0.2, 0.4, 0.6, 0.8)


class Stump(NamedTuple):
    feature: int
    threshold: float
    left: float
    right: float
    gain: float


class Boosted(NamedTuple):
    """A sum of stumps on the log-odds scale."""

    base: float
    rate: float
    stumps: tuple[Stump, ...]

    def probability(self, features: Sequence[Column]) -> Column:
        """The probability as one expression over the columns; a null or NaN value goes right."""
        terms = [F.when(~F.isnan(features[s.feature]) & (features[s.feature] <= s.threshold), s.left).otherwise(s.right) * self.rate for s in self.stumps]
        return _sigmoid(sum(terms, F.lit(self.base)))


def _sigmoid(raw: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), raw))))


def best_stump(hist: dict[tuple[int, int], tuple[float, float, int]], cuts: Sequence[Sequence[float]], least: int = 8) -> Stump | None:
    """The split of the greatest gain, the first by feature and threshold of equals; both sides hold ``least`` rows or more."""
    best = None
    for f, at in enumerate(cuts):
        bins = [hist.get((f, b), (0.0, 0.0, 0)) for b in range(len(at) + 1)]
        for k, threshold in enumerate(at):
            (gl, hl, nl), (gr, hr, nr) = ([sum(x[i] for x in side) for i in range(3)] for side in (bins[: k + 1], bins[k + 1 :]))
            gain = gl * gl / (hl + 1) + gr * gr / (hr + 1)
            if min(nl, nr) >= least and (best is None or gain > best.gain):
                best = Stump(f, threshold, gl / (hl + 1), gr / (hr + 1), gain)
    return best


def fit(rows: DataFrame, features: Sequence[str], label: str, weight: str | None = None, rounds: int = 30, rate: float = 0.08, least: int = 8) -> Boosted:
    """Boosted stumps for a 0/1 label; rows with a null label or weight take no part, and rounds end when no split has ``least`` rows on both sides."""
    known = rows.where(F.col(label).isNotNull()).select(*[F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)], F.col(label).cast("int").alias("y"), F.lit(1.0).alias("w") if weight is None else F.col(weight).cast("double").alias("w"))
    known = known.where(F.col("w").isNotNull())
    cuts = [sorted({q for q in quantiles(known.where(~F.isnan(f"f{k}")), f"f{k}", CUTS) if q is not None}) for k in range(len(features))]
    # A bin is the number of cuts below the value, so a value is at most cut k where its bin is at most k.
    bins = [F.coalesce(sum(((F.col(f"f{k}") > c).cast("int") for c in at), F.lit(0)), F.lit(len(at))) for k, at in enumerate(cuts)]
    table = cut(known.select(F.array(*bins).alias("bins"), "y", "w").groupBy("bins", "y").agg(F.count("*").alias("n"), F.sum("w").alias("w")))
    wet, all_ = table.agg(F.coalesce(F.sum(F.col("w") * F.col("y")), F.lit(0.0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    share = min(max(wet / all_ if all_ else 0.5, 1e-3), 1 - 1e-3)
    model = Boosted(math.log(share / (1 - share)), rate, ())
    for _ in range(rounds):
        terms = [F.when(F.col("bins")[s.feature] <= cuts[s.feature].index(s.threshold), s.left).otherwise(s.right) * rate for s in model.stumps]
        p = _sigmoid(sum(terms, F.lit(model.base)))
        pulled = table.withColumn("p", p).select("bins", "n", (F.col("w") * (F.col("y") - F.col("p"))).alias("g"), (F.col("w") * F.col("p") * (1 - F.col("p"))).alias("h"))
        each = pulled.select("n", "g", "h", F.posexplode("bins").alias("f", "b")).groupBy("f", "b").agg(F.sum("g"), F.sum("h"), F.sum("n"))
        stump = best_stump({(r[0], r[1]): (r[2], r[3], r[4]) for r in each.collect()}, cuts, least)
        if stump is None:
            break
        model = model._replace(stumps=(*model.stumps, stump))
    return model

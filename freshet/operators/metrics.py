"""Evaluation of scores against 0/1 labels. Ranks come from counts per distinct score, in ranges of the order (see ``prefix``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.operators import prefix


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    hit, yes = F.col("score") >= threshold, F.col("label") == 1
    return scored.agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"))


def rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and IoU; null where the denominator is zero."""
    part = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("*", part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1"), part(tp, tp + fp + fn).alias("iou"))


def brier(scored: DataFrame) -> DataFrame:
    """Brier score, that of the base rate, and the skill; null without rows or for one class."""
    means = scored.agg(F.avg((F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))).alias("b"), F.avg(F.col("label").cast("double")).alias("p"))
    base = F.col("p") * (1 - F.col("p"))
    return means.select(F.round("b", 6).alias("brier"), F.round(base, 6).alias("brier_base"), F.when(base > 0, F.round(1 - F.col("b") / base, 6)).alias("skill"))


def by_score(scored: DataFrame) -> DataFrame:
    return scored.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))


def auroc(scored: DataFrame) -> DataFrame:
    """Mann-Whitney with half ties, over distinct scores."""
    t = prefix.running(by_score(scored), "score", ["n", "pos"]).withColumn("below", F.col("before_n") - F.col("before_pos"))
    won = F.sum(F.col("pos") * (F.col("below") + (F.col("n") - F.col("pos")) / 2.0))
    pairs = F.sum("pos") * F.sum(F.col("n") - F.col("pos"))
    return t.agg(F.when(pairs > 0, F.round(won / pairs, 6)).alias("auroc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """Step integral over distinct scores, falling; equal scores enter together."""
    t = prefix.running(by_score(scored).withColumn("falling", -F.col("score")), "falling", ["n", "pos"])
    t = t.withColumn("tp", F.col("before_pos") + F.col("pos")).withColumn("seen", F.col("before_n") + F.col("n"))
    return t.agg(F.when(F.sum("pos") > 0, F.round(F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / F.sum("pos"), 6)).alias("average_precision"))


def rank_correlation(rows: DataFrame, x: str, y: str, key: str, least: float = 0.1) -> DataFrame:
    """One row (n, rank_correlation, informative): the correlation of ordinal ranks, of ties by ``key``, over rows whose two values are known and finite.

    Both orders are counted in ranges, so any number of rows is ranked. Null
    for two rows or fewer; ``informative`` says that it exceeds ``least``.
    """
    known = rows.select(*[F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"))], F.col(key).alias("k"))
    for c in ("x", "y"):
        known = known.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")))
    for c in ("x", "y"):
        known = prefix.running(known.withColumn("o", F.struct(c, "k")).withColumn("one", F.lit(1)), "o", ["one"]).withColumnRenamed("before_one", f"rank_{c}").drop("o", "one", "total_one")
    r = F.when(F.count("*") > 2, F.round(F.corr("rank_x", "rank_y"), 6))
    return known.agg(F.count("*").alias("n"), r.alias("rank_correlation")).withColumn("informative", F.coalesce(F.col("rank_correlation") > least, F.lit(False)))


def calibration_error(scored: DataFrame, bins: int = 10, limit: float = 0.1) -> DataFrame:
    """Expected calibration error over the bins of ``reliability``, weighted by rows, and whether it is within ``limit``; null without rows."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    each = scored.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.avg("score").alias("s"), F.avg(F.col("label").cast("double")).alias("y"))
    ece = each.agg((F.sum(F.col("n") * F.abs(F.col("s") - F.col("y"))) / F.sum("n")).alias("e"))
    return ece.select(F.round("e", 6).alias("ece"), F.when(F.col("e") <= limit, "CALIBRATED").when(F.col("e") > limit, "NOT CALIBRATED").alias("status"))


def subset(scored: DataFrame, flag: Column, threshold: float) -> DataFrame:
    """``rates`` of the rows where ``flag`` holds; an empty subset has zeros and nulls."""
    return rates(confusion(scored.where(flag), threshold))


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Per bin: n, mean score, observed rate; a score of 1 is in the last bin."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return scored.groupBy(b).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg(F.col("label").cast("double")), 6).alias("observed"))


def conformal(scored: DataFrame, alpha: float = 0.2) -> DataFrame:
    """Quantiles of the absolute error, and the share of labels inside the clipped interval of the first."""
    err = F.abs(F.col("label") - F.col("score"))
    found = prefix.quantiles(scored.select(err.alias("e")), "e", [1 - alpha, 0.1, 0.9])
    q = scored.sparkSession.createDataFrame([tuple(found)], "q80 double, q10 double, q90 double")
    inside = F.col("label").between(F.greatest(F.col("score") - F.col("q80"), F.lit(0.0)), F.least(F.col("score") + F.col("q80"), F.lit(1.0)))
    met = scored.crossJoin(F.broadcast(q)).groupBy("q80", "q10", "q90").agg(F.avg(inside.cast("double")).alias("coverage"))
    return met.select(*[F.round(c, 6).alias(c) for c in ("q80", "q10", "q90", "coverage")])


def event_iou(scored: DataFrame, event: str, threshold: float) -> DataFrame:
    """Per event: tp, fp, fn and IoU (null where nothing is predicted or true): events, not rows, are independent."""
    hit, yes = F.col("score") >= threshold, F.col("label") == 1
    pooled = scored.groupBy(event).agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"))
    any_ = F.col("tp") + F.col("fp") + F.col("fn")
    return pooled.withColumn("iou", F.when(any_ > 0, F.col("tp") / any_))


def macro_micro(scored: DataFrame, event: str, threshold: float) -> DataFrame:
    """Mean, population deviation and median over events beside the pooled value."""
    micro = F.sum("tp") / F.sum(F.col("tp") + F.col("fp") + F.col("fn"))
    parts = {"macro_iou": F.avg("iou"), "std_iou": F.stddev_pop("iou"), "median_iou": F.median("iou"), "micro_iou": micro}
    return event_iou(scored, event, threshold).agg(F.count("iou").alias("n_events"), *[F.round(v, 6).alias(k) for k, v in parts.items()])


def by_tokens(rows: DataFrame, tokens: str, label: str, score: str) -> DataFrame:
    """Means per token of a list column; rows with a null or empty list count as ``unknown``."""
    found = F.explode(F.when(F.coalesce(F.size(tokens), F.lit(0)) > 0, F.col(tokens)).otherwise(F.array(F.lit("unknown"))))
    each = rows.select(found.alias("token"), label, score)
    return each.groupBy("token").agg(F.count("*").alias("n"), F.round(F.avg(F.col(label).cast("double")), 6).alias("rate"), F.round(F.avg(score), 6).alias("mean_score"))


def choose_threshold(scored: DataFrame, grid: list[float]) -> DataFrame:
    """The grid's first threshold of the greatest F1. One pass: a row adds to counts per grid slot, which are then summed."""
    edges = F.array(*[F.lit(t) for t in grid])
    slots = scored.groupBy(F.size(F.filter(edges, lambda t: t <= F.col("score"))).alias("slot"), "label").agg(F.count("*").alias("n"))
    each = slots.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(len(grid)))))
    hit = F.col("slot") >= F.col("k")
    counts = each.groupBy("k").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name) for name, c in (("tp", hit & (F.col("label") == 1)), ("fp", hit & (F.col("label") == 0)), ("fn", ~hit & (F.col("label") == 1)))])
    any_ = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = counts.withColumn("f1", F.when(any_ > 0, 2 * F.col("tp") / any_).otherwise(0.0)).orderBy(F.col("f1").desc(), "k").limit(1)
    return f1.select(F.round(F.element_at(edges, F.col("k")), 2).alias("threshold"), F.round("f1", 6).alias("f1"))


def climatology(rows: DataFrame, group: str, month: str, y: str, least: int) -> DataFrame:
    """Mean of ``y`` by group and month; below ``least`` rows the month's mean."""
    own = rows.groupBy(group, month).agg(F.count("*").alias("n"), F.avg(y).alias("p"))
    wide = rows.groupBy(month).agg(F.avg(y).alias("wide"))
    return own.join(wide, month).select(group, month, "n", F.round(F.when(F.col("n") >= least, F.col("p")).otherwise(F.col("wide")), 6).alias("climatology"))


def bootstrap(events: DataFrame, key: str, value: str, draws: int) -> DataFrame:
    """(n_events, mean, low, high): resamples of events with Poisson(1) weights from a hash of (draw, event).

    Each event is exploded ``draws`` times and summed by draw, so it needs no
    numbering of events and merges anywhere.
    """
    u = F.pmod(F.xxhash64("draw", key), F.lit(1 << 53)) / F.lit(float(1 << 53))
    steps, total, term = [], 0.0, 0.36787944117144233  # the Poisson(1) distribution function, term by term
    for k in range(1, 9):
        total += term
        steps.append(total)
        term /= k
    weight = F.size(F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s <= F.col("u")))
    each = events.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("u", u).withColumn("weight", weight)
    means = each.groupBy("draw").agg((F.sum(F.col("weight") * F.col(value)) / F.sum("weight")).alias("m"))
    spread = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return events.agg(F.count("*").alias("n_events"), F.avg(value).alias("mean")).crossJoin(spread)

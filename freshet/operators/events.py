"""Events, samples and pairs: summaries, splits, leakage, alignment. Aggregations merge on the map side; joins are on equality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.prefix import group_quantiles
from freshet.operators.times import overlaps


def finite(value: str) -> Column:
    """Whether a number is known, and neither NaN nor infinite."""
    return F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) != float("inf"))


def numeric_summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, min, quartiles, mean and max of the known, finite values of each group; groups without any have n 0 and nulls.

    The quartiles are exact and counted in ranges of the values, so a group of any size is spread over tasks.
    """
    v = F.when(finite(value), F.col(value).cast("double"))
    whole = rows.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg(v), 6).alias("mean"))
    q = group_quantiles(rows, keys, v, [0.25, 0.5, 0.75]).select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.round(f"q{i}", 6).alias(name) for i, name in enumerate(("q25", "median", "q75"))])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return whole.join(q, same, "left").drop(*[f"__{k}" for k in keys])


def missingness(pairs: DataFrame, key: str, event: str, eligibility: str, coverage: str) -> DataFrame:
    """Per value of ``key``: pairs, events, pairs of each eligibility, and how many have no coverage at all."""
    none = F.coalesce(F.col(coverage), F.lit(0.0)) <= 0
    return pairs.groupBy(key).agg(
        F.count("*").alias("n_pairs"), F.countDistinct(event).alias("n_events"), *[F.count_if(F.col(eligibility) == e).alias(f"n_{e.lower()}") for e in ("FULL", "PARTIAL", "STATE_ONLY")],
        F.count_if(none).alias("n_coverage_zero"), F.round(F.count_if(none) / F.count("*"), 6).alias("zero_coverage_rate"), F.round(F.avg(coverage), 6).alias("mean_coverage"),
    )


def pearson(rows: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 5) -> DataFrame:
    """Per group the correlation of the rows whose two values are known and finite; null below ``least`` such rows or where one does not vary.

    Spark's ``corr`` fails by a division by zero where a value does not vary, so the covariance is divided here, only where both vary.
    """
    both = finite(x) & finite(y)
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = {"sa": F.stddev_pop(a), "sb": F.stddev_pop(b), "cov": F.covar_pop(a, b), "va": F.min(a) < F.max(a), "vb": F.min(b) < F.max(b)}  # merged deviations of equal values may be just above 0
    found = rows.groupBy(*keys).agg(F.count(a).alias("n"), *[c.alias(k) for k, c in spread.items()])
    r = F.try_divide(F.try_divide(F.col("cov"), F.col("sa")), F.col("sb"))
    return found.select(*keys, "n", F.when((F.col("n") >= least) & F.col("va") & F.col("vb") & (F.col("sa") > 0) & (F.col("sb") > 0), F.round(r, 6)).alias("pearson"))


def hard_cases(pixels: DataFrame, keys: Sequence[str], y: str, rain: str) -> DataFrame:
    """Per sample the flags of hard cases; ``y``: 1 wet, 0 dry, null unknown."""
    s = pixels.groupBy(*keys).agg(F.count("*").alias("n"), F.count(y).alias("known"), F.count_if(F.col(y) == 1).alias("wet"), F.coalesce(F.max(rain), F.lit(0.0)).alias("rain"))
    wet, n = F.col("wet"), F.col("n")
    flags = {"weak_flood": wet.between(1, 20), "small_flood": wet.between(1, 50), "nodata_heavy": (n - F.col("known")) >= 0.5 * n, "low_rainfall": F.col("rain") < 5.0, "rare_event": (wet > 0) & (wet < 0.05 * F.greatest("known", F.lit(1)))}
    return s.select(*keys, *[c.alias(k) for k, c in flags.items()])


def prevalence(pixels: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """Wet, dry and unknown pixels, and the wet share of the known; null without any."""
    known = F.count(y)
    return pixels.groupBy(*keys).agg(F.count_if(F.col(y) == 1).alias("n_wet"), F.count_if(F.col(y) == 0).alias("n_dry"), (F.count("*") - known).alias("n_unknown"), F.when(known > 0, F.round(F.count_if(F.col(y) == 1) / known, 6)).alias("prevalence"))


def records(scenes: DataFrame, event: str, at: str, wet: str, region: str) -> DataFrame:
    """One row an event: first and last scene, the peak (most wet, the earliest of equals), regions in order, scenes."""
    peak = F.max_by(F.col(at), F.struct(F.col(wet), -F.col(at)))
    return scenes.groupBy(event).agg(F.min(at).alias("first_s"), peak.alias("peak_s"), F.max(at).alias("last_s"), F.count("*").alias("n_scenes"), F.array_join(F.array_sort(F.collect_set(region)), ",").alias("regions"))


def pair_statistics(pairs: DataFrame, keys: Sequence[str], before: str, after: str) -> DataFrame:
    """Turnover (changed share of the known) and IoU of the wet cells before and after; null with nothing known or nothing wet."""
    b, a = F.col(before), F.col(after)
    changed, known, both, either = F.count_if(a != b), F.count(a != b), F.count_if(a & b), F.count_if((a | b) & a.isNotNull() & b.isNotNull())
    return pairs.groupBy(*keys).agg(known.alias("n_known"), F.when(known > 0, F.round(changed / known, 6)).alias("turnover"), F.when(either > 0, F.round(both / either, 6)).alias("iou"))


def channel_audit(rows: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One row a channel: known values, mean, deviation, and whether it never varies. One pass over the rows, whatever the channels."""
    stats = [F.struct(F.lit(c).alias("channel"), F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_pop(c), 6).alias("std"), (F.coalesce(F.max(c) == F.min(c), F.lit(True))).alias("constant")) for c in channels]
    return rows.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def temporal_split(year: Column, last_train: int, val: int) -> Column:
    """train up to a year, val in the next named, test afterwards."""
    return F.when(year <= last_train, "train").when(year == val, "val").otherwise("test")


def held_out_split(key: Column, held: Sequence, named: str = "test") -> Column:
    """Geographic or event-level: the held keys are ``named``, all others train; an unknown key has no split."""
    return F.when(key.isNull(), None).when(key.isin(*held), named).otherwise("train")


def straddling(rows: DataFrame, unit: str, split: str) -> DataFrame:
    """Units in more than one split, with how many."""
    return rows.groupBy(unit).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def split_exposure(rows: DataFrame, unit: str, split: str) -> DataFrame:
    """Each unit as train_only, test_only (val counts as test) or mixed."""
    has = lambda c: F.max(c.cast("int")) == 1
    train, test = has(F.col(split) == "train"), has(F.col(split) != "train")
    return rows.groupBy(unit).agg(F.when(train & test, "mixed").when(train, "train_only").when(test, "test_only").alias("exposure"))


def sample_errors(lookback: Column, complete: Column, kind: Column, issued_s: Column, issue_s: Column, valid_s: Column, horizon_h: Column) -> Column:
    """The leakage rules that a sample breaks, in order: an array of names."""
    checks = {
        "lookback_length": lookback != 24, "lookback_incomplete": complete < 0.8, "forecast_as_observed": kind == "FORECAST", "unexpected_kind": ~kind.isin("OBSERVED", "SIMULATED", "UNAVAILABLE", "FORECAST"),
        "issued_after_issue": issued_s > issue_s, "valid_not_issue_plus_horizon": F.abs((valid_s - issue_s) / 3600.0 - horizon_h) > 0.01,
    }
    return F.array_compact(F.array(*[F.when(c, k) for k, c in checks.items()]))


def secondary_rules(start: Column, country: Column, inside: Column, area: Column, dead: Column, displaced: Column, cause: Column, region: str = "bangladesh", foreign: Sequence[str] = ("nigeria",)) -> tuple[Column, Column]:
    """(quality, rejection) of a catalogue event; rejection is null where it is accepted.

    Unknown counts are zero and an unknown centroid counts as inside; an
    unknown country is not the ``region``, and one that names a ``foreign``
    one is not either.
    """
    where = F.lower(F.coalesce(country, F.lit("")))
    useful = where.contains(region)
    for name in foreign:
        useful = useful & ~where.contains(name)
    month, none = F.month(start), (F.coalesce(dead, F.lit(0)) == 0) & (F.coalesce(displaced, F.lit(0)) < 10_000)
    low = F.lower(F.coalesce(cause, F.lit("")))
    rejected = (
        F.when(start.isNull(), "missing_event_dates").when(~useful, "country_not_useful").when(~F.coalesce(inside, F.lit(True)) & (F.coalesce(area, F.lit(0.0)) < 100_000), "centroid_outside")
        .when((area < 1000) & none, "tiny_or_unconfirmed_extent").when(month.isin(1, 2) & none, "winter_residual_water_cluster")
    )
    storm = low.contains("tropical") | low.contains("cyclone") | low.contains("amphan") | low.contains("storm surge")
    quality = F.when(storm, "tropical_cyclone_or_compound").when(month.isin(4, 5), "haor_premonsoon").when(month.isin(6, 7, 8, 9, 10), "monsoon_riverine").otherwise("ok")
    return F.when(rejected.isNull(), quality), rejected


def first_match(events: DataFrame, windows: DataFrame, key: Sequence[str], event: str, window: str, pad_days: int = 45, bucket_days: int = 64) -> DataFrame:
    """Each event with the first window, by start then name, that it meets within ``pad_days``; null where none does.

    ``events`` and ``windows`` have ``start`` and ``end`` dates, reversed ones are turned round. Both go to every
    bucket of days that they touch, so the join is on equality, whatever the span.
    """
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    events, windows = (t.withColumns({"start": F.least("start", "end"), "end": F.greatest("start", "end")}) for t in (events, windows))
    bucket = lambda lo, hi: F.explode(F.sequence(F.floor(lo / bucket_days), F.floor(hi / bucket_days))).alias("__b")
    left = events.select(*key, event, F.col("start").alias("__s"), F.col("end").alias("__e"), bucket(day(F.col("start")) - pad_days, day(F.col("end")) + pad_days))
    right = windows.select(*key, F.col(window).alias("__w"), F.col("start").alias("__ws"), F.col("end").alias("__we"), bucket(day(F.col("start")), day(F.col("end"))))
    met = left.join(right, [*key, "__b"]).where(overlaps(F.col("__s"), F.col("__e"), F.col("__ws"), F.col("__we"), pad_days))
    first = met.groupBy(*key, event).agg(F.min(F.struct("__ws", "__w")).alias("m"))
    return events.join(first, [*key, event], "left").select(*key, event, F.col("m.__w").alias("matched"))


def lattice_hours(readings: DataFrame, area: str, point: str, hour: str, value: str) -> DataFrame:
    """Per area and hour the mean of the points that know it, and whether half of the area's points, one at least, do."""
    size = readings.groupBy(area).agg(F.countDistinct(point).alias("n_points"))
    hourly = readings.where(F.col(value).isNotNull()).groupBy(area, hour).agg(F.avg(value).alias("mean"), F.countDistinct(point).alias("n_known"))
    return hourly.join(size, area).select(area, hour, F.round("mean", 6).alias("mean_mm"), (F.col("n_known") >= F.greatest(F.lit(1), F.ceil(0.5 * F.col("n_points")))).alias("present"))


def best_source(rows: DataFrame, key: str, source: str, coverage: str, usable: Column) -> DataFrame:
    """Per key the usable source of the greatest coverage, the first by name of equals; null where none is usable."""
    rank = F.struct(F.coalesce(F.col(coverage), F.lit(0.0)).alias("c"), F.col(source).alias("s"))
    top = F.max(F.when(usable, rank["c"]))
    found = rows.withColumn("__ok", usable).groupBy(key).agg(top.alias("coverage"), F.collect_set(F.when(F.col("__ok"), rank)).alias("r"))
    best = F.filter("r", lambda x: x["c"] == F.col("coverage"))
    return found.select(key, "coverage", F.array_min(F.transform(best, lambda x: x["s"])).alias("selected_source"))


def lookback_and_label(series: DataFrame, key: str, hour: str, value: str, lookback: int, horizon: int, threshold: float, complete: float = 0.8) -> DataFrame:
    """Hourly samples: the sum and completeness of the ``lookback`` hours before, and whether the value ``horizon`` hours on exceeds ``threshold`` (null: unknown).

    Samples below the completeness are left out.
    """
    order = Window.partitionBy(key).orderBy(hour)
    past, ahead = order.rangeBetween(-lookback, -1), order.rangeBetween(horizon, horizon)
    rows = series.select(key, hour, F.round(F.sum(value).over(past), 4).alias("rain"), (F.count(value).over(past) / lookback).alias("complete"), (F.max(value).over(ahead) > threshold).cast("int").alias("y"))
    return rows.where(F.col("complete") >= complete).withColumn("complete", F.round("complete", 6))


def latest_shared(a: DataFrame, b: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Per key the last time that both hold; keys without one are left out."""
    return a.select(*keys, at).join(b.select(*keys, at).distinct(), [*keys, at], "left_semi").groupBy(*keys).agg(F.max(at).alias(f"latest_{at}"))


def onset_error(observed: DataFrame, predicted: DataFrame, key: str, at: str) -> DataFrame:
    """Per key the first observed and predicted times; computed only where both exist, never inferred."""
    first = lambda rows, name: rows.groupBy(key).agg(F.min(at).alias(name))
    both = first(observed, "observed_onset").join(first(predicted, "predicted_onset"), key, "full")
    known = F.col("observed_onset").isNotNull() & F.col("predicted_onset").isNotNull()
    return both.select(key, F.when(known, "COMPUTED_AT_SCENE_RESOLUTION").otherwise("UNAVAILABLE").alias("status"), F.when(known, F.round(F.col("predicted_onset") - F.col("observed_onset"), 3)).alias("onset_shift_s"))


def scaled(rows: DataFrame, columns: Sequence[str], fit: Column) -> DataFrame:
    """Columns less the mean over their deviation, both from the rows where ``fit`` holds; a deviation of zero counts as one. One row of statistics is broadcast."""
    stats = rows.where(fit).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = rows.crossJoin(F.broadcast(stats))
    return out.withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0) for c in columns}).drop(*stats.columns)


def fingerprint(columns: Mapping[str, Column]) -> Column:
    """SHA-256 of a row's values as JSON with sorted names; null values are named."""
    return F.sha2(F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"}), 256)

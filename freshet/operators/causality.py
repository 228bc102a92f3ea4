"""What may be known at a forecast's issue: leakage rules of samples, vintages of forcing, model runs, and times of results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.operators.times import known_before

DAY = 86_400


def broken(rules: Mapping[str, Column]) -> Column:
    """The names of the rules that hold, in order; an unknown rule does not hold."""
    return F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def tabular_rules(lookback: Column, complete: Column, split: Column, kinds: Column, forecast: Column, issued_s: Column, issue_s: Column, valid_s: Column, horizon_h: Column, flags: Mapping[str, Column], hours: int = 24) -> dict[str, Column]:
    """The leakage rules of a tabular sample, by name.

    ``kinds`` is the array of its hourly values' kinds, ``forecast`` a forecast
    rain that it uses or null, ``flags`` what its provenance admits:
    reanalysis_as_forecast, discharge_at_valid, physics_at_valid, map_after_issue.
    """
    used = forecast.isNotNull()
    admitted = {k: _flag(flags[k]) for k in ("discharge_at_valid", "physics_at_valid", "map_after_issue") if k in flags}
    return {
        "lookback_length": lookback != hours, "lookback_incomplete": (complete < 0.8) & split.isin("train", "val", "test"), "forecast_as_observed": F.array_contains(kinds, "FORECAST"),
        "unexpected_kind": F.exists(kinds, lambda k: ~F.coalesce(k.isin("OBSERVED", "SIMULATED", "UNAVAILABLE"), F.lit(False))), "forecast_without_issue": used & issued_s.isNull(), "forecast_after_issue": used & (issued_s > issue_s),
        "reanalysis_as_forecast": used & _flag(flags.get("reanalysis_as_forecast", F.lit(False))), **admitted, "valid_not_issue_plus_horizon": F.abs((valid_s - issue_s) / 3600.0 - horizon_h) > 0.01,
    }


#: Flags of a spatial sample's provenance, and the rule that each breaks.
SPATIAL_FLAGS = {
    "satellite_as_input": ("sar_at_issue", "optical_at_valid"), "future_rain": ("era5_at_valid", "future_rain"), "future_discharge": ("q_lookback_includes_valid", "q_at_valid"), "physics_at_valid": ("physics_at_valid",),
    "persistence_is_target": ("persistence_is_target",), "pixel_split": ("pixel_iid_split",), "scaler_of_test": ("scaler_fit_on_test",), "invented_horizon": ("invented_subdaily_label",),
}


def spatial_rules(flags: Column, kinds: Column, issue_s: Column, valid_s: Column, horizon_h: Column, complete: Column, cube: Column, rain: Column, split: Column) -> dict[str, Column]:
    """The leakage rules of a spatial sample, by name; ``flags`` is the array of what its provenance admits.

    An incomplete lookback is forgiven where half of the rain cube is there and
    the rain is of a lattice (``rain`` OBSERVED or REANALYSIS).
    """
    admits = lambda names: F.arrays_overlap(F.coalesce(flags, F.array().cast("array<string>")), F.array(*[F.lit(n) for n in names]))
    rules = {name: admits(names) for name, names in SPATIAL_FLAGS.items()}
    lattice = (F.coalesce(cube, F.lit(0.0)) >= 0.5) & _flag(rain.isin("OBSERVED", "REANALYSIS"))
    return rules | {
        "forecast_as_observed": F.array_contains(kinds, "FORECAST"), "issue_not_before_valid": issue_s >= valid_s, "valid_not_issue_plus_horizon": F.abs((valid_s - issue_s) / 3600.0 - horizon_h) > 1.0,
        "lookback_incomplete": (complete < 0.8) & ~lattice & split.isin("train", "val", "test"),
    }


def vintage_ok(availability: Column, issue: Column, t0: Column) -> Column:
    """Whether a forcing value's issue allows its availability class at t0: a forecast needs one at or before t0, an observation with one must not be later; what is used as explanation only may be."""
    early = known_before(issue, t0)
    return F.when(availability == "FORECAST_AVAILABLE", early).when((availability == "OBSERVED_AVAILABLE") & issue.isNotNull(), early).otherwise(True)


def last_model_run(t0_s: Column, cycles: Sequence[int] = (0, 6, 12, 18), latency_hours: float = 6.0) -> Column:
    """Epoch seconds of the last cycle (hours of the day, UTC) whose products are out, ``latency_hours`` after it, at t0."""
    ready = F.floor(t0_s - latency_hours * 3600.0)
    day = F.floor(ready / DAY) * DAY
    inside = F.lit(None).cast("bigint")
    for c in sorted(cycles):
        inside = F.when(ready - day >= c * 3600, day + c * 3600).otherwise(inside)
    return F.coalesce(inside, day - DAY + max(cycles) * 3600)


def valid_time(t: Column) -> Column:
    """A simulation time if it is finite and not negative, else null."""
    t = t.cast("double")
    return F.when(~F.isnan(t) & (t != float("inf")) & (t >= 0), t)


def at_times(asked: DataFrame, results: DataFrame, keys: Sequence[str], at: str, tolerance: float = 1e-9) -> DataFrame:
    """``asked`` with ``time_key``: the least time that ``results`` holds for its keys within ``tolerance``; null where there is none.

    Times fall in cells as wide as ten tolerances; a time asks its own and the two beside it, so
    the join is on equality.
    """
    width = 10 * tolerance
    cell = lambda c: F.floor(c / width)
    names = [f"__{k}" for k in keys]
    held = results.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], valid_time(F.col(at)).alias("__t")).where("__t IS NOT NULL").distinct().withColumn("__c", cell(F.col("__t")))
    # Equal questions are asked once.
    wanted = asked.select(*keys, at).distinct().withColumn("__v", valid_time(F.col(at)))
    near = wanted.withColumn("__c", F.explode(F.transform(F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)]), lambda k: cell(F.col("__v")) + k)))
    same = F.col("__c") == F.col("__c2")
    for k, n in zip(keys, names, strict=True):
        same = same & (F.col(k) == F.col(n))
    found = near.join(held.withColumnRenamed("__c", "__c2"), same).where(F.abs(F.col("__t") - F.col("__v")) <= tolerance).groupBy(*keys, at).agg(F.min("__t").alias("time_key"))
    return asked.join(found, [*keys, at], "left")


#: What two results must share to be compared cell by cell, in the order of the checks, and the code of a mismatch.
SHARED = {
    "city_id": "CITY_ID_MISMATCH", "crs": "CRS_MISMATCH", "nx": "NX_MISMATCH", "ny": "NY_MISMATCH", "dx": "DX_MISMATCH", "dy": "DY_MISMATCH", "origin_x": "ORIGIN_MISMATCH", "origin_y": "ORIGIN_MISMATCH",
    "bounds": "BOUNDS_MISMATCH", "row_orientation": "ROW_ORIENTATION_MISMATCH", "cell_center": "CELL_CENTER_CONVENTION_MISMATCH",
}


def incompatibility(a: Column, b: Column, fields: Sequence[str] = tuple(SHARED)) -> Column:
    """The code of the first of ``fields`` in which the structs differ, ARRAY_SHAPE_MISMATCH if either's ``cells`` are not nx times ny, else null; results are never resampled to fit. Two unknown values are equal."""
    code = F.lit(None).cast("string")
    checks = [(~a[f].eqNullSafe(b[f]), SHARED[f]) for f in fields] + [(~_flag(s["cells"] == s["nx"] * s["ny"]), "ARRAY_SHAPE_MISMATCH") for s in (a, b)]
    for differs, name in reversed(checks):
        code = F.when(differs, name).otherwise(code)
    return code

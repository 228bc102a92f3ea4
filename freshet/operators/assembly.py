"""Samples assembled from scenes, hourly rain and daily states, and their feature vectors as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.temporal import as_of
from freshet.operators.times import known_before, seasonality

LOOKBACK = 24


def assemble(scenes: DataFrame, rain: DataFrame, states: DataFrame, city: str, scene: str, valid: str, hour: str, value: str, day: str, state: str, horizon: int = 192, least: float = 0.8) -> DataFrame:
    """(scene, city, issue, precip, complete, state_day, state, persistence) of each scene that has a known rain for ``least`` of the 24 hours before its issue.

    ``valid`` and ``hour`` count hours, ``day`` counts days. The issue is
    ``horizon`` hours before the scene; the state is the last known one of a
    day that ended at or before it; ``persistence`` is the scene kept before
    it in its city, if that was valid before the issue. ``precip`` holds the 24
    hours in order, null where unknown. A scene takes its hours by equality.
    Scenes of one city and hour are ordered by id; a scene without a city or
    hour is dropped.
    """
    kept = scenes.where(F.col(city).isNotNull() & F.col(valid).isNotNull()).select(city, scene, valid, (F.col(valid) - horizon).alias("issue"))
    known = rain.where(F.col(value).isNotNull()).groupBy(city, F.col(hour).alias("__h")).agg(F.max(value).alias("__v"))
    asked = kept.withColumn("__back", F.explode(F.sequence(F.lit(1), F.lit(LOOKBACK)))).withColumn("__h", F.col("issue") - F.col("__back"))
    hours = asked.join(known, [city, "__h"], "left").groupBy(city, scene, valid, "issue").agg(F.array_sort(F.collect_list(F.struct("__h", "__v"))).alias("__p"), (F.count("__v") / LOOKBACK).alias("complete"))  # 24 a scene
    usable = hours.where(F.col("complete") >= least).withColumn("precip", F.col("__p.__v")).drop("__p")
    before = F.lag(F.struct(F.col(scene).alias("s"), F.col(valid).alias("v"))).over(Window.partitionBy(city).orderBy(valid, scene))
    usable = usable.withColumn("__b", before).withColumn("persistence", F.when(F.col("__b.v") < F.col("issue"), F.col("__b.s"))).drop("__b")
    # A day's state is known when the day has ended.
    daily = states.where(F.col(state).isNotNull()).groupBy(city, F.col(day).alias("state_day")).agg(F.max(state).alias("state")).withColumn("__at", (F.col("state_day") + 1) * 24)
    found = as_of(usable.withColumn("__at", F.col("issue") + 1), daily, city, "__at", ["state_day", "state"])
    return found.select(scene, city, "issue", "precip", "complete", F.col("prior_state_day").alias("state_day"), F.col("prior_state").alias("state"), "persistence")


def feature_vector(precip: Column, antecedent_24h: Column, antecedent_72h: Column, forecast: Column, dem: Column, q_last: Column, windows: Mapping[int, Column], month: Column, horizon: Column) -> dict[str, Column]:
    """The 42 features of a tabular sample, by name; what is unknown is 0, and has a flag that says so where it matters.

    ``precip`` is cut or filled with zeros to 24 hours; ``dem`` is a struct of
    min, mean and p10, or null; ``windows`` gives sums that are known by
    themselves, the others are summed from the 24 hours.
    """
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    hours = [zero(F.get(precip, F.lit(k))) for k in range(LOOKBACK)]
    last = lambda n: sum(hours[LOOKBACK - n :], F.lit(0.0))
    own = lambda n: F.coalesce(windows[n].cast("double"), last(n)) if n in windows else last(n)
    sin, cos = seasonality(month)
    return {f"precip_h{k:02}": h for k, h in enumerate(hours)} | {
        "antecedent_24h": zero(antecedent_24h), "antecedent_72h": zero(antecedent_72h), "forecast_to_h": zero(forecast), "forecast_present": forecast.isNotNull().cast("double"),
        "dem_min": zero(dem["min"]), "dem_mean": zero(dem["mean"]), "dem_p10": zero(dem["p10"]), "dem_present": dem.isNotNull().cast("double"),
        "q_last": F.log1p(F.greatest(zero(q_last), F.lit(0.0))), "q_present": q_last.isNotNull().cast("double"), "month_sin": sin, "month_cos": cos, "horizon_hours": horizon.cast("double"),
        "precip_1h": own(1), "precip_3h": own(3), "precip_6h": own(6), "precip_12h": own(12), "precip_48h": F.coalesce(windows[48].cast("double"), zero(antecedent_72h)) if 48 in windows else zero(antecedent_72h),
    }


def pixel_features(i: Column, j: Column, ni: int, nj: int, sample: Mapping[str, Column], maps: Mapping[str, Column]) -> dict[str, Column]:
    """The 18 causal features of a pixel, by name; the target map is none of them.

    ``sample`` has p24, p72, p6, q_last, month, precip (its hours), is_point
    and is_cell; ``maps`` has, where there are such maps, the pixel's p24, p72,
    persistence, dem, slope and river. A pixel without persistence has 0.5
    and a flag; other unknown values are the sample's or 0.
    """
    known = lambda c: F.when(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), c.cast("double"))
    zero = lambda c: F.coalesce(known(c), F.lit(0.0))
    at = lambda name: zero(maps[name]) if name in maps else F.lit(0.0)
    local = lambda name: F.coalesce(known(maps[name]), zero(sample[name])) if name in maps else zero(sample[name])
    persists = known(maps["persistence"]) if "persistence" in maps else F.lit(None).cast("double")
    sin, cos = seasonality(sample["month"])
    late = F.slice(sample["precip"], -6, 6)
    recent = F.when(F.size(sample["precip"]) >= 6, F.aggregate(late, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))) / 6.0)
    return {
        "p24": zero(sample["p24"]), "p72": zero(sample["p72"]), "p24_local": local("p24"), "p72_local": local("p72"), "p6": zero(sample["p6"]), "q_log": F.log1p(F.greatest(zero(sample["q_last"]), F.lit(0.0))), "month_sin": sin, "month_cos": cos,
        "persistence": F.coalesce(persists, F.lit(0.5)), "persistence_known": persists.isNotNull().cast("double"), "row": i / float(max(ni - 1, 1)), "col": j / float(max(nj - 1, 1)), "dem": at("dem"), "slope": at("slope"), "river_distance": at("river"),
        "rain_is_point": F.coalesce(sample["is_point"], F.lit(False)).cast("double"), "q_is_cell": F.coalesce(sample["is_cell"], F.lit(False)).cast("double"), "recent_rain": F.coalesce(recent, F.lit(0.0)),
    }


def attach_states(pairs: DataFrame, hydro: DataFrame, pair: str, default: str = "MODELLED_STATE") -> DataFrame:
    """``pairs`` with state_time, hydro_lag_hours, hydro_staleness and hydrology_status: of ``hydro`` (state_time, lag_hours, staleness, status by pair), or the pair's own where it has none.

    A pair's own status goes ahead of the other's. Of several rows of a pair in ``hydro`` the
    one of the latest state is taken.
    """
    best = hydro.groupBy(pair).agg(F.max_by(F.struct("state_time", "lag_hours", "staleness", "status"), F.struct(F.col("state_time").isNotNull(), "state_time", "lag_hours")).alias("__h"))
    own = lambda c: F.col(c) if c in pairs.columns else F.lit(None)
    out = pairs.join(best, pair, "left")
    made = {"state_time": F.coalesce(F.col("__h.state_time"), own("state_time")), "hydro_lag_hours": F.col("__h.lag_hours"), "hydro_staleness": F.coalesce(F.col("__h.staleness"), own("hydro_staleness")), "hydrology_status": F.coalesce(own("hydrology_status"), F.col("__h.status"), F.lit(default))}
    return out.withColumns(made).drop("__h")


def causal_pairs(pairs: DataFrame, t0: Column, state_time: Column, forecast_issue: Column, forecast_coverage: Column, observed_hours: Column, rain_hours: Column, required_hours: Column, complete: float = 0.999) -> DataFrame:
    """``pairs`` with what each may be used for at t0: state_ok, forecast_coverage (none of a forecast issued after t0), antecedent_coverage, eligibility, and the ``hindsight`` that its inputs show."""
    from freshet.operators.times import eligibility

    issued = F.when(forecast_issue.isNull() | known_before(forecast_issue, t0), F.coalesce(forecast_coverage, F.lit(0.0))).otherwise(0.0)
    state_ok = known_before(state_time, t0)
    late: Sequence[Column] = (F.when(forecast_issue > t0, "forecast_after_t0"), F.when(state_time > t0, "state_after_t0"))
    return pairs.withColumns({
        "state_ok": state_ok, "forecast_coverage": issued, "antecedent_coverage": F.when(required_hours > 0, F.coalesce(rain_hours, F.lit(0)) / required_hours).otherwise(0.0),
        "eligibility": eligibility(state_ok, issued, F.coalesce(observed_hours > 0, F.lit(False)), complete), "hindsight": F.array_compact(F.array(*late)),
    })

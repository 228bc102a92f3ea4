"""Time as column expressions: ISO text, hour keys, issue times, seasons, intervals. All in UTC; null in, null out."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_utc(text: Column) -> Column:
    """Microseconds since 1970 of an ISO time; without zone or offset it is UTC; null where it is no time."""
    zoned = F.when(text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.unix_micros(zoned.try_cast("timestamp"))


def iso_utc(ts: Column) -> Column:
    """Whole seconds with a Z, of a time without zone."""
    return F.concat(F.substring(F.replace(ts.cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T")), 1, 19), F.lit("Z"))


def hour_key(ts: Column) -> Column:
    """The key that hourly values are looked up by, to the minute: 2024-01-31T05:30:00."""
    return F.concat(F.substring(F.replace(ts.cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T")), 1, 16), F.lit(":00"))


def hours_between(later_s: Column, earlier_s: Column) -> Column:
    """Hours between two times in epoch seconds; negative if the later is earlier."""
    return (later_s - earlier_s) / 3600.0


def issue_seconds(valid_s: Column, lead_hours: float = 192.0) -> Column:
    """The issue time of a forecast that is valid at ``valid_s``."""
    return valid_s - lead_hours * 3600.0


def delta_bucket(hours: Column, edges: Sequence[float]) -> Column:
    """The half-open bucket of days that ``hours`` falls in, named by its ends; the last is open. Null for negative or unknown ones."""
    days, named = hours / 24.0, F.lit(None).cast("string")
    for lo, hi in reversed(list(zip(edges, [*edges[1:], None], strict=True))):
        named = F.when((days >= lo) if hi is None else (days >= lo) & (days < hi), f"{lo:g}+ days" if hi is None else f"{lo:g}-{hi:g} days").otherwise(named)
    return named


def seasonality(month: Column) -> tuple[Column, Column]:
    """Sine and cosine of the month's place in the year."""
    turn = F.lit(2 * math.pi) * month / 12
    return F.sin(turn), F.cos(turn)


def mechanism(month: Column, profile: Column) -> Column:
    """Fixed rules: what floods in a month; ``profile`` is the region's own mechanism, or null."""
    return (
        F.when(month.isin(4, 5), "haor_premonsoon_flash").when(month.isin(6, 7, 8, 9), F.coalesce(profile, F.lit("monsoon_riverine")))
        .when(month.isin(1, 2), "winter_or_early").otherwise(F.coalesce(profile, F.lit("unspecified")))
    )


def in_window(at: Column, start: Column, end: Column) -> Column:
    """Closed at both ends; an unknown end is open."""
    return at.isNotNull() & F.coalesce(at >= start, F.lit(True)) & F.coalesce(at <= end, F.lit(True))


def half_open(at: Column, start: Column, end: Column) -> Column:
    """Whether ``start`` < ``at`` <= ``end``."""
    return (at > start) & (at <= end)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column, pad_days: int = 0) -> Column:
    """Whether two intervals of days meet, or lie at most ``pad_days`` apart; a reversed one is turned round. Null if a day is unknown."""
    known = a_start.isNotNull() & a_end.isNotNull() & b_start.isNotNull() & b_end.isNotNull()
    apart = lambda first, second: F.datediff(F.least(*second), F.greatest(*first)) <= pad_days
    return F.when(known, apart((a_start, a_end), (b_start, b_end)) & apart((b_start, b_end), (a_start, a_end)))


def known_before(issue: Column, t0: Column) -> Column:
    """Causality: the issue is at or before t0; an unknown issue is not."""
    return F.coalesce(issue <= t0, F.lit(False))


def precip_class(window: Column, kind: Column, issue: Column, t0: Column) -> Column:
    """What a rain value may be used for at t0, from its window (pre_t0, in_horizon), kind and issue time."""
    known = known_before(issue, t0)
    ahead = F.when(kind == "FORECAST", F.when(known, "FORECAST_AVAILABLE").when(issue.isNotNull(), "POST_T0_OBSERVATION").otherwise("UNAVAILABLE")).otherwise("POST_T0_OBSERVATION")
    past = F.when(kind.isin("OBSERVED", "REANALYSIS", "MODELLED"), "OBSERVED_AVAILABLE").when(kind == "FORECAST", F.when(known, "FORECAST_AVAILABLE").otherwise("UNAVAILABLE")).otherwise("UNKNOWN")
    return F.when(kind == "UNAVAILABLE", "UNAVAILABLE").when(kind.isin("DEMO", "SIMULATED"), "UNKNOWN").when(window == "in_horizon", ahead).when(window == "pre_t0", past).otherwise("UNKNOWN")


def eligibility(state_ok: Column, coverage: Column, observed: Column, complete: float = 0.999) -> Column:
    """What a pair of scenes can serve: its state is known, its forecast hours are covered, or there are observations only."""
    return (
        F.when(state_ok & (coverage >= complete), "FULL").when(state_ok & (coverage > 0), "PARTIAL").when(state_ok, "STATE_ONLY").when(observed, "OBSERVED_ONLY").otherwise("UNAVAILABLE")
    )


def coded(value: Column, codes: Mapping[str, int], other: int = 255) -> Column:
    """Labels by a table of codes; what the table lacks is ``other``, the unknown."""
    found = F.lit(other)
    for k, v in codes.items():
        found = F.when(value == k, v).otherwise(found)
    return found

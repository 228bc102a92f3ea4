"""What a sample, grid, record or share must be before it is used: each check names what is wrong, and null is never taken as right."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _is(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def sample_label(complete: Column, track_a: Column, b_available: Column, track_b: Column, track: str = "A", least: float = 0.8) -> Column:
    """The 0/1 label that a sample is learnt with on a track, null where it may not be used: too few hours, no label, or one that is not available."""
    label = track_a if track == "A" else F.when(_is(b_available), track_b)
    return F.when(complete >= least, label.cast("int"))


def unknown_scored(pixels: DataFrame, keys: Sequence[str], code: Column, scored: Column, unknown: int = 255) -> DataFrame:
    """Per sample the pixels that are unknown, and how many of them carry a score nevertheless; ``kept`` says that none does. A null code is unknown, a NaN score is none."""
    dark = F.coalesce(code == unknown, F.lit(True))
    has = scored.isNotNull() & ~F.isnan(scored.cast("double"))
    out = pixels.groupBy(*keys).agg(F.count_if(dark).alias("n_unknown"), F.count_if(dark & has).alias("n_scored"))
    return out.withColumn("kept", F.col("n_scored") == 0)


def covers(start: Column, end: Column, first: Column, last: Column) -> Column:
    """Whether a lattice of the days [first, last] covers an event; unknown days are not covered."""
    return _is((start >= first) & (end <= last))


def missing_provenance(record: Column, fields: Sequence[str], any_of: Sequence[str] = ("checksum", "source_url")) -> Column:
    """The names of the required fields that a struct lacks, in order, then the ``any_of`` group joined by "|" if it has none of it; empty text is lacking, too."""
    lacks = lambda f: F.coalesce(F.trim(record[f].cast("string")) == "", F.lit(True))
    none = F.lit(True)
    for f in any_of:
        none = none & lacks(f)
    return F.array_compact(F.array(*[F.when(lacks(f), f) for f in fields], F.when(none, "|".join(any_of))))


def grid_error(grid: Column, west: Column, south: Column, tolerance: float = 1e-9) -> Column:
    """Why a grid cannot be inspected cell by cell, null where it can: its crs, the place of its cells, its origin, or its size."""
    off = ~_is(F.abs(grid["origin_x"] - west) <= tolerance) | ~_is(F.abs(grid["origin_y"] - south) <= tolerance)
    return (
        F.when(~_is(grid["crs"] == "EPSG:4326"), "UNSUPPORTED_CRS").when(~_is(grid["cell_center"] == "cell_center"), "UNSUPPORTED_CELL_CENTER").when(off, "ORIGIN_OFF_BOUNDS")
        .when(~_is((grid["nx"] > 0) & (grid["ny"] > 0)), "EMPTY_GRID")
    )


def surface_audit(cells: DataFrame, keys: Sequence[str], i: str, j: str, value: str, nx: Column, ny: Column) -> DataFrame:
    """Per surface: cells, those that are null, NaN or infinite, the finite range, and ``error``: SHAPE where it is not exactly nx by ny cells from (0, 0), NON_FINITE, or null.

    ``nx`` and ``ny`` are aggregates, as of a column that each row repeats.
    Cells are first reduced to one row a place, so a repeated cell is found.
    """
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    # Distinct places: a count of distinct keys would be held in one task for a whole surface.
    sizes = cells.groupBy(*keys).agg(nx.alias("nx"), ny.alias("ny"), F.min(i).alias("i0"), F.max(i).alias("i1"), F.min(j).alias("j0"), F.max(j).alias("j1"))
    places = cells.groupBy(*keys, i, j).agg(F.count("*").alias("n"), F.count_if(finite).alias("ok"), F.count_if(F.isnan(v)).alias("nan"), F.count_if(F.abs(v) == float("inf")).alias("inf"), F.min(F.when(finite, v)).alias("lo"), F.max(F.when(finite, v)).alias("hi"))
    whole = places.groupBy(*keys).agg(F.sum("n").alias("n_cells"), F.count("*").alias("n_places"), F.sum(F.col("n") - F.col("ok") - F.col("nan") - F.col("inf")).alias("n_null"), F.sum("nan").alias("n_nan"), F.sum("inf").alias("n_inf"), F.min("lo").alias("least"), F.max("hi").alias("most"))
    shape = _is((F.col("n_cells") == F.col("nx") * F.col("ny")) & (F.col("n_places") == F.col("n_cells")) & (F.col("i0") == 0) & (F.col("j0") == 0) & (F.col("i1") == F.col("ny") - 1) & (F.col("j1") == F.col("nx") - 1))
    error = F.when(~shape, "SHAPE").when(F.col("n_null") + F.col("n_nan") + F.col("n_inf") > 0, "NON_FINITE")
    return whole.join(sizes, list(keys)).select(*keys, "n_cells", "n_null", "n_nan", "n_inf", "least", "most", error.alias("error"))


def run_errors(rain: Column, lx: Column, ly: Column, dt: Column) -> Column:
    """What is wrong with a run's parameters, in order: unknown or NaN ones are wrong, too."""
    good = lambda c, cond: _is(cond & ~F.isnan(c.cast("double")))
    checks = {"negative_rain": good(rain, rain >= 0), "domain_not_positive": good(lx, lx > 0) & good(ly, ly > 0), "step_not_positive": good(dt, dt > 0)}
    return F.array_compact(F.array(*[F.when(~c, k) for k, c in checks.items()]))


def wet_from_fraction(fraction: Column, threshold: float = 0.0) -> Column:
    """1 if a flooded fraction exceeds the threshold, else 0; null for an unknown one."""
    return F.when(fraction.isNotNull() & ~F.isnan(fraction.cast("double")), (fraction > threshold).cast("int"))


def share_refusal(revoked_at: Column, visibility: Column, owner: Column, requester: Column, signed_in: Column) -> Column:
    """Why a shared snapshot is not shown, null where it is: REVOKED, PRIVATE to another owner (the default), or SIGN_IN for an organization's."""
    seen = F.coalesce(visibility, F.lit("private"))
    return F.when(revoked_at.isNotNull(), "REVOKED").when((seen == "private") & owner.isNotNull() & ~requester.eqNullSafe(owner), "PRIVATE").when((seen == "organization") & ~_is(signed_in), "SIGN_IN")

"""An azimuthal-equidistant projection as column arithmetic, and the pixels of its tiles."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the projection's sphere, in metres.
RADIUS = 6378137.0


class Plane(NamedTuple):
    """The projection's centre in degrees and its false origin in metres; by default the grid of Asia."""

    lat0: float = 47.0
    lon0: float = 94.0
    east: float = 4340913.84808
    north: float = 4812712.92347

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """(x, y) in metres; distance and bearing from the centre are kept."""
        sin0, cos0 = math.sin(math.radians(self.lat0)), math.cos(math.radians(self.lat0))
        phi, turn = F.radians(lat), F.radians(lon - self.lon0)
        cos_c = sin0 * F.sin(phi) + cos0 * F.cos(phi) * F.cos(turn)
        c = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_c)))
        k = F.when(c < 1e-12, 1.0).otherwise(c / F.sin(c)) * RADIUS
        return k * F.cos(phi) * F.sin(turn) + self.east, k * (cos0 * F.sin(phi) - sin0 * F.cos(phi) * F.cos(turn)) + self.north

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(lat, lon) in degrees; the centre's own coordinates at the centre."""
        sin0, cos0 = math.sin(math.radians(self.lat0)), math.cos(math.radians(self.lat0))
        dx, dy = (x - self.east) / RADIUS, (y - self.north) / RADIUS
        c = F.sqrt(dx * dx + dy * dy)
        sin_c = F.when(c < 1e-12, 1.0).otherwise(F.sin(c) / c)  # by the distance
        sine = F.cos(c) * sin0 + dy * sin_c * cos0
        lat = F.when(sine.isNotNull(), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sine))))
        lon = F.atan2(dx * sin_c, cos0 * F.cos(c) - dy * sin_c * sin0)
        return F.degrees(lat), F.degrees(lon) + self.lon0


class Tile(NamedTuple):
    """A square raster: its north-west corner in metres, pixels a side, metres a pixel."""

    west: float
    north: float
    size: int = 15000
    pixel: float = 20.0

    def address(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(row, column), fractional, rows from the north."""
        return (self.north - y) / self.pixel, (x - self.west) / self.pixel

    def holds(self, row: Column, col: Column) -> Column:
        return (row >= 0) & (row < self.size) & (col >= 0) & (col < self.size)

    def window(self, corners: Sequence[tuple[Column, Column]], pad: int = 8) -> Column:
        """(row0, row1, col0, col1) around addresses, padded and clipped to the tile; null where nothing is left."""
        rows, cols = [r for r, _ in corners], [c for _, c in corners]
        low = lambda at: F.greatest(F.lit(0), (F.floor(F.least(*at)) - pad).cast("int"))
        high = lambda at: F.least(F.lit(self.size), (F.ceil(F.greatest(*at)) + pad).cast("int"))
        r0, r1, c0, c1 = low(rows), high(rows), low(cols), high(cols)
        return F.when((r1 > r0) & (c1 > c0), F.struct(r0.alias("row0"), r1.alias("row1"), c0.alias("col0"), c1.alias("col1")))


#: The two tiles of the study region.
TILES = {"E039N021T3": Tile(3900000.0, 2400000.0), "E039N024T3": Tile(3900000.0, 2700000.0)}

"""Great-circle distance and grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import ColumnLike, as_col

# Fixed values.
EARTH_RADIUS_KM = 6371.0
KM_PER_MILE = 1.60934

#: Length of one degree of latitude for the radius above.
KM_PER_DEGREE = EARTH_RADIUS_KM * math.pi / 180.0


def haversine_km(lat1: ColumnLike, lon1: ColumnLike, lat2: ColumnLike, lon2: ColumnLike) -> Column:
    """Great-circle distance in kilometres, as one code-generated expression."""
    phi1, phi2 = F.radians(as_col(lat1)), F.radians(as_col(lat2))
    half_dlat = (phi2 - phi1) / 2
    half_dlon = (F.radians(as_col(lon2)) - F.radians(as_col(lon1))) / 2
    chord = F.sin(half_dlat) * F.sin(half_dlat) + F.cos(phi1) * F.cos(phi2) * F.sin(
        half_dlon
    ) * F.sin(half_dlon)
    # Rounding can push the chord a hair past 1 for antipodes. (least() would turn a
    # missing coordinate into a distance; this keeps it NULL.)
    chord = F.when(chord > 1.0, F.lit(1.0)).otherwise(chord)
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(chord), F.sqrt(F.lit(1.0) - chord))


def cell(degrees: ColumnLike, places: int) -> Column:
    """Whole-number grid cell: the coordinate rounded to ``places`` decimals, times 10**places.

    Integer cells compare and join exactly, and there is no negative zero.
    """
    return F.round(as_col(degrees) * F.lit(float(10**places)), 0).cast("int")


def cell_label(cell_col: ColumnLike, places: int) -> Column:
    """Text of one cell coordinate."""
    return F.format_string(f"%.{places}f", as_col(cell_col) / F.lit(float(10**places)))


def cell_pair_label(lat_cell: ColumnLike, lon_cell: ColumnLike, places: int) -> Column:
    """``"lat,lon"`` text of a cell."""
    return F.concat_ws(",", cell_label(lat_cell, places), cell_label(lon_cell, places))


def within_box(
    lat: ColumnLike, lon: ColumnLike, south: float, west: float, north: float, east: float
) -> Column:
    """Bounding-box predicate made of plain comparisons, so Parquet can skip row groups."""
    return as_col(lat).between(south, north) & as_col(lon).between(west, east)


#: Decimals of a region label.
CELL_LABEL_PLACES = 1

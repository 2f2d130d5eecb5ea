"""Distance joins as equi-joins on grid cells.

A bare distance condition would plan a nested-loop join. Instead both sides get
a grid cell at least as wide as the radius, one side is copied into its 3 x 3
neighbour cells, and the join is on the cell. Equal coordinates are folded
together on both sides first: copies of one point cannot pile up in a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.geo import KM_PER_DEGREE, haversine_km
from placewise.functions.numbers import round_to
from placewise.functions.texts import UNKNOWN
from placewise.session import stage

MATCH_RADIUS_KM = 0.05
ZONE_RADIUS_KM = 1.0
_SLACK = 1.1


def _row_cells(row: Column, edge: float) -> Column:
    """Number of longitude cells in a latitude row, narrow enough in degrees to stay
    wider than the radius on the ground. Rows near a pole are one single cell."""
    top = F.least((F.greatest(F.abs(row), F.abs(row + 1)) + 1) * F.lit(edge), F.lit(90.0))
    n = F.floor(F.lit(360.0 / edge) * F.cos(F.radians(top)))
    return F.when(n < 8, F.lit(1)).otherwise(n).cast("long")


def _column_of(lon: Column, n: Column) -> Column:
    around = F.pmod(lon + F.lit(180.0), F.lit(360.0))
    return F.least(F.floor(around * n / F.lit(360.0)).cast("long"), n - 1)


def _with_cell(df: DataFrame, lat: str, lon: str, radius_km: float) -> DataFrame:
    edge = radius_km / KM_PER_DEGREE * _SLACK
    rows = df.withColumn("_cy", F.floor(F.col(lat) / F.lit(edge)).cast("long"))
    return rows.withColumn("_cx", _column_of(F.col(lon), _row_cells(F.col("_cy"), edge)))


def _with_neighbour_cells(df: DataFrame, lat: str, lon: str, radius_km: float) -> DataFrame:
    """Each point once per cell that can hold something within the radius."""
    edge = radius_km / KM_PER_DEGREE * _SLACK
    own = F.floor(F.col(lat) / F.lit(edge)).cast("long")
    rows = df.withColumn("_cy", F.explode(F.array(own - 1, own, own + 1)))
    rows = rows.withColumn("_n", _row_cells(F.col("_cy"), edge))
    at = _column_of(F.col(lon), F.col("_n"))
    # Columns wrap around at 180 degrees; a row of one cell yields it once.
    around = F.array_distinct(F.array(*[F.pmod(at + d, F.col("_n")) for d in (-1, 0, 1)]))
    return rows.withColumn("_cx", F.explode(around)).drop("_n")


def close_points(left: DataFrame, right: DataFrame, radius_km: float) -> DataFrame:
    """Pairs of distinct points ``(lat, lon)`` x ``(plat, plon)`` within the radius, with distance.

    The left side is the one copied into neighbour cells: pass the smaller one.
    """
    a = _with_neighbour_cells(left, "lat", "lon", radius_km)
    b = _with_cell(right, "plat", "plon", radius_km)
    pairs = a.join(b, ["_cy", "_cx"]).drop("_cy", "_cx")
    return pairs.withColumn("distance_km", haversine_km("lat", "lon", "plat", "plon")).filter(
        F.col("distance_km") <= radius_km
    )


def nearest_category(
    points: DataFrame,
    pois: DataFrame,
    key: str = "location_id",
    radius_km: float = MATCH_RADIUS_KM,
    first_pass: float = 0.125,
) -> DataFrame:
    """Category, name and distance (m) of the nearest categorised POI within the radius.

    Points without one keep ``unknown`` and a NULL distance. Two passes keep
    crowded areas cheap: a narrow radius first, which settles every point with
    something next to it, then the full radius for the others only. A nearest
    POI inside the narrow radius is the nearest overall, so nothing changes.

    Points and POIs, folded by coordinate, are written once: both passes read them, and conditions on their cells are
    not pushed down to the rows they were folded from.
    """
    points = stage(points, "points")
    named = pois.filter(F.col("category").isNotNull())
    targets = named.groupBy(F.col("lat").alias("plat"), F.col("lon").alias("plon")).agg(
        F.min(F.struct("poi_id", "category", "name")).alias("poi")
    )
    targets = stage(targets, "targets")
    spots = points.select("lat", "lon").distinct()

    def nearest(where: DataFrame, radius: float) -> DataFrame:
        hits = close_points(where, targets, radius)
        best = F.min(F.struct("distance_km", "poi"))
        return hits.groupBy("lat", "lon").agg(best.alias("_best"))

    narrow = nearest(spots, radius_km * first_pass)
    others = spots.join(narrow.select("lat", "lon"), ["lat", "lon"], "left_anti")
    settled = narrow.unionByName(nearest(others, radius_km))
    return points.join(settled, ["lat", "lon"], "left").select(
        key,
        F.coalesce(F.col("_best.poi.category"), F.lit(UNKNOWN)).alias("category"),
        F.col("_best.poi.name").alias("poi_name"),
        round_to(F.col("_best.distance_km") * 1000, 1).alias("distance_m"),
    )


def zone_category_counts(
    zones: DataFrame, pois: DataFrame, radius_km: float = ZONE_RADIUS_KM
) -> DataFrame:
    """POIs per (zone, category) within the radius of the zone's point.

    POIs are counted per coordinate and category before the join, and the
    zone side, which is the small one, is the side copied to neighbour cells.
    ``first_id`` is the lowest POI id, used to break ties.
    """
    counted = (
        pois.filter(F.col("category").isNotNull())
        .groupBy(F.col("lat").alias("plat"), F.col("lon").alias("plon"), "category")
        .agg(F.count(F.lit(1)).alias("n"), F.min("poi_id").alias("first_id"))
    )
    counted = stage(counted, "counted-pois")  # as above: conditions on cells stay behind the fold
    near = close_points(zones.select("zone_id", "lat", "lon"), counted, radius_km)
    return near.groupBy("zone_id", "category").agg(
        F.sum("n").alias("n"), F.min("first_id").alias("first_id")
    )


def zone_categories(zones: DataFrame, counts: DataFrame) -> DataFrame:
    """Per zone: main category, sorted category list, POI count."""
    per_zone = counts.groupBy("zone_id").agg(
        F.min_by("category", F.struct((-F.col("n")).alias("k"), "first_id")).alias("_main"),
        F.sort_array(F.collect_set("category")).alias("_all"),
        F.sum("n").alias("_pois"),
    )
    return zones.join(per_zone, "zone_id", "left").select(
        *zones.columns,
        F.coalesce("_main", F.lit(UNKNOWN)).alias("primary_category"),
        F.coalesce("_all", F.array().cast("array<string>")).alias("all_categories"),
        F.coalesce("_pois", F.lit(0)).cast("long").alias("poi_count"),
    )


def match_statistics(matches: DataFrame) -> DataFrame:
    """Locations, matched locations and match rate, as one row."""
    return matches.agg(
        F.count(F.lit(1)).alias("n_locations"),
        F.count(F.when(F.col("category") != UNKNOWN, 1)).alias("n_matched"),
    ).withColumn(
        "match_rate_pct",
        round_to(F.coalesce(F.try_divide(F.col("n_matched") * 100.0, F.col("n_locations")), F.lit(0.0)), 1),
    )


def top_categories(matches: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most frequent known categories."""
    counted = matches.filter(F.col("category") != UNKNOWN).groupBy("category").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.orderBy(F.col("n").desc(), "category").limit(k)

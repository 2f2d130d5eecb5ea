"""Statistics of training trips, as one table per key.

One pass brings the trips to counts and sums per (origin, destination, hour) and per (origin, day): a table bounded by zones and
calendar, not by trips. All statistics but the last trips of an origin follow from it; for those it tells the days to look at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.functions.geo import cell, haversine_km
from placewise.functions.numbers import round_to
from placewise.session import stage

from .history import last_n_array
from .profiles import CELL_PLACES


def trip_counts(trips: DataFrame) -> DataFrame:
    """Trips, minutes and squared minutes per origin, destination and hour; rows with ``is_day`` hold those per origin and day.

    No statistic needs the days of a destination or an hour; counts of all four keys together would be hardly fewer than the trips.
    """
    minutes = F.col("duration_min")
    sets = [("pu_zone", "do_zone", "pickup_hour"), ("pu_zone", "pickup_date")]
    return trips.groupingSets(sets, "pu_zone", "do_zone", "pickup_hour", "pickup_date").agg(
        (F.grouping("do_zone") == 1).alias("is_day"),
        F.count(F.lit(1)).alias("n"), F.sum(minutes).alias("minutes"), F.sum(minutes * minutes).alias("squares"),
    )


def _by_hour(counts: DataFrame) -> DataFrame:
    return counts.filter(~F.col("is_day")).drop("pickup_date", "is_day")


def _by_day(counts: DataFrame) -> DataFrame:
    return counts.filter("is_day").select("pu_zone", "pickup_date", "n")


def _mean(total: str) -> Column:
    return round_to(F.sum(total) / F.sum("n"), 2)


def _mean_hour() -> Column:
    return round_to(F.sum(F.col("pickup_hour") * F.col("n")) / F.sum("n"), 2)


def od_stats(counts: DataFrame) -> DataFrame:
    """Trips, mean duration and mean pickup hour per origin and destination."""
    return _by_hour(counts).groupBy("pu_zone", "do_zone").agg(
        F.sum("n").alias("od_count"), _mean("minutes").alias("od_mean_dur"), _mean_hour().alias("avg_hour_od")
    )


def origin_stats(counts: DataFrame) -> DataFrame:
    """Trips, mean duration, distinct destinations and days, hour mean and population deviation.

    The distinct counts are taken over rows that are distinct already: destinations first, then days, each summed to
    its origin.
    """
    n, hours = F.sum("n"), F.sum(F.col("pickup_hour") * F.col("n"))
    squares = F.sum(F.col("pickup_hour") * F.col("pickup_hour") * F.col("n"))
    hourly = _by_hour(counts)
    sums = hourly.groupBy("pu_zone").agg(
        n.alias("pu_count"),
        _mean("minutes").alias("pu_mean_dur"),
        _mean_hour().alias("mean_hour"),
        round_to(F.sqrt(F.greatest(squares / n - (hours / n) * (hours / n), F.lit(0.0))), 2).alias("std_hour"),
    )

    def distinct(rows: DataFrame, key: str, out: str) -> DataFrame:
        return rows.select("pu_zone", key).distinct().groupBy("pu_zone").agg(F.count(key).alias(out))

    dropoffs, days = distinct(hourly, "do_zone", "unique_dropoffs"), distinct(_by_day(counts), "pickup_date", "active_days")
    whole = sums.join(dropoffs, "pu_zone").join(days, "pu_zone")
    return whole.select("pu_zone", "pu_count", "pu_mean_dur", "unique_dropoffs", "active_days", "mean_hour", "std_hour")


def destination_stats(counts: DataFrame) -> DataFrame:
    """Arrivals and mean duration per destination."""
    return _by_hour(counts).groupBy("do_zone").agg(F.sum("n").alias("do_count"), _mean("minutes").alias("do_mean_dur"))


def origin_spread(counts: DataFrame, zones: DataFrame) -> DataFrame:
    """Population deviation of the distance to the distinct destinations; 0 for one."""
    pairs = _by_hour(counts).select("pu_zone", "do_zone").distinct()
    o = zones.select(F.col("zone_id").alias("pu_zone"), F.col("lat").alias("_olat"), F.col("lon").alias("_olon"))
    d = zones.select(F.col("zone_id").alias("do_zone"), F.col("lat").alias("_dlat"), F.col("lon").alias("_dlon"))
    away = pairs.join(o, "pu_zone").join(d, "do_zone", "left")
    km = haversine_km("_olat", "_olon", "_dlat", "_dlon")
    return away.groupBy("pu_zone").agg(
        round_to(F.coalesce(F.stddev_pop(km), F.lit(0.0)), 4).alias("geo_spread")
    )


def origin_hour_stats(counts: DataFrame) -> DataFrame:
    """Mean and sample deviation of the duration per origin and hour; 0 for a single trip."""
    n, total, squares = F.sum("n"), F.sum("minutes"), F.sum("squares")
    variance = F.try_divide(F.greatest(squares - total * total / n, F.lit(0.0)), n - 1)
    return _by_hour(counts).groupBy("pu_zone", "pickup_hour").agg(
        _mean("minutes").alias("hour_mean"),
        round_to(F.coalesce(F.sqrt(variance), F.lit(0.0)), 2).alias("hour_std"),
    )


def recent_trips(
    trips: DataFrame, n: int = 5, extra: tuple[str, ...] = (), counts: DataFrame | None = None
) -> DataFrame:
    """Last ``n`` trips per origin as an array, oldest first.

    Trips are counted per origin and day first, or taken from the ``counts`` of the same trips; only the trips of the last
    days that together hold ``n`` are put in order.
    """
    if counts is None:
        days = trips.groupBy("pu_zone", "pickup_date").agg(F.count(F.lit(1)).alias("n"))
    else:
        days = _by_day(counts)
    later = Window.partitionBy("pu_zone").orderBy(F.col("pickup_date").desc()).rowsBetween(Window.unboundedPreceding, -1)
    held = days.withColumn("_later", F.coalesce(F.sum("n").over(later), F.lit(0))).filter(F.col("_later") < n)
    # At most n days an origin; once written, their real size decides how they are joined.
    held = stage(held.select(F.col("pu_zone").alias("_zone"), F.col("pickup_date").alias("_day")), "last-days")
    same_day = F.col("pu_zone").eqNullSafe(F.col("_zone")) & F.col("pickup_date").eqNullSafe(F.col("_day"))
    rounded = trips.join(held, same_day, "left_semi").withColumn("duration_min", round_to("duration_min", 2))
    fields = ["do_zone", "duration_min", "pickup_hour", *extra]
    return last_n_array(rounded, ["pu_zone"], ["pickup_ts", "trip_id"], n, fields, "recent")


def zone_cells(zones: DataFrame) -> DataFrame:
    """Grid cell of each zone's point."""
    return zones.withColumns({"cell_lat": cell("lat", CELL_PLACES), "cell_lon": cell("lon", CELL_PLACES)})


def cell_counts(counts: DataFrame, zones: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pickups per cell, drop-offs per cell, and trips per cell pair with their mean duration.

    Counts are first summed per zone pair, so only small tables are joined to cells.
    """
    pairs = _by_hour(counts).groupBy("pu_zone", "do_zone").agg(F.sum("n").alias("n"), F.sum("minutes").alias("minutes"))
    cells = zone_cells(zones)
    o = cells.select(F.col("zone_id").alias("pu_zone"), F.col("cell_lat").alias("o_lat"), F.col("cell_lon").alias("o_lon"))
    d = cells.select(F.col("zone_id").alias("do_zone"), F.col("cell_lat").alias("d_lat"), F.col("cell_lon").alias("d_lon"))
    pickups = pairs.join(o, "pu_zone").groupBy("o_lat", "o_lon").agg(F.sum("n").alias("pickups"))
    dropoffs = pairs.join(d, "do_zone").groupBy("d_lat", "d_lon").agg(F.sum("n").alias("dropoffs"))
    both = pairs.join(o, "pu_zone").join(d, "do_zone").groupBy("o_lat", "o_lon", "d_lat", "d_lon").agg(
        F.sum("n").alias("cell_od_count"), round_to(F.sum("minutes") / F.sum("n"), 2).alias("cell_od_mean_dur")
    )
    return pickups, dropoffs, both

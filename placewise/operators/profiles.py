"""User profiles and place dimensions from check-ins.

Everything starts from ``visit_counts``: one row per user, place, coordinate and
day with a count. It is built with partial aggregation before its shuffle, so
heavy users and popular places shrink early, and later steps never see raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placewise.functions.geo import cell, cell_pair_label, haversine_km
from placewise.functions.numbers import flag, ratio_or_zero, round_to
from placewise.functions.texts import UNKNOWN

REGION_PLACES = 1
CELL_PLACES = 3


def visit_counts(checkins: DataFrame, tie: str = "event_id") -> DataFrame:
    """Check-ins per (user, place, coordinate, day) with the first (time, tie)."""
    return checkins.groupBy(
        "user_id", "location_id", "latitude", "longitude", F.to_date("ts").alias("day")
    ).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", tie)).alias("first_seen"))


def profile_users(visits: DataFrame) -> DataFrame:
    """Check-in count, distinct places and cells, centre, spread, main region, active days."""
    base = visits.groupBy("user_id").agg(
        F.sum("n").alias("total_checkins"),
        (F.sum(F.col("latitude") * F.col("n")) / F.sum("n")).alias("centroid_lat"),
        (F.sum(F.col("longitude") * F.col("n")) / F.sum("n")).alias("centroid_lon"),
    )
    distinct = visits.groupBy("user_id").agg(
        F.count_distinct("location_id").alias("unique_locations"),
        F.count_distinct("day").alias("active_days"),
        F.count_distinct(cell("latitude", CELL_PLACES), cell("longitude", CELL_PLACES)).alias(
            "unique_cells"
        ),
    )
    points = visits.groupBy("user_id", "latitude", "longitude").agg(
        F.sum("n").alias("n"), F.min("first_seen").alias("first_seen")
    )
    away = haversine_km("centroid_lat", "centroid_lon", "latitude", "longitude")
    spread = (
        points.join(base, "user_id")
        .withColumn("_d", away)
        .groupBy("user_id")
        .agg(F.sqrt(F.sum(F.col("_d") * F.col("_d") * F.col("n")) / F.sum("n")).alias("_spread"))
    )
    regions = points.groupBy(
        "user_id",
        cell("latitude", REGION_PLACES).alias("region_lat"),
        cell("longitude", REGION_PLACES).alias("region_lon"),
    ).agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"))
    # The most frequent region; the one seen first wins a tie.
    main = regions.groupBy("user_id").agg(
        F.min_by(
            F.struct("region_lat", "region_lon"), F.struct((-F.col("n")).alias("k"), "first_seen")
        ).alias("_r")
    )
    return (
        base.join(distinct, "user_id")
        .join(spread, "user_id")
        .join(main, "user_id")
        .select(
            "user_id",
            "total_checkins",
            "unique_locations",
            "unique_cells",
            "active_days",
            "centroid_lat",
            "centroid_lon",
            round_to("_spread", 2).alias("geo_spread_km"),
            F.col("_r.region_lat").alias("region_lat"),
            F.col("_r.region_lon").alias("region_lon"),
            cell_pair_label("_r.region_lat", "_r.region_lon", REGION_PLACES).alias("primary_region"),
        )
    )


def with_category(df: DataFrame, categories: DataFrame, key: str = "location_id") -> DataFrame:
    """Left lookup of a place category; places without one are ``unknown``."""
    looked_up = df.join(categories.select(key, F.col("category").alias("_c")), key, "left")
    return looked_up.withColumn("category", F.coalesce("_c", F.lit(UNKNOWN))).drop("_c")


def category_counts(visits: DataFrame, categories: DataFrame) -> DataFrame:
    """Visits per (user, known category) with the time each category was first seen."""
    known = with_category(visits, categories).filter(F.col("category") != UNKNOWN)
    return known.groupBy("user_id", "category").agg(
        F.sum("n").alias("n"), F.min("first_seen").alias("first_seen")
    )


def entropy_bits(count: str):
    """Shannon entropy of counts as one aggregate: log2(total) - sum(c log2 c) / total."""
    c = F.col(count).cast("double")
    return F.greatest(F.log2(F.sum(c)) - F.sum(c * F.log2(c)) / F.sum(c), F.lit(0.0))


def concentration(count: str):
    """Sum of squared shares as one aggregate."""
    c = F.col(count).cast("double")
    return F.sum(c * c) / (F.sum(c) * F.sum(c))


def profile_categories(counts: DataFrame, profiles: DataFrame, top: int = 5) -> DataFrame:
    """Per user: distinct categories, known share, entropy, concentration, top categories.

    ``top_categories`` is an array of (category, n), most frequent first, ties
    to the category seen first; its length is bounded by the category vocabulary.
    """
    ranked = F.sort_array(
        F.collect_list(F.struct((-F.col("n")).alias("k"), "first_seen", "category", "n"))
    )
    per_user = counts.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("unique_categories"),
        F.sum("n").alias("known_visits"),
        entropy_bits("n").alias("entropy"),
        concentration("n").alias("concentration"),
        ranked.alias("_ranked"),
    )
    joined = profiles.select("user_id", "total_checkins").join(per_user, "user_id", "left")
    top_items = F.transform(F.slice("_ranked", 1, top), lambda x: F.struct(x["category"], x["n"]))
    return joined.select(
        "user_id",
        F.coalesce("unique_categories", F.lit(0)).cast("long").alias("unique_categories"),
        F.coalesce("known_visits", F.lit(0)).cast("long").alias("known_visits"),
        ratio_or_zero("known_visits", "total_checkins").alias("known_ratio"),
        F.coalesce("entropy", F.lit(0.0)).alias("entropy"),
        F.coalesce("concentration", F.lit(0.0)).alias("concentration"),
        F.coalesce(top_items, F.array().cast("array<struct<category:string,n:bigint>>")).alias(
            "top_categories"
        ),
    )


def place_points(visits: DataFrame) -> DataFrame:
    """Median coordinate per place.

    Counts per distinct coordinate value come first. The middle values are found by running counts over the sorted
    values, which spill to disk, so no place has to fit in memory.
    """

    def median(value: str, out: str) -> DataFrame:
        counted = visits.where(F.col(value).isNotNull()).groupBy("location_id", value).agg(F.sum("n").alias("_n"))
        place = Window.partitionBy("location_id")
        upto = F.sum("_n").over(place.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
        running = counted.withColumns({"_upto": upto, "_all": F.sum("_n").over(place)})
        low = F.min(F.when(F.col("_upto") > F.expr("(_all - 1) div 2"), F.col(value)))
        high = F.min(F.when(F.col("_upto") > F.expr("_all div 2"), F.col(value)))
        return running.groupBy("location_id").agg(((low + high) / 2).alias(out))

    return median("latitude", "lat").join(median("longitude", "lon"), "location_id")


def first_points(visits: DataFrame) -> DataFrame:
    """First recorded coordinate per place."""
    first = F.min_by(F.struct("latitude", "longitude"), F.col("first_seen"))
    return visits.groupBy("location_id").agg(first.alias("_p")).select(
        "location_id", F.col("_p.latitude").alias("lat"), F.col("_p.longitude").alias("lon")
    )


def venue_dimension(rows: DataFrame, order: list[str]) -> DataFrame:
    """First category and mean coordinate per venue."""
    return rows.groupBy("location_id").agg(
        F.min_by(F.struct("category", "category_id"), F.struct(*order)).alias("_f"),
        F.avg("latitude").alias("latitude"),
        F.avg("longitude").alias("longitude"),
    ).select(
        "location_id",
        F.col("_f.category").alias("category"),
        F.col("_f.category_id").alias("category_id"),
        "latitude",
        "longitude",
    )


def popularity(visits: DataFrame, *by) -> DataFrame:
    """Check-ins per place or cell."""
    return visits.groupBy(*by).agg(F.sum("n").alias("popularity"))


def upper_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and the element at index n // 2 of the sorted values, per key.

    Distinct values are counted first; the pick then runs over running totals. Meant
    for rounded values such as distances with two decimals, whose number is bounded.
    """
    from pyspark.sql import Window

    counted = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumns(
        {"_upto": F.sum("_n").over(w), "_all": F.sum("_n").over(Window.partitionBy(key))}
    )
    return placed.groupBy(key).agg(
        (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("mean_value"),
        F.min(F.when(F.col("_upto") > F.floor(F.col("_all") / 2), F.col(value))).alias("upper_median"),
        F.max("_all").alias("n"),
    )

"""Overlap of two entities: shared places, shared hours, category similarity.

All joins run on (user, place) or (user, category) keys, which are unique on the
looked-up side. A popular place therefore never multiplies rows: the number of
rows is the number of places of the first user of each requested pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.functions.geo import haversine_km
from placewise.functions.numbers import ratio_or_zero, round_to
from placewise.functions.texts import UNKNOWN

from .profiles import with_category

PAIR = ["user_a", "user_b"]


def shared_keys(pairs: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys both users have, with each side's count ``n_a`` and ``n_b``."""
    a = counts.select(F.col("user_id").alias("user_a"), *keys, F.col("n").alias("n_a"))
    b = counts.select(F.col("user_id").alias("user_b"), *keys, F.col("n").alias("n_b"))
    return pairs.select(*PAIR).distinct().join(a, "user_a").join(b, ["user_b", *keys])


def overlap_counts(shared: DataFrame, prefix: str) -> DataFrame:
    """Number of shared keys per pair."""
    return shared.groupBy(*PAIR).agg(F.count(F.lit(1)).alias(prefix))


def co_occurrences(
    pairs: DataFrame, checkins: DataFrame, place: Sequence[str], out: str, tolerance_hours: int = 0
) -> DataFrame:
    """Check-ins of ``user_b`` at a place and hour where ``user_a`` checked in too.

    Both sides are counted per (user, place, hour) first. By default the same
    clock hour must match; a positive ``tolerance_hours`` also accepts the
    neighbouring clock hours.
    """
    hour = F.date_trunc("HOUR", F.col("ts"))
    hours = checkins.groupBy("user_id", *place, hour.alias("_hour")).agg(F.count(F.lit(1)).alias("n"))
    a = hours.select(F.col("user_id").alias("user_a"), *place, "_hour")
    if tolerance_hours:
        shifts = F.array(*[F.expr(f"INTERVAL '{h}' HOUR") for h in range(-tolerance_hours, tolerance_hours + 1)])
        a = a.withColumn("_shift", F.explode(shifts)).withColumn("_hour", F.col("_hour") + F.col("_shift"))
        a = a.drop("_shift").distinct()
    b = hours.select(F.col("user_id").alias("user_b"), *place, "_hour", "n")
    met = pairs.select(*PAIR).distinct().join(a, "user_a").join(b, ["user_b", *place, "_hour"])
    return met.groupBy(*PAIR).agg(F.sum("n").alias(out))


def both_profiles(pairs: DataFrame, profiles: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Attach the profile of both users with ``_a`` / ``_b`` suffixes."""
    for side in ("a", "b"):
        p = profiles.select(
            F.col("user_id").alias(f"user_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in columns]
        )
        pairs = pairs.join(p, f"user_{side}")
    return pairs


PROFILE_COLUMNS = (
    "total_checkins",
    "unique_locations",
    "unique_cells",
    "active_days",
    "centroid_lat",
    "centroid_lon",
    "geo_spread_km",
    "region_lat",
    "region_lon",
    "primary_region",
)


def pair_features(
    pairs: DataFrame, checkins: DataFrame, visits: DataFrame, profiles: DataFrame
) -> DataFrame:
    """Five pair measures on exact places, and the same on grid cells, per pair."""
    from placewise.functions.geo import cell

    from .profiles import CELL_PLACES

    place = ["location_id"]
    cells = ["cell_lat", "cell_lon"]
    place_counts = visits.groupBy("user_id", *place).agg(F.sum("n").alias("n"))
    cell_cols = {"cell_lat": cell("latitude", CELL_PLACES), "cell_lon": cell("longitude", CELL_PLACES)}
    cell_counts = visits.withColumns(cell_cols).groupBy("user_id", *cells).agg(F.sum("n").alias("n"))

    unique = pairs.select(*PAIR).distinct()
    wide = both_profiles(unique, profiles, PROFILE_COLUMNS)
    wide = wide.join(overlap_counts(shared_keys(unique, place_counts, place), "_shared"), PAIR, "left")
    wide = wide.join(overlap_counts(shared_keys(unique, cell_counts, cells), "_shared_cells"), PAIR, "left")
    wide = wide.join(co_occurrences(unique, checkins, place, "_met"), PAIR, "left")
    wide = wide.join(
        co_occurrences(unique, checkins.withColumns(cell_cols), cells, "_met_cells"), PAIR, "left"
    )

    def jaccard(shared: str, size: str):
        union = F.col(f"{size}_a") + F.col(f"{size}_b") - F.col(shared)
        return round_to(ratio_or_zero(shared, union), 4)

    wide = wide.fillna(0, ["_shared", "_shared_cells", "_met", "_met_cells"])
    apart = haversine_km("centroid_lat_a", "centroid_lon_a", "centroid_lat_b", "centroid_lon_b")
    same = (F.col("region_lat_a") == F.col("region_lat_b")) & (
        F.col("region_lon_a") == F.col("region_lon_b")
    )
    return wide.withColumns(
        {
            "shared_locations": F.col("_shared"),
            "jaccard_locations": jaccard("_shared", "unique_locations"),
            "centroid_distance_km": round_to(apart, 2),
            "same_region": same.cast("int"),
            "temporal_co_occurrences": F.col("_met"),
            "shared_cells": F.col("_shared_cells"),
            "jaccard_cells": jaccard("_shared_cells", "unique_cells"),
            "temporal_co_cells": F.col("_met_cells"),
        }
    ).drop("_shared", "_shared_cells", "_met", "_met_cells")


def pair_category_features(
    pairs: DataFrame, visits: DataFrame, categories: DataFrame, counts: DataFrame, category_profiles: DataFrame
) -> DataFrame:
    """Ten category measures per pair.

    The counts outside shared places are the full counts minus the counts at
    shared places, so only shared places are looked at again.
    """
    unique = pairs.select(*PAIR).distinct()
    zero = F.lit(0).cast("long")

    def side(user: str, column: str) -> DataFrame:
        own = counts.select(F.col("user_id").alias(user), "category", F.col("n"))
        columns = {c: F.col("n") if c == column else zero for c in ("n_a", "n_b", "s_a", "s_b")}
        return unique.join(own, user).withColumns(columns).drop("n")

    place_counts = visits.groupBy("user_id", "location_id").agg(F.sum("n").alias("n"))
    shared = shared_keys(unique, place_counts, ["location_id"])
    shared = with_category(shared, categories).filter(F.col("category") != UNKNOWN)
    shared = shared.select(
        *PAIR, "category", zero.alias("n_a"), zero.alias("n_b"),
        F.col("n_a").alias("s_a"), F.col("n_b").alias("s_b"),
    )
    rows = side("user_a", "n_a").unionByName(side("user_b", "n_b")).unionByName(shared)
    per_category = rows.groupBy(*PAIR, "category").agg(
        *[F.sum(c).alias(c) for c in ("n_a", "n_b", "s_a", "s_b")]
    )
    totals = category_profiles.select("user_id", F.greatest("known_visits", F.lit(1)).alias("t"))
    for s in ("a", "b"):
        t = totals.select(F.col("user_id").alias(f"user_{s}"), F.col("t").alias(f"t_{s}"))
        per_category = per_category.join(t, f"user_{s}")
    p, q = F.col("n_a") / F.col("t_a"), F.col("n_b") / F.col("t_b")
    middle = (p + q) / 2

    def divergence(x):
        return F.when(x > 0, x * F.log2(x / middle)).otherwise(F.lit(0.0))

    ns_a, ns_b = F.col("n_a") - F.col("s_a"), F.col("n_b") - F.col("s_b")

    def count_if(condition):
        return F.count(F.when(condition, 1))

    def cosine(x, y):
        size = F.sqrt(F.sum(x * x).cast("double")) * F.sqrt(F.sum(y * y).cast("double"))
        return F.coalesce(F.try_divide(F.sum(x * y).cast("double"), size), F.lit(0.0))

    per_pair = per_category.groupBy(*PAIR).agg(
        count_if((F.col("n_a") > 0) & (F.col("n_b") > 0)).alias("_both"),
        count_if((F.col("n_a") > 0) | (F.col("n_b") > 0)).alias("_any"),
        count_if(F.col("n_a") > 0).alias("_in_a"),
        count_if(F.col("n_b") > 0).alias("_in_b"),
        count_if((ns_a > 0) & (ns_b > 0)).alias("_ns_both"),
        count_if((ns_a > 0) | (ns_b > 0)).alias("_ns_any"),
        cosine(F.col("n_a"), F.col("n_b")).alias("_cosine"),
        cosine(ns_a, ns_b).alias("_ns_cosine"),
        (F.sum(divergence(p) + divergence(q)) / 2).alias("_js"),
    )
    tops = category_profiles.select("user_id", "top_categories")
    wide = both_profiles(unique, tops, ["top_categories"]).join(per_pair, PAIR, "left")

    def names(side_name: str, n: int):
        return F.transform(F.slice(f"top_categories_{side_name}", 1, n), lambda x: x["category"])

    first_a = F.try_element_at(names("a", 1), F.lit(1))
    first_b = F.try_element_at(names("b", 1), F.lit(1))

    def number(c: str):
        return F.coalesce(F.col(c), F.lit(0)).cast("long")

    def rounded(c):
        return round_to(F.coalesce(c, F.lit(0.0)), 4)

    return wide.select(
        *PAIR,
        number("_both").alias("shared_categories"),
        rounded(ratio_or_zero("_both", "_any")).alias("category_jaccard"),
        rounded(F.col("_cosine")).alias("category_cosine"),
        number("_in_a").alias("unique_categories_a"),
        number("_in_b").alias("unique_categories_b"),
        F.coalesce((first_a == first_b).cast("int"), F.lit(0)).alias("same_top_category"),
        rounded(ratio_or_zero("_ns_both", "_ns_any")).alias("non_shared_category_jaccard"),
        rounded(F.col("_ns_cosine")).alias("non_shared_category_cosine"),
        rounded(F.col("_js")).alias("category_js_divergence"),
        F.size(F.array_intersect(names("a", 3), names("b", 3))).cast("long").alias("top3_category_overlap"),
    )

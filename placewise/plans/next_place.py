"""Next place of a user: one true place against regional candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.functions.geo import cell, haversine_km
from placewise.functions.numbers import flag, ratio_or_zero, round_to
from placewise.functions.texts import UNKNOWN
from placewise.operators.history import array_mean, array_std, hold_out, last_n_array
from placewise.operators.profiles import (
    CELL_PLACES,
    REGION_PLACES,
    first_points,
    popularity,
    profile_categories,
    profile_users,
    visit_counts,
    with_category,
)
from placewise.operators.sampling import keep_per_case, probe, shuffled_position, split_in_proportion

from .levels import feature_names

N_NEGATIVES = 19
ORDER = ["ts", "event_id"]
NO_HOUR, NO_VISIT_HOUR = 12.0, -1.0

_REGION = ["region_lat", "region_lon"]


def _regions(lat: str, lon: str) -> dict[str, Column]:
    return {"region_lat": cell(lat, REGION_PLACES), "region_lon": cell(lon, REGION_PLACES)}


def neighbour_regions(last: DataFrame, venues: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """``(pools, index)``: candidate pools in the 3 x 3 regions around a user's last place.

    ``pools`` has one row per (user, region): its size, and how many pool members come
    before it; ``pool_size`` is the user's whole pool. ``index`` numbers the
    places of each region. The pools are never expanded, so their cost does not
    depend on how many places a region holds.
    """
    index = shuffled_position(
        venues.withColumns(_regions("lat", "lon")), ["location_id"], seed, _REGION, "_local", "_n"
    )
    sizes = index.groupBy(*_REGION).agg(F.max("_n").alias("_n"))
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    around = last.withColumns(_regions("latitude", "longitude"))
    around = around.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    around = around.withColumns(
        {"region_lat": F.col("region_lat") + F.col("_i"), "region_lon": F.col("region_lon") + F.col("_j")}
    ).drop("_i", "_j")
    pools = around.join(sizes, _REGION)
    w = Window.partitionBy("user_id").orderBy(*_REGION)  # at most nine rows
    pools = pools.withColumns(
        {
            "_before": F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"),
            "pool_size": F.sum("_n").over(Window.partitionBy("user_id")),
        }
    )
    return pools, index.select(*_REGION, "_local", "location_id", "lat", "lon")


def pool_sizes(last: DataFrame, venues: DataFrame, seed: str = "places") -> DataFrame:
    """Candidates per user: places in the 3 x 3 regions without the true one."""
    pools, _ = neighbour_regions(last, venues, seed)
    per_user = pools.groupBy("user_id", "location_id").agg(F.max("pool_size").alias("pool_size"))
    # The true place is a member unless its first recorded point lies elsewhere.
    home = venues.withColumns(_regions("lat", "lon")).select("location_id", *_REGION)
    inside = pools.join(home, ["location_id", *_REGION], "left_semi").select("user_id").distinct()
    inside = inside.withColumn("_in", F.lit(1))
    return per_user.join(inside, "user_id", "left").select(
        "user_id", (F.col("pool_size") - F.coalesce("_in", F.lit(0))).alias("n_candidates")
    )


def next_place_cases(
    checkins: DataFrame, users: DataFrame, n_train: int, n_test: int, seed: str,
    n_negatives: int = N_NEGATIVES,
) -> tuple[DataFrame, DataFrame]:
    """``(cases, history)`` for randomly chosen train and test users, fewer of both in proportion if the input has too few.

    A case row is (split, user, candidate place and point, label). The history
    is everything before each user's last check-in; it is what profiles are built on.
    """
    mine = checkins.join(users.select("user_id"), "user_id", "left_semi")
    last, history = hold_out(mine, ["user_id"], ORDER)
    last = last.select("user_id", "location_id", "latitude", "longitude")
    venues = first_points(visit_counts(mine))
    ready = pool_sizes(last, venues, seed).filter(F.col("n_candidates") >= n_negatives)
    chosen = split_in_proportion(ready.select("user_id"), ["user_id"], {"train": n_train, "test": n_test}, seed)

    truths = last.join(chosen, "user_id").withColumn("_truth", F.col("location_id"))
    pools, index = neighbour_regions(truths, venues, seed)
    per_user = pools.select("user_id", "split", "_truth", "pool_size").distinct()
    # One more probe than needed: at most one can hit the true place.
    probes = probe(per_user, ["user_id"], "pool_size", F.lit(n_negatives + 1), seed)
    # Which of the (at most nine) regions a probe falls into, and where in it.
    spots = pools.select("user_id", *_REGION, "_before", "_n")
    parts = spots.groupBy("user_id").agg(F.collect_list(F.struct(*_REGION, "_before", "_n")).alias("_parts"))
    hit = F.filter(
        "_parts",
        lambda r: (F.col("probe_pos") >= r["_before"]) & (F.col("probe_pos") < r["_before"] + r["_n"]),
    )
    located = probes.join(parts, "user_id").withColumn("_hit", F.try_element_at(hit, F.lit(1)))
    located = located.select(
        "user_id", "split", "_truth", "probe_pos", *[F.col("_hit")[c].alias(c) for c in _REGION],
        (F.col("probe_pos") - F.col("_hit._before")).alias("_local"),
    )
    here = truths.select("user_id", "latitude", "longitude")
    is_truth = F.col("probe_pos") == -1
    rows = located.join(index, [*_REGION, "_local"], "left").filter(
        is_truth | (F.col("location_id") != F.col("_truth"))
    )
    rows = rows.join(here, "user_id").select(
        "split", "user_id",
        F.when(is_truth, F.col("_truth")).otherwise(F.col("location_id")).alias("location_id"),
        F.when(is_truth, F.col("latitude")).otherwise(F.col("lat")).alias("lat"),
        F.when(is_truth, F.col("longitude")).otherwise(F.col("lon")).alias("lon"),
        is_truth.cast("int").alias("label"),
    )
    cases = keep_per_case(rows, ["user_id"], ["location_id"], n_negatives, seed)
    return cases, history.join(chosen, "user_id")


def next_place_features(
    cases: DataFrame,
    history: DataFrame,
    train_checkins: DataFrame,
    tier: str,
    categories: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Feature table of the top level for one tier.

    ``history`` holds the check-ins before each hold-out, ``train_checkins`` all
    check-ins of the training users (for popularity), ``counts`` the category
    counts of the histories (enriched tier only).
    """
    visits = visit_counts(history)
    profiles = profile_users(visits)
    cell_cols = {"_cy": cell("latitude", CELL_PLACES), "_cx": cell("longitude", CELL_PLACES)}
    rows = cases.withColumns({"_cy": cell("lat", CELL_PLACES), "_cx": cell("lon", CELL_PLACES)})
    if tier == "latlng":
        place = ["_cy", "_cx"]
        keyed_history, unique = history.withColumns(cell_cols), "unique_cells"
    else:
        place = ["location_id"]
        keyed_history, unique = history, "unique_locations"
    popular = train_checkins.withColumns(cell_cols).groupBy(*place).agg(
        F.count(F.lit(1)).alias("_popularity")
    )
    visited = keyed_history.groupBy("user_id", *place).agg(
        F.count(F.lit(1)).alias("_visits"), F.avg(F.hour("ts")).alias("_visit_hour")
    )
    recent_fields = ["latitude", "longitude", "ts"]
    if tier == "enriched":
        history = with_category(history, categories)
        recent_fields.append("category")
    recent = last_n_array(history, ["user_id"], ORDER, 15, recent_fields, "_recent")

    rows = (
        rows.join(profiles, "user_id")
        .join(popular, place, "left")
        .join(visited, ["user_id", *place], "left")
        .join(recent, "user_id", "left")
    )
    n_recent = F.size("_recent")
    # slice() by the last five would be empty for shorter arrays, so count from the front.
    last5 = F.slice("_recent", F.greatest(n_recent - 4, F.lit(1)), F.lit(5))
    km = F.transform(last5, lambda c: haversine_km(c["latitude"], c["longitude"], F.col("lat"), F.col("lon")))
    hours = F.transform("_recent", lambda c: F.hour(c["ts"]))
    rows = rows.withColumn("_km", km)
    zero = F.lit(0.0)
    columns: dict[str, Column] = {
        "user_checkins": F.col("total_checkins").cast("double"),
        "user_places": F.col(unique).cast("double"),
        "popularity": F.coalesce("_popularity", F.lit(0)).cast("double"),
        "in_main_region": flag(
            (cell("lat", REGION_PLACES) == F.col("region_lat"))
            & (cell("lon", REGION_PLACES) == F.col("region_lon"))
        ),
        "distance_to_centre": round_to(haversine_km("centroid_lat", "centroid_lon", "lat", "lon"), 2),
        "geo_spread": F.col("geo_spread_km"),
        "active_days_f": F.col("active_days").cast("double"),
        "visited": flag(F.col("_visits") > 0),
        "visits": F.coalesce("_visits", F.lit(0)).cast("double"),
        "distance_to_last": F.coalesce(F.try_element_at("_km", F.lit(-1)), zero),
        "recent_min_km": F.coalesce(F.array_min("_km"), zero),
        "recent_mean_km": F.coalesce(array_mean(F.col("_km")), zero),
        "recent_last_km": F.coalesce(F.try_element_at("_km", F.lit(-1)), zero),
        "mean_hour": F.coalesce(array_mean(hours), F.lit(NO_HOUR)),
        "std_hour": F.coalesce(array_std(hours), zero),
        "mean_visit_hour": F.coalesce("_visit_hour", F.lit(NO_VISIT_HOUR)),
    }
    if tier == "enriched":
        rows = with_category(rows, categories).withColumnRenamed("category", "_cat")
        cat_profiles = profile_categories(counts, profiles, 1)
        rows = rows.join(
            cat_profiles.select(
                "user_id",
                F.col("entropy").alias("_entropy"),
                F.col("known_visits").alias("_known"),
                F.try_element_at("top_categories", F.lit(1))["category"].alias("_top"),
            ),
            "user_id",
            "left",
        )
        own = counts.select("user_id", F.col("category").alias("_cat"), F.col("n").alias("_cat_n"))
        rows = rows.join(own, ["user_id", "_cat"], "left")
        known = F.col("_cat") != UNKNOWN
        same = F.size(F.filter("_recent", lambda c: c["category"] == F.col("_cat")))
        columns |= {
            "cat_known": flag(known),
            "cat_in_profile": flag(F.col("_cat_n") > 0),
            "cat_is_top": flag(known & (F.col("_top") == F.col("_cat"))),
            "cat_entropy": F.coalesce("_entropy", zero),
            "cat_visits": F.coalesce("_cat_n", F.lit(0)).cast("double"),
            "cat_share": ratio_or_zero(F.coalesce("_cat_n", F.lit(0)), "_known"),
            "recent_same_cat": F.when(known, same).otherwise(0).cast("double"),
        }
    names = feature_names("next_place", tier)
    return rows.select("split", "user_id", "location_id", "label", *[columns[c].alias(c) for c in names])

"""Feature columns per task, tier and context level.

A feature table holds the columns of the highest level once; a lower level is
a projection of it. ``enriched`` marks the columns that need place categories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

LEVELS = ("G0", "G1", "G2", "G3", "G4")

# Each level lists the columns it adds, in order.
FRIENDSHIP_VENUE = {
    "G0": ["checkins_a", "checkins_b", "checkins_sum"],
    "G1": ["same_region_f", "centroid_distance", "region_match"],
    "G2": ["locations_a", "locations_b", "shared_locs", "jaccard_locs"],
    "G3": ["spread_a", "spread_b", "days_a", "days_b"],
    "G4": ["co_occurrences", "scaled_distance", "weighted_jaccard"],
}
FRIENDSHIP_LATLNG = {
    "G0": FRIENDSHIP_VENUE["G0"],
    "G1": FRIENDSHIP_VENUE["G1"],
    "G2": ["cells_a", "cells_b", "shared_cells_f", "jaccard_cells_f", "spread_a", "spread_b"],
    "G3": ["days_a", "days_b"],
    "G4": ["co_cells", "scaled_distance", "weighted_jaccard_cells"],
}
FRIENDSHIP_ENRICHED = {
    "G0": FRIENDSHIP_VENUE["G0"],
    "G1": FRIENDSHIP_VENUE["G1"] + ["same_top_cat", "entropy_a", "entropy_b", "top3_overlap"],
    "G2": FRIENDSHIP_VENUE["G2"]
    + ["shared_cats", "cat_jaccard", "cats_a", "cats_b", "ns_cat_jaccard", "cat_js"]
    + ["concentration_a", "concentration_b"],
    "G3": FRIENDSHIP_VENUE["G3"],
    "G4": FRIENDSHIP_VENUE["G4"] + ["cat_cosine", "ns_cat_cosine"],
}
NEXT_PLACE = {
    "G0": ["user_checkins", "user_places", "popularity"],
    "G1": ["in_main_region", "distance_to_centre"],
    "G2": ["geo_spread", "active_days_f", "visited", "visits", "distance_to_last"],
    "G3": ["recent_min_km", "recent_mean_km", "recent_last_km"],
    "G4": ["mean_hour", "std_hour", "mean_visit_hour"],
}
NEXT_PLACE_ENRICHED = {
    "G0": NEXT_PLACE["G0"],
    "G1": NEXT_PLACE["G1"] + ["cat_known", "cat_in_profile", "cat_is_top"],
    "G2": NEXT_PLACE["G2"] + ["cat_entropy", "cat_visits", "cat_share"],
    "G3": NEXT_PLACE["G3"] + ["recent_same_cat"],
    "G4": NEXT_PLACE["G4"],
}
OD_RANKING = {
    "G0": ["origin_trips", "origin_dropoffs", "popularity"],
    "G1": ["same_borough", "distance_km_f"],
    "G2": ["geo_spread", "active_days_f", "visited", "od_trips", "distance_to_last"],
    "G3": ["recent_min_km", "recent_mean_km", "recent_last_km"],
    "G4": ["mean_hour", "std_hour", "mean_od_hour"],
}
OD_RANKING_ENRICHED = {
    "G0": OD_RANKING["G0"],
    "G1": OD_RANKING["G1"] + ["origin_cat_known", "cand_cat_known", "cand_cat_at_origin"],
    "G2": OD_RANKING["G2"] + ["origin_cat_entropy", "cand_cat_count", "cand_cat_share"],
    "G3": OD_RANKING["G3"] + ["recent_same_cat"],
    "G4": OD_RANKING["G4"],
}
DURATION = {
    "G0": ["origin_trips", "dest_trips", "origin_mean_min", "dest_mean_min"],
    "G1": ["origin_id", "dest_id", "same_borough", "distance_km_f"],
    "G2": ["geo_spread", "active_days_f", "od_trips", "od_mean_min", "trip_km"],
    "G3": ["recent_min", "recent_mean", "recent_last"],
    "G4": ["hour_f", "dow_f", "hour_mean_min", "hour_std_min"],
}
DURATION_ENRICHED = {
    "G0": DURATION["G0"],
    "G1": DURATION["G1"] + ["origin_cat_known", "dest_cat_known", "same_main_cat"],
    "G2": DURATION["G2"] + ["origin_cat_entropy", "dest_cat_entropy", "shared_cats"],
    "G3": DURATION["G3"] + ["recent_same_cat_min"],
    "G4": DURATION["G4"],
}
REVIEW = {
    "G0": ["n_categories", "name_length", "prior"],
    "G1": ["in_main_city", "city_share", "city_stars"],
    "G2": ["cat_overlap", "cat_stars", "cat_visits", "user_stars", "user_std"],
    "G3": ["recent_stars", "recent_std", "recent_match", "recent_slope", "recent_streak"]
    + ["recent_categories", "last5_stars"],
    "G4": ["distance_km_f", "mean_radius_km", "distance_rank", "mean_gap_days", "weekend_share"],
}

REGISTRY: dict[tuple[str, str], dict[str, list[str]]] = {
    ("friendship", "venue_id"): FRIENDSHIP_VENUE,
    ("friendship", "latlng"): FRIENDSHIP_LATLNG,
    ("friendship", "enriched"): FRIENDSHIP_ENRICHED,
    ("next_place", "venue_id"): NEXT_PLACE,
    ("next_place", "latlng"): NEXT_PLACE,
    ("next_place", "enriched"): NEXT_PLACE_ENRICHED,
    ("od_ranking", "zone_id"): OD_RANKING,
    ("od_ranking", "latlng"): OD_RANKING,
    ("od_ranking", "enriched"): OD_RANKING_ENRICHED,
    ("duration", "zone_id"): DURATION,
    ("duration", "latlng"): DURATION,
    ("duration", "enriched"): DURATION_ENRICHED,
    ("rating", "reviews"): REVIEW,
    ("next_business", "reviews"): REVIEW,
}

_PLAIN_TIER = {"friendship": "venue_id", "next_place": "venue_id", "od_ranking": "zone_id", "duration": "zone_id"}


def feature_names(task: str, tier: str, level: str = "G4") -> list[str]:
    """Ordered columns of a level, lower levels first."""
    added = REGISTRY[(task, tier)]
    return [c for g in LEVELS[: LEVELS.index(level) + 1] for c in added[g]]


def enriched_names(task: str, level: str = "G4") -> list[str]:
    """Columns of the enriched tier that need place categories."""
    plain = set(feature_names(task, _PLAIN_TIER[task], level))
    return [c for c in feature_names(task, "enriched", level) if c not in plain]


def at_level(features: DataFrame, task: str, tier: str, level: str, keys: list[str]) -> DataFrame:
    """Project a feature table to one level; unread columns are pruned from the plan."""
    return features.select(*keys, *feature_names(task, tier, level))


def without_enrichment(features: DataFrame, task: str, level: str, keys: list[str]) -> DataFrame:
    """The enriched table of a level with its enrichment columns left out."""
    drop = set(enriched_names(task, level))
    kept = [c for c in feature_names(task, "enriched", level) if c not in drop]
    return features.select(*keys, *kept)

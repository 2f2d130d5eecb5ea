"""Friendship between two users: case building and features in three tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.numbers import floored_ratio, hash_draw, permutation_keys, permuted
from placewise.operators.filters import both_ends, without_pairs
from placewise.operators.pairs import PAIR, pair_category_features, pair_features
from placewise.operators.sampling import shuffled_position, split_in_proportion, take_first, take_shuffled
from placewise.session import stage

from .levels import feature_names

MIN_CHECKINS = 20
MIN_KNOWN_SHARE = 0.8
MIN_REGION_USERS = 5


def positives(edges: DataFrame, users: DataFrame) -> DataFrame:
    """Friend pairs of two eligible users."""
    pairs = edges.select(F.col("a").alias("user_a"), F.col("b").alias("user_b"))
    return both_ends(pairs, users, "user_id", "user_a", "user_b")


_BLOCK = 1024


def _pair_numbers(pools: DataFrame, group: Sequence[str], seed: str) -> DataFrame:
    """Rows (group, _j) to the ``_j``-th pair of the group's pool in a seeded order: positions _x < _y.

    The pairs of a pool of P users are numbered 0 .. P(P-1)/2 - 1; the order is a permutation of the numbers keyed by the group.
    """
    keys = permutation_keys(seed, *group) if group else permutation_keys(seed, F.lit("all"))
    y = F.floor((1 + F.sqrt(1 + 8 * F.col("_k").cast("double"))) / 2).cast("long")
    rows = pools.withColumn("_k", permuted("_j", "_pairs", keys)).withColumn("_y", y)
    # The root is a double: put right what it may miss by one.
    below = F.expr("_y * (_y - 1) div 2")
    rows = rows.withColumn("_y", F.when(below > F.col("_k"), F.col("_y") - 1).when(below + F.col("_y") <= F.col("_k"), F.col("_y") + 1).otherwise(F.col("_y")))
    return rows.withColumn("_x", F.col("_k") - F.expr("_y * (_y - 1) div 2"))


def _non_friends(placed: DataFrame, edges: DataFrame, group: Sequence[str], n: int, seed: str) -> DataFrame:
    """``min(n, available)`` distinct pairs of one group who are not friends.

    Every group's pairs are walked in a seeded order without replacement, the same number of steps in each
    group; if too few non-friends were met, the walk goes on with twice as many steps until ``n`` are found
    or all pairs are used up. Steps beyond a group's pairs are never made.
    """
    pools = stage(
        placed.groupBy(*group).agg(F.max("pool_size").alias("_size")).withColumn("_pairs", F.expr("_size * (_size - 1) div 2"))
        .where("_pairs > 0"),
        "pools",
    )
    x = placed.select(*group, F.col("pos").alias("_x"), F.col("user_id").alias("u"))
    y = placed.select(*group, F.col("pos").alias("_y"), F.col("user_id").alias("v"))
    groups, total, most = pools.agg(F.count("*"), F.coalesce(F.sum("_pairs"), F.lit(0)), F.coalesce(F.max("_pairs"), F.lit(0))).first()
    done, steps, found, kept = 0, -(-5 * n // (4 * max(groups, 1))) + 1, 0, None
    while total and found < n and done < most:
        upto = min(done + steps, most)
        blocks = pools.withColumn("_last", F.least(F.col("_pairs"), F.lit(upto))).where(F.col("_last") > done).withColumn(
            "_block", F.explode(F.expr(f"sequence({done}L, _last - 1, {_BLOCK}L)"))
        )
        # Blocks are spread before they become rows: one group may want very many.
        steps_taken = blocks.repartition(*group, "_block").withColumn(
            "_j", F.explode(F.expr(f"sequence(_block, least(_block + {_BLOCK} - 1, _last - 1))"))
        )
        drawn = _pair_numbers(steps_taken, group, seed).join(x, [*group, "_x"]).join(y, [*group, "_y"])
        order = hash_draw(f"{seed}o", *group) if group else F.lit(0)
        pairs = drawn.select(F.least("u", "v").alias("user_a"), F.greatest("u", "v").alias("user_b"), "_j", order.alias("_o"))
        met = stage(without_pairs(pairs, edges, *PAIR), "non-friends")
        kept = met if kept is None else kept.union(met)
        found += met.count()
        done, steps = upto, 2 * steps
    if kept is None:
        kept = edges.select(F.col("a").alias("user_a"), F.col("b").alias("user_b"), F.lit(0).alias("_j"), F.lit(0).alias("_o")).limit(0)
    return take_first(kept, ["_j", "_o", *PAIR], n).select(*PAIR)


def random_non_friends(users: DataFrame, edges: DataFrame, n: int, seed: str) -> DataFrame:
    """``min(n, available)`` distinct pairs of eligible users who are not friends."""
    return _non_friends(shuffled_position(users.select("user_id"), ["user_id"], seed), edges, (), n, seed)


def regional_non_friends(
    profiles: DataFrame, edges: DataFrame, n: int, seed: str, min_users: int = MIN_REGION_USERS
) -> DataFrame:
    """``min(n, available)`` non-friend pairs whose users share their main region.

    Regions with at least ``min_users`` users take turns. Indexes are built in hash slots per region, so a region
    with a large part of all users spreads over many tasks.
    """
    region = ["region_lat", "region_lon"]
    placed = shuffled_position(profiles.select("user_id", *region), ["user_id"], seed, region)
    return _non_friends(placed.filter(F.col("pool_size") >= min_users), edges, region, n, seed)


def region_sizes(profiles: DataFrame, min_users: int = MIN_REGION_USERS) -> DataFrame:
    """Users per main region, regions with at least ``min_users``."""
    sizes = profiles.groupBy("primary_region").agg(F.count(F.lit(1)).alias("n_users"))
    return sizes.filter(F.col("n_users") >= min_users)


def labelled(pos: DataFrame, neg: DataFrame) -> DataFrame:
    """Positives (label 1) and negatives (label 0) as one table."""
    return pos.select(*PAIR, F.lit(1).alias("label")).unionByName(
        neg.select(*PAIR, F.lit(0).alias("label"))
    )


def friendship_cases(edges: DataFrame, users: DataFrame, n_each: int, seed: str) -> DataFrame:
    """``n_each`` friend pairs and as many random non-friend pairs of eligible users."""
    pos = take_shuffled(positives(edges, users), PAIR, n_each, seed)
    return labelled(pos, random_non_friends(users, edges, n_each, seed))


def friendship_slices(edges: DataFrame, users: DataFrame, n_train: int, n_test: int, seed: str) -> DataFrame:
    """Disjoint training and test pairs (``split``), half of each friends; fewer of all kinds in proportion if there are too few friends."""
    halves = {"train": n_train // 2, "test": n_test // 2}
    pos = stage(split_in_proportion(positives(edges, users), PAIR, halves, seed), "friend-slices")
    drawn = random_non_friends(users, edges, pos.count(), seed)
    neg = split_in_proportion(drawn, PAIR, halves, seed)
    return pos.select(*PAIR, F.lit(1).alias("label"), "split").unionByName(neg.select(*PAIR, F.lit(0).alias("label"), "split"))


def hard_friendship_cases(edges: DataFrame, profiles: DataFrame, n_each: int, seed: str) -> DataFrame:
    """``n_each`` friend pairs and as many non-friend pairs from the same region."""
    pos = take_shuffled(positives(edges, profiles), PAIR, n_each, seed)
    return labelled(pos, regional_non_friends(profiles, edges, n_each, seed))


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def _common_columns() -> dict[str, Column]:
    reach = F.col("geo_spread_km_a") + F.col("geo_spread_km_b")
    return {
        "checkins_a": _d("total_checkins_a"),
        "checkins_b": _d("total_checkins_b"),
        "checkins_sum": (F.col("total_checkins_a") + F.col("total_checkins_b")).cast("double"),
        "same_region_f": _d("same_region"),
        "centroid_distance": F.col("centroid_distance_km"),
        # The feature set carries the region match twice on purpose.
        "region_match": (F.col("primary_region_a") == F.col("primary_region_b")).cast("double"),
        "spread_a": F.col("geo_spread_km_a"),
        "spread_b": F.col("geo_spread_km_b"),
        "days_a": _d("active_days_a"),
        "days_b": _d("active_days_b"),
        "scaled_distance": floored_ratio("centroid_distance_km", reach),
    }


def _venue_columns() -> dict[str, Column]:
    return {
        "locations_a": _d("unique_locations_a"),
        "locations_b": _d("unique_locations_b"),
        "shared_locs": _d("shared_locations"),
        "jaccard_locs": F.col("jaccard_locations"),
        "co_occurrences": _d("temporal_co_occurrences"),
        "weighted_jaccard": F.col("jaccard_locations") * (F.col("temporal_co_occurrences") + 1),
    }


def _cell_columns() -> dict[str, Column]:
    return {
        "cells_a": _d("unique_cells_a"),
        "cells_b": _d("unique_cells_b"),
        "shared_cells_f": _d("shared_cells"),
        "jaccard_cells_f": F.col("jaccard_cells"),
        "co_cells": _d("temporal_co_cells"),
        "weighted_jaccard_cells": F.col("jaccard_cells") * (F.col("temporal_co_cells") + 1),
    }


def _category_columns() -> dict[str, Column]:
    return {
        "same_top_cat": _d("same_top_category"),
        "entropy_a": F.col("cat_entropy_a"),
        "entropy_b": F.col("cat_entropy_b"),
        "top3_overlap": _d("top3_category_overlap"),
        "shared_cats": _d("shared_categories"),
        "cat_jaccard": F.col("category_jaccard"),
        "cats_a": _d("unique_categories_a"),
        "cats_b": _d("unique_categories_b"),
        "ns_cat_jaccard": F.col("non_shared_category_jaccard"),
        "cat_js": F.col("category_js_divergence"),
        "concentration_a": F.col("cat_concentration_a"),
        "concentration_b": F.col("cat_concentration_b"),
        "cat_cosine": F.col("category_cosine"),
        "ns_cat_cosine": F.col("non_shared_category_cosine"),
    }


def friendship_features(cases: DataFrame, measures: DataFrame, tier: str) -> DataFrame:
    """Feature table of the top level; ``measures`` comes from :func:`pair_measures`."""
    columns = _common_columns()
    if tier == "latlng":
        columns |= _cell_columns()
    else:
        columns |= _venue_columns()
    if tier == "enriched":
        columns |= _category_columns()
    rows = cases.select(*PAIR, "label").join(measures, PAIR)
    names = feature_names("friendship", tier)
    return rows.select(*PAIR, "label", *[columns[c].alias(c) for c in names])


def pair_measures(
    pairs: DataFrame, checkins: DataFrame, visits: DataFrame, profiles: DataFrame,
    categories: DataFrame | None = None, counts: DataFrame | None = None,
    category_profiles: DataFrame | None = None,
) -> DataFrame:
    """All pair measures; the category ones when categories are given."""
    measures = pair_features(pairs, checkins, visits, profiles)
    if categories is None:
        return measures
    cats = pair_category_features(pairs, visits, categories, counts, category_profiles)
    for s in ("a", "b"):
        extra = category_profiles.select(
            F.col("user_id").alias(f"user_{s}"),
            F.col("entropy").alias(f"cat_entropy_{s}"),
            F.col("concentration").alias(f"cat_concentration_{s}"),
        )
        measures = measures.join(extra, f"user_{s}")
    return measures.join(cats, PAIR)

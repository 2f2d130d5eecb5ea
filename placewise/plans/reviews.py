"""Review tasks: predicting the stars of a review, and ranking the next business."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.geo import haversine_km
from placewise.functions.numbers import flag, ratio_or_zero, round_to
from placewise.functions.texts import split_list, split_set
from placewise.operators.filters import active_entities, first_per_key
from placewise.operators.history import (
    array_mean,
    array_slope,
    array_std,
    hold_out,
    last_n_array,
    streak,
)
from placewise.operators.sampling import keep_per_case, permute, probe, shuffled_position, take_shuffled
from placewise.session import stage

from .levels import feature_names

ORDER = ["review_date", "review_id"]
MIN_REVIEWS = 20
N_NEGATIVES = 19
MAX_RECENT = 15
DEFAULT_STARS = 3.0
BUSINESS = ["business_name", "categories", "city", "latitude", "longitude"]


def eligible_users(reviews: DataFrame, min_reviews: int = MIN_REVIEWS, without: DataFrame | None = None) -> DataFrame:
    """Users with enough reviews, minus the users of another case set."""
    users = active_entities(reviews, "user_id", min_reviews)
    if without is not None:
        users = users.join(without.select("user_id"), "user_id", "left_anti")
    return users


def rating_cases(
    reviews: DataFrame, users: DataFrame, n_held: int = 3, all_targets: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``(cases, history)``: the last ``n_held`` reviews are held out of the history.

    The target is the newest held review, or each of them with ``all_targets``.
    """
    mine = stage(reviews.join(users.select("user_id"), "user_id", "left_semi"), "case-reviews")
    held, history = hold_out(mine, ["user_id"], ORDER, n_held)
    targets = held if all_targets else held.filter(F.col("rn") == 1)
    return targets.withColumn("case_id", F.concat_ws("-", "user_id", "rn")).drop("rn"), history


def next_business_cases(
    reviews: DataFrame, users: DataFrame, seed: str, n_negatives: int = N_NEGATIVES
) -> tuple[DataFrame, DataFrame]:
    """``(candidates, history)``: the last business against businesses never reviewed.

    Candidates carry ``pos``, their place in a random order, and ``label``.
    A user for whom too few businesses are left has no case.
    """
    mine = stage(reviews.join(users.select("user_id"), "user_id", "left_semi"), "case-reviews")
    held, history = hold_out(mine, ["user_id"], ORDER, 1)
    index = shuffled_position(reviews.select("business_id").distinct(), ["business_id"], seed)
    visited = mine.select("user_id", "business_id").distinct()
    n_visited = visited.groupBy("user_id").agg(F.count(F.lit(1)).alias("_visited"))
    size = index.select(F.max("pool_size")).scalar()
    cases = held.select("user_id", F.col("business_id").alias("_truth")).join(n_visited, "user_id").withColumn("_size", size)
    # As many probes more as the user has businesses that must be thrown out.
    probes = probe(cases, ["user_id"], "_size", F.col("_visited") + n_negatives, seed, "pos")
    is_truth = F.col("pos") == -1
    drawn = probes.select("user_id", "_truth", "pos").join(index, "pos", "left").select(
        "user_id",
        F.when(is_truth, F.col("_truth")).otherwise(F.col("business_id")).alias("business_id"),
        is_truth.cast("int").alias("label"),
        # NULL for the truth, which must not meet the user's own reviews.
        F.col("business_id").alias("_drawn"),
    )
    unseen = drawn.join(visited.withColumnRenamed("business_id", "_drawn"), ["user_id", "_drawn"], "left_anti")
    both = keep_per_case(
        unseen.drop("_drawn"), ["user_id"], ["business_id"], n_negatives, seed, require=n_negatives
    )
    both = stage(permute(both, ["user_id"], ["business_id"], seed), "business-candidates")
    # Only the rows of drawn businesses are looked at for their first one.
    drawn_rows = reviews.select("business_id", *BUSINESS, *ORDER).join(both.select("business_id").distinct(), "business_id", "left_semi")
    businesses = first_per_key(drawn_rows, ["business_id"], ORDER)
    candidates = both.join(businesses.select("business_id", *BUSINESS), "business_id")
    return candidates.withColumn("case_id", F.concat_ws("-", "user_id", "business_id")), history


def listwise(candidates: DataFrame, case: str = "user_id", item: str = "business_id") -> DataFrame:
    """One row per case: candidate array in position order, and the truth's position."""
    packed = F.sort_array(F.collect_list(F.struct("pos", item)))
    return candidates.groupBy(case).agg(
        F.transform(packed, lambda c: c[item]).alias("candidates"),
        F.max(F.when(F.col("label") == 1, F.col("pos"))).alias("truth_pos"),
    )


def pointwise(cases: DataFrame, case: str = "user_id", item: str = "business_id") -> DataFrame:
    """One row per candidate with its position and label."""
    rows = cases.select(case, "truth_pos", F.posexplode("candidates").alias("pos", item))
    return rows.select(case, item, "pos", (F.col("pos") == F.col("truth_pos")).cast("int").alias("label"))


def category_profile(history: DataFrame) -> DataFrame:
    """Reviews and mean stars (1 decimal) per user and listed category."""
    rows = history.select(
        "user_id", "stars", *ORDER, F.explode(split_list("categories")).alias("category")
    )
    return rows.groupBy("user_id", "category").agg(
        F.count(F.lit(1)).alias("n"),
        round_to(F.avg("stars"), 1).alias("avg_stars"),
        F.min(F.struct(*ORDER)).alias("first_seen"),
    )


def review_features(cases: DataFrame, history: DataFrame, prior: float) -> DataFrame:
    """Feature table of the top level for (user, business) cases.

    ``prior`` is the uninformed guess carried as a constant feature. The table
    also holds ``n_history`` for the compact summary.
    """
    people = cases.select("user_id").distinct()
    history = history.join(people, "user_id", "left_semi")
    users = history.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_history"),
        F.avg("stars").alias("_stars"),
        F.stddev_pop("stars").alias("_std"),
        F.datediff(F.max("review_date"), F.min("review_date")).alias("_days"),
        F.avg((F.weekday("review_date") >= 5).cast("double")).alias("_weekend"),
        F.avg(F.when(F.col("latitude") != 0, F.col("latitude"))).alias("_ulat"),
        F.avg(F.when(F.col("longitude") != 0, F.col("longitude"))).alias("_ulon"),
    )
    cities = history.groupBy("user_id", "city").agg(
        F.count(F.lit(1)).alias("_city_n"),
        F.avg("stars").alias("_city_stars"),
        F.min(F.struct(*ORDER)).alias("_first"),
    )
    main_city = cities.groupBy("user_id").agg(
        F.min_by("city", F.struct((-F.col("_city_n")).alias("k"), "_first")).alias("_main_city")
    )
    recent_rows = history.withColumn("_cats", split_list("categories"))
    recent = last_n_array(recent_rows, ["user_id"], ORDER, MAX_RECENT, ["stars", "_cats"], "_recent")

    rows = cases.withColumn("_list", split_list("categories")).withColumn("_set", F.array_distinct("_list"))
    matched = (
        rows.select("case_id", "user_id", F.explode("_set").alias("category"))
        .join(category_profile(history).drop("first_seen"), ["user_id", "category"])
        .groupBy("case_id")
        .agg(
            F.count(F.lit(1)).alias("_matched"),
            F.avg("avg_stars").alias("_cat_stars"),
            F.sum("n").alias("_cat_n"),
        )
    )
    rows = (
        rows.join(users, "user_id", "left")
        .join(main_city, "user_id", "left")
        .join(cities.drop("_first"), ["user_id", "city"], "left")
        .join(recent, "user_id", "left")
        .join(matched, "case_id", "left")
        .withColumn("_km", haversine_km("_ulat", "_ulon", "latitude", "longitude"))
    )
    # Distance rank: history points are counted per coordinate first, so the
    # join grows with a user's distinct places, not with their reviews.
    points = (
        history.filter(F.col("latitude") != 0)
        .groupBy("user_id", "latitude", "longitude")
        .agg(F.count(F.lit(1)).alias("_n"))
        .join(users.select("user_id", "_ulat", "_ulon"), "user_id")
        .select("user_id", "_n", haversine_km("_ulat", "_ulon", "latitude", "longitude").alias("_d"))
    )
    ranks = (
        rows.select("case_id", "user_id", "_km")
        .join(points, "user_id")
        .groupBy("case_id")
        .agg(
            (F.sum(F.col("_d") * F.col("_n")) / F.sum("_n")).alias("_radius"),
            (F.sum(F.when(F.col("_d") <= F.col("_km") + 1e-9, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("_rank"),
        )
    )
    rows = rows.join(ranks, "case_id", "left")

    stars = F.transform("_recent", lambda r: r["stars"])
    hit = lambda r: F.arrays_overlap(r["_cats"], F.col("_set"))
    last5 = F.slice(stars, F.greatest(F.size(stars) - 4, F.lit(1)), F.lit(5))
    zero = F.lit(0.0)
    user_stars = F.coalesce("_stars", F.lit(DEFAULT_STARS))
    columns: dict[str, Column] = {
        "n_categories": F.size("_list").cast("double"),
        "name_length": F.length("business_name").cast("double"),
        "prior": F.lit(prior),
        "in_main_city": flag(F.col("city") == F.col("_main_city")),
        "city_share": ratio_or_zero(F.coalesce("_city_n", F.lit(0)), "n_history"),
        "city_stars": F.coalesce("_city_stars", F.lit(DEFAULT_STARS)),
        "cat_overlap": ratio_or_zero(F.coalesce("_matched", F.lit(0)), F.size("_set")),
        "cat_stars": F.coalesce("_cat_stars", user_stars),
        "cat_visits": F.coalesce("_cat_n", F.lit(0)).cast("double"),
        "user_stars": user_stars,
        "user_std": F.coalesce("_std", zero),
        "recent_stars": F.coalesce(array_mean(stars), zero),
        "recent_std": F.coalesce(array_std(stars), zero),
        "recent_match": ratio_or_zero(F.size(F.filter("_recent", hit)), F.size("_recent")),
        "recent_slope": F.coalesce(array_slope(stars), zero),
        "recent_streak": F.coalesce(streak(F.col("_recent"), hit), F.lit(0)).cast("double"),
        "recent_categories": F.coalesce(
            F.size(F.array_distinct(F.flatten(F.transform("_recent", lambda r: r["_cats"])))), F.lit(0)
        ).cast("double"),
        "last5_stars": F.coalesce(array_mean(last5), zero),
        "distance_km_f": F.coalesce("_km", zero),
        "mean_radius_km": F.coalesce("_radius", zero),
        "distance_rank": F.coalesce("_rank", F.lit(0.5)),
        # The mean of the gaps between consecutive dates needs only both ends.
        "mean_gap_days": F.when(F.col("n_history") > 1, F.col("_days") / (F.col("n_history") - 1)).otherwise(0.0),
        "weekend_share": F.coalesce("_weekend", zero),
    }
    names = feature_names("rating", "reviews")
    return rows.select(
        "case_id", "user_id", F.coalesce("n_history", F.lit(0)).cast("double").alias("n_history"),
        *[columns[c].alias(c) for c in names],
    )


COMPACT = ("user_stars", "n_history", "user_std", "cat_overlap", "cat_stars", "in_main_city")


def compact_summary(features: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """The six-number summary used next to embeddings; all zero without history."""
    return features.select(
        *keys, *[F.when(F.col("n_history") > 0, F.col(c)).otherwise(0.0).alias(c) for c in COMPACT]
    )

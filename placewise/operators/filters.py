"""Row filters over trips and entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Trip cleaning limits in minutes.
MIN_MINUTES, MAX_MINUTES = 1, 120


def with_trip_columns(trips: DataFrame) -> DataFrame:
    """Duration in minutes, pickup hour, Monday-based weekday and date."""
    seconds = F.timestamp_diff("MICROSECOND", F.col("pickup_ts"), F.col("dropoff_ts")) / F.lit(1e6)
    return trips.withColumns(
        {
            "duration_min": seconds / 60,
            "pickup_hour": F.hour("pickup_ts"),
            "pickup_dow": F.weekday("pickup_ts"),
            "pickup_date": F.date_format("pickup_ts", "yyyy-MM-dd"),
        }
    )


def clean_trips(
    trips: DataFrame,
    excluded_zones: Sequence[int],
    min_minutes: float = MIN_MINUTES,
    max_minutes: float = MAX_MINUTES,
) -> DataFrame:
    """Trips between wanted zones, of plausible length, that moved at all."""
    kept = trips.filter(
        ~F.col("pu_zone").isin(*excluded_zones)
        & ~F.col("do_zone").isin(*excluded_zones)
        & (F.col("trip_distance") > 0)
    )
    return with_trip_columns(kept).filter(F.col("duration_min").between(min_minutes, max_minutes))


def active_entities(df: DataFrame, key: str, min_rows: int) -> DataFrame:
    """Keys with at least ``min_rows`` rows (counted before the shuffle)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows).select(key)


def covered_entities(
    df: DataFrame, key: str, is_known: Column, min_share: float, min_rows: int = 1
) -> DataFrame:
    """Keys whose share of known rows reaches ``min_share``."""
    stats = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(is_known, 1)).alias("known")
    )
    return stats.filter(
        (F.col("n") >= min_rows) & (F.col("known") / F.col("n") >= F.lit(min_share))
    ).select(key)


def both_ends(pairs: DataFrame, entities: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Pairs with both members in ``entities``: two semi joins."""
    e = entities.select(key)
    return pairs.join(e.withColumnRenamed(key, left), left, "left_semi").join(
        e.withColumnRenamed(key, right), right, "left_semi"
    )


def without_pairs(pairs: DataFrame, known: DataFrame, left: str, right: str) -> DataFrame:
    """Drop pairs found in a canonical edge table ``(a, b)``."""
    keys = pairs.withColumns({"_a": F.least(left, right), "_b": F.greatest(left, right)})
    edges = known.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    return keys.join(edges, ["_a", "_b"], "left_anti").drop("_a", "_b")


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in an explicit order, by aggregation with partial results."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    )
    return picked.select(*key, *[F.col("_first")[c].alias(c) for c in rest])

"""Trajectory ranking: the last stop of a session against places not in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.operators.history import chronological_split, hold_out, sessionise
from placewise.operators.sampling import keep_per_case, permute, probe, shuffled_position, take_shuffled

SESSION = ["user_id", "session_no"]
ORDER = ["ts", "event_id"]
N_NEGATIVES = 19


def trajectories(checkins: DataFrame, gap_hours: int = 24, min_length: int = 3) -> DataFrame:
    """Check-ins with the number of their session."""
    return sessionise(checkins, "user_id", "ts", "event_id", gap_hours, min_length)


def split_sessions(
    stops: DataFrame, train_share: float = 0.8, val_share: float = 0.1
) -> DataFrame:
    """One row per session with its length, first time and train/val/test split."""
    sessions = stops.groupBy(*SESSION).agg(
        F.min("ts").alias("start_ts"), F.count(F.lit(1)).alias("n_stops")
    )
    return chronological_split(
        sessions, "start_ts", SESSION, (("train", train_share), ("val", val_share)), "test"
    )


def visit_profile(stops: DataFrame) -> DataFrame:
    """Category visits per user (training sessions only are passed in)."""
    return stops.groupBy("user_id", "category").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*ORDER)).alias("first_seen")
    )


def trajectory_cases(
    stops: DataFrame, sessions: DataFrame, venues: DataFrame, n_cases: int, seed: str,
    n_negatives: int = N_NEGATIVES,
) -> tuple[DataFrame, DataFrame]:
    """``(candidates, context)`` for randomly chosen sessions.

    Candidates are the last stop and places outside the session; where too few
    exist, any place but the last stop. ``context`` is the session without it.
    """
    chosen = take_shuffled(sessions.select(*SESSION), SESSION, n_cases, seed)
    mine = stops.join(chosen, SESSION, "left_semi")
    held, context = hold_out(mine, SESSION, ORDER, 1)
    truths = held.select(*SESSION, F.col("location_id").alias("_truth"))
    inside = mine.select(*SESSION, "location_id").distinct()
    n_inside = inside.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("_inside"))
    index = shuffled_position(venues.select("location_id"), ["location_id"], seed)
    size = index.select(F.max("pool_size")).scalar()
    cases = truths.join(n_inside, SESSION).withColumn("_size", size)
    cases = cases.withColumn("_strict", F.col("_size") - F.col("_inside") >= n_negatives)
    spare = F.when(F.col("_strict"), F.col("_inside")).otherwise(1)
    probes = probe(cases, SESSION, "_size", spare + n_negatives, seed, "pos")
    is_truth = F.col("pos") == -1
    drawn = probes.join(index.drop("pool_size"), "pos", "left")
    drawn = drawn.filter(is_truth | (F.col("location_id") != F.col("_truth")))
    marks = inside.withColumn("_hit", F.lit(True))
    drawn = drawn.join(marks, [*SESSION, "location_id"], "left")
    drawn = drawn.filter(F.col("_hit").isNull() | ~F.col("_strict")).select(
        *SESSION, F.when(is_truth, F.col("_truth")).otherwise(F.col("location_id")).alias("location_id"),
        is_truth.cast("int").alias("label"),
    )
    both = keep_per_case(drawn, SESSION, ["location_id"], n_negatives, seed)
    return permute(both, SESSION, ["location_id"], seed), context

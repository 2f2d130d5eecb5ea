"""Sessions over a stream of check-ins, closed by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap_hours: int = 24, delay: str = "1 hour") -> DataFrame:
    """Closed sessions per key: a session ends after ``gap_hours`` without an event.

    Events later than ``delay`` behind the newest one are cut off. State is one
    window per open session. Use append mode: a session is emitted once, when
    the watermark passes its end.
    """
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    window = F.session_window("_ts", f"{gap_hours} hours")
    return timed.groupBy(key, window.alias("_w")).agg(
        F.count(F.lit(1)).alias("n_events"), F.max("_ts").alias("end_ts")
    ).select(key, F.col("_w.start").cast("timestamp_ntz").alias("start_ts"),
             F.col("end_ts").cast("timestamp_ntz").alias("end_ts"), "n_events")


def closed_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id",
                    gap_hours: int = 24, delay_hours: int = 1) -> DataFrame:
    """Batch twin: sessions the stream has emitted once all given events are read."""
    from placewise.operators.history import sessionise

    numbered = sessionise(events, key, ts, tie, gap_hours, min_length=1)
    sessions = numbered.groupBy(key, "session_no").agg(
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("n_events")
    )
    # The watermark is kept in whole milliseconds.
    newest = F.date_trunc("MILLISECOND", events.select(F.max(ts)).scalar()).cast("timestamp_ntz")
    closes = F.col("end_ts") + F.expr(f"INTERVAL '{gap_hours}' HOUR")
    return sessions.filter(closes <= newest - F.expr(f"INTERVAL '{delay_hours}' HOUR")).drop("session_no")

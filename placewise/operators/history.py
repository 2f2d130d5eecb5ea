"""Chronology: last rows, hold-outs, sessions and time-ordered splits."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, Window, WindowSpec
from pyspark.sql import functions as F

from placewise.functions.numbers import hash_key
from placewise.session import stage

from .sampling import row_at


def last_n(df: DataFrame, key: Sequence[str], order: Sequence[str], n: int, out: str = "rn") -> DataFrame:
    """The last ``n`` rows per key, ``out`` = 1 for the newest.

    Spark limits each key to ``n`` rows per partition before the shuffle.
    """
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


def last_n_array(
    df: DataFrame, key: Sequence[str], order: Sequence[str], n: int, fields: Sequence[str], out: str
) -> DataFrame:
    """The last ``n`` rows per key as an array of structs, oldest first (at most ``n`` long)."""
    recent = last_n(df, key, order, n, "_rn")
    item = F.struct((-F.col("_rn")).alias("_k"), *fields)
    packed = recent.groupBy(*key).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    bare = F.transform(F.col("_items"), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return packed.select(*key, bare.alias(out))


def hold_out(
    df: DataFrame, key: Sequence[str], order: Sequence[str], n: int = 1
) -> tuple[DataFrame, DataFrame]:
    """``(held, history)``: the last ``n`` rows per key, and everything before them.

    ``held`` carries ``rn`` (1 = newest). The history is everything ordered
    before the oldest held row, found by comparing with a per-key cut-off, so
    no window runs over a whole history.
    """
    held = last_n(df, key, order, n)
    cut = held.groupBy(*key).agg(F.min(F.struct(*order)).alias("_cut"))
    history = df.join(cut, list(key)).filter(F.struct(*order) < F.col("_cut")).drop("_cut")
    return held, history


def sessionise(
    df: DataFrame,
    key: str,
    ts: str,
    tie: str,
    gap_hours: int = 24,
    min_length: int = 3,
    slice_unit: str = "DAY",
    out: str = "session_no",
) -> DataFrame:
    """Number sessions per key; a gap longer than ``gap_hours`` starts a new one.

    Rows are worked on in (key, time slice) groups, so a key with a large part of
    all rows still spreads over many tasks. One small row per slice carries its first
    and last time, its inner breaks, and the rows before its first and from its last break; sums over those rows give
    every slice the number it starts from and the lengths of the sessions that reach beyond it. The rows
    themselves are read twice and shuffled once with all their columns.
    """
    gap = F.expr(f"INTERVAL '{int(gap_hours)}' HOUR")
    sliced = df.withColumn("_slice", F.date_trunc(slice_unit, F.col(ts)).cast("timestamp_ntz"))
    inside = Window.partitionBy(key, "_slice").orderBy(ts, tie)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)

    def broken(rows: DataFrame) -> DataFrame:
        breaks = F.when(F.col(ts) > F.lag(ts).over(inside) + gap, 1).otherwise(0)
        return rows.withColumn("_brk", breaks).withColumn("_run", F.sum("_brk").over(so_far))

    numbers = _slice_sessions(broken(sliced.select(key, "_slice", ts, tie)), key, ts, inside, gap)
    joined = broken(sliced).join(numbers, [key, "_slice"])
    fragment = Window.partitionBy(key, "_slice", "_run")
    length = (
        F.when(F.col("_run") == 0, F.col("_head_rows"))
        .when(F.col("_run") == F.col("_inner"), F.col("_tail_rows"))
        .otherwise(F.count(F.lit(1)).over(fragment))
    )
    numbered = joined.withColumn(out, (F.col("_base") + F.col("_run")).cast("long"))
    if min_length > 1:
        numbered = numbered.withColumn("_length", length).filter(F.col("_length") >= min_length)
    return numbered.select(*df.columns, out)


def _slice_sessions(breaks: DataFrame, key: str, ts: str, inside: WindowSpec, gap: Column) -> DataFrame:
    """One row per (key, slice): the number its first session has, its breaks, and the whole lengths of its first and last session."""
    at_break = F.when(F.col("_brk") == 1, F.col("_at"))
    slices = breaks.withColumn("_at", F.row_number().over(inside)).groupBy(key, "_slice").agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.sum("_brk").alias("_inner"), F.count(F.lit(1)).alias("_n"),
        F.min(at_break).alias("_first_break"), F.max(at_break).alias("_last_break"),
    )
    across = Window.partitionBy(key).orderBy("_slice")
    before = F.lag("_last").over(across)
    starts = F.when(before.isNull() | (F.col("_first") > before + gap), 1).otherwise(0)
    total = F.sum(F.col("_starts") + F.col("_inner")).over(across.rowsBetween(Window.unboundedPreceding, 0))
    slices = slices.withColumn("_starts", starts).withColumn("_base", total - F.col("_inner"))
    head = F.struct(
        F.lit(True).alias("head"), F.col("_base").alias("no"), F.coalesce(F.col("_first_break") - 1, F.col("_n")).alias("rows")
    )
    tail = F.struct(
        F.lit(False).alias("head"), (F.col("_base") + F.col("_inner")).alias("no"),
        F.coalesce(F.col("_n") - F.col("_last_break") + 1, F.lit(0)).alias("rows"),
    )
    pieces = slices.select(key, "_slice", "_base", "_inner", F.explode(F.array(head, tail)).alias("_piece"))
    whole = F.sum("_piece.rows").over(Window.partitionBy(key, "_piece.no"))
    return pieces.withColumn("_whole", whole).groupBy(key, "_slice").agg(
        F.max("_base").alias("_base"), F.max("_inner").alias("_inner"),
        F.max(F.when(F.col("_piece.head"), F.col("_whole"))).alias("_head_rows"),
        F.max(F.when(~F.col("_piece.head"), F.col("_whole"))).alias("_tail_rows"),
    )


def chronological_split(
    df: DataFrame,
    ts: str,
    tie: Sequence[str],
    shares: Sequence[tuple[str, float]] = (("train", 0.8), ("val", 0.1)),
    rest: str = "test",
    out: str = "split",
) -> DataFrame:
    """Cut the global time order at ``floor(n * share)`` rows, exactly.

    Rows are counted per hour, a table bounded by the calendar. Only the rows of the hours that hold a cut are put in order
    (by time, then a hash of the ``tie`` columns, so even a timestamp shared by very many rows spreads over the ranges of the
    sort), and the row at each cut is found there. Every other row is labelled by comparing it with those few rows,
    without a shuffle. Rows without a time are not counted and belong to ``rest``; rows equal in time and ``tie`` stay on one side.
    """
    hour = F.date_trunc("HOUR", F.col(ts).cast("timestamp"))
    hours = stage(df.filter(F.col(ts).isNotNull()).groupBy(hour.alias("_hour")).agg(F.count(F.lit(1)).alias("_n")), "hours")
    whole = Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, 0)  # one row per hour of the calendar
    total = hours.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    cuts, share_sum = [], 0.0
    for _, share in shares:
        share_sum += share
        cuts.append(math.floor(total * share_sum))
    placed = hours.withColumn("_before", F.sum("_n").over(whole) - F.col("_n"))
    # The row at position c is the first one behind the cut; there is none if the cut takes all rows.
    holds = {c: (F.col("_before") <= c) & (F.lit(c) < F.col("_before") + F.col("_n")) for c in cuts}
    found = placed.filter(reduce(or_, holds.values())).collect()
    order = [ts, "_hash"]
    borders: dict[int, Column | None] = dict.fromkeys(cuts)
    for r in found:
        inside = [c for c in borders if r["_before"] <= c < r["_before"] + r["_n"]]
        # The bounds of the hour are given on the column itself, so that they reach the scan.
        low = F.lit(r["_hour"]).cast(df.schema[ts].dataType)
        rows = df.filter((F.col(ts) >= low) & (F.col(ts) < low + F.expr("INTERVAL '1' HOUR")))
        keyed = rows.withColumn("_hash", hash_key("order", *tie)).select(*order)
        at = row_at(keyed, order, [c - r["_before"] for c in inside])
        for c in inside:
            borders[c] = at[c - r["_before"]]

    def behind(border: Row) -> Column:
        """Whether a row comes at or after the border row; the hash is taken of rows at its time only."""
        time = F.lit(border[ts]).cast(df.schema[ts].dataType)
        return F.when(F.col(ts) != time, F.col(ts) > time).otherwise(hash_key("order", *tie) >= F.lit(border["_hash"]))

    label = F.when(F.col(ts).isNull(), F.lit(rest))
    for (name, _), c in zip(shares, cuts, strict=True):
        label = label.when(~behind(borders[c]) if borders[c] is not None else F.lit(True), F.lit(name))
    return df.withColumn(out, label.otherwise(F.lit(rest)))


def streak(items: Column, matches) -> Column:
    """Length of the run of matching elements at the end of a (short) array."""
    reverse = F.reverse(items)
    first_miss = F.array_position(
        F.transform(reverse, lambda x: F.when(matches(x), F.lit(1)).otherwise(F.lit(0))), F.lit(0)
    )
    return F.when(first_miss == 0, F.size(items)).otherwise(first_miss - 1).cast("long")


def array_mean(values: Column) -> Column:
    """Mean of a short numeric array, NULL when empty."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.try_divide(total, F.size(values).cast("double"))


def array_std(values: Column) -> Column:
    """Population standard deviation of a short numeric array, 0 for fewer than two."""
    mean = array_mean(values)
    squares = F.aggregate(
        F.transform(values, lambda x: (x.cast("double") - mean) * (x.cast("double") - mean)),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return F.when(F.size(values) > 1, F.sqrt(squares / F.size(values))).otherwise(F.lit(0.0))


def array_slope(values: Column) -> Column:
    """Least-squares slope over positions 0, 1, ...; 0 for fewer than three values."""
    n = F.size(values).cast("double")
    middle = (n - 1) / 2
    weighted = F.aggregate(
        F.transform(values, lambda x, i: (i.cast("double") - middle) * x.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return F.when(n >= 3, F.try_divide(weighted * 12, n * (n * n - 1))).otherwise(F.lit(0.0))

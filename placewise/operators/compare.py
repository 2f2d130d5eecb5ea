"""Comparing conditions: grids, steps, arms, disagreements, correlations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.functions.numbers import ratio_or_zero, round_to

NEUTRAL_BAND = 0.005


def complete_grid(metrics: DataFrame, models: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """One row per model and level, NULL metrics where a condition has no results.

    The grid is a parameter list, not a join of tables.
    """
    cells = [(m, g) for m in models for g in levels]
    grid = metrics.sparkSession.createDataFrame(cells, "model string, level string")
    return grid.join(metrics, ["model", "level"], "left")


def condition_table(metrics: DataFrame, metric: str, levels: Sequence[str], row: str = "model") -> DataFrame:
    """Models as rows, levels as columns."""
    return metrics.groupBy(row).pivot("level", list(levels)).agg(F.first(metric))


def marginal_gains(metrics: DataFrame, metric: str, by: str = "model") -> DataFrame:
    """Gain of each level over the one before it; 0 where one of the two is missing."""
    w = Window.partitionBy(by).orderBy("level")
    gain = F.coalesce(F.col(metric) - F.lag(metric).over(w), F.lit(0.0))
    steps = metrics.withColumns({"gain": round_to(gain, 6), "from_level": F.lag("level").over(w)})
    return steps.filter(F.col("from_level").isNotNull()).select(by, "from_level", "level", "gain")


def compare_arms(
    metrics: DataFrame, arm: str, first: str, second: str, on: Sequence[str], metric: str
) -> DataFrame:
    """``first`` against ``second`` per condition: both values, their difference and the winner."""

    def side(name: str, out: str) -> DataFrame:
        return metrics.filter(F.col(arm) == name).select(*on, F.col(metric).alias(out))

    both = side(first, "first_value").join(side(second, "second_value"), list(on))
    both = both.filter(F.col("first_value").isNotNull() & F.col("second_value").isNotNull())
    delta = F.col("first_value") - F.col("second_value")
    winner = F.when(delta > 0, first).when(delta < 0, second).otherwise("tie")
    return both.select(
        *on, "first_value", "second_value", round_to(delta, 4).alias("delta"), winner.alias("winner")
    )


def arm_deltas(
    metrics: DataFrame, arm: str, pairs: Sequence[tuple[str, str]], on: Sequence[str], names: Sequence[str]
) -> DataFrame:
    """Several pairs of arms and several metrics at once: (contrast, metric, ``on``, both values, their difference, the winner).

    ``pairs`` are (first, second), such as hard and easy negatives, a few and no examples, or a tuned and a plain
    model; a contrast is named ``first - second``. Conditions that lack one side are left out. The metrics are read once per side.
    """
    values = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))
    long = metrics.select(arm, *on, F.explode(values).alias("_v")).select(F.col(arm).alias("_arm"), *on, "_v.*")
    sides = F.array(*(F.struct(F.lit(f"{a} - {b}").alias("contrast"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))
    each = long.withColumn("_p", F.explode(sides)).filter((F.col("_arm") == F.col("_p.a")) | (F.col("_arm") == F.col("_p.b")))
    groups = each.groupBy(F.col("_p.contrast").alias("contrast"), "metric", *on).agg(
        F.max(F.when(F.col("_arm") == F.col("_p.a"), F.col("value"))).alias("first_value"),
        F.max(F.when(F.col("_arm") == F.col("_p.b"), F.col("value"))).alias("second_value"),
        F.first("_p.a").alias("_a"), F.first("_p.b").alias("_b"),
    )
    delta = F.col("first_value") - F.col("second_value")
    winner = F.when(delta > 0, F.col("_a")).when(delta < 0, F.col("_b")).otherwise("tie")
    return groups.filter(delta.isNotNull()).select(
        "contrast", "metric", *on, "first_value", "second_value", round_to(delta, 4).alias("delta"), winner.alias("winner")
    )


def disagreement(
    first: DataFrame, second: DataFrame, case: Sequence[str], names: tuple[str, str] = ("enriched", "venue_id"),
    by: Sequence[str] = (),
) -> DataFrame:
    """How often two prediction sets differ, and which one is right when they do."""
    a = first.select(*by, *case, "label", F.col("prediction").alias("_p"))
    b = second.select(*by, *case, F.col("prediction").alias("_q"))
    rows = a.join(b, [*by, *case])
    y, p, q = F.col("label"), F.col("_p"), F.col("_q")

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    same, right_p, right_q = p.eqNullSafe(q), p.eqNullSafe(y), q.eqNullSafe(y)
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cases"),
        count(same).alias("_same"),
        count(~same & right_p & ~right_q).alias("first_right"),
        count(~same & right_q & ~right_p).alias("second_right"),
        count(~same & (right_p == right_q)).alias("both_wrong"),
    )
    differ = F.col("n_cases") - F.col("_same")
    return counts.select(
        *by,
        "n_cases",
        round_to(ratio_or_zero("_same", "n_cases"), 4).alias("agreement_rate"),
        differ.alias("n_disagreements"),
        "first_right",
        "second_right",
        "both_wrong",
        round_to(ratio_or_zero("first_right", differ), 4).alias("first_right_rate"),
        round_to(ratio_or_zero("second_right", differ), 4).alias("second_right_rate"),
        F.when(F.col("first_right") > F.col("second_right"), names[0])
        .when(F.col("second_right") > F.col("first_right"), names[1])
        .otherwise("tie")
        .alias("winner"),
    )


def effect_label(delta: Column, band: float = NEUTRAL_BAND) -> Column:
    """``helps``, ``hurts`` or ``neutral``."""
    return F.when(delta > band, "helps").when(delta < -band, "hurts").otherwise("neutral")


def cross_correlations(features: DataFrame, first: Sequence[str], second: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair (one of ``first``, one of ``second``).

    One distributed pass builds the matrix over all columns; what comes back is
    its entries, a number fixed by the feature lists. A constant column gives 0.
    """
    columns = [*first, *second]
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(features)
    matrix = Correlation.corr(vectors.select("features"), "features").first()[0].toArray()
    at = {c: i for i, c in enumerate(columns)}
    rows = [
        (a, b, float(r) if math.isfinite(r) else 0.0)
        for a in first
        for b in second
        for r in [matrix[at[a], at[b]]]
    ]
    return features.sparkSession.createDataFrame(rows, "first string, second string, r double")


def level_correlations(features: DataFrame, levels: dict[str, tuple[Sequence[str], Sequence[str]]]) -> DataFrame:
    """(level, first, second, r) for every enrichment column of a level with every other column of it.

    ``levels`` names the enrichment columns and all columns of each level. Levels are column subsets of one table, so one
    matrix over all columns serves them all. Levels without columns of either kind have no rows.
    """
    every = list(dict.fromkeys(c for _, names in levels.values() for c in names))
    marked = list(dict.fromkeys(c for first, _ in levels.values() for c in first))
    matrix = cross_correlations(features, marked, [c for c in every if c not in set(marked)])
    wanted = [
        (level, a, b) for level, (first, names) in levels.items() for a in first for b in names if b not in set(first)
    ]
    named = features.sparkSession.createDataFrame(wanted, "level string, first string, second string")
    return named.join(matrix, ["first", "second"])


def correlation_summary(correlations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and maximum absolute correlation, and counts above 0.3 and 0.5."""
    size = F.abs("r")
    return correlations.groupBy(*by).agg(
        round_to(F.avg(size), 4).alias("mean_correlation"),
        round_to(F.max(size), 4).alias("max_correlation"),
        F.count(F.when(size > 0.3, 1)).alias("pairs_above_03"),
        F.count(F.when(size > 0.5, 1)).alias("pairs_above_05"),
        F.count(F.lit(1)).alias("n_pairs"),
    )


def top_correlations(correlations: DataFrame, n: int) -> DataFrame:
    """The ``n`` pairs of each level with the largest absolute correlation; ties fall by the columns' names."""
    order = Window.partitionBy("level").orderBy(F.round(F.abs("r"), 9).desc(), "first", "second")
    ranked = correlations.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)
    return ranked.select("level", "position", "first", "second", round_to(F.abs("r"), 3).alias("correlation"))


def importance_shares(importances: DataFrame) -> DataFrame:
    """Share of each feature and of all enrichment features, from (name, importance, is_enrichment).

    There is one row per feature, so the totals are taken over one small window.
    """
    every = Window.partitionBy()
    total = F.sum("importance").over(every)
    enriched = F.sum(F.when(F.col("is_enrichment"), F.col("importance")).otherwise(0.0)).over(every)
    order = F.row_number().over(Window.orderBy(F.col("importance").desc(), "name"))
    return importances.select(
        "name",
        "is_enrichment",
        round_to("importance", 4).alias("importance"),
        round_to(ratio_or_zero(F.col("importance") * 100, total), 2).alias("share_pct"),
        round_to(ratio_or_zero(enriched * 100, total), 2).alias("enrichment_share_pct"),
        order.alias("position"),
    )

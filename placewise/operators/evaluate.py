"""Metrics of predictions, as aggregates per condition."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.functions.numbers import HASH_SPACE, hash_draw, hash_key, ratio_or_zero, round_to, star_prediction
from placewise.functions.texts import strip


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 (4 decimals); NULL predictions do not count."""
    y, p = F.col(label), F.col(prediction)
    counts = df.groupBy(*by).agg(
        _count((p == 1) & (y == 1)).alias("tp"),
        _count((p == 0) & (y == 0)).alias("tn"),
        _count((p == 1) & (y == 0)).alias("fp"),
        _count((p == 0) & (y == 1)).alias("fn"),
        F.count(p).alias("n_valid"),
        F.count(F.lit(1)).alias("n_total"),
    )
    precision = ratio_or_zero("tp", F.col("tp") + F.col("fp"))
    recall = ratio_or_zero("tp", F.col("tp") + F.col("fn"))
    return counts.select(
        *by,
        round_to(ratio_or_zero(F.col("tp") + F.col("tn"), "n_valid"), 4).alias("accuracy"),
        round_to(precision, 4).alias("precision"),
        round_to(recall, 4).alias("recall"),
        round_to(ratio_or_zero(2 * precision * recall, precision + recall), 4).alias("f1"),
        "tp", "tn", "fp", "fn", "n_valid", "n_total",
    )


def ranking_metrics(df: DataFrame, ranking: str = "ranking", truth: str = "truth_pos", by: Sequence[str] = ()) -> DataFrame:
    """Hit rates at 1 and 5 and mean reciprocal rank of rankings held as arrays.

    A NULL ranking is left out; a truth missing from its ranking scores 0.
    """
    rank = F.array_position(F.col(ranking), F.col(truth))
    scored = df.withColumn("_rank", rank)

    def hit(k: int) -> Column:
        return F.coalesce(F.avg(F.when(F.col("_rank").isNotNull(), F.col("_rank").between(1, k).cast("double"))), F.lit(0.0))

    reciprocal = F.when(F.col("_rank") > 0, 1.0 / F.col("_rank")).when(F.col("_rank") == 0, 0.0)
    return scored.groupBy(*by).agg(
        round_to(hit(1), 6).alias("acc_at_1"),
        round_to(hit(5), 6).alias("acc_at_5"),
        round_to(F.coalesce(F.avg(reciprocal), F.lit(0.0)), 6).alias("mrr"),
        F.count(F.lit(1)).alias("n_total"),
        F.count("_rank").alias("n_valid"),
        _count(F.col("_rank").isNull()).alias("n_parse_failures"),
    )


def usage_totals(df: DataFrame, usage: str = "usage", cached: str = "cached", by: Sequence[str] = ()) -> DataFrame:
    """Tokens spent and answers taken from the ledger."""
    return df.groupBy(*by).agg(
        F.coalesce(F.sum(F.col(usage)["total_tokens"]), F.lit(0)).cast("long").alias("total_tokens"),
        _count(F.col(cached)).alias("cached_responses"),
    )


def rank_candidates(df: DataFrame, query: Sequence[str], score: str, tie: Sequence[Column], out: str = "rank") -> DataFrame:
    """1-based rank by score within each query (a query holds 20 candidates)."""
    w = Window.partitionBy(*query).orderBy(F.col(score).desc(), *tie)
    return df.withColumn(out, F.row_number().over(w))


def rank_yes_no(df: DataFrame, query: Sequence[str], candidate: str, prediction: str, seed: str = "ties") -> DataFrame:
    """Rank yes answers before all others; ties fall in a reproducible random order."""
    yes = F.lower(strip(prediction)).startswith("yes").cast("int")
    scored = df.withColumn("_yes", F.coalesce(yes, F.lit(0)))
    tie = [hash_key(seed, *query, candidate), F.col(candidate)]
    return rank_candidates(scored, query, "_yes", tie).drop("_yes")


def first_hit_metrics(ranked: DataFrame, query: Sequence[str], label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Hit rates and mean reciprocal rank of the best-ranked positive per query.

    Queries without a positive are left out.
    """
    best = ranked.filter(F.col(label) == 1).groupBy(*by, *query).agg(F.min("rank").alias("_rank"))

    def mean(c: Column) -> Column:
        return round_to(F.coalesce(F.avg(c), F.lit(0.0)), 4)

    return best.groupBy(*by).agg(
        mean((F.col("_rank") == 1).cast("double")).alias("acc_at_1"),
        mean((F.col("_rank") <= 5).cast("double")).alias("acc_at_5"),
        mean(1.0 / F.col("_rank")).alias("mrr"),
        F.count(F.lit(1)).alias("n_queries"),
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute and root mean squared error; share of rounded predictions exact or one off."""
    valid = df.filter(F.col(predicted).isNotNull())
    off = F.abs(F.col(actual) - F.col(predicted))
    off_stars = F.abs(F.col(actual) - star_prediction(predicted))

    def mean(c: Column) -> Column:
        return round_to(F.coalesce(F.avg(c), F.lit(0.0)), 4)

    return valid.groupBy(*by).agg(
        mean(off).alias("mae"),
        round_to(F.coalesce(F.sqrt(F.avg(off * off)), F.lit(0.0)), 4).alias("rmse"),
        mean((off_stars == 0).cast("double")).alias("exact"),
        mean((off_stars <= 1).cast("double")).alias("within_1"),
        F.count(F.lit(1)).alias("n"),
    )


#: Powers of two below this count are drawn by inversion; what is above them by a corrected normal draw.
INVERTED = 64
#: Values are told apart to this many decimals, and weights drawn for each.
VALUE_DECIMALS = 6


def poisson_borders(mean: float) -> list[int]:
    """Whole numbers that turn a draw in [0, 2**32) into a Poisson weight: the number of borders at or below it."""
    total, term, k, borders = 0.0, math.exp(-mean), 0, []
    while True:
        total += term
        border = int(total * HASH_SPACE)
        if border >= HASH_SPACE - 1:
            return borders
        borders.append(border)
        k += 1
        term *= mean / k


def poisson_weight(count: Column, draws: Sequence[Column]) -> Column:
    """A Poisson draw with mean ``count`` from eight numbers in [0, 2**32): the sum of ``count`` independent Poisson(1) weights.

    Poisson(a + b) is Poisson(a) plus Poisson(b): the binary digits of the count below ``INVERTED`` are drawn by inversion, each
    from its own number; the rest (``INVERTED`` at least) by the normal approximation with its skewness corrected.
    """
    weight = F.lit(0)
    for i in range(INVERTED.bit_length() - 1):
        part = F.lit(0)
        for border in poisson_borders(float(1 << i)):
            part = part + (draws[i] >= F.lit(border)).cast("int")
        weight = weight + F.when(count.bitwiseAND(F.lit(1 << i)) > 0, part).otherwise(F.lit(0))
    mean = (count - F.pmod(count, F.lit(INVERTED))).cast("double")
    u, v = (d.cast("double") / F.lit(float(HASH_SPACE)) for d in draws[6:8])
    z = F.sqrt(F.lit(-2.0) * F.log(u + F.lit(1.0 / HASH_SPACE))) * F.cos(F.lit(2 * math.pi) * v)
    large = F.floor(F.greatest(mean + F.sqrt(mean) * z + (z * z - 1) / 6, F.lit(0.0)) + 0.5)
    return weight + F.when(mean > 0, large).otherwise(F.lit(0))


def eight_draws(seed: str, *parts: str) -> list[Column]:
    """Eight reproducible whole numbers in [0, 2**32)."""
    digests = F.concat(hash_key(seed, *parts), hash_key(f"{seed}+", *parts))
    return [F.conv(F.substring(digests, 8 * i + 1, 8), 16, 10).cast("long") for i in range(8)]


def poisson_thresholds(limit: int = 12) -> list[int]:
    """Whole-number borders that turn a draw in [0, 2**32) into a Poisson(1) weight."""
    total, borders = 0.0, []
    for k in range(limit):
        total += math.exp(-1.0) / math.factorial(k)
        borders.append(int(total * HASH_SPACE))
    return borders


def row_bootstrap_interval(
    df: DataFrame, key: Sequence[str], value: Column, n_resamples: int = 1000, confidence: float = 0.95,
    by: Sequence[str] = (), seed: str = "boot",
) -> DataFrame:
    """Percentile interval of the mean of ``value`` over Poisson resamples of the rows themselves.

    Each row draws its own weight per resample from a hash of its key. The conditions ``by`` of one key share its draws
    (resamples of the same cases), so a key is drawn once per resample; its sums per condition are added up first and
    ride along as one short list. What is shuffled is one row per condition, resample and partition.
    """
    rows = df.select(*by, *key, value.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    per_key = rows.groupBy(*key, *by).agg(F.sum("_v").alias("_s"), F.count(F.lit(1)).alias("_c"))
    items = F.collect_list(F.struct(*by, "_s", "_c")).alias("_items")
    # Keys grow a thousandfold here: spread even a small table over all tasks.
    n_tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = per_key.repartition(n_tasks, *key).groupBy(*key).agg(items)
    copies = keys.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))))
    weight = F.lit(0)
    for border in poisson_thresholds():
        weight = weight + (F.col("_draw") >= F.lit(border)).cast("int")
    # No filter on the weight: pushed down, it would compute the hash once per border.
    weighted = copies.withColumn("_draw", hash_draw(seed, *key, "_b")).withColumn("_w", weight)
    parts = weighted.select("_b", "_w", F.inline("_items"))
    means = parts.groupBy(*by, "_b").agg(F.try_divide(F.sum(F.col("_s") * F.col("_w")), F.sum(F.col("_c") * F.col("_w"))).alias("_m"))
    # A resample in which no row of a condition has a weight is none, and not counted.
    means = means.filter(F.col("_m").isNotNull())
    alpha = (1 - confidence) / 2
    return means.groupBy(*by).agg(
        round_to(F.percentile("_m", alpha), 6).alias("ci_lower"),
        round_to(F.percentile("_m", 1 - alpha), 6).alias("ci_upper"),
        F.count(F.lit(1)).alias("n_resamples"),
    )


def bootstrap_interval(
    df: DataFrame, value: Column, n_resamples: int = 1000, confidence: float = 0.95, by: Sequence[str] = (), seed: str = "boot"
) -> DataFrame:
    """Percentile interval of the mean of ``value`` over Poisson resamples.

    In a Poisson resample every row has a Poisson(1) weight, so all rows of one value together have a Poisson(count) weight.
    Rows are therefore counted per value first, and a resample draws one weight for each value: its cost depends on
    the different values (two for a hit rate, as many as candidates for a reciprocal rank), not on the rows.
    """
    units = F.round(value.cast("double") * F.lit(float(10**VALUE_DECIMALS))).cast("long")
    rows = df.select(*by, units.alias("_v")).filter(F.col("_v").isNotNull())
    counts = rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    copies = counts.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))))
    # The counts are few rows in few tasks: spread their resamples, as the sums need them.
    spread = copies.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "_b")
    drawn = spread.withColumns({f"_d{i}": d for i, d in enumerate(eight_draws(seed, *by, "_v", "_b"))})
    weighted = drawn.withColumn("_w", poisson_weight(F.col("_c"), [F.col(f"_d{i}") for i in range(8)]).cast("long"))
    mean = F.try_divide(F.sum(F.col("_v") * F.col("_w")), F.sum("_w")) / F.lit(float(10**VALUE_DECIMALS))
    means = weighted.groupBy(*by, "_b").agg(mean.alias("_m"))
    alpha = (1 - confidence) / 2
    return means.groupBy(*by).agg(
        round_to(F.percentile("_m", alpha), 6).alias("ci_lower"),
        round_to(F.percentile("_m", 1 - alpha), 6).alias("ci_upper"),
        F.count(F.lit(1)).alias("n_resamples"),
    )


def ranking_values(df: DataFrame, ranking: str = "ranking", truth: str = "truth_pos") -> DataFrame:
    """One row per case and ranking metric: (metric, value) beside the other columns. A case without a ranking has no value."""
    at = F.array_position(F.col(ranking), F.col(truth))
    hit = {k: at.between(1, k).cast("double") for k in (1, 5)}
    reciprocal = F.when(at > 0, 1.0 / at).when(at == 0, 0.0)
    values = {"acc_at_1": hit[1], "acc_at_5": hit[5], "mrr": reciprocal}
    items = F.array(*(F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in values.items()))
    return df.withColumn("_item", F.explode(items)).select(*df.columns, "_item.*")


def ranking_intervals(
    df: DataFrame, ranking: str = "ranking", truth: str = "truth_pos", by: Sequence[str] = (), n_resamples: int = 1000, seed: str = "boot"
) -> DataFrame:
    """Percentile intervals of the hit rates at 1 and 5 and of the mean reciprocal rank, per condition."""
    values = ranking_values(df.select(*by, ranking, truth), ranking, truth)
    return bootstrap_interval(values, F.col("value"), n_resamples, by=[*by, "metric"], seed=seed)


def random_line(n_candidates: int) -> dict[str, float]:
    """Expected metrics of a random ranking, in closed form."""
    return {
        "acc_at_1": 1.0 / n_candidates,
        "acc_at_5": min(5, n_candidates) / n_candidates,
        "mrr": sum(1.0 / r for r in range(1, n_candidates + 1)) / n_candidates,
    }


def popularity_line(candidates: DataFrame, query: Sequence[str], item: str, counts: DataFrame, tie: Sequence[Column]) -> DataFrame:
    """Metrics of ranking candidates by their popularity."""
    scored = candidates.join(counts, item, "left").withColumn("_score", F.coalesce("popularity", F.lit(0)))
    return first_hit_metrics(rank_candidates(scored, query, "_score", tie), query)

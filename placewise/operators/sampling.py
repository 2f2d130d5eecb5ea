"""Reproducible shuffles, exact-size samples and candidate draws that scale.

A shuffle is an order by a hash of the row key. Positions in that order are
found in two steps: rows are put into 4096 slots by the first digits of the
hash, slot sizes are summed up (a table of at most 4096 rows per group), and
rows are ranked inside their slot. No task ever sees a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from placewise.functions.numbers import ColumnLike, as_col, hash_draw, hash_key, permutation_keys, permuted
from placewise.session import stage

SLOT_DIGITS = 3
#: Hash digits of the slots in which a cut is looked for.
FINE_DIGITS = 4
_BLOCK = 1024


def _place(
    df: DataFrame, group: Sequence[str], slot: Column, order: Sequence[Column], out: str, size_out: str,
    first: int | None = None,
) -> DataFrame:
    """0-based position of each row in (slot, order), per group, and the group size.

    With ``first``, slots that begin at or after that position are left out before any row is ranked, or shuffled: the
    slots left are at most ``first`` per group, and are broadcast.
    """
    keyed = df.withColumn("_slot", slot)
    sizes = keyed.groupBy(*group, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*group).orderBy("_slot")
    sizes = sizes.select(
        *group,
        "_slot",
        (F.sum("_n").over(upto.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*group)).alias(size_out),
    )
    if first is not None:
        sizes = F.broadcast(sizes.filter(F.col("_before") < first))
    inner = F.row_number().over(Window.partitionBy(*group, "_slot").orderBy(*order))
    placed = keyed.join(sizes, [*group, "_slot"]).withColumn("_rank", inner)
    return placed.withColumn(out, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop(
        "_slot", "_rank", "_before"
    )


def shuffled_position(
    df: DataFrame,
    key: Sequence[str],
    seed: str,
    group: Sequence[str] = (),
    out: str = "pos",
    size_out: str = "pool_size",
) -> DataFrame:
    """Dense 0-based index of every row in a reproducible shuffle, whole or per group."""
    keyed = df.withColumn("_h", hash_key(seed, *key))
    placed = _place(
        keyed, group, F.substring("_h", 1, SLOT_DIGITS), [F.col("_h"), *map(F.col, key)], out, size_out
    )
    return placed.drop("_h")


def _range_place(df: DataFrame, order: Sequence[str], out: str, first: int | None = None) -> DataFrame:
    """Position of each row in an explicit order: the ranges of a distributed sort are the slots.

    The rows are written once, so that the ranges stay the same in every later pass.
    """
    ranged = df.repartitionByRange(*map(F.col, order)).withColumn("_range", F.spark_partition_id())
    placed = _place(stage(ranged, "ranges"), (), F.col("_range"), [F.col(c) for c in order], out, "_size", first)
    return placed.drop("_range", "_size")


def ordered_position(df: DataFrame, key: str, out: str = "pos") -> DataFrame:
    """Dense 0-based index of rows in key order."""
    return _range_place(df, [key], out)


def take_shuffled(df: DataFrame, key: Sequence[str], n: int, seed: str) -> DataFrame:
    """Exactly ``n`` rows (or all) in reproducible random order.

    Rows are counted in 65,536 hash slots; only the slots up to the one in which the ``n``-th row falls are ranked,
    each for itself, so no task gathers ``n`` rows.
    """
    keyed = df.withColumn("_h", hash_key(seed, *key))
    slot = F.substring("_h", 1, FINE_DIGITS)
    placed = _place(keyed, (), slot, [F.col("_h"), *map(F.col, key)], "_pos", "_size", first=n)
    return placed.filter(F.col("_pos") < n).drop("_h", "_pos", "_size")


def take_first(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of an explicit order; ranges beyond the ``n``-th row are never ranked."""
    return _range_place(df, order, "_pos", first=n).filter(F.col("_pos") < n).drop("_pos")


def row_at(df: DataFrame, order: Sequence[str], positions: Sequence[int]) -> dict[int, Row]:
    """The rows at these few positions of an explicit order; only the ranges up to the last one are ranked."""
    placed = _range_place(df, order, "_pos", first=max(positions) + 1)
    return {r["_pos"]: r for r in placed.filter(F.col("_pos").isin(*positions)).collect()}


def split_bands(df: DataFrame, key: Sequence[str], sizes: dict[str, int], seed: str) -> DataFrame:
    """Disjoint slices of one shuffle: the first ``sizes[a]`` rows are ``a``, and so on.

    The slices are parameters of a run, so the sorted part is cut to their sum
    before it is numbered.
    """
    taken = take_shuffled(df, key, sum(sizes.values()), seed)
    placed = shuffled_position(taken, key, seed, out="_pos", size_out="_size")
    label: Column | None = None
    upper = 0
    for name, size in sizes.items():
        upper += size
        condition = F.col("_pos") < upper
        label = F.when(condition, name) if label is None else label.when(condition, name)
    return placed.withColumn("split", label).drop("_pos", "_size")


def split_in_proportion(df: DataFrame, key: Sequence[str], sizes: dict[str, int], seed: str) -> DataFrame:
    """Slices as in ``split_bands``; where there are fewer rows than the sum of ``sizes``, every slice shrinks in proportion.

    So no slice of a small input is empty because those before it took all rows.
    """
    total = sum(sizes.values())
    taken = take_shuffled(df, key, total, seed)
    placed = shuffled_position(taken, key, seed, out="_pos", size_out="_size")
    label: Column | None = None
    upper = 0
    for name, size in sizes.items():
        upper += size
        condition = F.col("_pos") < F.expr(f"_size * {upper} div {total}")
        label = F.when(condition, name) if label is None else label.when(condition, name)
    return placed.withColumn("split", label).drop("_pos", "_size")


def balanced(df: DataFrame, label: str, key: Sequence[str], n: int, seed: str) -> DataFrame:
    """``n/2`` rows of each label value. Only the hash slots of a label up to its last wanted row are ranked,
    each for itself, so labels of any size are safe."""
    keyed = df.withColumn("_h", hash_key(seed, *key))
    slot = F.substring("_h", 1, FINE_DIGITS)
    placed = _place(keyed, [label], slot, [F.col("_h"), *map(F.col, key)], "_pos", "_size", first=n // 2)
    return placed.filter(F.col("_pos") < n // 2).drop("_h", "_pos", "_size")


def group_validation_split(
    df: DataFrame, case: Sequence[str], share: float, seed: str, out: str = "is_validation"
) -> DataFrame:
    """Mark all rows of ``floor(n_cases * share)`` randomly chosen cases."""
    cases = shuffled_position(df.select(*case).distinct(), case, seed, out="_pos", size_out="_size")
    marked = cases.select(*case, (F.col("_pos") < F.floor(F.col("_size") * share)).alias(out))
    return df.join(marked, list(case))


def permute(df: DataFrame, case: Sequence[str], item: Sequence[str], seed: str, out: str = "pos") -> DataFrame:
    """0-based random position of each candidate inside its case (20 rows per case)."""
    w = Window.partitionBy(*case).orderBy(hash_key(seed, *case, *item), *item)
    return df.withColumn(out, F.row_number().over(w) - 1)


def with_replacement(df: DataFrame, key: Sequence[str], n: int, seed: str) -> DataFrame:
    """``n`` rows if there are that many, else ``n`` draws with replacement.

    A draw is a row number hashed into the dense index, so it is an equi-join.
    """
    placed = shuffled_position(df, key, seed, out="_pos", size_out="_size")
    # One seed row (position 0) fans out to the draws; none are made when rows suffice.
    draws = placed.filter((F.col("_pos") == 0) & (F.col("_size") < n)).select(
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw_no"), "_size"
    )
    draws = draws.select(
        "draw_no", F.pmod(hash_draw(seed, "draw_no"), F.col("_size")).alias("_pos")
    )
    drawn = draws.join(placed.drop("_size"), "_pos").drop("_pos")
    whole = placed.filter((F.col("_size") >= n) & (F.col("_pos") < n))
    whole = whole.withColumn("draw_no", F.col("_pos").cast("int")).drop("_pos", "_size")
    return drawn.unionByName(whole)


def explode_range(df: DataFrame, count: str, out: str) -> DataFrame:
    """One row per whole number below ``count``; built in blocks so no long array is held."""
    blocks = df.filter(F.col(count) > 0).withColumn(
        "_block",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / _BLOCK).cast("long"))),
    )
    last = F.least(F.col(count) - 1, (F.col("_block") + 1) * _BLOCK - 1).cast("long")
    return blocks.withColumn(out, F.explode(F.sequence(F.col("_block") * _BLOCK, last))).drop("_block")


def probe(
    cases: DataFrame, case: Sequence[str], pool_size: str, wanted: ColumnLike, seed: str, out: str = "probe_pos"
) -> DataFrame:
    """Random positions in a shuffled pool, drawn without replacement and for every case on its own.

    Position -1 is added to every case: it stands for the true candidate, so that
    truths and negatives come from one pass over the cases.

    ``wanted`` is the number of candidates plus the number of pool members that
    may have to be thrown out again, so enough always survive; the positions are the first ones of a permutation keyed by
    the case, and when ``wanted`` reaches the pool size they are the whole pool.
    The cost per case is what it needs, never the pool.
    """
    sized = cases.withColumn("_m", F.least(as_col(wanted).cast("long"), F.col(pool_size).cast("long")))
    sized = sized.withColumns({"_probes": F.col("_m") + 1, "_keys": permutation_keys(seed, *case)})
    rows = explode_range(sized, "_probes", "_j").withColumn("_j", F.col("_j") - 1)
    spot = F.when(F.col("_j") < 0, F.lit(-1).cast("long")).otherwise(permuted("_j", pool_size, "_keys"))
    return rows.withColumn(out, spot).drop("_m", "_j", "_probes", "_keys")


def keep_per_case(
    df: DataFrame, case: Sequence[str], item: Sequence[str], n: int, seed: str, require: int | None = None
) -> DataFrame:
    """The true candidate (label 1) and up to ``n`` hash-chosen negatives per case.

    With ``require``, cases with fewer negatives than that drop out; the count
    stays inside the same grouping, so it costs no further shuffle.
    """
    groups = Window.partitionBy(*case)
    order = groups.orderBy(F.col("label").desc(), hash_key(seed, *case, *item), *item)
    kept = df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n + 1)
    if require is not None:
        kept = kept.withColumn("_kept", F.count(F.lit(1)).over(groups)).filter(F.col("_kept") > require)
        kept = kept.drop("_kept")
    return kept.drop("_rn")

"""What each column adds to the score of each row: exact contributions over the fitted trees.

A contribution is the Shapley value of a column in the tree's own expectation: where a column is not known, a row goes down both
branches in the shares of the training rows that did. Per leaf this has a closed form over the columns on its path, at most
as many as the tree is deep, so no subsets of all columns are ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.functions.numbers import round_to
from placewise.session import scratch_path

from .models import assemble


@dataclass(frozen=True)
class Leaf:
    """A leaf: the columns on its path, the range (low, high] each must be in, and what it adds for every set of met ranges.

    ``adds[p]`` holds a number per column; bit i of ``p`` says that the row is in the range of column i.
    """

    columns: np.ndarray
    low: np.ndarray
    high: np.ndarray
    adds: np.ndarray
    expected: float


def _leaf(columns: list[int], low: list[float], high: list[float], shares: list[float], value: float) -> Leaf:
    """Shapley values of the game: the product over columns of 1 or 0 (known: in range or not) or the column's share (not known)."""
    k = len(columns)
    adds = np.zeros((1 << k, k))
    for met in range(1 << k):
        known = [float(met >> i & 1) for i in range(k)]
        for i in range(k):
            others = [j for j in range(k) if j != i]
            for size in range(k):
                weight = factorial(size) * factorial(k - size - 1) / factorial(k)
                for chosen in combinations(others, size):
                    product = np.prod([known[j] if j in chosen else shares[j] for j in others])
                    adds[met, i] += weight * product * (known[i] - shares[i])
    expected = value * float(np.prod(shares))
    return Leaf(np.array(columns, np.int64), np.array(low), np.array(high), adds * value, expected)


def tree_leaves(nodes: Sequence, weight: float) -> list[Leaf]:
    """The leaves of one tree from its node rows (id, prediction, rawCount, children, split)."""
    at = {n["id"]: n for n in nodes}
    out = []
    stack = [(0, {})]  # node, and per column: low, high, share of the training rows
    while stack:
        number, path = stack.pop()
        node = at[number]
        if node["leftChild"] < 0:
            columns = sorted(path)
            parts = [path[c] for c in columns]
            out.append(_leaf(columns, [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts], weight * node["prediction"]))
            continue
        split = node["split"]
        if split["numCategories"] >= 0:
            raise ValueError("contributions are for numeric columns")
        column, border = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
        low, high, share = path.get(column, (-np.inf, np.inf, 1.0))
        for child, bounds in ((node["leftChild"], (low, min(high, border))), (node["rightChild"], (max(low, border), high))):
            part = at[child]["rawCount"] / node["rawCount"]
            stack.append((child, path | {column: (*bounds, share * part)}))
    return out


def model_leaves(model, spark) -> list[Leaf]:
    """The leaves of a fitted tree ensemble, from its saved node table (one row per node: a number fixed by the model's size)."""
    path = scratch_path(spark, "model")
    model.write().save(path)
    trees: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        trees.setdefault(r["treeID"], []).append(r)
    return [leaf for i, nodes in sorted(trees.items()) for leaf in tree_leaves(nodes, model.treeWeights[i])]


def add_up(rows: np.ndarray, leaves: Sequence[Leaf]) -> np.ndarray:
    """Contributions of every column (second axis) to every row (first axis)."""
    total = np.zeros_like(rows)
    for leaf in leaves:
        values = rows[:, leaf.columns]
        met = ((values > leaf.low) & (values <= leaf.high)) @ (1 << np.arange(len(leaf.columns)))
        total[:, leaf.columns] += leaf.adds[met]
    return total


def contributions(model, df: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per row: the keys, ``contributions`` (one number per column, in the order of ``names``), ``base`` and the model's ``margin``.

    The base is the expected margin of the training rows; base and contributions add up to the margin of the row. The
    margin of a classifier is that of label 1 before it is turned into a probability, of a regressor its prediction.
    """
    spark = df.sparkSession
    leaves = model_leaves(model, spark)
    base = sum(leaf.expected for leaf in leaves)
    scored = model.transform(assemble(df, names))
    margin = vector_to_array("rawPrediction")[1] if "rawPrediction" in scored.columns else F.col("prediction")
    given = scored.select(*keys, margin.alias("margin"), vector_to_array("features").alias("_x"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(names))
                found = add_up(x, leaves)
                lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, len(names), dtype=np.int32), found.ravel())
                columns = [*(batch.column(c) for c in (*keys, "margin")), pa.array(np.full(len(x), base)), lists]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "margin", "base", "contributions"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(walk, f"{fields}, base double, contributions array<double>")


def contribution_shares(rows: DataFrame, names: Sequence[str], enriched: Sequence[str]) -> DataFrame:
    """(name, is_enrichment, importance): mean absolute contribution per column, for ``compare.importance_shares``."""
    marks = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(n in set(enriched)).alias("is_enrichment")) for n in names))
    each = rows.select(F.explode(F.arrays_zip(marks.alias("column"), F.col("contributions").alias("value"))).alias("_c"))
    return each.groupBy("_c.column.name", "_c.column.is_enrichment").agg(F.avg(F.abs("_c.value")).alias("importance"))


def largest_gap(rows: DataFrame) -> DataFrame:
    """How far base and contributions are from the margin, at most: zero but for rounding."""
    total = F.aggregate("contributions", F.col("base"), lambda a, x: a + x)
    return rows.agg(round_to(F.max(F.abs(total - F.col("margin"))), 6).alias("largest_gap"), F.count(F.lit(1)).alias("n"))

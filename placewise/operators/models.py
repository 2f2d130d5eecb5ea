"""Model training and inspection on feature tables with Spark ML.

Tables are written out once before training (``session.stage``), because the
learners pass over them many times.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.numbers import finite_or_zero, hash_unit, round_to
from placewise.session import stage

from .compare import effect_label
from .sampling import shuffled_position, take_shuffled

VALIDATION_SHARE = 0.15


def assemble(df: DataFrame, names: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vector of finite values, keeping all other columns."""
    clean = df.withColumns({c: finite_or_zero(c) for c in names})
    return VectorAssembler(inputCols=list(names), outputCol=out).transform(clean)


def with_validation_flag(df: DataFrame, key: Sequence[str], share: float = VALIDATION_SHARE, seed: str = "val") -> DataFrame:
    """Mark a reproducible share of the training rows for early stopping."""
    return df.withColumn("is_validation", hash_unit(seed, *key) < share)


def column_moments(train: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean and population deviation per column, as one row per column."""
    wide = train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]
    )
    items = [
        F.struct(F.lit(c).alias("name"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("std"))
        for c in names
    ]
    return wide.select(F.explode(F.array(*items)).alias("_x")).select("_x.*")


def standardise(train: DataFrame, others: Sequence[DataFrame], names: Sequence[str]) -> list[DataFrame]:
    """Scale by the training mean and population deviation; constant columns only shift.

    The fitted moments are one number pair per column, read once like any fitted scaler.
    """
    moments = {r["name"]: (r["mean"], r["std"]) for r in column_moments(train, names).collect()}

    def scale(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (F.col(c) - F.lit(moments[c][0])) / F.lit(moments[c][1] or 1.0) for c in names}
        )

    return [scale(d) for d in (train, *others)]


def boosted_classifier(train: DataFrame, names: Sequence[str], key: Sequence[str], label: str = "label", **params):
    """Gradient-boosted trees for a 0/1 label, stopped early on a held-out share of the training rows."""
    rows = with_validation_flag(assemble(train, names), key)
    options = {"maxIter": 300, "maxDepth": 4, "stepSize": 0.1, "seed": 42} | params
    return GBTClassifier(labelCol=label, validationIndicatorCol="is_validation", **options).fit(rows)


def boosted_regressor(train: DataFrame, names: Sequence[str], key: Sequence[str], label: str, **params):
    """Gradient-boosted trees for a number, stopped early in the same way."""
    rows = with_validation_flag(assemble(train, names), key)
    options = {"maxIter": 300, "maxDepth": 4, "stepSize": 0.1, "seed": 42} | params
    return GBTRegressor(labelCol=label, validationIndicatorCol="is_validation", **options).fit(rows)


def neural_classifier(train: DataFrame, names: Sequence[str], label: str = "label", hidden: Sequence[int] = (128, 64), **params):
    """Feed-forward network; pass standardised features."""
    options = {"maxIter": 500, "seed": 42} | params
    layers = [len(names), *hidden, 2]
    return MultilayerPerceptronClassifier(labelCol=label, layers=layers, **options).fit(assemble(train, names))


def logistic_classifier(train: DataFrame, names: Sequence[str], label: str = "label", **params):
    """Logistic regression; pass standardised features."""
    options = {"maxIter": 1000, "regParam": 0.01} | params
    return LogisticRegression(labelCol=label, **options).fit(assemble(train, names))


def score_binary(model, df: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Probability of label 1 and the 0/1 prediction."""
    scored = model.transform(assemble(df, names))
    return scored.select(
        *keys,
        vector_to_array("probability")[1].alias("score"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def score_number(model, df: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Predicted number."""
    return model.transform(assemble(df, names)).select(*keys, "prediction")


def accuracy(scored: DataFrame, label: str = "label") -> float:
    hit = F.avg((F.col("prediction") == F.col(label)).cast("double"))
    return float(scored.agg(hit.alias("a")).first()["a"] or 0.0)


def ablation(
    train: DataFrame, test: DataFrame, names: Sequence[str], enriched: Sequence[str], key: Sequence[str], level: str, **params
) -> DataFrame:
    """Accuracy with and without the enrichment columns, and what they did."""
    spark = train.sparkSession
    train, test = stage(train, "ablation-train"), stage(test, "ablation-test")
    plain = [c for c in names if c not in set(enriched)]
    with_all = accuracy(score_binary(boosted_classifier(train, names, key, **params), test, names, [*key, "label"]))
    without = with_all
    if len(plain) < len(names):
        without = accuracy(score_binary(boosted_classifier(train, plain, key, **params), test, plain, [*key, "label"]))
    row = [(level, with_all, without, len(enriched), len(names))]
    result = spark.createDataFrame(
        row, "level string, acc_with double, acc_without double, n_enrichment int, n_features int"
    )
    delta = F.col("acc_with") - F.col("acc_without")
    return result.select(
        "level", round_to("acc_with", 4).alias("acc_with"), round_to("acc_without", 4).alias("acc_without"),
        round_to(delta * 100, 2).alias("delta_pp"), effect_label(delta).alias("effect"),
        "n_enrichment", "n_features",
    )


def importances(model, names: Sequence[str], enriched: Sequence[str], spark) -> DataFrame:
    """(name, importance, is_enrichment) of a tree model: one row per feature."""
    marks = set(enriched)
    rows = [(n, float(v), n in marks) for n, v in zip(names, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "name string, importance double, is_enrichment boolean")


def permutation_importance(
    model, df: DataFrame, names: Sequence[str], key: Sequence[str], label: str = "label", seed: str = "perm"
) -> DataFrame:
    """Accuracy lost when one feature at a time is taken from a random other row.

    Every row gets one donor row by joining two shuffles on their positions;
    the copies with one swapped feature are then scored in a single pass.
    """
    base = df.select(*key, label, F.array(*[finite_or_zero(c) for c in names]).alias("_x"))
    rows = shuffled_position(base, key, seed, out="_pos", size_out="_n")
    donors = shuffled_position(base.select(*key, F.col("_x").alias("_donor")), key, f"{seed}-donor", out="_pos", size_out="_m")
    paired = rows.join(donors.select("_pos", "_donor"), "_pos")
    # Feature -1 is the unchanged row.
    copies = paired.withColumn("_f", F.explode(F.sequence(F.lit(-1), F.lit(len(names) - 1))))
    swapped = F.transform("_x", lambda v, i: F.when(i == F.col("_f"), F.get("_donor", i)).otherwise(v))
    scored = model.transform(copies.withColumn("features", array_to_vector(swapped)))
    acc = scored.groupBy("_f").agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("_acc"))
    unchanged = acc.filter(F.col("_f") == -1).select("_acc").scalar()
    labels = F.array(*[F.lit(n) for n in names])
    return acc.filter(F.col("_f") >= 0).select(
        F.get(labels, F.col("_f")).alias("name"),
        round_to(unchanged - F.col("_acc"), 6).alias("accuracy_drop"),
    )


def grid(
    train: DataFrame, test: DataFrame, cells: dict[tuple[str, str], Sequence[str]], learner, keys: Sequence[str], side_by_side: int = 4
) -> DataFrame:
    """Fit ``learner`` for every (tier, level) and score the test rows: one table with the keys, tier, level, score and prediction.

    All columns of all cells are assembled and written once; a cell takes its columns from the vector. Fits of
    different cells do not wait for each other: ``side_by_side`` of them run at a time, each in a scheduler pool of its own, so that
    with fair scheduling the short jobs of one fill the gaps of the others. ``learner`` is an estimator over ``features``.
    """
    spark = train.sparkSession
    names = list(dict.fromkeys(n for columns in cells.values() for n in columns))
    rows, asked = (
        stage(assemble(df, names, "_all").select(*(c for c in df.columns if c not in names), "_all"), "grid") for df in (train, test)
    )

    def one(cell: tuple[str, str]) -> DataFrame:
        tier, level = cell
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{tier}-{level}")
        taken = VectorSlicer(inputCol="_all", outputCol="features", indices=[names.index(n) for n in cells[cell]])
        scored = learner.fit(taken.transform(rows)).transform(taken.transform(asked))
        score = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
        marks = {"tier": F.lit(tier), "level": F.lit(level), "n_features": F.lit(len(cells[cell]))}
        return scored.withColumns(marks).select("tier", "level", "n_features", *keys, score.alias("score"), F.col("prediction").cast("double").alias("prediction"))

    with ThreadPoolExecutor(side_by_side) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, cells))


#: Rows of the sample whose pair distances are taken.
SEPARATION_ROWS = 2000


def separation(df: DataFrame, names: Sequence[str], key: Sequence[str], label: str = "label", rows: int = SEPARATION_ROWS) -> float:
    """Silhouette of the label classes in standardised feature space, with Euclidean distance.

    The distances need all pairs, so they are taken over a bounded sample (``rows`` rows, drawn by hash of the key; all if there
    are fewer). The sample is sent to the tasks as one matrix, and every task turns its rows into sums of distances per
    class, one tile of rows at a time: no pair is ever a row.
    """
    (scaled,) = standardise(df, [], names)
    drawn = take_shuffled(scaled.select(*key, label, *names), key, rows, "separation")
    sample = stage(assemble(drawn, names).select(F.col(label).cast("int").alias("_class"), vector_to_array("features").alias("_x")), "sample")
    held = sample.collect()  # at most ``rows`` of them
    matrix, classes = np.array([r["_x"] for r in held]), np.array([r["_class"] for r in held])
    if len(set(classes.tolist())) < 2:
        return 0.0

    def silhouettes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                own = batch.column("_class").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(row_silhouettes(x, own, matrix, classes))], ["s"])

    return float(sample.mapInArrow(silhouettes, "s double").agg(F.avg("s")).first()[0])


def row_silhouettes(x: np.ndarray, own: np.ndarray, matrix: np.ndarray, classes: np.ndarray, tile: int = 256) -> np.ndarray:
    """Silhouette of each row of ``x`` against all rows of ``matrix``, of which it is one; a class of one row scores 0."""
    labels, sizes = np.unique(classes, return_counts=True)
    members = (classes[:, None] == labels).astype(float)
    out = np.zeros(len(x))
    for at in range(0, len(x), tile):
        part, mine = x[at : at + tile], np.searchsorted(labels, own[at : at + tile])
        apart = np.sqrt(((part[:, None, :] - matrix[None, :, :]) ** 2).sum(axis=2))
        sums = apart @ members
        rows = np.arange(len(part))
        inside = sums[rows, mine] / np.maximum(sizes[mine] - 1, 1)
        means = sums / sizes
        means[rows, mine] = np.inf
        nearest = means.min(axis=1)
        scores = (nearest - inside) / np.maximum(np.maximum(inside, nearest), 1e-300)
        out[at : at + tile] = np.where(sizes[mine] > 1, scores, 0.0)
    return out


def separation_table(df: DataFrame, levels: dict[str, tuple[Sequence[str], Sequence[str]]], key: Sequence[str]) -> DataFrame:
    """Silhouette per level with all columns and without the enrichment columns."""
    staged = stage(df, "separation")
    rows = [
        (level, separation(staged, full, key), separation(staged, plain, key), len(full), len(plain))
        for level, (full, plain) in levels.items()
    ]
    result = df.sparkSession.createDataFrame(
        rows, "level string, full_silhouette double, plain_silhouette double, full_dims int, plain_dims int"
    )
    return result.withColumns({c: round_to(c, 4) for c in ("full_silhouette", "plain_silhouette")})

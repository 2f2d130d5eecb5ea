"""Small helpers shared by the text operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points of a word: everything but the space and \t \n \v \f \r.
WORD = r"[^ \t\n\x0B\f\r]+"
#: Rows of one Arrow batch: bounds the memory of a Python worker when texts are long.
BATCH_ROWS = 512


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    """A null text is the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``function`` to Arrow batches of at most ``BATCH_ROWS`` rows; ``None`` means no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                out = function(batch.slice(start, BATCH_ROWS))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold few rows, so that a batch of very long texts fits a worker, and let workers find this package
    from whatever folder the session was started.

    Only a larger number of rows than ours is lowered; the settings change no result.
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


# -- labelled rows -------------------------------------------------------------

#: Folds of the ids by crc32(id as text) mod 4: the last number is held out of every fit.
FIT_FOLDS, HELD_OUT = (0, 1, 3), 2


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def hash_share(seed: str, key: str) -> Column:
    """A number from 0 to 1 drawn by hash."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 20)) / F.lit(float(1 << 20))


def labelled_sample(labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """(_id, _label) of about ``per_class`` rows a class outside the held-out fold, at most three times that in all, and the
    share of each class that was taken. A repeated id counts as its highest label; null labels are none."""
    rows = (
        labels.where(fold(F.col("doc_id")).isin(*FIT_FOLDS) & F.col(label).isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.max(label).cast("int").alias("_label"))
    )
    sizes = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    share = {c: min(1.0, per_class / n) for c, n in sizes.items()}
    taken = F.lit(False)
    for c, s in share.items():
        taken = taken | ((F.col("_label") == c) & (hash_share("sample", "_id") < s))
    return rows.where(taken).limit(3 * per_class), share

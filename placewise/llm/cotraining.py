"""Quality classifier by co-training of two views.

The text view sees only the text (lengths, character classes, repetition, hashed words), the metadata view only the other columns
of the page (language, source, length field). Both are logistic regressions trained by Spark.

1. A labelled sample, about ``per_class`` rows a class (the documented bound of the fit), and an unlabelled pool of
   about ``pool`` documents are drawn by hash; their features are written.
2. In every round each view is fitted on the labelled rows and on the pool rows the *other* view was confident
   about in the round before, with half weight.
3. A third of the labelled sample is never trained on: there each view's margin is calibrated (a logistic curve), and a last
   regression weighs the two calibrated views.
4. All documents are scored in one pass; the model sent to the tasks is two short coefficient vectors.

Labels of the held-out fold (crc32 of the id mod 4 = 2) are never used.

Defined results: a null text is empty; null metadata have features of their own; without both classes among the labels
every document gets the share of good labels (0 without labels); repeated rows are scored one by one; null ids
are carried along and never drawn; a repeated label counts as its highest value; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from math import log1p
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.session import stage

from .common import hash_share, labelled_sample, map_batches, small_batches, text_or_empty

WORDS = re.compile(r"\S+")
WORD_BUCKETS, LANG_BUCKETS, SOURCE_BUCKETS, LENGTH_BUCKETS = 64, 8, 32, 24
#: Classes of bytes whose shares are features.
BYTE_CLASSES = {
    "letters": b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digits": b"0123456789",
    "stops": b".,;:!?'\"-()",
    "symbols": b"#*$%&|<>@=+^~_\\/[]{}",
    "spaces": b" \t\n\v\f\r",
}
_CLASS = np.zeros((256, len(BYTE_CLASSES)))
for _i, _members in enumerate(BYTE_CLASSES.values()):
    _CLASS[list(_members), _i] = 1.0

TEXT_SIZE = len(BYTE_CLASSES) + 6 + WORD_BUCKETS
META_SIZE = 3 + LANG_BUCKETS + SOURCE_BUCKETS + LENGTH_BUCKETS
_MEMO = 400_000
FIT_ROWS = 8192


class Buckets(dict):
    """Word to its bucket; bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        self[word] = found = crc32(word.lower().encode("utf-8", "replace")) % WORD_BUCKETS
        return found


_BUCKETS = Buckets()


def text_features(text: str) -> np.ndarray:
    """Shares of byte classes; lengths, repeated lines and distinct words; normalised counts of hashed words."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    shares = np.bincount(data, minlength=256) @ _CLASS / max(len(data), 1)
    found = WORDS.findall(text)
    words = Counter(found)
    n = max(len(found), 1)
    lines = [line for line in text.split("\n") if line.strip()]
    most = max(words.values(), default=0)
    more = (
        log1p(len(found)),
        (len(text) - text.count(" ")) / n,
        len(words) / n,
        most / n,
        1 - len(set(lines)) / max(len(lines), 1),
        log1p(len(found) / max(len(lines), 1)),
    )
    buckets = np.zeros(WORD_BUCKETS)
    at = np.fromiter(map(_BUCKETS.__getitem__, words), np.int64, len(words))
    np.add.at(buckets, at, np.sqrt(np.fromiter(words.values(), np.float64, len(words))))
    norm = np.sqrt((buckets**2).sum())
    return np.concatenate([shares, more, buckets / norm if norm else buckets])


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed language and source, the length field and its power of two, and which of them are missing."""
    out = np.zeros(META_SIZE)
    out[0], out[1], out[2] = lang is None, source is None, n_chars is None
    at = 3
    for value, size in ((lang, LANG_BUCKETS), (source, SOURCE_BUCKETS)):
        if value is not None:
            out[at + crc32(value.encode("utf-8", "replace")) % size] = 1
        at += size
    if n_chars is not None:
        out[at + min(max(int(n_chars), 0).bit_length(), LENGTH_BUCKETS - 1)] = 1
    return out


@dataclass
class View:
    coefficients: np.ndarray
    intercept: float
    slope: float  # of the calibration curve
    shift: float

    def calibrated(self, features: np.ndarray) -> float:
        return self.slope * (float(features @ self.coefficients) + self.intercept) + self.shift


@dataclass
class CoTrained:
    """Both views and their weights, or only the share of good labels where there is nothing to learn."""

    prior: float
    text: View | None = None
    meta: View | None = None
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def score(self, text: str, lang: str | None, source: str | None, n_chars: int | None) -> tuple[float, float, float]:
        """Probability of good quality: combined, by the text, by the metadata."""
        if self.text is None or self.meta is None:
            return self.prior, self.prior, self.prior
        a, b = self.text.calibrated(text_features(text)), self.meta.calibrated(meta_features(lang, source, n_chars))
        return _sigmoid(self.weights[0] * a + self.weights[1] * b + self.weights[2]), _sigmoid(a), _sigmoid(b)


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def _features(rows: DataFrame) -> DataFrame:
    """(_id, _label, _weight, a, b) of rows with text and metadata."""

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [text_features(t) for t in batch.column("text").to_pylist()]
        given = zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)
        metas = [meta_features(*g) for g in given]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("_id", "_label", "_weight")), pa.array(texts, pa.list_(pa.float64())), pa.array(metas, pa.list_(pa.float64()))],
            ["_id", "_label", "_weight", "a", "b"],
        )

    schema = "_id long, _label int, _weight double, a array<double>, b array<double>"
    return map_batches(rows, compute, schema)


def _fit(rows: DataFrame, column: str) -> tuple:
    """Spark's logistic regression on ``column`` (an array), label and weight; returns the model."""
    given = rows.select(array_to_vector(column).alias("features"), F.col("_label").cast("double").alias("label"), "_weight")
    return LogisticRegression(weightCol="_weight", regParam=1e-3, maxIter=30, tol=1e-4).fit(given)


def _margins(model, rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the model's log-odds of ``column``."""
    applied = model.transform(rows.withColumn("features", array_to_vector(column)))
    return applied.withColumn(name, vector_to_array("rawPrediction")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _columns(docs: DataFrame, doc_id: str, text: str, lang: str, source: str, n_chars: str) -> DataFrame:
    return docs.select(
        F.col(doc_id).cast("long").alias("_id"),
        text_or_empty(text).alias("text"),
        F.col(lang).cast("string").alias("lang"),
        F.col(source).cast("string").alias("source"),
        F.col(n_chars).cast("long").alias("n_chars"),
    )


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 6000,
    pool: int = 12000,
    rounds: int = 3,
    confidence: float = 0.95,
    **columns: str,
) -> CoTrained:
    """Co-train the two views; see the module for the steps."""
    spark = docs.sparkSession
    small_batches(spark)
    given = _columns(docs, **(_NAMES | columns))
    sample, share = labelled_sample(labels, "quality", per_class)
    mass = {c: labelled / share[c] for c, labelled in ((r["_label"], r["count"]) for r in sample.groupBy("_label").count().collect())}
    prior = mass.get(1, 0.0) / sum(mass.values()) if mass else 0.0
    if len(mass) < 2:
        return CoTrained(prior)
    weight = F.when(F.col("_label") == 1, F.lit(1 / share[1])).otherwise(F.lit(1 / share[0]))
    # The sample has at most three times per_class rows of two numbers: small enough to be sent to every task.
    labelled = given.join(F.broadcast(sample), "_id").withColumn("_weight", weight)
    rate = min(1.0, pool / max(docs.count(), 1))
    drawn = given.where(hash_share("pool", "_id") < rate).join(
        labels.select(F.col("doc_id").cast("long").alias("_id")).distinct(), "_id", "left_anti"
    )
    unlabelled = drawn.select("*", F.lit(None).cast("int").alias("_label"), F.lit(sum(mass.values()) / (2 * pool)).alias("_weight"))
    rows = stage(_features(labelled.unionByName(unlabelled)), "views")
    rows = rows.coalesce(1 + (2 * per_class + pool) // FIT_ROWS)  # one task per FIT_ROWS rows of the bounded sample
    known = rows.where("_label is not null").withColumn("_check", hash_share("calibration", "_id") < 1 / 3)
    train, check, free = known.where("not _check").drop("_check"), known.where("_check").drop("_check"), rows.where("_label is null")
    if {r["_label"] for r in train.select("_label").distinct().collect()} != {0, 1}:
        return CoTrained(prior)

    def confident(model, column: str) -> DataFrame:
        """Pool rows of which the model is sure, labelled by it."""
        cut = float(np.log(confidence / (1 - confidence)))
        marked = _margins(model, free.drop("_label"), column, "_margin").where(F.abs("_margin") >= cut)
        return marked.withColumn("_label", (F.col("_margin") > 0).cast("int")).select(train.columns)

    text_model, meta_model = _fit(train, "a"), _fit(train, "b")
    for _ in range(rounds):
        from_text, from_meta = confident(text_model, "a"), confident(meta_model, "b")
        text_model, meta_model = _fit(train.union(from_meta), "a"), _fit(train.union(from_text), "b")

    views, both = {}, check
    for name, model, column in (("text", text_model, "a"), ("meta", meta_model, "b")):
        both = _margins(model, both, column, f"m_{name}")
        curve = _fit(both.withColumn("m", F.array(f"m_{name}")), "m")
        views[name] = View(model.coefficients.toArray(), float(model.intercept), float(curve.coefficients[0]), float(curve.intercept))
        both = both.withColumn(f"c_{name}", F.lit(views[name].slope) * F.col(f"m_{name}") + F.lit(views[name].shift))
    last = _fit(both.withColumn("c", F.array("c_text", "c_meta")), "c")
    return CoTrained(prior, views["text"], views["meta"], (*map(float, last.coefficients), float(last.intercept)))


_NAMES = {"doc_id": "doc_id", "text": "text", "lang": "lang", "source": "source", "n_chars": "n_chars"}


def score_quality(docs: DataFrame, model: CoTrained, threshold: float = 0.5, **columns: str) -> DataFrame:
    """doc_id, score (probability of good quality), text_score, meta_score, kept (score of at least ``threshold``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two short vectors

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        given = zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars")), strict=True)
        found = [shared.value.score(*g) for g in given]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("_id"),
                *(pa.array([f[i] for f in found], pa.float64()) for i in range(3)),
                pa.array([f[0] >= threshold for f in found], pa.bool_()),
            ],
            ["doc_id", "score", "text_score", "meta_score", "kept"],
        )

    small_batches(docs.sparkSession)
    rows = _columns(docs, **(_NAMES | columns))
    return map_batches(rows, score, "doc_id long, score double, text_score double, meta_score double, kept boolean")

"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fitting
  * A sample of labelled rows, about ``per_class`` of each class by a hash of the id (the documented bound of the
    fit), gives the vocabulary: words and word beginnings (4 to 6 letters) whose share of toxic texts is far from
    their share of clean ones, at most ``vocabulary`` terms.
  * Document frequencies of these terms are counted over all documents.
  * Two thirds of the sample become the index: examples with equal vectors are one example with label counts;
    examples are cut into blocks, and each term keeps its largest weight per block.
  * The last third calibrates: an isotonic map from the vote to the share of toxic rows, weighted back to the class
    sizes before sampling.

Scoring
  Terms of a text give an upper bound per block; blocks are opened from the highest bound down until no bound
  reaches the k-th best cosine, so the k nearest examples are exact. Their labels vote with weights that fall with
  the distance; a prior of fixed weight stands for the rest. The nearest examples and shared terms are
  the evidence.

Everything that is sent to the tasks is bounded by ``per_class`` and ``vocabulary``. Labels, languages, sources and
ids are never inputs of a score.

Defined results: a null or empty text, or one without vocabulary terms, has no neighbours and gets the calibrated prior;
without any labelled row every score is 0; rows of repeated ids are scored one by one; a repeated label counts as its
highest value; null labels are no labels; ties of cosine go to the example with the smaller first id.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from math import log, log1p, sqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HELD_OUT, fold, labelled_sample, map_batches, small_batches, text_or_empty

WORDS = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are terms beside the whole word.
BEGINNINGS = (4, 5, 6)
LONGEST_TERM = 32
#: Terms for the number of words of a text that have vocabulary terms: one, two, three, four or more.
HITS = ("#1", "#2", "#3", "#4")
#: A term counts if seen in this many sample texts, this many standard errors apart, with this ratio of shares.
LEAST_SEEN, LEAST_Z, LEAST_LIFT = 6, 5.0, 3.0
BLOCK = 64
PRIOR_WEIGHT = 1.0
_MEMO = 400_000


def words(text: str) -> Counter[str]:
    return Counter(WORDS.findall(text.lower()))


def terms_of(word: str) -> list[str]:
    """The word itself and its beginnings, which end in a star."""
    return [word[:LONGEST_TERM], *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


class Lookup(dict):
    """Word to the ids of its vocabulary terms; bounded, so that rare words do not pile up."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= _MEMO:
            self.clear()
        self[word] = found = tuple(self.vocabulary[t] for t in terms_of(word) if t in self.vocabulary)
        return found

    def count(self, text: str) -> Counter[int]:
        out: Counter[int] = Counter()
        hits = 0
        for word, n in words(text).items():
            found = self[word]
            hits += n if found else 0
            for term in found:
                out[term] += n
        if hits:
            out[self.vocabulary[HITS[min(hits, len(HITS)) - 1]]] = 1
        return out


_LOOKUP: Lookup | None = None


def _worker_lookup(vocabulary: dict[str, int]) -> Lookup:
    """The worker's memo of words, kept from batch to batch."""
    global _LOOKUP
    if _LOOKUP is None or _LOOKUP.vocabulary != vocabulary:
        _LOOKUP = Lookup(vocabulary)
    return _LOOKUP


# -- the index -----------------------------------------------------------------


@dataclass
class BlockMaxIndex:
    """Postings cut into blocks of examples: per block one row of weights for each term that it holds, and per term and
    block the largest weight."""

    block_max: np.ndarray  # terms x blocks
    row: np.ndarray  # blocks x terms: row of ``postings``, 0 for terms that the block lacks
    postings: np.ndarray  # rows x BLOCK weights; row 0 is empty

    @staticmethod
    def build(vectors: list[dict[int, float]], n_terms: int) -> BlockMaxIndex:
        n_blocks = -(-len(vectors) // BLOCK)
        block_max = np.zeros((n_terms, n_blocks))
        row = np.zeros((n_blocks, n_terms), np.int32)
        postings = [np.zeros(BLOCK)]
        for e, vector in enumerate(vectors):
            block, place = divmod(e, BLOCK)
            for t, w in vector.items():
                if not row[block, t]:
                    row[block, t] = len(postings)
                    postings.append(np.zeros(BLOCK))
                postings[row[block, t]][place] = w
                block_max[t, block] = max(block_max[t, block], w)
        return BlockMaxIndex(block_max, row, np.array(postings))

    def nearest(self, query: dict[int, float], k: int, at_once: int = 4) -> list[tuple[float, int]]:
        """The exact ``k`` best (cosine, example) with a positive cosine, best first, ties by example.

        Blocks are opened from the highest bound down, a few at once, until no bound reaches the k-th best.
        """
        terms = np.fromiter(query.keys(), np.int64, len(query))
        weights = np.fromiter(query.values(), np.float64, len(query))
        bound = weights @ self.block_max[terms]
        order = np.argsort(-bound, kind="stable")[: np.count_nonzero(bound)]
        scores, examples, least = np.empty(0), np.empty(0, np.int64), 0.0
        for at in range(0, len(order), at_once):
            blocks = order[at : at + at_once]
            if bound[blocks[0]] < least - 1e-9:
                break
            found = np.einsum("t,bte->be", weights, self.postings[self.row[blocks][:, terms]])
            some, place = np.nonzero(found)
            scores = np.append(scores, found[some, place].round(9))
            examples = np.append(examples, blocks[some] * BLOCK + place)
            if len(scores) > k:
                best = np.lexsort((examples, -scores))[:k]
                scores, examples = scores[best], examples[best]
            if len(scores) == k:
                least = scores.min()
        best = np.lexsort((examples, -scores))
        return list(zip(scores[best].tolist(), examples[best].tolist(), strict=True))


# -- the model -----------------------------------------------------------------


@dataclass
class ToxicityModel:
    """What scoring needs; its size is bounded by the fit's sample and vocabulary."""

    terms: list[str]
    idf: list[float]
    index: BlockMaxIndex | None
    ids: list[int]  # the smallest id of each example
    toxic: list[int]
    total: list[int]
    prior: float
    k: int
    curve: list[tuple[float, float]] = field(default_factory=list)

    def vector(self, counts: Counter[int]) -> dict[int, float]:
        weights = {t: log1p(n) * self.idf[t] for t, n in counts.items()}
        norm = sqrt(sum(w * w for w in weights.values()))
        return {t: w / norm for t, w in weights.items()} if norm else {}

    def vote(self, vector: dict[int, float]) -> tuple[float, list[tuple[float, int]]]:
        """Distance-weighted share of toxic labels among the nearest examples, and these examples."""
        near = self.index.nearest(vector, self.k) if self.index and vector else []
        yes, all_ = PRIOR_WEIGHT * self.prior, PRIOR_WEIGHT
        for cosine, e in near:
            weight = cosine / (1.05 - min(cosine, 1.0)) / 20 * (1 + log(self.total[e]))
            yes += weight * self.toxic[e] / self.total[e]
            all_ += weight
        return yes / all_, near

    def calibrated(self, raw: float) -> float:
        if not self.curve:
            return raw
        x, y = zip(*self.curve, strict=True)
        return float(np.clip(np.interp(raw, x, y), 0, 1))


def isotonic(points: list[tuple[float, int, float]], prior: float) -> list[tuple[float, float]]:
    """(raw, label, weight) to the points of a non-decreasing curve; each step is drawn to the prior by one row."""
    tied: dict[float, list[float]] = {}  # sum of weights, of weighted labels, of weighted raw
    for raw, label, weight in points:
        sums = tied.setdefault(round(raw, 9), [0.0, 0.0, 0.0])
        for i, value in enumerate((1.0, label, raw)):
            sums[i] += weight * value
    steps: list[list[float]] = []
    for _, sums in sorted(tied.items()):
        steps.append(sums)
        while len(steps) > 1 and steps[-2][1] * steps[-1][0] >= steps[-1][1] * steps[-2][0]:
            last = steps.pop()
            steps[-1] = [a + b for a, b in zip(steps[-1], last, strict=True)]
    return [(r / w, (y + prior) / (w + 1)) for w, y, r in steps]


def _vocabulary(texts: DataFrame, size: int) -> list[str]:
    """Terms of the sample texts with far apart shares in the two classes."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        toxic, clean = Counter(), Counter()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("_label").to_pylist(), strict=True):
            (toxic if label else clean).update({t for w in words(text) for t in terms_of(w)})
        terms = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_pydict(
            {
                "term": pa.array(terms, pa.string()),
                "toxic": pa.array([toxic[t] for t in terms], pa.int64()),
                "clean": pa.array([clean[t] for t in terms], pa.int64()),
            }
        )

    sizes = {r["_label"]: r["count"] for r in texts.groupBy("_label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return []
    counts = map_batches(texts, count, "term string, toxic long, clean long").groupBy("term")
    seen = counts.agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).where(F.col("a") + F.col("b") >= LEAST_SEEN)
    pooled = (F.col("a") + F.col("b")) / F.lit(float(n1 + n0))
    p1, p0 = F.col("a") / F.lit(float(n1)), F.col("b") / F.lit(float(n0))
    z = F.abs(p1 - p0) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * F.lit(1 / n1 + 1 / n0))
    apart = F.greatest(p1, p0) >= LEAST_LIFT * F.least(p1, p0)
    top = seen.withColumn("z", z).where(apart & (F.col("z") >= LEAST_Z)).orderBy(F.desc("z"), "term").limit(size)
    found = sorted(r["term"] for r in top.collect())
    return [*found, *HITS] if found else []


def _document_frequencies(docs: DataFrame, text: str, terms: list[str]) -> tuple[int, list[int]]:
    """Number of documents, and of those that hold each term, over all documents."""
    vocabulary = {t: i for i, t in enumerate(terms)}

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        lookup = _worker_lookup(vocabulary)
        seen = Counter({-1: batch.num_rows})
        for t in batch.column(0).to_pylist():
            seen.update(lookup.count(t).keys())
        return pa.RecordBatch.from_pydict({"term": pa.array(list(seen), pa.int32()), "n": pa.array(list(seen.values()), pa.int64())})

    counted = map_batches(docs.select(text_or_empty(text).alias("text")), count, "term int, n long")
    found = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(len(terms))]


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 6000,
    vocabulary: int = 2048,
    k: int = 15,
    doc_id: str = "doc_id",
    text: str = "text",
) -> ToxicityModel:
    """Fit on the labelled rows outside the held-out fold; see the module for the steps."""
    small_batches(docs.sparkSession)
    sample, share = labelled_sample(labels, "toxic", per_class)
    # The sample is bounded by per_class rows a class of two numbers each: small enough to be sent to every task.
    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), text_or_empty(text).alias("text")).join(
        F.broadcast(sample), "_id"
    )
    terms = _vocabulary(texts, vocabulary)
    n_docs, frequency = _document_frequencies(docs, text, terms)
    ids = {t: i for i, t in enumerate(terms)}

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        lookup = Lookup(ids)
        counted = [lookup.count(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("_id"),
                batch.column("_label"),
                pa.array([list(c) for c in counted], pa.list_(pa.int32())),
                pa.array([list(c.values()) for c in counted], pa.list_(pa.int32())),
            ],
            ["id", "toxic", "terms", "counts"],
        )

    rows = map_batches(texts, vectors, "id long, toxic int, terms array<int>, counts array<int>").collect()
    size = {c: sum(r["toxic"] == c for r in rows) for c in (0, 1)}
    weight = {c: 1 / share[c] for c in share}
    mass = {c: size[c] * weight.get(c, 0) for c in (0, 1)}
    prior = mass[1] / (mass[0] + mass[1]) if rows else 0.0
    idf = [log((1 + n_docs) / (1 + n)) + 0.1 for n in frequency]
    model = ToxicityModel(terms, idf, None, [], [], [], prior, k)
    examples: dict[tuple, list[int]] = {}
    checks = []
    for r in sorted(rows, key=lambda r: r["id"]):
        vector = model.vector(Counter(dict(zip(r["terms"], r["counts"], strict=True))))
        if crc32(f"calibration {r['id']}".encode()) % 3 == 0:
            checks.append((vector, r["toxic"]))
        elif vector:
            key = tuple(sorted((t, round(w, 9)) for t, w in vector.items()))
            found = examples.setdefault(key, [r["id"], 0, 0])
            found[1] += r["toxic"]
            found[2] += 1
    # Similar examples stand in one block: they are sorted by their heaviest terms.
    ordered = sorted(examples.items(), key=lambda e: (sorted(((-w, t) for t, w in e[0]))[:3], e[1][0]))
    if ordered:
        model.index = BlockMaxIndex.build([dict(key) for key, _ in ordered], len(terms))
        model.ids = [v[0] for _, v in ordered]
        model.toxic = [v[1] for _, v in ordered]
        model.total = [v[2] for _, v in ordered]
    points = [(model.vote(vector)[0], label, weight[label]) for vector, label in checks]
    model.curve = isotonic(points, prior) if points else []
    return model


class Scorer:
    """Score, nearest examples and term weights of single texts."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.lookup = Lookup({t: i for i, t in enumerate(model.terms)})
        self.memo: dict[frozenset, tuple] = {}

    def __call__(self, text: str) -> tuple[float, list[tuple[float, int]], dict[int, float]]:
        counts = self.lookup.count(text)
        key = frozenset(counts.items())
        if key not in self.memo:
            if len(self.memo) >= _MEMO // 10:
                self.memo.clear()
            vector = self.model.vector(Counter(dict(sorted(counts.items()))))
            raw, near = self.model.vote(vector)
            self.memo[key] = self.model.calibrated(raw), near, vector
        return self.memo[key]


_SCORER: Scorer | None = None


def _worker_scorer(model: ToxicityModel) -> Scorer:
    """The worker's scorer, kept from batch to batch for its memo of words."""
    global _SCORER
    if _SCORER is None or _SCORER.model is not model:
        _SCORER = Scorer(model)
    return _SCORER


def score_toxicity(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text", evidence: int = 3) -> DataFrame:
    """doc_id, held_out, score, predicted (at 0.3), and the evidence: nearest example ids, cosines and the shared terms."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fit's parameters
    held = F.coalesce(fold(F.col(doc_id)) == HELD_OUT, F.lit(False))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = _worker_scorer(shared.value)
        found = [scorer(t) for t in batch.column("text").to_pylist()]
        known = shared.value
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array([f[0] for f in found], pa.float64()),
                pa.array([int(f[0] >= 0.3) for f in found], pa.int32()),
                pa.array([[known.ids[e] for _, e in f[1][:evidence]] for f in found], pa.list_(pa.int64())),
                pa.array([[c for c, _ in f[1][:evidence]] for f in found], pa.list_(pa.float64())),
                pa.array([[known.terms[t] for t in sorted(f[2], key=lambda t, v=f[2]: (-v[t], t))[:evidence]] for f in found], pa.list_(pa.string())),
            ],
            ["doc_id", "held_out", "score", "predicted", "example_ids", "cosines", "terms"],
        )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"), text_or_empty(text).alias("text"))
    small_batches(docs.sparkSession)
    return map_batches(
        rows,
        score,
        "doc_id long, held_out boolean, score double, predicted int, example_ids array<long>, cosines array<double>, terms array<string>",
    )


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows that score under ``threshold``, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = _worker_scorer(shared.value)
        at = batch.schema.get_field_index(text)
        return batch.filter(pa.array([scorer(t or "")[0] < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    small_batches(docs.sparkSession)
    return map_batches(docs, keep, docs.schema)


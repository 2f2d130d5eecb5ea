"""Secret scans: fixed patterns, and a randomness test battery for all other long tokens.

Two passes over the texts, nothing but a histogram is shuffled:

1. Candidates are the runs of at least ``MIN_RUN`` token characters outside the fixed patterns' spans. The smallest alphabet
   that holds a run is its encoding. The battery has three tests of its being uniformly random over that alphabet:
   chi-squared uniformity, runs, and lag-one serial correlation, combined by Fisher's method. A run that the battery
   rejects (``LEAST_RANDOMNESS``) is no secret.
2. For the others the question is how likely an ordinary identifier is to look like that. Ordinary identifiers have a model of
   fixed values: letters with their usual frequencies, in words, with changes of case and digits now and then. The ratio of the
   two likelihoods is at least 1/p with probability at most p for an ordinary identifier, at any length (Markov's inequality),
   so its inverse, divided by the number of encodings tried, is a p-value. The evidence grows with the length of the run.
3. The p-values of all candidates of the corpus are counted per length class and bin (a table of fixed size), and in each length class
   the Benjamini-Hochberg step gives the largest threshold at which at most a share ``q`` of what is flagged is expected to
   be ordinary. The guarantee holds for tables of any size: a lone key in three rows is found as one among millions is.
   Flagged runs are added to the fixed patterns' spans.

Defined results: a null text is empty; an empty text has no spans; repeated rows give repeated rows; a
null id stays null; an empty table gives an empty result; columns beside id and text are ignored by
``scan_secrets`` and kept untouched by ``redact_secrets``. Very long texts cost their length: spans and runs are walked side by side.
Equal p-values fall on the same side of a threshold.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches, text_or_empty

# The base patterns and the least lengths of what they match.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

#: Words one of which every assignment holds, in lower case: texts without them need no pattern search.
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")

MIN_RUN = 16
#: Lower ends of the length classes.
LENGTHS = (16, 20, 24, 32, 48)
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets by size; a run has the first one that holds all its characters.
ENCODINGS = {
    "digits": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "hex_upper": _DIGITS + "ABCDEF",
    "lower": _LOWER,
    "upper": _UPPER,
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "base36_upper": _DIGITS + _UPPER,
    "letters": _UPPER + _LOWER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
    "any": _UPPER + _LOWER + _DIGITS + "+/-_",
}
_SETS = {name: frozenset(alphabet) for name, alphabet in ENCODINGS.items()}
_INDEX = {name: {c: i for i, c in enumerate(alphabet)} for name, alphabet in ENCODINGS.items()}

# Fixed values of ordinary identifiers: letters a to z in parts of a thousand, and how often one kind of character follows another.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
BEGINS = {"lower": 0.6, "upper": 0.25, "digit": 0.12, "mark": 0.03}
FOLLOWS = {
    "lower": {"lower": 0.88, "upper": 0.04, "digit": 0.03, "mark": 0.05},
    "upper": {"lower": 0.55, "upper": 0.38, "digit": 0.03, "mark": 0.04},
    "digit": {"lower": 0.06, "upper": 0.06, "digit": 0.78, "mark": 0.10},
    "mark": {"lower": 0.55, "upper": 0.20, "digit": 0.20, "mark": 0.05},
}
#: A run is taken for random unless the battery rejects it at this level.
LEAST_RANDOMNESS = 0.001
#: Bins are powers of two of the p-value; the last one holds all that is smaller.
BINS = 64


def _ordinary_table() -> tuple[dict[str, dict[str, float]], dict[str, str]]:
    """log2 of the chance of each token character after each kind of character ("" at the start), and the kinds."""
    kinds = {c: "lower" for c in _LOWER} | {c: "upper" for c in _UPPER} | {c: "digit" for c in _DIGITS} | {c: "mark" for c in "+/-_"}
    within = {c: LETTERS[i % 26] / sum(LETTERS) for i, c in enumerate(_LOWER + _UPPER)} | {c: 0.1 for c in _DIGITS} | {c: 0.25 for c in "+/-_"}
    after = {"": BEGINS} | FOLLOWS
    return {k: {c: math.log2(row[kinds[c]] * within[c]) for c in kinds} for k, row in after.items()}, kinds


_ORDINARY, _KIND = _ordinary_table()

_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_")] = True


# -- the battery ---------------------------------------------------------------


def infer_encoding(run: str) -> str | None:
    """The smallest alphabet that holds all characters."""
    characters = set(run)
    return next((name for name, alphabet in _SETS.items() if characters <= alphabet), None)


def evidence(run: str, encoding: str) -> float:
    """Bits by which random characters of the encoding explain the run better than an ordinary identifier does.

    2 ** -evidence is a p-value of the ordinary model; the bits for having chosen the encoding are taken off.
    """
    ordinary, kind = 0.0, ""
    for c in run:
        ordinary += _ORDINARY[kind][c]
        kind = _KIND[c]
    return -len(run) * math.log2(len(ENCODINGS[encoding])) - ordinary - math.log2(len(ENCODINGS))


def _upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def uniformity_p(values: list[int], size: int) -> float:
    """Chi-squared test against the uniform alphabet.

    The statistic has its exact mean and variance for this length, and a gamma shape by the Wilson-Hilferty cube root; so
    short strings over large alphabets are judged by their own length.
    """
    n = len(values)
    statistic = sum(c * c for c in Counter(values).values()) * size / n - n
    mean, variance = size - 1, 2 * (size - 1) * (n - 1) / n
    freedom = 2 * mean * mean / variance
    ratio = max(statistic, 1e-9) / mean
    z = (ratio ** (1 / 3) - (1 - 2 / (9 * freedom))) / math.sqrt(2 / (9 * freedom))
    return _upper_normal(z)


def runs_p(values: list[int], size: int) -> float:
    """Wald-Wolfowitz runs above and below the middle of the alphabet, two-sided."""
    high = [v >= size / 2 for v in values]
    n, above = len(high), sum(high)
    below = n - above
    if not above or not below:
        return 2.0 * 0.5**n
    runs = 1 + sum(a != b for a, b in pairwise(high))
    mean = 1 + 2 * above * below / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    return min(1.0, 2 * _upper_normal(abs(runs - mean) / math.sqrt(max(variance, 1e-9))))


def serial_p(values: list[int]) -> float:
    """Lag-one serial correlation of the alphabet positions, two-sided."""
    n = len(values)
    mean = sum(values) / n
    spread = sum((v - mean) ** 2 for v in values)
    if spread == 0:
        return 0.0
    r = sum((a - mean) * (b - mean) for a, b in pairwise(values)) / spread
    return min(1.0, 2 * _upper_normal(abs(r + 1 / n) * math.sqrt(n)))


def randomness_p(run: str, encoding: str) -> float:
    """Fisher's combination of the three tests: high for random strings, near zero for others."""
    index, size = _INDEX[encoding], len(ENCODINGS[encoding])
    values = [index[c] for c in run]
    logs = sum(-math.log(max(p, 1e-12)) for p in (uniformity_p(values, size), runs_p(values, size), serial_p(values)))
    return math.exp(-logs) * (1 + logs + logs * logs / 2)  # upper tail of chi-squared with 6 degrees at 2 * logs


def length_class(n: int) -> int:
    return sum(n >= least for least in LENGTHS) - 1


def evidence_bin(run: str) -> int:
    """Whole bits of evidence that a run is a secret; 0 for ordinary runs and for those that the battery rejects."""
    encoding = infer_encoding(run)
    bits = int(evidence(run, encoding)) if encoding else 0
    if bits < 1 or randomness_p(run, encoding) < LEAST_RANDOMNESS:
        return 0
    return min(bits, BINS - 1)


# -- spans of one batch --------------------------------------------------------


def _long_runs(texts: list[str]) -> list[list[str]]:
    """Per text, the maximal runs of at least ``MIN_RUN`` token characters."""
    data = np.frombuffer("\n".join(texts).encode("utf-8", "replace"), np.uint8)
    inside = np.concatenate(([False], _TOKEN[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= MIN_RUN
    found: list[list[str]] = [[] for _ in texts]
    if keep.any():
        sizes = np.array([len(t.encode("utf-8", "replace")) for t in texts]) + 1
        owner = np.searchsorted(np.cumsum(sizes), starts[keep], side="right")
        for i, a, b in zip(owner, starts[keep], ends[keep], strict=True):
            found[i].append(data[a:b].tobytes().decode("ascii"))
    return found


def _located(text: str, runs: list[str]) -> list[tuple[int, str]]:
    """Code point positions of runs that stand in the text in this order."""
    at, out = 0, []
    for run in runs:
        at = text.index(run, at)
        out.append((at, run))
        at += len(run)
    return out


def base_spans(text: str, runs: list[tuple[int, str]]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns; hexadecimal runs lie inside the long token runs."""
    spans = []
    lower = text.lower()
    if any(word in lower for word in ASSIGN_WORDS):
        spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    for at, run in runs:
        if len(run) >= MIN_HEX:
            spans += [(at + m.start(), at + m.end(), 2) for m in HEX.finditer(run) if len(m[0]) >= MIN_HEX]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def _outside(at: int, end: int, taken: list[tuple[int, int]], first: int) -> tuple[list[tuple[int, int]], int]:
    """The parts of [at, end) outside the sorted, disjoint ranges, and the number of the first range that may matter to later parts."""
    parts = []
    while first < len(taken) and taken[first][1] <= at:
        first += 1
    i = first
    while i < len(taken) and taken[i][0] < end:
        if taken[i][0] > at:
            parts.append((at, taken[i][0]))
        at = max(at, taken[i][1])
        i += 1
    if at < end:
        parts.append((at, end))
    return parts, first


def _candidates(text: str, runs: list[tuple[int, str]], base: list[tuple[int, int, int]]):
    """(start, end, length class, bin) of the long parts of runs outside the fixed spans; both lists are walked once."""
    taken: list[tuple[int, int]] = []
    for a, b, _ in base:  # sorted by start
        if taken and a <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    first = 0
    for at, run in runs:
        parts, first = _outside(at, at + len(run), taken, first)
        for a, b in parts:
            if b - a >= MIN_RUN:
                yield a, b, length_class(b - a), evidence_bin(text[a:b])


def _scan(texts: list[str]):
    for text, runs in zip(texts, _long_runs(texts), strict=True):
        located = _located(text, runs) if runs else []
        base = base_spans(text, located)
        yield text, base, list(_candidates(text, located, base)) if located else []


# -- false-discovery control ---------------------------------------------------


def thresholds_of(histogram: dict[tuple[int, int], int], q: float) -> dict[int, int]:
    """Per length class the least bin from which on candidates are flagged (Benjamini-Hochberg at level ``q``).

    With m candidates, R of them in bin b or above, p-values in bin b are at most 2 ** -b; the step is m * 2 ** -b <= q * R.
    """
    out = {}
    for length in {key[0] for key in histogram}:
        counts = [histogram.get((length, b), 0) for b in range(BINS)]
        passed = [b for b in range(1, BINS) if 0 < sum(counts) * 2.0**-b <= q * sum(counts[b:])]
        if passed:
            out[length] = min(passed)
    return out


def evidence_histogram(docs: DataFrame, text: str = "text") -> dict[tuple[int, int], int]:
    """Candidates of the whole corpus per length class and bin; its size is fixed by these."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = Counter((length, b) for _, _, found in _scan(batch.column(0).to_pylist()) for _, _, length, b in found)
        return pa.RecordBatch.from_pydict(
            {
                "length": pa.array([k[0] for k in seen], pa.int32()),
                "bin": pa.array([k[1] for k in seen], pa.int32()),
                "n": pa.array(list(seen.values()), pa.int64()),
            }
        )

    small_batches(docs.sparkSession)
    counted = map_batches(docs.select(text_or_empty(text).alias("text")), count, "length int, bin int, n long")
    rows = counted.groupBy("length", "bin").agg(F.sum("n").alias("n")).collect()
    return {(r["length"], r["bin"]): r["n"] for r in rows}


def _all_spans(base, found, thresholds) -> list[tuple[int, int, int]]:
    added = [(a, b, 3) for a, b, length, bits in found if bits >= thresholds.get(length, BINS)]
    return sorted(base + added, key=lambda s: (s[0], s[2])) if added else base


def _written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", q: float = 0.1) -> DataFrame:
    """One row per document with the counts and digests of the fixed patterns and all spans."""
    thresholds = thresholds_of(evidence_histogram(docs, text), q)

    def spans(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(base, _all_spans(base, found, thresholds)) for _, base, found in _scan(batch.column(1).to_pylist())]
        kinds = [Counter(k for _, _, k in every) for _, every in rows]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *(pa.array([k[kind] for k in kinds], pa.int64()) for kind in range(4)),
                pa.array([hashlib.sha256(_written(base).encode()).hexdigest() for base, _ in rows], pa.string()),
                pa.array([_written(every) for _, every in rows], pa.string()),
            ],
            ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"],
        )

    small_batches(docs.sparkSession)
    return map_batches(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")),
        spans,
        "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string",
    )


def redact_secrets(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", q: float = 0.1, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every span replaced by ``mark``; ``n_chars`` follows if there is such a column.

    A null text stays null; texts without a span stay as they are.
    """
    thresholds = thresholds_of(evidence_histogram(docs, text), q)

    def redact(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text)
        texts = batch.column(at).to_pylist()
        changed = {}
        for i, (whole, base, found) in enumerate(_scan([t or "" for t in texts])):
            spans = _all_spans(base, found, thresholds)
            if spans:
                parts, done = [], 0
                for a, b, _ in spans:
                    if b > done:
                        parts += [whole[done:a], mark] if a >= done else []
                        done = b
                changed[i] = "".join([*parts, whole[done:]])
        if not changed:
            return batch
        columns = list(batch.columns)
        columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], batch.schema.field(at).type)
        size = batch.schema.get_field_index(n_chars)
        if size >= 0:
            old = batch.column(size).to_pylist()
            columns[size] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(old)], batch.schema.field(size).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    small_batches(docs.sparkSession)
    return map_batches(docs, redact, docs.schema)

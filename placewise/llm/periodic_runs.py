"""Periodic runs of words: seeds on diagonals, extended once, and texts collapsed to one period a run.

A run is a stretch of words with smallest period q that no neighbouring word extends and that is at least
``max(LEAST_LENGTH, 2 q)`` words long. On the diagonal of lag q (word i against word i + q) it is a stretch of
``length - q >= max(LEAST_LENGTH - q, q)`` equal pairs, so lags from K to 2K - 1 are sure to show a repeated K-gram:

1. *Index.* Lags are taken in bands: K = 6 for lags 1 to 11, then 12, 24, 48 and so on, as long as any K-gram of the
   document repeats. Grams are numbered exactly (a 2K-gram is a pair of K-gram numbers, no hashes), and only
   positions whose K-gram repeats are looked at for 2K.
2. *Seeds.* Occurrences of a gram at most K / 2 apart have equal gaps, the gram's own period; such a chain is one seed
   source. Inside a chain the gap is the only lag that can be a smallest period. Between two chains each lag is named once.
   A chain meets at most four later chains within 2K words, so there are O(n) seeds a band however often a gram occurs.
3. *Covered.* Seeds of one lag in order: one that begins in what the seeds before it cover is in the same stretch and is
   not extended again.
4. *Extend.* Stretches grow by the numbered grams of all bands, the largest first, so an extension takes O(log n) steps.
5. Of the lags that give the same stretch of words the smallest is the period.

O(n log n) time and memory for a document of n words; documents are rows, so they need no shuffle and a lost task is run again.
A word is dropped from the collapsed text if a run holds it after the run's first q words.

Defined results: a null, empty or wordless text has no runs and collapses to the empty text; very long texts cost
n log n; equal longest runs are told apart by start, then period; repeated rows and null ids are kept row by row; an
empty table gives an empty result; of the other columns those named in ``keep`` pass, the rest are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, map_batches, small_batches, text_or_empty

# The least length of a run, and the least stretch of equal pairs it shows (lag 6: 12 - 6).
LEAST_LENGTH, LEAST_STRETCH = 12, 6
RUNS = "array<struct<start:long,length:long,period:long>>"


def _number(keys: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions whose key occurs at least twice, sorted by (key, position); their group numbers; group starts."""
    order = np.argsort(keys, kind="stable")
    keys, positions = keys[order], positions[order]
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    alone = new & np.append(new[1:], True)
    group = np.cumsum(new[~alone])
    return positions[~alone], group, new[~alone]


class Grams:
    """Numbers of the repeated K-grams by position (0: the gram occurs once), for K = 6, 12, 24, ..."""

    def __init__(self, words: np.ndarray):
        self.words, self.n = words, len(words)
        self.levels: list[tuple[int, np.ndarray]] = []

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        k, n = LEAST_STRETCH, self.n
        keys = self.words[: n - k + 1].astype(np.int64)
        positions = np.arange(n - k + 1)
        for j in range(1, k):  # one word more at a time; a gram that is alone stays alone
            keys = keys * np.int64(n + 1) + self.words[positions + j]
            positions, keys, _ = _number(keys, positions)
        return self._keep(k, positions, keys)

    def double(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, numbers = self.levels[-1]
        positions = positions[positions + 2 * k <= self.n]
        right = numbers[positions + k]
        positions, right = positions[right > 0], right[right > 0]
        positions, group, _ = _number(numbers[positions] * np.int64(self.n + 1) + right, positions)
        return self._keep(2 * k, positions, group)

    def _keep(self, k: int, positions: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(positions):
            numbers = np.zeros(self.n + 1, np.int64)
            numbers[positions] = group
            self.levels.append((k, numbers))
        return positions, group

    def extend(self, left: np.ndarray, right: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Grow the stretches [left, right) of pairs (i, i + lag) until both neighbours differ."""
        for k, numbers in reversed(self.levels):
            while True:
                at = np.where(right + lag + k <= self.n, right, self.n)
                grows = (numbers[at] > 0) & (numbers[at] == numbers[np.minimum(at + lag, self.n)])
                if not grows.any():
                    break
                right = right + k * grows
            while True:
                at = np.where(left >= k, left - k, self.n)
                grows = (numbers[at] > 0) & (numbers[at] == numbers[np.minimum(at + lag, self.n)])
                if not grows.any():
                    break
                left = left - k * grows
        words = np.append(self.words, -1)
        while True:
            grows = (right + lag < self.n) & (words[np.minimum(right, self.n)] == words[np.minimum(right + lag, self.n)])
            if not grows.any():
                break
            right = right + grows
        while True:
            grows = (left > 0) & (words[left - 1] == words[left - 1 + lag])
            if not grows.any():
                break
            left = left - grows
        return left, right


def _ranges(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each size its index, repeated, and the numbers from 0 to size - 1."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _seeds(k: int, positions: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, lag) pairs that hold every lag of the band at which a stretch of equal pairs shows a repeated gram."""
    low, high = (1, 2 * k - 1) if k == LEAST_STRETCH else (k, 2 * k - 1)
    gap = np.diff(positions)
    linked = (group[1:] == group[:-1]) & (2 * gap <= k)
    head = np.flatnonzero(np.append(True, ~linked))  # chains as ranges of (group, position) rows
    size = np.diff(np.append(head, len(positions)))
    at, lags = [], []
    inside = head[size > 1]
    at.append(positions[inside])
    lags.append(gap[inside])
    first, last, key = positions[head], positions[head + size - 1], group[head]
    for t in range(1, len(head)):
        a = np.arange(len(head) - t)
        a = a[(key[a] == key[a + t]) & (first[a + t] - last[a] <= high)]
        if not len(a):
            break
        b = a + t
        owner, step = _ranges(size[a])  # every word of the first chain with the head of the second
        start = positions[head[a][owner] + step]
        at.append(start)
        lags.append(first[b][owner] - start)
        owner, step = _ranges(size[b] - 1)  # and the head of the first with the rest of the second
        at.append(first[a][owner])
        lags.append(positions[head[b][owner] + step + 1] - first[a][owner])
    start, lag = np.concatenate(at), np.concatenate(lags)
    fits = (lag >= low) & (lag <= high)
    return start[fits], lag[fits]


def _uncovered(k: int, start: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds that begin beyond what the seed before them on the same lag covers."""
    order = np.lexsort((start, lag))
    start, lag = start[order], lag[order]
    fresh = np.ones(len(lag), bool)
    fresh[1:] = (lag[1:] != lag[:-1]) | (start[1:] > start[:-1] + k)
    return start[fresh], lag[fresh]


def find_runs(words: Sequence) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period."""
    n = len(words)
    none = np.empty((0, 3), np.int64)
    if n < LEAST_LENGTH:
        return none
    numbers: dict = {}
    fresh = count(1).__next__
    ids = np.fromiter((numbers.get(w) or numbers.setdefault(w, fresh()) for w in words), np.int64, n)
    grams = Grams(ids)
    positions, group = grams.first()
    seeds = []
    while len(positions):
        k = grams.levels[-1][0]
        seeds.append(_uncovered(k, *_seeds(k, positions, group)))
        positions, group = grams.double(positions)
    if not seeds:
        return none
    start, lag = (np.concatenate(x) for x in zip(*seeds, strict=True))
    left, right = grams.extend(start, start, lag)
    end = right + lag
    fits = end - left >= np.maximum(LEAST_LENGTH, 2 * lag)
    left, end, lag = left[fits], end[fits], lag[fits]
    order = np.lexsort((lag, end, left))
    left, end, lag = left[order], end[order], lag[order]
    first = np.ones(len(left), bool)
    first[1:] = (left[1:] != left[:-1]) | (end[1:] != end[:-1])
    runs = np.stack([left, end - left, lag], axis=1)[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, runs[:, 0] + runs[:, 2], 1)
    np.add.at(inside, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(inside[:n]) == 0


def collapse_runs(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per document: the ``keep`` columns, runs (start, length, period) and the collapsed text."""

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs, texts, sizes = [], [], []
        for value in batch.column("_text").to_pylist():
            words = value.encode("utf-8", "replace").split()  # bytes: splits at the six ASCII spaces
            found = find_runs(words)
            runs.append(found)
            sizes.append(len(found))
            if len(found):
                kept = kept_words(len(words), found)
                words = [w for w, stays in zip(words, kept.tolist(), strict=True) if stays]
            texts.append(b" ".join(words))
        rows = np.concatenate([np.empty((0, 3), np.int64), *runs])
        fields = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["start", "length", "period"])
        offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, fields)
        plain = [batch.column(i) for i in range(batch.num_columns - 1)]
        texts = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*plain, lists, texts], [*keep, "runs", "collapsed"])

    small_batches(docs.sparkSession)
    given = docs.select(*keep, text_or_empty(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return map_batches(given, search, f"{schema}{', ' if schema else ''}runs {RUNS}, collapsed string")


def longest_run(runs: str = "runs") -> Column:
    """The run of greatest length; on a tie the smallest start, then the smallest period. Null if there is none."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("b"), r["period"].alias("c"), r.alias("run")))
    return F.array_min(ranked)["run"]


def digest_runs(collapsed: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of what ``collapse_runs`` returns, without Python."""
    lines = F.transform(
        F.array_sort(F.transform("runs", lambda r: F.struct(r["start"], r["period"], r["length"]))),
        lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")),
    )
    best = collapsed.withColumn("_best", longest_run())
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted_periods(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with every tenth document, by hash, made periodic from some word on.

    With h = crc32(id as text), g = h div 10 and n words: where h mod 10 is 0 and n > 0, each word i >= a becomes word
    a + (i - a) mod p, with a = g mod n and p = 1 + (n - a) div (3 + g mod 8). Rows without an id stay as they are.
    """
    h = F.crc32(F.col(doc_id).cast("long").cast("string"))
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("_text"), h.alias("_h"))
    split = chosen.withColumn("_words", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("_text", F.lit(f"({WORD})"))))
    sized = split.select("doc_id", "_text", "_words", F.size("_words").alias("_n"), F.expr("_h div 10").alias("_g"))
    placed = sized.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    placed = placed.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    n, a, p = (F.col(c).cast("int") for c in ("_n", "_a", "_p"))
    root = F.slice("_words", a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(root, F.expr("cast((_n - _a) div _p + 1 as int)"))), F.lit(1), n - a)
    periodic = F.array_join(F.concat(F.slice("_words", F.lit(1), a), tail), " ")
    return placed.select("doc_id", F.when(a.isNotNull(), periodic).otherwise(F.col("_text")).alias("text"))


def runs_sql() -> str:
    """DuckDB's words for ``digest_runs(collapse_runs(planted_periods(documents)))``: every pair of equal 6-grams of a document,
    islands on each diagonal, and the smallest lag of each stretch."""
    return r"""
with crc as (
  select list_transform(range(256), lambda v: list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as step
), d as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint)),
      lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) as h
  from documents, crc
), sized as (
  select *, len(w) as n, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a from d
), placed as (
  select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from sized
), planted as (
  select r, doc_id, n, case when a is null then w else
    list_transform(range(n), lambda i: w[case when i < a then i else a + (i - a) % p end + 1]) end as w
  from placed
), spots as (
  select r, n, w, unnest(range(n)) as i from planted
), words as (
  select r, i, w[i + 1] as word, case when i + 6 <= n then array_to_string(w[i + 1:i + 6], ' ') end as gram from spots
), pairs as (
  select x.r, x.i, y.i - x.i as q from words x join words y on x.r = y.r and x.gram = y.gram and x.i < y.i
), islands as (
  select r, q, i, i - row_number() over (partition by r, q order by i) as island from pairs
), stretches as (
  select r, q, min(i) as s, max(i) + 6 as e from islands group by r, q, island
), runs as (
  select r, s as start, e + min(q) - s as length, min(q) as period
  from (select r, q, s, e, e + q as last from stretches where e - s >= greatest(q, 12 - q))
  group by r, s, e, last
  qualify row_number() over (partition by r, s, last order by min(q)) = 1
), told as (
  select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as told,
    min_by({'s': start, 'l': length, 'p': period}, (-length, start, period)) as best
  from runs group by r
), dropped as (
  select distinct r, unnest(range(start + period, start + length)) as i from runs
), collapsed as (
  select r, string_agg(word, ' ' order by i) as text from words anti join dropped using (r, i) group by r
)
select doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, best.l as length, best.p as period,
  1000 * best.l // best.p as exponent_milli, sha256(coalesce(told, '')) as runs_sha256, sha256(coalesce(text, '')) as collapsed_sha256
from planted left join told using (r) left join collapsed using (r)
"""

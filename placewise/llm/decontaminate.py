"""Benchmark decontamination by spaced-seed hashing.

Words (runs of letters, digits and underscores, in lower case) are hashed one by one. A mask such as ``11011011`` hashes the
marked words of a window and ignores the others, so a hit survives substitutions at the ignored
positions. The masks are chosen by enumeration: whichever words the default rule (13 words, 70 %) lets differ, one
mask at least still hits; items of 6 to 12 words have further, shorter masks. Steps:

1. Seeds of the benchmark items, and a Bloom filter of them with a fixed number of bits. Only the filter,
   whose size is a parameter, is sent to the tasks; it drops almost every training window early.
2. Windows of the documents that pass leave as one row per stretch of hits with the word hashes around it,
   and their hashes are joined with the benchmark's seeds: an exact join, so a full filter costs time only.
3. Every (stretch, item, alignment) is verified once: along the alignment the words are compared, and a
   window of ``overlap`` words (the whole item if it is shorter) must agree in at least ``agreement`` of them.

Defined results: null texts are empty and leak nothing; items of fewer than six words are too
short to show a leak; repeated rows leak alike and stay repeated; null ids are carried along; an empty corpus or
benchmark gives an empty result; other columns are ignored by ``find_leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.session import stage

from .common import map_batches, small_batches, text_or_empty

WORDS = re.compile(r"\w+")
#: Fixed masks: every one marks six words. Any 3 of 13 words may differ and one of them still hits.
MASKS = ("111111", "1111011", "11011011", "101101011", "1110001011", "1110111", "1110100011")
#: Masks of four words for items of 6 to 12 words, of which 70 % agree. Documents are searched for them only if the benchmark
#: has such items.
SHORT_MASKS = ("1111", "11011", "1100011", "1010101", "10111")
ALL_MASKS = MASKS + SHORT_MASKS
#: Items of fewer words are too short to show a leak; items of fewer than the second number have the short masks too.
LEAST_WORDS, SHORT_WORDS = 6, 13
#: Words kept on both sides of a hit for the verification.
REACH = 32
#: Bits of the Bloom filter as a power of two (2 MB), and its probes.
FILTER_BITS, PROBES = 24, 4

_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_MEMO = 400_000


class WordHashes(dict):
    """Word to its 64-bit hash; bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return found

    def of(self, text: str) -> np.ndarray:
        found = WORDS.findall(text.lower())
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


_HASHES = WordHashes()


def word_hashes(text: str) -> np.ndarray:
    return _HASHES.of(text)


def seeds(tokens: np.ndarray, mask: int) -> np.ndarray:
    """The hash of every window of this mask."""
    marks = [i for i, c in enumerate(ALL_MASKS[mask]) if c == "1"]
    n = len(tokens) - len(ALL_MASKS[mask]) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    mixed = np.full(n, (mask + 1) * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for odd, i in zip(_ODD, marks, strict=False):
        mixed += tokens[i : i + n] * odd
        mixed ^= mixed >> np.uint64(29)
    mixed *= _ODD[1]
    return mixed ^ (mixed >> np.uint64(32))


def item_masks(n_words: int) -> range:
    """The masks of a benchmark item of so many words."""
    if n_words < LEAST_WORDS:
        return range(0)
    return range(len(ALL_MASKS) if n_words < SHORT_WORDS else len(MASKS))


def _probe(hashes: np.ndarray, which: int) -> np.ndarray:
    """Bit position of a hash for one probe of the filter."""
    turned = hashes * _ODD[which] if which else hashes
    return (turned >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def passing(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Positions of the hashes that the filter may hold; each probe looks only at what the last one left."""
    left = np.flatnonzero(bits[_probe(hashes, 0)])
    for which in range(1, PROBES):
        left = left[bits[_probe(hashes[left], which)]]
    return left


def _item_seeds(benchmark: DataFrame, item_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(item, tokens) and (mask, hash, item, at)."""

    def tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [word_hashes(t) for t in batch.column("text").to_pylist()]
        rows = [
            [(m, int(h), at) for m in item_masks(len(t)) for at, h in enumerate(seeds(t, m).view(np.int64))] for t in found
        ]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("item"),
                batch.column("item_id"),
                pa.array([t.view(np.int64) for t in found], pa.list_(pa.int64())),
                pa.array(
                    [[{"mask": m, "hash": h, "at": at} for m, h, at in r] for r in rows],
                    pa.list_(pa.struct([("mask", pa.int32()), ("hash", pa.int64()), ("at", pa.int32())])),
                ),
            ],
            ["item", "item_id", "tokens", "seeds"],
        )

    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), text_or_empty(text).alias("text"))
    numbered = rows.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    items = stage(
        map_batches(
            numbered, tokens, "item long, item_id long, tokens array<long>, seeds array<struct<mask:int,hash:long,at:int>>"
        ),
        "items",
    )
    return items.select("item", "item_id", "tokens"), items.select("item", F.inline("seeds"))


def _filter(item_seeds: DataFrame) -> bytes:
    """The Bloom filter: set bits are merged in words of 64, so at most 2**FILTER_BITS / 64 rows are gathered."""

    def positions(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = batch.column(0).to_numpy().view(np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([_probe(hashes, p) for p in range(PROBES)]))], ["at"])

    at = map_batches(item_seeds.select("hash").distinct(), positions, "at long")
    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    merged = at.groupBy(F.expr("at >> 6").alias("word")).agg(F.bit_or(one).alias("bits"))
    packed = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    rows = merged.toArrow()
    packed[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return packed.astype("<i8").tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    """The worker's copy of the filter, one byte a bit, kept from batch to batch."""
    global _BITS
    if _BITS is None or _BITS[0] != packed:
        _BITS = packed, np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").astype(bool)
    return _BITS[1]


_BITS: tuple[bytes, np.ndarray] | None = None


def _stretches(found: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Hits (position, mask, hash) of one document in order, split where no kept words would be shared."""
    groups: list[list[tuple[int, int, int]]] = []
    for hit in found:
        if groups and hit[0] - groups[-1][-1][0] <= 2 * REACH:
            groups[-1].append(hit)
        else:
            groups.append([hit])
    return groups


def _document_hits(docs: DataFrame, packed: bytes, masks: list[int], doc_id: str, text: str) -> DataFrame:
    """One row per stretch of hits of these masks: the document's key, the word hashes around, and the hits."""
    shared = docs.sparkSession.sparkContext.broadcast(packed)  # 2**FILTER_BITS bits, whatever the data
    longest = max(map(len, ALL_MASKS))

    def search(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        bits = _unpacked(shared.value)
        per_doc = [word_hashes(t) for t in batch.column("text").to_pylist()]
        ends = np.cumsum([len(t) for t in per_doc])
        tokens = np.concatenate(per_doc) if per_doc else np.empty(0, np.uint64)
        hits: dict[int, list[tuple[int, int, int]]] = {}
        for mask in masks:
            hashes = seeds(tokens, mask)
            at = passing(hashes, bits)
            owner = np.searchsorted(ends, at, side="right")
            inside = at + len(ALL_MASKS[mask]) <= ends[owner] if len(at) else np.empty(0, bool)
            for d, i, h in zip(owner[inside].tolist(), at[inside].tolist(), hashes[at[inside]].view(np.int64).tolist(), strict=True):
                hits.setdefault(d, []).append((i, mask, h))
        if not hits:
            return None
        doc, starts, around, lists = [], [], [], []
        for d in sorted(hits):
            first, last = int(ends[d]) - len(per_doc[d]), int(ends[d])
            for group in _stretches(sorted(hits[d])):
                low = max(first, group[0][0] - REACH)
                high = min(last, group[-1][0] + longest + REACH)
                doc.append(d)
                starts.append(low - first)
                around.append(tokens[low:high].view(np.int64))
                lists.append([{"at": i - low, "mask": m, "hash": h} for i, m, h in group])
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(doc)),
                batch.column("text_key").take(pa.array(doc)),
                pa.array(starts, pa.int32()),
                pa.array(around, pa.list_(pa.int64())),
                pa.array(lists, pa.list_(pa.struct([("at", pa.int32()), ("mask", pa.int32()), ("hash", pa.int64())]))),
            ],
            ["doc_id", "text_key", "start", "around", "hits"],
        )

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("text_key"), text_or_empty(text).alias("text")
    )
    schema = "doc_id long, text_key long, start int, around array<long>, hits array<struct<at:int,mask:int,hash:long>>"
    return map_batches(rows, search, schema)


def aligned_overlap(around: np.ndarray, item: np.ndarray, shift: int, overlap: int) -> tuple[int, int, int, int]:
    """Compare ``around[shift + j]`` with ``item[j]``: (words that agree in the best window, size of the window,
    words that agree on the whole alignment, start of the best window in ``around``)."""
    low, high = max(0, -shift), min(len(item), len(around) - shift)
    size = min(overlap, len(item))
    same = around[low + shift : high + shift] == item[low:high]
    if len(same) < size:
        return 0, size, int(same.sum()), max(low + shift, 0)
    sums = np.concatenate(([0], np.cumsum(same)))
    windows = sums[size:] - sums[:-size]
    best = int(windows.argmax())
    return int(windows[best]), size, int(sums[-1]), low + shift + best


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    overlap: int = 13,
    agreement: float = 0.7,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, n_words and coverage of the item
    that agree, the word position of the overlap, and text_key (a hash of the text)."""
    small_batches(docs.sparkSession)
    items, item_seeds = _item_seeds(benchmark, item_id, text)
    masks = sorted(r["mask"] for r in item_seeds.select("mask").distinct().collect())  # at most one row a mask
    stretches = stage(
        _document_hits(docs, _filter(item_seeds), masks, doc_id, text).withColumn("stretch", F.monotonically_increasing_id()),
        "stretches",
    )
    hits = stretches.select("stretch", F.inline("hits"))
    met = hits.join(item_seeds.withColumnRenamed("at", "item_at"), ["mask", "hash"])
    alignments = met.select("stretch", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    pairs = alignments.join(stretches.select("stretch", "doc_id", "text_key", "start", "around"), "stretch").join(
        items, "item"
    )

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keep, n, share, at = [], [], [], []
        columns = (batch.column(c) for c in ("around", "tokens", "shift", "start"))
        for row, (around, tokens, shift, start) in enumerate(zip(*columns, strict=True)):
            item = tokens.values.to_numpy()
            best, size, total, place = aligned_overlap(around.values.to_numpy(), item, shift.as_py(), overlap)
            if best >= agreement * size:
                keep.append(row)
                n.append(total)
                share.append(total / len(item))
                at.append(start.as_py() + place)
        if not keep:
            return None
        rows = pa.array(keep)
        names = ("stretch", "doc_id", "text_key", "item_id")
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(rows) for c in names), pa.array(n, pa.int64()), pa.array(share, pa.float64()), pa.array(at, pa.int64())],
            [*names, "n_words", "coverage", "at_word"],
        )

    schema = "stretch long, doc_id long, text_key long, item_id long, n_words long, coverage double, at_word long"
    found = map_batches(pairs, verify, schema)
    best = F.max(F.struct("n_words", "coverage", (-F.col("at_word")).alias("back"))).alias("best")
    return (
        found.groupBy("doc_id", "text_key", "item_id")
        .agg(best)
        .select("doc_id", "item_id", "best.n_words", "best.coverage", (-F.col("best.back")).alias("at_word"), "text_key")
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that hold no benchmark item, all columns as they are. Rows are matched by id and text."""
    leaks = find_leaks(docs, benchmark, doc_id=doc_id, text=text, **options)
    keys = leaks.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    same = docs[doc_id].cast("long").eqNullSafe(keys["_id"]) & (F.xxhash64(text_or_empty(text)) == keys["_key"])
    return docs.join(keys, same, "left_anti")

"""Token sequences of fixed length by best-fit-decreasing packing, and their binary output.

Spark partitions the texts and every task tokenises its rows. A document of more than ``length`` tokens gives full
sequences at once, and only its rest is packed; nothing is cut off. The pieces of a task are packed in groups of at most
``GROUP_TOKENS`` tokens: largest piece first, each into the open sequence with the least room that still
holds it. The sequence is found by a segment tree over the capacities 0 to ``length``. There is no
shuffle, and a task holds one group, however large its input.

Output, one row per sequence: the ids as one row of a matrix (little-endian, 16 bits if the ids fit, padded), the cumulative
lengths of its segments, the positions (restarting at 0 in each segment), and for each segment the document's id,
its row key and the first token's place in the document. Which documents share a sequence depends on how
Spark cut the input; the tokens of every document, and their order, do not.

Defined results: a null or empty text has no tokens and is in no sequence; repeated rows are packed one by one; null ids
are carried along; of equal pieces the first one read goes first; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import read_ranks
from .common import BATCH_ROWS, small_batches, text_or_empty

GROUP_TOKENS = 2_000_000

SCHEMA = (
    "sequence long, n_tokens int, ids binary, positions binary, cu_lengths array<int>, "
    "doc_ids array<long>, starts array<long>"
)


class CapacityTree:
    """Segment tree over capacities: each leaf holds the open sequences with exactly that room (smallest number first),
    each inner node how many there are below."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, sequence: int) -> None:
        heapq.heappush(self.open[room], sequence)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, sequence) with the least room of at least ``need``."""
        at = need + self.size
        if not self.count[at]:
            # Up to the first node whose right sibling is not empty, then down to its leftmost leaf.
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return room, heapq.heappop(self.open[room])


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Numbers of the pieces of every sequence; all sizes are from 1 to ``length``."""
    tree, bins = CapacityTree(length), []
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[piece])
        if found is None:
            room, sequence = length, len(bins)
            bins.append([])
        else:
            room, sequence = found
        bins[sequence].append(piece)
        tree.put(room - sizes[piece], sequence)
    return bins


class Tokenizer:
    """One worker's tokenizer from a rank file."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.source = (rank_file, pattern)
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in rank_file.splitlines() if line)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text)


_TOKENIZER: Tokenizer | None = None


def worker_tokenizer(rank_file: bytes, pattern: str) -> Tokenizer:
    global _TOKENIZER
    if _TOKENIZER is None or _TOKENIZER.source != (rank_file, pattern):
        _TOKENIZER = Tokenizer(rank_file, pattern)
    return _TOKENIZER


Piece = tuple[int | None, int, np.ndarray]  # document id, first token's place, tokens


def _sequences(groups: list[list[Piece]], length: int, pad: int, first: int) -> pa.RecordBatch:
    """One row per list of pieces."""
    kind = "<u2" if pad < 1 << 16 else "<u4"
    lengths = [[len(p[2]) for p in pieces] for pieces in groups]
    ids, positions = [], []
    for pieces, sizes in zip(groups, lengths, strict=True):
        row, place = np.full(length, pad, kind), np.zeros(length, "<u2" if length <= 1 << 16 else "<u4")
        total = sum(sizes)
        row[:total] = np.concatenate([p[2] for p in pieces])
        place[:total] = np.concatenate([np.arange(n) for n in sizes])
        ids.append(row.tobytes())
        positions.append(place.tobytes())
    return pa.RecordBatch.from_pydict(
        {
            "sequence": pa.array(range(first, first + len(groups)), pa.int64()),
            "n_tokens": pa.array([sum(s) for s in lengths], pa.int32()),
            "ids": pa.array(ids, pa.binary()),
            "positions": pa.array(positions, pa.binary()),
            "cu_lengths": pa.array([np.concatenate(([0], np.cumsum(s))).astype(np.int32) for s in lengths], pa.list_(pa.int32())),
            "doc_ids": pa.array([[p[0] for p in pieces] for pieces in groups], pa.list_(pa.int64())),
            "starts": pa.array([[p[1] for p in pieces] for pieces in groups], pa.list_(pa.int64())),
        }
    )


def pack_tokens(
    docs: DataFrame,
    rank_path: str,
    pattern: str,
    length: int = 2048,
    pad: int = 50256,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Packed sequences of ``length`` ids; see the module for the columns."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(shared.value, pattern)
        number = TaskContext.get().partitionId() << 33
        waiting: list[Piece] = []
        held = 0

        def rows(groups: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for at in range(0, len(groups), BATCH_ROWS):
                yield _sequences(groups[at : at + BATCH_ROWS], length, pad, number)
                number += len(groups[at : at + BATCH_ROWS])

        for batch in batches:
            for key, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = tokenizer(whole)
                full = len(tokens) // length * length
                yield from rows([[(key, at, tokens[at : at + length])] for at in range(0, full, length)])
                if full < len(tokens):
                    waiting.append((key, full, tokens[full:]))
                    held += len(tokens) - full
                if held >= GROUP_TOKENS:
                    yield from rows([[waiting[i] for i in one] for one in best_fit_decreasing([len(p[2]) for p in waiting], length)])
                    waiting, held = [], 0
        if waiting:
            yield from rows([[waiting[i] for i in one] for one in best_fit_decreasing([len(p[2]) for p in waiting], length)])

    small_batches(docs.sparkSession)
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return given.mapInArrow(pack, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> DataFrame:
    """Write the sequences as Parquet (each row of the matrix is one binary value) and read them back."""
    packed.write.option("compression", "zstd").parquet(path)
    return packed.sparkSession.read.schema(packed.schema).parquet(path)


def digest_packed(packed: DataFrame) -> DataFrame:
    """The sequences with digests in the place of the matrices."""
    return packed.select(
        "sequence",
        "n_tokens",
        F.size("doc_ids").alias("n_segments"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("positions", 256).alias("positions_sha256"),
        "cu_lengths",
        "doc_ids",
        "starts",
    )

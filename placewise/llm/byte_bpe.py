"""Byte-level BPE encoding and decoding with recursive SQL in the tasks.

Spark partitions the texts; each task splits its texts by the pattern, and encodes every word it meets once: the
rows (word, position, token) of a batch of words join the merge table, each round contracts every word's leftmost
pair of least rank, and the recursion ends where no pair has a rank. Ordered aggregation of the remaining rows gives
the ids of a word; a document's ids are its words' ids in order. Decoding joins (document, segment, position, id) with
the vocabulary and aggregates the bytes by position; long documents are decoded in segments, so that no
group grows with the text.

The rank file is read on the driver, checked against ``MOST_BYTES`` and sent to the tasks as it is.

Defined results: a null text is empty; an empty text has no ids and decodes to no bytes; words of more than
``LONG_WORD`` bytes (runs without a break) are contracted with a heap instead of one round per merge, with the same
result; a very long text of many long words costs time in proportion to the squares of the words' lengths, and no more memory
than any other: the recursions are cut by the rows they make; repeated rows and null ids are carried along; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches, text_or_empty

#: Largest rank file that is sent to the tasks.
MOST_BYTES = 64 << 20
LONG_WORD = 256
#: Token rows of one recursion over all its rounds, which bounds the memory of the database: a word of n bytes makes at most
#: n (n + 1) / 2, as every round leaves it one token less.
ROWS_AT_ONCE = 1_000_000
#: Remembered words of a worker, ids of one decoding, ids of one segment.
_MEMO, IDS_AT_ONCE, SEGMENT = 400_000, 400_000, 65_536

ENCODE = """
with recursive tokens as (
    select s.word, s.pos, s.id, s.next_pos, s.next_id, m.rank, 0 as round
    from start s left join merges m on m.pair = (s.id::bigint << 20) | s.next_id
  union all (
    with best as (  -- the leftmost pair of least rank of every word that still has one
        select word, min((rank::bigint << 40) | (pos::bigint << 20) | next_pos) as k
        from tokens where rank is not null group by word
    ),
    chosen as (
        select word, (k >> 40)::int as merged, ((k >> 20) & 1048575)::int as left_pos, (k & 1048575)::int as right_pos from best
    ),
    contracted as (  -- the left token goes, the right one becomes the merged one, the one before sees it
        select word, next_pos, rank, round + 1 as round,
               case when pos = right_pos then left_pos else pos end as pos,
               case when pos = right_pos then merged else id end as id,
               case when next_pos = left_pos then merged else next_id end as next_id,
               pos = right_pos or next_pos = left_pos as changed
        from tokens join chosen using (word) where pos <> left_pos
    )
    select c.word, c.pos, c.id, c.next_pos, c.next_id, case when changed then m.rank else c.rank end, c.round
    from contracted c left join merges m on m.pair = case when changed then (c.id::bigint << 20) | c.next_id end
  )
)
select word, list(id order by pos) as ids
from tokens join (select word, max(round) as round from tokens group by word) using (word, round)
group by word
"""

DECODE = """
select document, segment, list(bytes order by pos) as bytes
from ids join vocabulary using (id) group by document, segment order by document, segment
"""
_END = (1 << 20) - 1  # no next token; ids are below it


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    return data


class ByteBpe:
    """One worker's encoder and decoder: the tables in an in-memory database, and a bounded memo of words."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.source = (rank_file, pattern)
        self.split = regex.compile(pattern).findall
        lines = (line.split() for line in rank_file.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.bytes_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.memo: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        pairs = [
            ((self.ranks[t[:i]] << 20) | self.ranks[t[i:]], rank)
            for t, rank in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        self._table("merges", pair=pa.array([p for p, _ in pairs], pa.int64()), rank=pa.array([r for _, r in pairs], pa.int32()))
        self._table(
            "vocabulary", id=pa.array(list(self.ranks.values()), pa.int32()), bytes=pa.array(list(self.ranks), pa.binary())
        )

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"create table {name} as select * from given")
        self.db.unregister("given")

    # -- encoding --

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        split = [self.split(t) for t in texts]
        new = {w for words in split for w in words if w not in self.memo}
        if new and len(self.memo) + len(new) > _MEMO:
            self.memo = {}
            new = {w for words in split for w in words}
        self._learn(sorted(new))
        out = [np.frombuffer(b"".join(map(self.memo.__getitem__, words)), "<i4") for words in split]
        if len(self.memo) > _MEMO:
            self.memo = {}
        return out

    def _learn(self, words: list[str]) -> None:
        rest: list[tuple[str, bytes]] = []
        for word in words:
            raw = word.encode("utf-8", "replace")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.memo[word] = np.array([whole], "<i4").tobytes()
            elif len(raw) > LONG_WORD:
                self.memo[word] = np.array(self.contract_long(raw), "<i4").tobytes()
            else:
                rest.append((word, raw))
        # Words of like length share their rounds.
        rest.sort(key=lambda w: len(w[1]))
        group, rows = [], 0
        for item in rest:
            made = len(item[1]) * (len(item[1]) + 1) // 2
            if group and rows + made > ROWS_AT_ONCE:
                self._contract(group)
                group, rows = [], 0
            group.append(item)
            rows += made
        if group:
            self._contract(group)

    def _contract(self, words: list[tuple[str, bytes]]) -> None:
        """Ids of the words by the recursive query over their token rows."""
        data = np.frombuffer(b"".join(raw for _, raw in words), np.uint8)
        sizes = np.array([len(raw) for _, raw in words])
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = (np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        last = pos == sizes[word] - 1
        ids = self.bytes_id[data]
        start = {
            "word": word,
            "pos": pos,
            "id": ids,
            "next_pos": np.where(last, _END, pos + 1).astype(np.int32),
            "next_id": np.where(last, _END, np.append(ids[1:], 0)).astype(np.int32),
        }
        self.db.register("start", pa.table(start))
        found = self.db.sql(ENCODE).to_arrow_table().combine_chunks()
        self.db.unregister("start")
        lists = found["ids"].combine_chunks() if isinstance(found["ids"], pa.ChunkedArray) else found["ids"]
        flat, offsets = lists.values.to_numpy().astype("<i4"), lists.offsets.to_numpy()
        for i, w in enumerate(found["word"].to_pylist()):
            self.memo[words[w][0]] = flat[offsets[i] : offsets[i + 1]].tobytes()

    def contract_long(self, raw: bytes) -> list[int]:
        """The same contraction of one word with a heap of (rank, position): n log n for a word of n bytes."""
        ranks, n = self.ranks, len(raw)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that starts here; -1: none
        alive = [True] * n

        def pair(at: int) -> tuple[int, int, int] | None:
            right = end[at]
            rank = ranks.get(raw[at : end[right]]) if right < n else None
            return None if rank is None else (rank, at, end[right])

        heap = [p for p in map(pair, range(n)) if p]
        heapq.heapify(heap)
        while heap:
            found = heapq.heappop(heap)
            at = found[1]
            if not alive[at] or pair(at) != found:
                continue
            right = end[at]
            alive[right] = False
            end[at] = end[right]
            if end[at] < n:
                before[end[at]] = at
            for changed in (before[at], at):
                if changed >= 0 and (again := pair(changed)):
                    heapq.heappush(heap, again)
        return [ranks[raw[i : end[i]]] for i in range(n) if alive[i]]

    # -- decoding --

    def decode(self, arrays: list[np.ndarray]) -> list[bytes]:
        """The bytes of every array of ids."""
        out: list[list[bytes]] = [[] for _ in arrays]
        pieces = [(d, at, a[at : at + SEGMENT]) for d, a in enumerate(arrays) for at in range(0, len(a), SEGMENT)]
        group, size = [], 0
        for piece in pieces:
            group.append(piece)
            size += len(piece[2])
            if size >= IDS_AT_ONCE:
                self._join(group, out)
                group, size = [], 0
        if group:
            self._join(group, out)
        return [b"".join(parts) for parts in out]

    def _join(self, pieces: list[tuple[int, int, np.ndarray]], out: list[list[bytes]]) -> None:
        sizes = [len(ids) for _, _, ids in pieces]
        rows = {
            "document": np.repeat(np.array([d for d, _, _ in pieces], np.int32), sizes),
            "segment": np.repeat(np.array([at // SEGMENT for _, at, _ in pieces], np.int32), sizes),
            "pos": np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]),
            "id": np.concatenate([ids for _, _, ids in pieces]),
        }
        self.db.register("ids", pa.table(rows))
        found = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("ids")
        for batch in found.to_batches():
            lists = batch.column("bytes")
            offsets, values = lists.offsets.to_numpy(), lists.values
            ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
            data = values.buffers()[2]
            for i, d in enumerate(batch.column("document").to_pylist()):
                first, last = int(ends[offsets[i]]), int(ends[offsets[i + 1]])
                out[d].append(data[first:last].to_pybytes())


_BPE: ByteBpe | None = None


def worker_bpe(rank_file: bytes, pattern: str) -> ByteBpe:
    """The worker's encoder, kept from batch to batch."""
    global _BPE
    if _BPE is None or _BPE.source != (rank_file, pattern):
        _BPE = ByteBpe(rank_file, pattern)
    return _BPE


def _inputs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))


def encode_texts(docs: DataFrame, rank_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = worker_bpe(shared.value, pattern).encode(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(_inputs(docs, doc_id, text), encode, "doc_id long, ids array<int>")


def decode_ids(tokens: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded) from (doc_id, ids): the bytes of the ids; null ids are none."""
    shared = tokens.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.array(x or [], np.int32) for x in batch.column("ids").to_pylist()]
        found = worker_bpe(shared.value, pattern).decode(ids)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "decoded"])

    small_batches(tokens.sparkSession)
    rows = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return map_batches(rows, decode, "doc_id long, decoded binary")


def round_trip(
    docs: DataFrame, rank_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Encode, then decode the ids: doc_id, n_tokens, digests of the ids (little-endian unsigned 32 bits) and of the decoded
    bytes, whether these are the text's, and with ``keep_ids`` the ids."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def both(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = worker_bpe(shared.value, pattern)
        texts = batch.column("text").to_pylist()
        ids = bpe.encode(texts)
        decoded = bpe.decode(ids)
        columns = {
            "doc_id": batch.column("doc_id"),
            "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
            "restored": pa.array([x == t.encode("utf-8", "replace") for x, t in zip(decoded, texts, strict=True)], pa.bool_()),
        }
        if keep_ids:
            columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, restored boolean"
    return map_batches(_inputs(docs, doc_id, text), both, schema + ", ids array<int>" * keep_ids)

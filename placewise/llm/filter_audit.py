"""How filters interact: what each removes in every order, and what it alone removes.

1. *Masks.* One pass over the texts tests the filters on single texts and puts the texts of about ``CHUNK_BYTES`` at a time
   into a radix trie, which holds the smallest id of each text at its terminal. A text is passed on once a chunk, by the first
   of its documents, so copies are merged before anything is shuffled, however many there are.
2. *Ranges.* Every chunk names the prefixes that cut its trie into equal parts. They are as long as the texts there need
   (one byte beyond the branch), so texts with a long common beginning are cut as well as others. Quantiles of these prefixes
   are the bounds of the ranges; a bounded sample of them is read, which decides the balance and never the result.
3. *Tries.* Each range is sorted by text and inserted in full into tries of bounded size, cut between different texts;
   terminals hold the smallest id of the table. The traversal gives the chunks' texts that have a smaller id elsewhere.
4. *Masks, reduced.* The flags are joined back by (chunk, number of the text), a key that is unique on one side and in one
   chunk on the other. Documents are counted per (id, part, mask), joined with their labels, and counted per (part, mask):
   at most 32 rows a part, from which every order of the filters is told by bit operations.

Filters (failure): A under 200 words; B fewer than half of the words distinct; C more than 3 % letters A-Z; D any of
``#$%&*|``; E the text of a smaller id.

Defined results: a null text is the empty text, which fails A (and E if a smaller id has one); a null language is the part
``""``; a null id fails E never and makes no other document fail it; repeated rows with equal ids are not smaller
than each other and count row by row; labels of repeated ids count with their greatest value, null labels as 0;
very long texts cost their length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.session import stage

from .common import small_batches, text_or_empty
from .radix_trie import RadixTrie

# The filters and their limits.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = re.compile(rb"[#$%&*|]")
A, B, C, D, E = (1 << i for i in range(5))

#: Bytes of different texts in a trie: bounds the memory of a worker.
CHUNK_BYTES = 16 << 20
#: Prefixes that a chunk names, and bytes of prefixes that the driver reads.
PREFIXES = 32
PREFIX_BYTES = 16 << 20
#: Bytes of text in a range, if there are more than the session's shuffle partitions hold.
RANGE_BYTES = 256 << 20
MOST_RANGES = 20_000
#: Rows of one output batch.
_ROWS = 4096

_MARKED = "chunk long, no int, doc_id long, part string, mask int, least long, text string, prefix binary"
_FOUND = "chunk long, no int, first long"


def text_mask(text: str, data: bytes) -> int:
    """Filters A to D that a text fails; ``data`` is its UTF-8."""
    words = data.split()  # bytes: splits at the six ASCII spaces
    return (
        A * (len(words) < LEAST_WORDS)
        | B * (100 * len(set(words)) < LEAST_DISTINCT * len(words))
        | C * (100 * (len(data) - len(data.translate(None, CAPITALS))) > MOST_CAPITALS * len(text))
        | D * (SYMBOLS.search(data) is not None)
    )


class _Chunk:
    """Documents of a task whose texts share a trie."""

    def __init__(self, number: int):
        self.number, self.trie = number, RadixTrie()
        self.rows: list[tuple[int, int | None, str]] = []
        self.texts: list[tuple] = []  # terminal, mask, text

    def add(self, doc_id: int | None, part: str, text: str) -> None:
        data = text.encode("utf-8", "replace")
        node = self.trie.insert(data, doc_id)
        if not node.members:
            node.members.append(len(self.texts))
            self.texts.append((node, text_mask(text, data), text))
        self.rows.append((node.members[0], doc_id, part))

    def batches(self) -> Iterator[pa.RecordBatch]:
        led: set[int] = set()
        out: list[tuple] = []
        size = 0
        for no, doc_id, part in self.rows:
            node, mask, text = self.texts[no]
            lead = no not in led
            led.add(no)
            size += len(text) if lead else 0
            out.append((self.number, no, doc_id, part, mask, node.least, text if lead else None, None))
            if len(out) == _ROWS or size > CHUNK_BYTES // 4:
                yield _batch(out, _MARKED)
                out, size = [], 0
        step = self.trie.size // PREFIXES + 1
        prefixes = self.trie.separators(step, int(step * (self.number * 0.6180339887498949 % 1)))
        out += [(None, None, None, None, None, None, None, p) for p in prefixes]
        if out:
            yield _batch(out, _MARKED)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True)
    arrays = [pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 20
    chunk = _Chunk(number)
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            chunk.add(*row)
            if chunk.trie.size >= CHUNK_BYTES or len(chunk.rows) >= 1 << 17:
                yield from chunk.batches()
                number += 1
                chunk = _Chunk(number)
    if chunk.rows:
        yield from chunk.batches()


# -- texts of the whole table ---------------------------------------------------


def range_bounds(marked: DataFrame, ranges: int) -> list[bytes]:
    """At most ``ranges - 1`` prefixes that cut the texts into ranges of about equal bytes."""
    prefixes = marked.where("prefix is not null").select("prefix")
    total = prefixes.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0))).first()[0]
    drawn = F.pmod(F.xxhash64("prefix"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, PREFIX_BYTES / max(total, 1))))
    found = sorted(bytes(r[0]) for r in prefixes.where(drawn).collect())
    picked = {found[i * len(found) // ranges] for i in range(1, ranges)} if found else set()
    return sorted(picked)


def _in_range(bounds: list[bytes]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        for batch in batches:
            texts = batch.column(3).cast(pa.binary()).to_pylist()
            where = pa.array([bisect_right(bounds, t) for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, where], [*batch.schema.names, "at"])

    return place


def _smaller_elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by text: tries of bounded size, then (chunk, no, first) of texts whose smallest id is not their chunk's."""

    def traverse(trie: RadixTrie) -> Iterator[pa.RecordBatch]:
        out = []
        for node in trie.terminals():
            for chunk, no, least in node.members:
                if least is not None and node.least < least:
                    out.append((chunk, no, node.least))
                    if len(out) == _ROWS:
                        yield _batch(out, _FOUND)
                        out = []
        if out:
            yield _batch(out, _FOUND)

    trie, last, held = RadixTrie(), None, 0
    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3).cast(pa.binary()).to_pylist(), strict=True)
        for chunk, no, least, text in rows:
            if text != last and (trie.size >= CHUNK_BYTES or held >= 1 << 17):
                yield from traverse(trie)
                trie, held = RadixTrie(), 0
            trie.insert(text, least).members.append((chunk, no, least))
            last, held = text, held + 1
    yield from traverse(trie)


def filter_masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per document: doc_id, part, mask (bit i is set if the document fails filter i of ``ABCDE``)."""
    spark = docs.sparkSession
    small_batches(spark)
    given = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        text_or_empty(text).alias("text"),
    )
    marked = stage(given.mapInArrow(_mark, _MARKED), "masks")
    leads = marked.where("text is not null").select("chunk", "no", "least", "text")
    size = leads.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, size // RANGE_BYTES))
    placed = leads.mapInArrow(_in_range(range_bounds(marked, ranges)), "chunk long, no int, least long, text string, at int")
    ranged = placed.repartitionById(ranges, F.col("at")).sortWithinPartitions("text", F.col("least").asc_nulls_last())
    found = ranged.select("chunk", "no", "least", "text").mapInArrow(_smaller_elsewhere, _FOUND)
    rows = marked.where("chunk is not null").select("chunk", "no", "doc_id", "part", "mask", "least")
    smaller = F.coalesce(F.col("doc_id") > F.coalesce("first", "least"), F.lit(False))
    return rows.join(found, ["chunk", "no"], "left").select(
        "doc_id", "part", F.col("mask").bitwiseOR(F.when(smaller, F.lit(E)).otherwise(F.lit(0))).alias("mask")
    )


# -- orders ---------------------------------------------------------------------


def mask_counts(masks: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those labelled quality 1 and toxic 1."""
    documents = masks.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("_good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("_toxic"),
    )
    return (
        documents.join(marks, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.coalesce("_good", F.lit(0))).alias("good"),
            F.sum(F.col("n") * F.coalesce("_toxic", F.lit(0))).alias("toxic"),
        )
    )


def _bits(letters: Column) -> Column:
    return sum((F.when(F.instr(letters, f) > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(FILTERS)), F.lit(0))


def audit_orders(counts: DataFrame) -> DataFrame:
    """What every filter removes at every step of every order of the filters, per part; zeros included."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    told = steps.withColumns(
        {
            "filter": F.substring("filter_order", F.col("step"), F.lit(1)),
            "earlier": F.substring("filter_order", F.lit(1), F.col("step") - 1),
        }
    ).withColumns({"own": _bits(F.col("filter")), "earlier": _bits(F.col("earlier"))})
    fails = F.col("mask").bitwiseAND(F.col("own")) > 0
    gone = F.col("mask").bitwiseAND(F.col("earlier")) > 0

    def total(condition: Column, value: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(F.lit(0))).cast("long")

    rows = told.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    shares = rows.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return rows.join(shares, ["part", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit_filters(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step."""
    counts = stage(mask_counts(filter_masks(docs, doc_id, text, part), labels, doc_id), "mask_counts")
    return audit_orders(counts)


def audit_sql() -> str:
    """DuckDB's words for ``audit_filters``: equal texts by a window, orders by a join of letters."""
    return r"""
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents
), m as (
  select doc_id, part,
    (len(w) < 200) as a, (100 * len(list_distinct(w)) < 50 * len(w)) as b,
    (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t)) as c,
    regexp_matches(t, '[#$%&*|]') as d,
    coalesce(doc_id > min(doc_id) over (partition by t), false) as e
  from d
), marks as (
  select doc_id, max(coalesce(quality = 1, false)::int) as good, max(coalesce(toxic = 1, false)::int) as toxic from labels group by doc_id
), f as (
  select m.*, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} as fails, a::int + b::int + c::int + d::int + e::int as n_fails,
    coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
  from m left join marks using (doc_id)
), g as (
  select part, fails, n_fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, fails, n_fails
), l as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as x
), orders as (
  select l1.x || l2.x || l3.x || l4.x || l5.x as filter_order
  from l l1, l l2, l l3, l l4, l l5
  where len(list_distinct([l1.x, l2.x, l3.x, l4.x, l5.x])) = 5
), steps as (
  select part, filter_order, step::int as step, substr(filter_order, step, 1) as x, n, n_fails, good, toxic,
    fails[substr(filter_order, step, 1)] as own,
    len(list_filter(string_split(substr(filter_order, 1, step - 1), ''), lambda y: fails[y])) > 0 as gone
  from g, orders, range(1, 6) s(step)
), told as (
  select part, filter_order, step, x,
    sum(n * (not own and not gone)::int)::bigint as kept, sum(n * (own and not gone)::int)::bigint as removed,
    sum(n * (own and gone)::int)::bigint as redundant, sum(n * (own and n_fails = 1)::int)::bigint as unique_fails,
    sum(good * (own and not gone)::int)::bigint as good_lost, sum(toxic * (own and not gone)::int)::bigint as toxic_lost
  from steps group by part, filter_order, step, x
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, x))::bigint as shapley
from told
"""

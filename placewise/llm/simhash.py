"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are sorted by their number of set bits and cut into tiles. Two fingerprints that differ in
at most ``radius`` bits have bit counts at most ``radius`` apart, so tile pairs with bit counts further apart are
never formed, and inside a pair a block only meets the rows within that distance. All other
pairs are compared exactly (exclusive-or, bit count), so no link is lost. A tile pair returns a spanning forest of
its links, never all of them: a group of n near copies gives fewer than n rows. A global component search
over the forests follows.

Defined results: a null or wordless text has the fingerprint zero, linked like any other; repeated rows share
fingerprint and component and stay repeated; a null id gets its group's component, which is null only if no row
of the group has an id; an empty table gives an empty result; other columns are ignored by
``near_duplicates`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.session import stage

from .common import free_name, map_batches, small_batches, text_or_empty
from .components import connected_components

SEED = 42
SHINGLE = 4
#: Most fingerprints of a tile (half a megabyte); smaller tables get smaller tiles so that all cores have work.
TILE_ROWS = 65536
LEAST_TILES = 24
_CHUNK = 65536


# -- fingerprints --------------------------------------------------------------


def shingle_hashes(text: str) -> np.ndarray:
    """XXH64 of every word shingle; a text with fewer words has one, a text without words none."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: lowers A-Z, splits at the six ASCII spaces
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, starts[SHINGLE:], strict=False)
    return np.fromiter((digest(joined[a : b - 1], SEED) for a, b in spans), np.uint64, len(words) - SHINGLE + 1)


def fingerprint(text: str) -> int:
    """A bit is set if it is set in more than half of the shingle hashes."""
    hashes = shingle_hashes(text)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _CHUNK):
        octets = hashes[start : start + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return map_batches(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")),
        digest,
        "doc_id long, fp long",
    )


# -- tiles ---------------------------------------------------------------------


class Forest:
    """Spanning forest of links between numbered nodes; labels are the smallest node of the tree."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[u], label[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up


def tile_forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint pairs that connect what links within tile ``a`` (``b`` None) or between two tiles connect.

    Both tiles are sorted by bit count.
    """
    other = a if b is None else b
    ones_a, ones_b = np.bitwise_count(a), np.bitwise_count(other)
    values = a if b is None else np.concatenate([a, b])
    offset = 0 if b is None else len(a)
    forest = Forest(len(values))
    rows, columns = 64, 8192
    for i in range(0, len(a), rows):
        block = a[i : i + rows, None]
        low = int(np.searchsorted(ones_b, int(ones_a[i]) - radius, "left"))
        high = int(np.searchsorted(ones_b, int(ones_a[min(i + rows, len(a)) - 1]) + radius, "right"))
        for j in range(max(low, i) if b is None else low, high, columns):
            near = np.bitwise_count(block ^ other[None, j : min(j + columns, high)]) <= radius
            hits = np.flatnonzero(near)
            if len(hits):
                u, v = np.divmod(hits, near.shape[1])
                forest.link(u + i, v + j + offset)
    child = np.flatnonzero(forest.label != np.arange(len(values)))
    return values[child], values[forest.label[child]]


def _tiles(fps: DataFrame, n: int) -> DataFrame:
    """(tile, low, high, fps): one row per range of bit counts, the fingerprints as packed bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy() for b in batches if b.num_rows]
        if parts:
            packed = np.concatenate(parts).view(np.uint64)
            ones = np.bitwise_count(packed)
            yield pa.RecordBatch.from_pydict(
                {
                    "tile": pa.array([TaskContext.get().partitionId()], pa.int32()),
                    "low": pa.array([int(ones[0])], pa.int32()),
                    "high": pa.array([int(ones[-1])], pa.int32()),
                    "fps": pa.array([packed.astype("<u8").tobytes()], pa.binary()),
                }
            )

    size = min(TILE_ROWS, max(1, -(-n // LEAST_TILES)))
    order = fps.select("fp", F.bit_count("fp").alias("ones"))
    ranged = order.repartitionByRange(-(-n // size), "ones", "fp").sortWithinPartitions("ones", "fp")
    return ranged.select("fp").mapInArrow(pack, "tile int, low int, high int, fps binary")


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose closure is that of all links of at most ``radius`` bits."""
    n = fps.count()
    if n < 2:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    tiles = stage(_tiles(fps, n), "tiles")
    spans = tiles.select("tile", "low", "high")
    # Tiles that share a bit count, the first one widened by the radius, are the pairs that may link.
    first = spans.select(F.col("tile").alias("i"), F.explode(F.sequence("low", F.col("high") + radius)).alias("ones"))
    second = spans.select(F.col("tile").alias("j"), F.explode(F.sequence("low", "high")).alias("ones"))
    pairs = first.join(second, "ones").where("i <= j").select("i", "j").distinct()
    work = pairs.join(tiles.select(F.col("tile").alias("i"), F.col("fps").alias("left")), "i").join(
        tiles.select(F.col("tile").alias("j"), F.col("fps").alias("right")), "j"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, left, right in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "left", "right")), strict=True):
                a = np.frombuffer(left, "<u8")
                u, v = tile_forest(a, None if i == j else np.frombuffer(right, "<u8"), radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["a", "b"])

    small_batches(fps.sparkSession)
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // TILE_ROWS)
    return work.repartition(parts, "i", "j").mapInArrow(compare, "a long, b long")


# -- documents -----------------------------------------------------------------


def near_duplicates(docs: DataFrame, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest id reachable)."""
    marked = stage(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    roots = connected_components(links(distinct, radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "doc_id", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Keep one document per component, the one with the smallest id; columns stay as they are.

    Of repeated rows with that id one stays. Rows without an id cannot be told apart by it: if a whole component has
    none, one of them stays.
    """
    found = near_duplicates(docs, radius, doc_id, text)
    mark = free_name(docs, "kept_id")
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(mark)).distinct()
    named = docs.join(kept, docs[doc_id].cast("long") == kept[mark], "left_semi")
    one_each = named.dropDuplicates([doc_id])
    nameless = found.where("component_id is null").select("fingerprint").distinct()
    lost = docs.where(F.col(doc_id).isNull())
    return one_each.union(_one_of_each_nameless(lost, nameless, radius, text))


def _one_of_each_nameless(rows: DataFrame, fingerprints_: DataFrame, radius: int, text: str) -> DataFrame:
    """Rows without ids whose component has no id either: give them ids of their own and keep one per component."""
    if rows.isEmpty():
        return rows
    columns, mark = rows.columns, free_name(rows, "own_id")
    own = stage(rows.withColumn(mark, F.monotonically_increasing_id()), "nameless")
    marked = near_duplicates(own, radius, mark, text)
    first = marked.join(fingerprints_, "fingerprint", "left_semi").where("doc_id = component_id")
    return own.join(first.select(F.col("doc_id").alias(mark)), mark, "left_semi").select(*columns)

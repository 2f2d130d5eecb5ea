"""Popularity counts and last-N rows per key over a stream, in the state that Spark keeps.

The streams are Spark's own stateful operators: a streaming count, and a ``StatefulProcessor`` with a list state. Checkpoints,
recovery and exactly-once updates are Spark's; a query started again on its checkpoint goes on where it stopped.
The current state is read with the ``statestore`` source, so no output table has to be kept up to date for it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

#: List state needs this state store.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "last_rows"


def popularity_stream(visits: DataFrame, place: str = "location_id") -> DataFrame:
    """Visits per place so far. A batch updates the places it holds; counts are added up before the shuffle."""
    return visits.groupBy(place).agg(F.count(F.lit(1)).alias("popularity"))


def trim(batch: pa.RecordBatch, key: str, order: Sequence[str], n: int) -> pa.RecordBatch:
    """The last ``n`` rows of every key in a batch."""
    codes = batch.column(key).dictionary_encode(null_encoding="encode").indices
    table = pa.table([codes, *(batch.column(c) for c in order)], names=["key", *(f"o{i}" for i in range(len(order)))])
    sorting = [("key", "ascending"), *((f"o{i}", "descending") for i in range(len(order)))]
    at = pc.sort_indices(table, sort_keys=sorting).to_numpy()
    keys = codes.to_numpy()[at]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else keys
    rank = np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))
    return batch.take(pa.array(np.sort(at[rank < n])))


class LastRows(StatefulProcessor):
    """Keeps the last ``n`` rows of a key in a list state and returns them after every batch that changed them.

    With ``forget_ms`` the rows of a key are dropped after that time without a new one, so that keys which never
    return do not stay in the state.
    """

    def __init__(self, schema: StructType, order: Sequence[str], n: int, forget_ms: int | None):
        self.schema, self.order, self.n, self.forget_ms = schema, list(order), n, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState(STATE, self.schema, self.forget_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        at = [self.schema.names.index(c) for c in self.order]
        # A missing order value comes before all others, as in an ascending sort.
        place = lambda row: tuple((row[i] is not None, row[i]) if row[i] is not None else (False,) for i in at)
        known = [tuple(r) for r in self.rows.get()]
        kept = heapq.nlargest(self.n, chain(known, (tuple(r) for r in rows)), key=place)
        if sorted(known, key=place) != kept[::-1]:
            self.rows.put(kept)
            row = Row(*self.schema.names)
            yield from (row(*r) for r in kept)

    def close(self) -> None:
        pass


def last_rows_stream(
    rows: DataFrame, n: int = 5, key: str = "user_id", order: Sequence[str] = ("ts", "event_id"), forget_ms: int | None = None
) -> DataFrame:
    """The last ``n`` rows per key; update mode returns all rows of every key that a batch changed.

    Every task keeps only the last ``n`` rows of a key in each of its Arrow batches before the shuffle, so a key with a large
    part of all rows sends few of them.
    """
    schema = rows.schema

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (trim(batch, key, order, n) for batch in batches)

    mode = "None" if forget_ms is None else "ProcessingTime"
    return rows.mapInArrow(trimmed, schema).groupBy(key).transformWithState(
        LastRows(schema, order, n, forget_ms), outputStructType=schema, outputMode="Update", timeMode=mode
    )


def start(stream: DataFrame, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Run a stream for its state alone; ``trigger`` as in ``writeStream.trigger`` (all that is there, then stop, if not given).

    Writers that need the changes use ``stream.writeStream.outputMode("update").foreachBatch(...)`` instead.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    writer = stream.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_popularity(spark: SparkSession, checkpoint: str, place: str = "location_id") -> DataFrame:
    """Visits per place as of the last finished batch."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(F.col(f"key.{place}").alias(place), F.col("value.count").alias("popularity"))


def read_last_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The kept rows of all keys as of the last finished batch."""
    state = spark.read.format("statestore").option("stateVarName", STATE).load(checkpoint)
    return state.select("list_element.*")

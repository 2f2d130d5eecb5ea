"""Shards by fixed virtual slots: records are hashed into slots, and a versioned map says which shard holds a slot.

Native DataFrame operations only.

1. Every record's (id, CRC of the text) is hashed into one of ``slots`` virtual slots, for good. Copies of a text have ids
   of their own and fall into different slots. Inside a slot records are dealt to ``PARTS`` parts in turn, so that a
   slot with many repeated rows is never one group.
2. Bytes and rows are summed per (slot, part), partially before the shuffle: at most ``slots * PARTS`` rows at any input size.
3. The map starts with slot mod shards and is edited by the measured bytes: a shard keeps its largest slots up to the fair
   share, and what is over goes, the largest first, to the shard with the fewest bytes. A slot that holds more than a
   quarter of the fair share is mapped part by part. Only edited slots move; with a shard more, slots move only into
   it or to even out; with a shard less, its slots are dealt to the others.
4. Every edit is a new version of the map, appended to a table of its own; older versions stay readable.
5. Records take their shard from the map by a broadcast of its cells, and are numbered inside their shard: the rows of the
   cells before theirs, plus their rank in their own cell. Nothing but (id, size, CRC) is shuffled, once.

Defined results: a null or empty text has size 16 and CRC 0; null ids are hashed like any other value; repeated rows
share a slot (not always a part) and are numbered one by one; a text longer than a shard's fair share makes its shard that
much larger, as records are not cut; ties in bytes are settled by slot and part; an empty table gives an empty result and
an unedited map; other columns are ignored by ``assign_shards`` and kept by ``write_shards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placewise.session import stage

from .common import free_name

#: Virtual slots, and parts of a slot.
SLOTS, PARTS = 8192, 16
#: Bytes of a record besides its text.
RECORD = 16
#: A slot of more than this share of a shard's bytes is mapped part by part.
HEAVY = 0.25
MAP = "version int, slot int, part int, shard int"


# -- slots ----------------------------------------------------------------------


def virtual_slot(doc_id: Column, text_crc32: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id, text_crc32), F.lit(slots)).cast("int")


def _record(doc_id: str, text: str, slots: int) -> dict[str, Column]:
    crc = F.coalesce(F.crc32(F.col(text).cast("string")), F.lit(0)).cast("long")
    return {
        "doc_id": F.col(doc_id).cast("long"),
        "size": (F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + F.lit(RECORD)).cast("long"),
        "text_crc32": crc,
        "virtual_slot": virtual_slot(F.col(doc_id).cast("long"), crc, slots),
        "part": F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int"),
    }


def records(docs: DataFrame, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, part), written once: the parts follow the rows' order, so they are kept."""
    return stage(docs.select(*(c.alias(n) for n, c in _record(doc_id, text, slots).items())), "records")


def cell_sizes(rows: DataFrame) -> DataFrame:
    """(slot, part, rows, bytes) of every cell that holds records."""
    cells = rows.groupBy(F.col("virtual_slot").alias("slot"), "part")
    return stage(cells.agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")), "cells")


# -- the map --------------------------------------------------------------------


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slot mod shards. Part -1 stands for the whole slot."""
    slot = F.col("id").cast("int")
    return spark.range(slots).select(
        F.lit(1).alias("version"), slot.alias("slot"), F.lit(-1).alias("part"), (slot % shards).cast("int").alias("shard")
    )


def _pick_shards(loads: Column, units: Column) -> Column:
    """The shard of each unit, in order: the one with the fewest bytes so far (the first of equals)."""
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("picks"))

    def deal(state: Column, unit: Column) -> Column:
        least = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(
            F.transform(state["loads"], lambda load, i: F.when(i == least, load + unit["bytes"]).otherwise(load)).alias("loads"),
            F.concat(state["picks"], F.array(least)).alias("picks"),
        )

    return F.aggregate(units, start, deal)["picks"]


def _deal(placed: DataFrame, fair: Column, shards: int) -> DataFrame:
    """(slot, part, bytes, old) with new places: a shard keeps its largest units up to the fair share, the rest are dealt."""
    order = Window.partitionBy("old").orderBy(F.desc("bytes"), "slot", "part")
    fits = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)) <= fair
    judged = stage(placed.withColumn("stays", F.coalesce((F.col("old") < shards) & fits, F.lit(False))), "units")
    unit = F.struct((-F.col("bytes")).alias("minus"), "slot", "part", "bytes")
    load = judged.where("stays").groupBy("old").agg(F.struct("old", F.sum("bytes").alias("bytes")).alias("load"))
    moving = judged.where("not stays").select(unit.alias("unit"))
    # One row: the loads of all shards, and the units to deal.
    both = load.select("load", F.lit(None).alias("unit")).union(moving.select(F.lit(None), "unit")).agg(
        F.map_from_entries(F.collect_list("load")).alias("kept"), F.sort_array(F.collect_list("unit")).alias("units")
    )
    loads = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.element_at("kept", i), F.lit(0).cast("long"))
    )
    both = both.select("units", loads.alias("loads"))
    dealt = both.select(F.explode(F.arrays_zip("units", _pick_shards(F.col("loads"), F.col("units")).alias("picks"))).alias("u"))
    dealt = dealt.select("u.units.slot", "u.units.part", "u.units.bytes", F.col("u.picks").alias("old"))
    return judged.where("stays").select("slot", "part", "bytes", "old").union(dealt)


def edited_map(slot_map: DataFrame, cells: DataFrame, shards: int) -> DataFrame:
    """The next version of the map for these cells and this number of shards; slots without records stay where they are.

    The work is bounded by the number of slots: one row of all units to be dealt, and an array of loads by shard.
    """
    fair = F.lit(cells.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("double")).first()[0] / shards)
    whole = Window.partitionBy("slot")
    heavy = F.sum("bytes").over(whole) > F.lit(HEAVY) * fair
    units = (
        cells.withColumn("part", F.when(heavy, F.col("part")).otherwise(F.lit(-1)))
        .groupBy("slot", "part")
        .agg(F.sum("bytes").alias("bytes"))
    )
    known = slot_map.select("slot", F.col("part").alias("_part"), F.col("shard").alias("_shard"))
    # A unit is where its own row, or its whole slot, was before; the parts of a slot no longer heavy go to the first part's place.
    same = (units["slot"] == known["slot"]) & ((units["part"] == known["_part"]) | (known["_part"] == -1) | (units["part"] == -1))
    placed = units.join(known, same, "left").groupBy(units["slot"], "part", "bytes").agg(
        F.min_by("_shard", F.struct(F.when(F.col("_part") == F.col("part"), 0).otherwise(1), "_part")).alias("old")
    )
    # Once more for shards that large units of the first deal put over the fair share.
    settled = _deal(_deal(placed, fair, shards), fair, shards)
    empty = slot_map.join(settled.select("slot").distinct(), "slot", "left_anti").where("part = -1")
    rows = settled.select("slot", "part", F.col("old").alias("shard")).union(empty.select("slot", "part", F.pmod("shard", F.lit(shards)).alias("shard")))
    version = slot_map.agg(F.max("version")).first()[0] + 1
    return rows.select(F.lit(version).alias("version"), "slot", F.col("part").cast("int").alias("part"), F.col("shard").cast("int").alias("shard"))


def save_map(slot_map: DataFrame, folder: str) -> DataFrame:
    """Append a version to the table in ``folder`` and read that version back."""
    version = slot_map.first()["version"]
    slot_map.coalesce(1).write.mode("append").parquet(folder)
    return load_map(slot_map.sparkSession, folder, version)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """One version of the map, the newest if none is named."""
    table = spark.read.schema(MAP).parquet(folder)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == version)


def map_edits(old: DataFrame, new: DataFrame) -> DataFrame:
    """(slot, part, old_shard, new_shard) of what moves between two versions."""
    a, b = old.select("slot", "part", F.col("shard").alias("old_shard")), new.select("slot", "part", F.col("shard").alias("new_shard"))
    return a.join(b, ["slot", "part"], "full").where(~F.col("old_shard").eqNullSafe(F.col("new_shard")))


# -- records --------------------------------------------------------------------


def _cells_with_shards(cells: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Cells with their shard: a cell's own row of the map, or its slot's."""
    whole = slot_map.where("part = -1").select("slot", F.col("shard").alias("_whole"))
    own = slot_map.where("part >= 0").select("slot", "part", F.col("shard").alias("_own"))
    joined = cells.join(whole, "slot", "left").join(own, ["slot", "part"], "left")
    return joined.select("slot", "part", "rows", "bytes", F.coalesce("_own", "_whole").alias("shard"))


def number_records(rows: DataFrame, cells: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Records with their shard and their place in it, gapless from 0."""
    before = Window.partitionBy("shard").orderBy("slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = _cells_with_shards(cells, slot_map).select(
        F.col("slot").alias("virtual_slot"), "part", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_before")
    )
    rank = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size"))
    ranked = rows.withColumn("_rank", rank)
    # At most slots * PARTS rows of a few numbers: a bound that does not grow with the data.
    return ranked.join(F.broadcast(offsets), ["virtual_slot", "part"]).withColumn("place", (F.col("_before") + F.col("_rank") - 1).cast("long"))


def assign_shards(
    docs: DataFrame, folder: str, slot_map: DataFrame | None = None, shards: int = 40, slots: int = SLOTS,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, part, shard, place) of every record; the map table in ``folder`` gets a version.

    ``slot_map`` is the version to edit (``load_map(spark, folder)``); without one the table begins with the first map.
    """
    rows = records(docs, slots, doc_id, text)
    cells = cell_sizes(rows)
    if slot_map is None:
        slot_map = save_map(first_map(docs.sparkSession, shards, slots), folder)
    edited = save_map(edited_map(slot_map, cells, shards), folder)
    return number_records(rows, cells, edited).drop("_before", "_rank")


def write_shards(
    docs: DataFrame, slot_map: DataFrame, path: str, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text",
    rows_per_file: int = 100_000,
) -> None:
    """Write whole documents into one folder a shard. A shard is written by ``PARTS`` tasks, each with files of bounded rows."""
    slot, part, shard, whole, own = (free_name(docs, n) for n in ("slot", "part", "shard", "whole", "own"))
    made = _record(doc_id, text, slots)
    named = docs.withColumns({slot: made["virtual_slot"], part: made["part"]})
    by_slot = slot_map.where("part = -1").select(F.col("slot").alias(slot), F.col("shard").alias(whole))
    by_part = slot_map.where("part >= 0").select(F.col("slot").alias(slot), F.col("part").alias(part), F.col("shard").alias(own))
    placed = named.join(F.broadcast(by_slot), slot, "left").join(F.broadcast(by_part), [slot, part], "left")
    placed = placed.withColumn(shard, F.coalesce(own, whole))
    spread = placed.repartition(shard, part).select(*docs.columns, shard)
    spread.write.option("maxRecordsPerFile", rows_per_file).partitionBy(shard).parquet(path)

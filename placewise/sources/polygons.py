"""Zone boundaries: shapefiles as tables of vertices, and centroids weighted by area.

Coordinates are taken as the file has them; files in a projected system are to be re-projected before.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placewise.functions.numbers import round_to

# Fixed values of the file format.
POLYGON_TYPES = (5, 15, 25)
HEADER_BYTES = 100
_VERTICES = "zone_id long, ring int, seq int, lat double, lon double"


def shape_rings(data: bytes) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(record, rings) of the polygons of a .shp file; a ring is an array of (x, y). Other shapes and null shapes are left out."""
    at = HEADER_BYTES
    record = 0
    while at + 8 <= len(data):
        words = struct.unpack_from(">ii", data, at)[1]
        body, at = at + 8, at + 8 + 2 * words
        if struct.unpack_from("<i", data, body)[0] in POLYGON_TYPES:
            n_parts, n_points = struct.unpack_from("<ii", data, body + 36)
            starts = np.frombuffer(data, "<i4", n_parts, body + 44)
            points = np.frombuffer(data, "<f8", 2 * n_points, body + 44 + 4 * n_parts).reshape(-1, 2)
            yield record, np.split(points, starts[1:])
        record += 1


def attribute_column(data: bytes, names: list[str]) -> list[int | None]:
    """The whole numbers of the first of these columns that a .dbf file has, by record."""
    n, header, width = struct.unpack_from("<IHH", data, 4)
    fields, offset, at = {}, 1, 32
    while data[at] != 0x0D:
        size = data[at + 16]
        fields[data[at : at + 11].split(b"\0")[0].decode("latin-1")] = (offset, size)
        offset, at = offset + size, at + 32
    found = next((fields[f] for f in names if f in fields), None)
    if found is None:
        raise ValueError(f"none of the columns {names} in {list(fields)}")
    out = []
    for i in range(n):
        start = header + i * width + found[0]
        text = data[start : start + found[1]].decode("latin-1").strip(" \0")
        out.append(int(float(text)) if text and "*" not in text else None)
    return out


def read_polygons(spark: SparkSession, folder: str, id_columns: tuple[str, ...] = ("LocationID", "OBJECTID")) -> DataFrame:
    """(zone_id, ring, seq, lat, lon): the boundary vertices of all shapefiles in a folder, from any store that Spark reads.

    The id comes from the first of ``id_columns`` in the .dbf file of the same name; records without an id, or with 0, are left out.
    A file is read by one task, so zones of many files spread.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    shapes = files.filter(F.lower("path").endswith(".shp")).select(stem.alias("stem"), F.col("content").alias("shp"))
    tables = files.filter(F.lower("path").endswith(".dbf")).select(stem.alias("stem"), F.col("content").alias("dbf"))

    def vertices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shp, dbf in zip(batch.column("shp").to_pylist(), batch.column("dbf").to_pylist(), strict=True):
                ids = attribute_column(dbf, list(id_columns))
                for record, rings in shape_rings(shp):
                    for ring, points in enumerate(rings):
                        if ids[record]:
                            n = len(points)
                            columns = [np.full(n, ids[record]), np.full(n, ring, np.int32), np.arange(n, dtype=np.int32)]
                            arrays = [pa.array(c) for c in (*columns, points[:, 1].copy(), points[:, 0].copy())]
                            yield pa.RecordBatch.from_arrays(arrays, ["zone_id", "ring", "seq", "lat", "lon"])

    return shapes.join(tables, "stem").select("shp", "dbf").mapInArrow(vertices, _VERTICES)


def polygon_centroids(vertices: DataFrame, zone: str = "zone_id") -> DataFrame:
    """(zone, lat, lon, area): the centroid of each zone's area, 6 decimals, and the area in square units of the coordinates.

    A zone may have many parts, and holes, which run the other way round than the outer rings: signed areas and moments are
    summed over all rings, so holes are taken off. Rings may repeat their first vertex at the end or not. A zone
    without area is placed at the mean of its vertices.
    """
    order = Window.partitionBy(zone, "ring").orderBy("seq")

    def following(c: str):
        return F.coalesce(F.lead(c).over(order), F.first(c).over(order))

    # Coordinates from the ring's first vertex, as products of large numbers that differ little lose digits.
    local = {f"_{a}": F.col(c) - F.first(c).over(order) for a, c in (("x", "lon"), ("y", "lat"))}
    rows = vertices.withColumns({**local, "_lon0": F.first("lon").over(order), "_lat0": F.first("lat").over(order)})
    rows = rows.withColumns({"_nx": following("_x"), "_ny": following("_y")})
    cross = F.col("_x") * F.col("_ny") - F.col("_nx") * F.col("_y")
    rings = rows.groupBy(zone, "ring").agg(
        F.sum(cross).alias("_a2"),
        F.sum((F.col("_x") + F.col("_nx")) * cross).alias("_mx"),
        F.sum((F.col("_y") + F.col("_ny")) * cross).alias("_my"),
        F.first("_lon0").alias("_lon0"), F.first("_lat0").alias("_lat0"),
        F.sum("lon").alias("_lons"), F.sum("lat").alias("_lats"), F.count(F.lit(1)).alias("_n"),
    )
    zones = rings.groupBy(zone).agg(
        F.sum("_a2").alias("_a2"),
        F.sum(F.col("_mx") / 3 + F.col("_lon0") * F.col("_a2")).alias("_mx"),
        F.sum(F.col("_my") / 3 + F.col("_lat0") * F.col("_a2")).alias("_my"),
        (F.sum("_lons") / F.sum("_n")).alias("_lon"), (F.sum("_lats") / F.sum("_n")).alias("_lat"),
    )
    flat = F.abs("_a2") < 1e-15
    return zones.select(
        zone,
        round_to(F.when(flat, F.col("_lat")).otherwise(F.try_divide("_my", "_a2")), 6).alias("lat"),
        round_to(F.when(flat, F.col("_lon")).otherwise(F.try_divide("_mx", "_a2")), 6).alias("lon"),
        round_to(F.abs("_a2") / 2, 9).alias("area"),
    )

"""Point-of-interest inputs and the filtered point-of-interest table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.functions.geo import within_box

# Fixed values: (south, west, north, east).
US_BOX = (24.0, -130.0, 50.0, -60.0)
NYC_BOX = (40.4, -74.3, 40.95, -73.7)


def read_places(
    spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None
) -> DataFrame:
    """Place records with nested names, categories and bounding box.

    Only the nested fields named here are read; the box test is on the plain
    ``bbox`` fields, so Parquet row groups outside it are skipped.
    """
    raw = spark.read.parquet(path)
    if box is not None:
        south, west, north, east = box
        raw = raw.filter(within_box("bbox.ymin", "bbox.xmin", south, west, north, east))
    return raw.select(
        F.col("id").alias("poi_id"),
        F.col("names.primary").alias("name"),
        F.col("categories.primary").alias("category"),
        F.col("bbox.ymin").alias("lat"),
        F.col("bbox.xmin").alias("lon"),
    )


def write_places(pois: DataFrame, path: str) -> None:
    """Filtered places, one folder per whole-degree latitude band, for pruning by area; crowded bands are split."""
    banded = pois.withColumn("lat_band", F.floor("lat").cast("int"))
    banded.hint("rebalance", F.col("lat_band")).write.partitionBy("lat_band").parquet(path)


def read_written_places(
    spark: SparkSession, path: str, box: tuple[float, float, float, float]
) -> DataFrame:
    """Places of a box: whole latitude bands are pruned, the rest is pushed down."""
    south, west, north, east = box
    return (
        spark.read.parquet(path)
        .filter(F.col("lat_band").between(int(south // 1), int(north // 1)))
        .filter(within_box("lat", "lon", south, west, north, east))
        .drop("lat_band")
    )

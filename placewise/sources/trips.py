"""Trip and zone inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The five columns wanted from a monthly trip file.
TRIP_COLUMNS = {
    "tpep_pickup_datetime": "pickup_ts",
    "tpep_dropoff_datetime": "dropoff_ts",
    "PULocationID": "pu_zone",
    "DOLocationID": "do_zone",
    "trip_distance": "trip_distance",
}

ZONE_LOOKUP_SCHEMA = T.StructType(
    [
        T.StructField("zone_id", T.IntegerType()),
        T.StructField("borough", T.StringType()),
        T.StructField("zone_name", T.StringType()),
        T.StructField("service_zone", T.StringType()),
    ]
)


def existing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths that exist, checked through the Hadoop file system of each."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        hpath = jvm.org.apache.hadoop.fs.Path(p)
        if hpath.getFileSystem(conf).exists(hpath):
            found.append(p)
    return found


def read_trips(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Monthly trip files as one table; missing months are skipped.

    Selecting five columns first keeps every other column unread in Parquet.
    """
    found = existing_paths(spark, paths)
    if not found:
        raise FileNotFoundError(f"none of the trip files exist: {list(paths)}")
    raw = spark.read.parquet(*found)
    return raw.select(*[F.col(src).alias(dst) for src, dst in TRIP_COLUMNS.items()])


def read_zone_lookup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ZONE_LOOKUP_SCHEMA).option("header", True).csv(path)


def zone_centroids(vertices: DataFrame, zone: str = "zone_id") -> DataFrame:
    """One point per zone from boundary vertices: their mean, 6 decimals."""
    from placewise.functions.numbers import round_to

    means = vertices.groupBy(zone).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return means.select(zone, round_to("lat", 6).alias("lat"), round_to("lon", 6).alias("lon"))

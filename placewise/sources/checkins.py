"""Check-in and friendship inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewise.functions.texts import strip

VENUE_CHECKIN_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("location_id", T.StringType()),
        T.StructField("category_id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("tz_offset_min", T.IntegerType()),
        T.StructField("utc_time", T.StringType()),
    ]
)

# The two time formats met in venue check-in files.
VENUE_TIME_FORMATS = ("EEE MMM dd HH:mm:ss Z yyyy", "yyyy-MM-dd HH:mm:ss")


def canonical_edges(df: DataFrame, u: str, v: str) -> DataFrame:
    """Undirected edges once each, smaller id first."""
    return df.select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")).distinct()


def parse_edges(lines: DataFrame, text: str = "value") -> DataFrame:
    """Edge list lines: ``#`` comments skipped, exactly two whole numbers needed; white space at the ends is ignored."""
    fields = F.split(strip(text), r"\s+")
    pairs = lines.filter(~F.col(text).startswith("#")).select(fields.alias("f"))
    pairs = pairs.filter(F.size("f") == 2)
    return canonical_edges(
        pairs.select(F.col("f")[0].try_cast("long").alias("u"), F.col("f")[1].try_cast("long").alias("v")).dropna(),
        "u",
        "v",
    )


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return parse_edges(spark.read.text(path))


def _checkin_fields(lines: DataFrame, text: str) -> DataFrame:
    f = F.split(strip(text), "\t")
    return lines.select(f.alias("f")).select(
        F.when(F.size("f") == 5, F.col("f")[0].try_cast("long")).alias("user_id"),
        F.regexp_replace(F.get("f", F.lit(1)), "Z$", "").try_cast("timestamp_ntz").alias("ts"),
        F.get("f", F.lit(2)).try_cast("double").alias("latitude"),
        F.get("f", F.lit(3)).try_cast("double").alias("longitude"),
        F.get("f", F.lit(4)).try_cast("long").alias("location_id"),
    )


def parse_checkins(lines: DataFrame, text: str = "value") -> DataFrame:
    """Tab-separated check-ins; white space at the ends of a line is ignored. Lines without exactly five fields, or with one that is
    no number or time, are dropped; :func:`count_bad_checkins` counts them."""
    return _checkin_fields(lines, text).dropna()


def count_bad_checkins(lines: DataFrame, text: str = "value") -> DataFrame:
    """One row: lines in all, and lines that :func:`parse_checkins` drops."""
    fields = _checkin_fields(lines, text)
    whole = F.greatest(*(F.col(c).isNull() for c in fields.columns))
    return fields.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(whole).alias("n_bad"))


def read_checkins(spark: SparkSession, path: str) -> DataFrame:
    return parse_checkins(spark.read.text(path))


def read_venue_checkins(spark: SparkSession, path: str) -> DataFrame:
    """CSV check-ins with a header and eight columns, renamed by position."""
    raw = spark.read.schema(VENUE_CHECKIN_SCHEMA).option("header", True).csv(path)
    clean = F.regexp_replace("utc_time", r"^(\w{3}) ", "")
    ts = F.coalesce(
        F.try_to_timestamp(clean, F.lit(VENUE_TIME_FORMATS[0].removeprefix("EEE "))),
        F.try_to_timestamp(F.col("utc_time"), F.lit(VENUE_TIME_FORMATS[1])),
    )
    # Keep the UTC wall clock, whatever the session's time zone is.
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    return raw.withColumn("ts", utc.cast("timestamp_ntz")).drop("utc_time")

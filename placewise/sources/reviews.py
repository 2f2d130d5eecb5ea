"""Business and review inputs (JSON lines)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUSINESS_SCHEMA = T.StructType(
    [
        T.StructField("business_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("categories", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)
REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("business_id", T.StringType()),
        T.StructField("stars", T.DoubleType()),
        T.StructField("date", T.StringType()),
    ]
)


def join_reviews(reviews: DataFrame, businesses: DataFrame) -> DataFrame:
    """Reviews with their business; reviews of unknown businesses drop out."""
    b = businesses.select(
        "business_id",
        F.coalesce("name", F.lit("")).alias("business_name"),
        F.coalesce("categories", F.lit("")).alias("categories"),
        F.coalesce("city", F.lit("")).alias("city"),
        F.coalesce("latitude", F.lit(0.0)).alias("latitude"),
        F.coalesce("longitude", F.lit(0.0)).alias("longitude"),
    )
    r = reviews.select(
        "user_id",
        "business_id",
        F.col("stars").cast("int").alias("stars"),
        F.to_date(F.substring("date", 1, 10)).alias("review_date"),
    )
    return r.join(b, "business_id")


def read_reviews(spark: SparkSession, business_path: str, review_path: str) -> DataFrame:
    businesses = spark.read.schema(BUSINESS_SCHEMA).json(business_path)
    reviews = spark.read.schema(REVIEW_SCHEMA).json(review_path)
    return join_reviews(reviews, businesses)

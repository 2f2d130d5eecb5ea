"""Writers for case tables, dimensions and chat files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Columnar table; nested history and candidate columns are kept as they are."""
    df.write.partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON-lines interchange form of a table."""
    df.write.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header row."""
    df.write.option("header", True).csv(path)


def chat_messages(system: Column, user: Column, answer: Column | None = None) -> Column:
    """``[{role, content}, ...]``; the answer turn is present where it is not NULL."""

    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    turns = F.array(turn("system", system), turn("user", user))
    if answer is None:
        return turns
    return F.when(answer.isNull(), turns).otherwise(
        F.concat(turns, F.array(turn("assistant", answer)))
    )


#: Rows of one chat file at most.
CHAT_FILE_ROWS = 100_000


def write_chat(df: DataFrame, path: str) -> None:
    """Chat files, one folder per split and level; test rows keep their metadata columns.

    Rows are rebalanced by folder: small folders stay in one task, large ones are split over many, and no file
    grows without bound.
    """
    spread = df.hint("rebalance", F.col("split"), F.col("level"))
    spread.write.option("maxRecordsPerFile", CHAT_FILE_ROWS).partitionBy("split", "level").json(path)

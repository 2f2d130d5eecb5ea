"""Request files for a text model, its response files, and prediction files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewise.operators.sampling import ordered_position

# Fixed values.
REQUESTS_PER_FILE = 50_000
NO_REASONING = "No reasoning."

RESPONSE_SCHEMA = T.StructType(
    [
        T.StructField("custom_id", T.StringType()),
        T.StructField(
            "response",
            T.StructType(
                [
                    T.StructField("status_code", T.IntegerType()),
                    T.StructField(
                        "body",
                        T.StructType(
                            [
                                T.StructField(
                                    "choices",
                                    T.ArrayType(
                                        T.StructType(
                                            [
                                                T.StructField(
                                                    "message",
                                                    T.StructType(
                                                        [T.StructField("content", T.StringType())]
                                                    ),
                                                )
                                            ]
                                        )
                                    ),
                                )
                            ]
                        ),
                    ),
                ]
            ),
        ),
    ]
)

PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("prediction", T.IntegerType()),
    ]
)


def custom_id(split: Column, level: Column, case_no: Column, candidate_no: Column | None = None) -> Column:
    """``split|level|00012`` or ``split|level|0012|03``."""
    if candidate_no is None:
        return F.format_string("%s|%s|%05d", split, level, case_no)
    return F.format_string("%s|%s|%04d|%02d", split, level, case_no, candidate_no)


def number_chunks(requests: DataFrame, key: str, size: int = REQUESTS_PER_FILE) -> DataFrame:
    """File number of each request when requests are cut in key order every ``size`` rows."""
    placed = ordered_position(requests, key, "_pos")
    return placed.withColumn("chunk", F.floor(F.col("_pos") / size).cast("long")).drop("_pos")


def write_requests(requests: DataFrame, path: str, key: str, size: int = REQUESTS_PER_FILE) -> None:
    """One folder per chunk holding one JSON-lines file of at most ``size`` requests."""
    chunks = number_chunks(requests, key, size)
    chunks.repartition("chunk").sortWithinPartitions("chunk", key).write.partitionBy("chunk").json(path)


def answer_text(response: Column, default: str = NO_REASONING) -> Column:
    """Answer of a response record; a failed or empty one gives ``default``."""
    content = F.try_element_at(response["body"]["choices"], F.lit(1))["message"]["content"]
    return F.when((response["status_code"] == 200) & (content != ""), content).otherwise(
        F.lit(default)
    )


def read_responses(spark: SparkSession, path: str, default: str = NO_REASONING) -> DataFrame:
    raw = spark.read.schema(RESPONSE_SCHEMA).json(path)
    return raw.select("custom_id", answer_text(F.col("response"), default).alias("text"))


def read_predictions(
    spark: SparkSession, path_glob: str, schema: T.StructType = PREDICTION_SCHEMA
) -> DataFrame:
    """Prediction files named ``model__level.json`` as one table with both columns.

    Conditions without a file are simply absent; see ``operators.compare.complete_grid``.
    """
    raw = spark.read.schema(schema).json(path_glob)
    # The condition is the file's name, or its folder's name when Spark wrote it.
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)__(G\d)(\.json|/)", 1)
    level = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)__(G\d)(\.json|/)", 2)
    return raw.select("*", name.alias("model"), level.alias("level"))


#: Fields of a result record and their types; each may be missing, null or of another type in any record.
RESULT_FIELDS = {
    "index": ("$.index", "bigint"),
    "label": ("$.label", "int"),
    "prediction": ("$.prediction", "int"),
    "ranking": ("$.ranking", "array<int>"),
    "truth_pos": ("$.ground_truth_idx", "int"),
    "total_tokens": ("$.usage.total_tokens", "bigint"),
    "cached": ("$.cached", "boolean"),
}


def read_results(spark: SparkSession, path_glob: str, whole_files: bool = False) -> DataFrame:
    """Result files of any of these shapes as one table, one row per record, with the condition from the file's name.

    A file holds one record per line, or, with ``whole_files``, one JSON document: an array of records or a single one.
    Records with a label and a prediction, and records with a ranking, may stand in one folder. A field that is missing
    or of another type is null; a line or file that is no JSON object is kept as one row with ``is_bad``, so that bad rows
    can be counted and never end the reading.
    """
    raw = spark.read.text(path_glob, wholetext=whole_files)
    where = F.col("_metadata.file_path")
    named = raw.select(
        F.try_parse_json("value").alias("_v"),
        F.regexp_extract(where, r"([^/]+?)__(G\d)(\.json|/)", 1).alias("model"),
        F.regexp_extract(where, r"([^/]+?)__(G\d)(\.json|/)", 2).alias("level"),
    )
    # An array becomes one row per record; anything else is a list of one.
    records = F.coalesce(F.try_variant_get("_v", "$", "array<variant>"), F.array("_v"))
    rows = named.withColumn("_r", F.explode(records))
    shape = F.schema_of_variant("_r")
    bad = ~F.coalesce(shape.startswith("OBJECT"), F.lit(False))
    fields = [F.try_variant_get("_r", at, kind).alias(name) for name, (at, kind) in RESULT_FIELDS.items()]
    return rows.select("model", "level", *fields, bad.alias("is_bad"))


def result_counts(results: DataFrame) -> DataFrame:
    """Per condition: records, records without an answer, bad rows, tokens spent and answers from the ledger."""
    answered = F.col("prediction").isNotNull() | F.col("ranking").isNotNull()
    return results.groupBy("model", "level").agg(
        F.count_if(~F.col("is_bad")).alias("n_total"),
        F.count_if(~F.col("is_bad") & ~answered).alias("n_unanswered"),
        F.count_if("is_bad").alias("n_bad"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.count_if(F.coalesce("cached", F.lit(False))).alias("cached_responses"),
    )

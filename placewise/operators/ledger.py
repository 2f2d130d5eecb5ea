"""Requests against a table of answers: what is pending, what is missing, what repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.texts import content_key


def request_key(model: Column, messages: Column, temperature: Column, max_tokens: Column | None) -> Column:
    """Content key of a request; without ``max_tokens`` it is the older form of the key."""
    fields = [("model", model), ("messages", messages), ("temperature", temperature)]
    if max_tokens is not None:
        fields.append(("max_tokens", max_tokens))
    return content_key(fields)


def pending(requests: DataFrame, answers: DataFrame, key: str = "key") -> DataFrame:
    """Requests whose key has no answer yet."""
    return requests.join(answers.select(key), key, "left_anti")


def answered(
    requests: DataFrame, answers: DataFrame, key: str = "key", older_key: str = "older_key", content: str = "content"
) -> DataFrame:
    """Answer per request: by its key, else a non-empty one by its older key, re-keyed."""
    now = answers.select(F.col(key), F.col(content).alias("_now"), F.lit(True).alias("_found"))
    old = answers.filter(F.col(content) != "").select(F.col(key).alias(older_key), F.col(content).alias("_old"))
    joined = requests.join(now, key, "left").join(old, older_key, "left")
    return joined.filter(F.col("_found").isNotNull() | F.col("_old").isNotNull()).select(
        *requests.columns,
        F.when(F.col("_found"), F.col("_now")).otherwise(F.col("_old")).alias(content),
        F.col("_found").isNull().alias("from_older_key"),
    )


def unique_texts(texts: DataFrame, text: str, namespace: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(keyed, distinct)``: every text with its key, and each key once.

    Results per key go back to all rows by a join on the key.
    """
    prefix = F.lit("".join(f"{n}:" for n in namespace))
    keyed = texts.withColumn("key", F.sha2(F.concat(prefix, F.col(text)), 256))
    return keyed, keyed.groupBy("key").agg(F.min(text).alias(text))


def not_completed(cases: DataFrame, completed: DataFrame, case: str) -> DataFrame:
    """Cases left to do after an earlier, interrupted run."""
    return cases.join(completed.select(case), case, "left_anti")


def collect_answers(
    requests: DataFrame, responses: DataFrame, default: str, key: str = "custom_id"
) -> DataFrame:
    """Every request with its answer text, or the default where none came back."""
    found = responses.select(key, F.col("text").alias("_text"))
    return requests.join(found, key, "left").select(
        *requests.columns,
        F.coalesce("_text", F.lit(default)).alias("text"),
        F.col("_text").isNull().cast("int").alias("is_missing"),
    )


def missing_counts(collected: DataFrame, by: Sequence[str]) -> DataFrame:
    """Requests and missing answers per group."""
    return collected.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_requests"), F.sum("is_missing").cast("long").alias("n_missing")
    )

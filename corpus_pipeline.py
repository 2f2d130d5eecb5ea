"""A corpus pipeline: toxicity, near duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and
rereads it as the next stage's documents, so a lost executor costs at most one stage. All stages but the last return the
columns of ``documents`` as they came:

1. ``toxicity`` drops documents that score 0.3 or more (fitted on the labels outside the held-out fold).
2. ``near_duplicates`` keeps the document with the smallest id of every SimHash component.
3. ``decontamination`` drops documents that hold a benchmark item.
4. ``secrets`` replaces secrets by a mark; every document stays.
5. ``tokens`` encodes the texts and decodes them again: ids, their digests, and whether the text came back.

Nulls, empty texts, ties, repeated rows and empty tables are handled as the operators state it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from placewise.llm.byte_bpe import round_trip
from placewise.llm.common import table
from placewise.llm.decontaminate import drop_leaks
from placewise.llm.secrets import redact_secrets
from placewise.llm.simhash import drop_near_duplicates
from placewise.llm.toxicity import drop_toxic, fit_toxicity
from placewise.session import stage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, radius=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(docs, path, public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: SQL can express neither the stages' models nor their hashes; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

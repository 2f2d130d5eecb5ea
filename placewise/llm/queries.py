"""The queries of the text operators over whole tables, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.session import scratch_path

from .byte_bpe import round_trip
from .common import table
from .cotraining import fit_quality, score_quality
from .decontaminate import find_leaks
from .filter_audit import audit_filters, audit_sql
from .html_text import extract_main_text
from .licenses import scan_licenses, scan_sql
from .packing import digest_packed, pack_tokens, write_packed
from .periodic_runs import collapse_runs, digest_runs, planted_periods, runs_sql
from .quality_rules import apply_quality_rules
from .secrets import scan_secrets
from .sharding import assign_shards
from .simhash import near_duplicates
from .toxicity import fit_toxicity, score_toxicity


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_quality_rules(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), radius=4)


def op5_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    packed = pack_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return digest_packed(write_packed(packed, scratch_path(spark, "packed")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.drop("text_key")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law is equal bytes; a record's slot is its place in its shard."""
    rows = assign_shards(table(spark, sf_dir, "documents"), scratch_path(spark, "slot_map"), shards=40)
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_runs(collapse_runs(planted_periods(table(spark, sf_dir, "documents"))))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_scan": op2_license_scan,
    "op3_html_extraction": op3_html_extraction,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_token_packing": op5_token_packing,
    "op6_decontamination": op6_decontamination,
    "op7_secret_scan": op7_secret_scan,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_toxicity": op10_toxicity,
    "op11_sharding": op11_sharding,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": scan_sql(),
    "op12_periodic_runs": runs_sql(),
    "op13_filter_audit": audit_sql(),
}

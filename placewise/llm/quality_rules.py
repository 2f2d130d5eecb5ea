"""Quality rules with thresholds that follow the data: quantile sketches per language and source.

Native DataFrame operations only. The texts are read once: counts per document are written, and all further steps work
on them. Each (language, source) group of the documents that pass the base rules gets one KLL sketch per measure;
sketches merge, so groups are summed partially before the shuffle and small groups take the merged sketch of their
language, or of the corpus. A document is kept if it passes the base rules and every measure lies within
``fence`` interquartile ranges of its group's quartiles. The thresholds are joined back to the counts.

Defined results: a null text has no words and fails the base rules; null languages and sources are groups like any other;
repeated rows are counted and judged one by one; null ids are carried along; an empty table gives an empty result;
other columns are ignored. Where no document passes the base rules there are no thresholds, and nothing is kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.session import stage

from .common import text_or_empty

# White space and symbols of the counts, the window of repeated words, the base rules.
SPACE = r"[ \t\n\x0B\f\r]+"
NOT_SPACE = r"[^ \t\n\x0B\f\r]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30

#: Measures, whether their low side counts too, and the least interquartile range (a group of equal texts has none).
MEASURES = {
    "word_length": (True, 0.5),
    "symbol_share": (False, 0.02),
    "dup_line_share": (False, 0.1),
    "repeat_share": (False, 0.1),
}
SKETCH_K = 400


def _covered(positions: str) -> Column:
    """Words covered by windows of ``WINDOW`` words that start at these sorted positions."""
    n = F.size(positions)
    gaps = F.zip_with(
        F.slice(positions, F.lit(1), n - 1),
        F.slice(positions, F.lit(2), n - 1),
        lambda a, b: F.least(b - a, F.lit(WINDOW)),
    )
    return F.when(n > 0, F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap)).otherwise(F.lit(0))


def count_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words; drops the text.

    The steps stand in separate selections, so that arrays are made once and not for every use. Repeated windows are looked
    for by a 64-bit hash of their words; the sort runs only for texts that have any.
    """
    kept = [c for c in docs.columns if c != text]
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(NOT_SPACE))
    split = docs.withColumn("_text", text_or_empty(text)).select(
        *kept,
        F.array_remove(F.split("_text", SPACE), "").alias("_words"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    starts = F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i, F.lit(WINDOW))))
    hashed = split.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_words") >= WINDOW, hashes).otherwise(F.array().cast("array<long>")).alias("_hashes"),
    )
    counts = [*kept, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    placed = F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = hashed.select(*counts, F.when(repeats, F.sort_array(placed)).alias("_placed"))
    size = F.size("_placed")
    twice = F.filter(
        "_placed",
        lambda x, i: ((i > 0) & (F.get("_placed", i - 1)["h"] == x["h"]))
        | ((i < size - 1) & (F.get("_placed", i + 1)["h"] == x["h"])),
    )
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    found = ordered.select(*counts, F.when(F.col("_placed").isNotNull(), starts).alias("_starts"))
    covered = F.when(F.col("_starts").isNotNull(), _covered("_starts")).otherwise(F.lit(0))
    return found.select(*counts, covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _measures() -> dict[str, Column]:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {
        "word_length": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / words,
    }


def _bounds(sketch: str, measure: str, fence: float) -> tuple[Column, Column]:
    two_sided, least = MEASURES[measure]
    low, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
    spread = F.lit(fence) * F.greatest(high - low, F.lit(least))
    return (low - spread if two_sided else F.lit(float("-inf"))), high + spread


def _binary(value: bytes | None) -> Column:
    return F.lit(None).cast("binary") if value is None else F.lit(bytearray(value))


def group_thresholds(counts: DataFrame, fence: float, least_group: int) -> DataFrame:
    """(lang, source, low and high per measure) of every group of ``counts``."""
    measured = counts.select("lang", "source", base_failed().alias("failed"), *(m.alias(n) for n, m in _measures().items()))
    passed = F.when(~F.col("failed"), 1)
    groups = stage(
        measured.groupBy("lang", "source").agg(
            F.count(passed).alias("n"),
            *(F.kll_sketch_agg_double(F.when(~F.col("failed"), F.col(m)), F.lit(SKETCH_K)).alias(m) for m in MEASURES),
        ),
        "sketches",
    )

    def merged(frame: DataFrame) -> DataFrame:
        sketches = (F.kll_merge_agg_double(m, F.lit(SKETCH_K)).alias(f"{m}_merged") for m in MEASURES)
        return frame.agg(F.sum("n").alias("n_merged"), *sketches)

    # Groups of too few documents take the merged sketch of their language, or of the corpus (one row of a few kilobytes).
    filled = groups.where("n > 0")
    by_language = merged(filled.groupBy(F.col("lang").alias("_lang")))
    corpus = merged(filled).first().asDict()
    if not corpus["n_merged"]:
        corpus = dict.fromkeys(corpus)  # no document passed: no thresholds
    joined = groups.join(by_language, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    own, language = F.col("n") >= least_group, F.coalesce(F.col("n_merged") >= least_group, F.lit(False))
    found = joined.select(
        "lang",
        "source",
        *(
            F.when(own, F.col(m)).when(language, F.col(f"{m}_merged")).otherwise(_binary(corpus[f"{m}_merged"])).alias(m)
            for m in MEASURES
        ),
    )
    limits = [
        bound.alias(f"{side}_{m}") for m in MEASURES for side, bound in zip(("low", "high"), _bounds(m, m, fence), strict=True)
    ]
    return found.select("lang", "source", *limits)


def apply_quality_rules(
    docs: DataFrame,
    fence: float = 3.0,
    least_group: int = 100,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """One row per document: the counts, base_failed, kept, and the measures that left their group's range."""
    named = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(lang).alias("lang"),
        F.col(source).alias("source"),
        F.col(text).alias("text"),
    )
    counts = stage(count_columns(named), "counts")
    limits = group_thresholds(counts, fence, least_group).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    joined = counts.join(limits, same, "left")
    outside = [
        F.when(~value.between(F.col(f"low_{m}"), F.col(f"high_{m}")), F.lit(m)) for m, value in _measures().items()
    ]
    left = F.array_compact(F.array(*outside))
    known = reduce(lambda a, b: a & b, (F.col(f"high_{m}").isNotNull() for m in MEASURES))
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & known & (F.size(left) == 0)).alias("kept"),
        left.alias("outside"),
    )

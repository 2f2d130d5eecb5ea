"""Reading structure out of free-text answers with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import ColumnLike, as_col
from .texts import strip

# Fixed value: duration assumed when an answer holds no number.
DEFAULT_MINUTES = 15.0


def _in_range(numbers: Column, n: int) -> Column:
    return F.filter(numbers, lambda x: (x >= 1) & (x <= n))


def _zero_based(numbers: Column) -> Column:
    return F.transform(numbers, lambda x: (x - 1).cast("int"))


def _numbers(text: Column) -> Column:
    """All digit runs as whole numbers; runs too long for a BIGINT drop out."""
    found = F.regexp_extract_all(text, F.lit(r"\b(\d+)\b"), F.lit(1))
    return F.filter(F.transform(found, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def parse_ranking(answer: ColumnLike, n_candidates: int) -> Column:
    """Zero-based candidate order from an answer, NULL when there is none.

    Three readings, in order: the whole text is a JSON list of whole numbers;
    a bracketed number list stands somewhere in the text; any whole numbers,
    first mention only. Numbers outside 1..n are dropped; only the last
    reading removes repeats and rejects an empty outcome.
    """
    text = strip(answer)
    whole_list = F.when(
        text.rlike(r"^\[\s*(-?\d+(\s*,\s*-?\d+)*)?\s*\]$"), F.from_json(text, "array<bigint>")
    )
    bracket = F.regexp_extract(text, r"(\[[\d,\s]+\])", 1)
    inner_list = F.when(
        bracket.rlike(r"^\[\s*\d+(\s*,\s*\d+)*\s*\]$"), F.from_json(bracket, "array<bigint>")
    )
    loose = F.array_distinct(_in_range(_numbers(text), n_candidates))
    loose = F.when(F.size(loose) > 0, loose)
    return _zero_based(
        F.coalesce(
            _in_range(whole_list, n_candidates), _in_range(inner_list, n_candidates), loose
        )
    )


def parse_star(answer: ColumnLike) -> Column:
    """First stand-alone digit 1..5, else NULL."""
    found = F.regexp_extract(strip(answer), r"\b([1-5])\b", 1)
    return F.when(found != "", found.cast("int"))


def parse_yes_no(answer: ColumnLike) -> Column:
    """1 for an answer starting with yes, 0 for no, else NULL."""
    text = F.lower(strip(answer))
    return F.when(text.startswith("yes"), F.lit(1)).when(text.startswith("no"), F.lit(0))


def parse_minutes(answer: ColumnLike, default: float = DEFAULT_MINUTES) -> Column:
    """First number in the answer, else ``default``."""
    found = F.regexp_extract(as_col(answer), r"([\d.]+)", 1)
    return F.coalesce(found.try_cast("double"), F.lit(default))

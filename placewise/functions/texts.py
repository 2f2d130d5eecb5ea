"""List-valued text, titles, names and content keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import ColumnLike, as_col

UNKNOWN = "unknown"

# The day names in week order.
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def strip(text: ColumnLike) -> Column:
    """The text without white space of any kind at both ends."""
    return F.regexp_replace(as_col(text), r"(?U)^\s+|\s+$", "")


def split_list(text: ColumnLike, separator: str = ",") -> Column:
    """Split, trim and drop empty entries; NULL text gives an empty list."""
    parts = F.split(F.coalesce(as_col(text), F.lit("")), separator)
    return F.filter(F.transform(parts, strip), lambda x: x != F.lit(""))


def split_set(text: ColumnLike, separator: str = ",") -> Column:
    """Like :func:`split_list` without repeats."""
    return F.array_distinct(split_list(text, separator))


def overlap_share(a: Column, b: Column) -> Column:
    """Share of set ``a`` found in set ``b``; 0 for an empty ``a``."""
    return F.coalesce(
        F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a).cast("double")),
        F.lit(0.0),
    )


def category_title(category: ColumnLike) -> Column:
    """``fast_food`` -> ``Fast Food``; ``unknown`` -> ``Unknown Venue``."""
    c = as_col(category)
    return F.when(c == UNKNOWN, F.lit("Unknown Venue")).otherwise(
        F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
    )


def day_name(dow: ColumnLike) -> Column:
    """Name of a Monday-based day number."""
    names = F.array(*[F.lit(n) for n in DAY_NAMES])
    return F.coalesce(F.try_element_at(names, as_col(dow).cast("int") + 1), F.lit("Unknown"))


def content_key(fields: Sequence[tuple[str, Column]]) -> Column:
    """SHA-256 over a canonical JSON document with sorted field names."""
    document = F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields, key=lambda f: f[0])]))
    return F.sha2(document, 256)


def numbered_lines(items: Column, render) -> Column:
    """``  1. ...`` lines joined by line breaks; ``render`` maps an element to text."""
    lines = F.transform(
        items,
        lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), render(x)),
    )
    return F.array_join(lines, "\n")


def sections(*parts: Column, separator: str = "\n\n") -> Column:
    """Join the parts that are present; NULL parts vanish with their separator."""
    return F.concat_ws(separator, *parts)

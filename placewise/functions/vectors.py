"""Element-wise arithmetic on embedding arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def product(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def pair_vector(a: Column, b: Column, extra: Column) -> Column:
    """``[a, b, a-b, a*b, extra]`` as one array of 4*d + len(extra) numbers."""
    return F.concat(a, b, difference(a, b), product(a, b), extra)


def item_vector(a: Column, extra: Column) -> Column:
    """``[a, extra]``: one reasoning embedding followed by the compact summary."""
    return F.concat(a, extra)

"""Rounding, safe arithmetic and reproducible hash draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

HASH_SPACE = 2**32


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_to(c: ColumnLike, places: int) -> Column:
    """Round half up at ``places`` decimals, the same way on every engine.

    The small nudge absorbs differences in summation order, which would
    otherwise flip values that sit on a rounding border.
    """
    scale = float(10**places)
    return F.floor(as_col(c) * F.lit(scale) + F.lit(0.5 + 1e-6)) / F.lit(scale)


def fixed(c: ColumnLike, places: int) -> Column:
    """Decimal text with exactly ``places`` digits after the point."""
    if places == 0:
        return F.floor(as_col(c) + F.lit(0.5 + 1e-6)).cast("string")
    return F.format_string(f"%.{places}f", round_to(c, places))


def thousands(c: ColumnLike) -> Column:
    """Integer text with thousands separators."""
    return F.format_number(as_col(c).cast("long"), 0)


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, 0.0 elsewhere (also where it is NULL)."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def ratio_or_zero(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """``numerator / denominator``, 0.0 when the denominator is 0 or NULL."""
    num, den = as_col(numerator).cast("double"), as_col(denominator).cast("double")
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def floored_ratio(numerator: ColumnLike, denominator: ColumnLike, floor: float = 0.01) -> Column:
    """``numerator / max(denominator, floor)``."""
    return as_col(numerator) / F.greatest(as_col(denominator), F.lit(floor))


def finite_or_zero(c: ColumnLike, infinite: float = 0.0) -> Column:
    """NULL and NaN become 0; +/-infinity becomes ``+/-infinite``."""
    x = as_col(c).cast("double")
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(0.0))
        .when(x == F.lit(float("inf")), F.lit(infinite))
        .when(x == F.lit(float("-inf")), F.lit(-infinite))
        .otherwise(x)
    )


def star_prediction(c: ColumnLike) -> Column:
    """Nearest whole star in 1..5, halves to the even star."""
    return F.least(F.greatest(F.bround(as_col(c)), F.lit(1.0)), F.lit(5.0)).cast("int")


def hash_key(seed: str, *parts: ColumnLike) -> Column:
    """Hex text that orders rows in a reproducible shuffle."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[as_col(p).cast("string") for p in parts]))


def hash_draw(seed: str, *parts: ColumnLike) -> Column:
    """Reproducible whole number in ``[0, 2**32)``."""
    return F.conv(F.substring(hash_key(seed, *parts), 1, 8), 16, 10).cast("long")


def hash_unit(seed: str, *parts: ColumnLike) -> Column:
    """Reproducible number in ``[0, 1)``."""
    return hash_draw(seed, *parts) / F.lit(float(HASH_SPACE))


#: Rounds of a keyed permutation, and steps of its walk back into range (it leaves with probability under a half).
PERMUTATION_ROUNDS, PERMUTATION_WALK = 6, 64
#: Least bits of its range: smaller halves would not mix. A walk in 2**6 numbers ends within 64 steps.
PERMUTATION_BITS = 6


def permutation_keys(seed: str, *parts: ColumnLike) -> Column:
    """Round keys of the permutation that belongs to a case."""
    digests = F.concat(hash_key(seed, *parts), hash_key(f"{seed}+", *parts))
    words = (F.conv(F.substring(digests, 8 * i + 1, 8), 16, 10).cast("long") for i in range(PERMUTATION_ROUNDS))
    return F.array(*words)


def permuted(index: ColumnLike, size: ColumnLike, keys: ColumnLike) -> Column:
    """Where a keyed permutation of ``0 .. size - 1`` sends ``index``; ``size`` is below 2**60.

    A Feistel network over the smallest power of two (64 at least) that holds ``size`` numbers, walked along its cycle until
    it is back in range. Different keys give unrelated permutations, so the first m places of a case are m draws without replacement,
    independent of those of any other case.
    """
    size, start, keys = as_col(size).cast("long"), as_col(index).cast("long"), as_col(keys)
    bits = F.greatest(F.length(F.bin(size - 1)), F.lit(PERMUTATION_BITS))
    high, low = (F.pow(F.lit(2.0), half).cast("long") for half in (F.floor(bits / 2), F.ceil(bits / 2)))

    def turn(state: Column, key: Column) -> Column:
        mixed = (state["right"] + key) % F.lit(1 << 31) * F.lit(1597334677) % F.lit(1 << 31)
        # The middle of a square follows all bits of its root.
        square = F.shiftright(mixed * mixed, 20) % state["wide"]
        return F.struct(
            state["right"].alias("left"), state["left"].bitwiseXOR(square).alias("right"),
            state["narrow"].alias("wide"), state["wide"].alias("narrow"),
        )

    def once(x: Column) -> Column:
        right = x % low
        left = ((x - right) / low).cast("long")  # exact: the difference ends in zeros
        parts = F.struct(left.alias("left"), right.alias("right"), high.alias("wide"), low.alias("narrow"))
        return F.aggregate(keys, parts, turn, lambda s: s["left"] * low + s["right"])

    walk = F.sequence(F.lit(2), F.lit(PERMUTATION_WALK))
    return F.aggregate(walk, once(start), lambda x, _: F.when(x >= size, once(x)).otherwise(x))

"""Numeric and text expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BINS_PER_E_FOLD = 8192
_BIN_OFFSET = 8_000_000  # above 8192 * |ln(smallest double)|, keeps positive bins positive


def round_half_even(value: Column, digits: int) -> Column:
    """Half-even rounding of the scaled binary value, as numpy does it."""
    scale = float(10 ** digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def missing_to_null(value: Column) -> Column:
    """NaN becomes NULL, so that aggregates skip it."""
    return F.when(~F.isnan(value), value)


def trim_all(text: Column) -> Column:
    """Strip all Unicode white space; SQL ``trim`` strips spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def coerce_numeric(text: Column) -> Column:
    """Text to double; whatever is not a plain decimal number becomes NULL.

    Spark's cast also takes Java forms (``1.0d``, ``2f``, ``0x1p3``). They carry a
    letter no decimal number has, except in ``inf`` / ``infinity``.
    """
    text = trim_all(text.cast("string"))
    java_only = text.rlike("(?i)[xdf]") & ~text.rlike("(?i)inf")
    return F.when(~java_only, missing_to_null(text.try_cast("double")))


def normalize_code(value: Column, strict: bool = True) -> Column:
    """Integer code as unpadded text. ``strict`` raises on a bad or missing code."""
    text = trim_all(value.cast("string"))
    whole = F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))
    code = whole.cast("string")
    if not strict:
        return code
    message = F.concat(F.lit("not an integer code: "), F.coalesce(text, F.lit("NULL")))
    return F.when(whole.isNull(), F.raise_error(message).cast("string")).otherwise(code)


def order_bin(value: Column) -> Column:
    """Order-preserving bin of a double: a <= b implies order_bin(a) <= order_bin(b).

    Logarithmic bins, each about 1/8192 of its value wide, so any set of doubles
    meets a bounded number of bins. Every step (ln, scaling, floor) is monotone, hence
    ranks computed per bin and then within one bin are exact.
    """
    size = F.least(F.abs(value), F.lit(1.7e308))
    level = (F.floor(F.log(size) * F.lit(float(_BINS_PER_E_FOLD))).cast("bigint")
             + F.lit(_BIN_OFFSET))
    # coalesce only tells the optimiser that a bin is never null.
    return F.coalesce(F.when(value > 0, level).when(value < 0, -level),
                      F.lit(0).cast("bigint"))

"""Number formatting and rounding with the behaviour of exact binary values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fixed(value: Column, digits: int) -> Column:
    """``%.<digits>f`` text, rounded half-even on the exact binary value.

    Where the text needs more than 17 significant digits, the digits are those of the shortest decimal form.
    """
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def round_binary(value: Column, digits: int) -> Column:
    """Round a double the way its exact binary value rounds."""
    return fixed(value, digits).cast("double")


def round_scaled(value: Column, digits: int) -> Column:
    """Scale, round half to even, scale back: the rounding of array libraries."""
    return F.rint(value * 10 ** digits) / 10 ** digits

"""Numbers as the table tools read and round them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 3) -> Column:
    """Rounds halves towards positive infinity, in doubles."""
    k = float(10**digits)
    return F.floor(x.cast("double") * k + 0.5).cast("double") / k


#: How numbers are written: decimal, with an exponent, or without an end.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?Infinity$"


def is_number(text: Column) -> Column:
    """Whether a cell reads as a number: decimal, exponent or hexadecimal; blank cells don't."""
    t = F.trim(text)
    return t.rlike(NUMBER) | t.rlike("^0[xX][0-9a-fA-F]+$")


def number(text: Column) -> Column:
    """A cell's value; blank is 0, hexadecimal is understood, null where it isn't a number."""
    t = F.trim(text)
    hexa = F.conv(F.regexp_extract(t, "^0[xX]([0-9a-fA-F]+)$", 1), 16, 10).cast("double")
    value = F.when(t.rlike("^0[xX]"), hexa).when(t.rlike(NUMBER), t.try_cast("double"))
    return F.when(t == "", F.lit(0.0)).otherwise(value)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def safe_share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """part / whole, or ``empty`` where the whole is 0."""
    return F.when(whole == 0, F.lit(empty)).otherwise(part.cast("double") / whole)

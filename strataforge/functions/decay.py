"""Recency and intent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataforge.functions.numbers import clamp01

HALF_LIFE_DAYS = 14.0


def age_decay(age: Column, half_life: float, most: float) -> Column:
    """Halves every half_life; 0 for ages below 0 or above ``most``."""
    return F.when((age < 0) | (age > most), F.lit(0.0)).otherwise(F.pow(F.lit(0.5), age / half_life))


def recency(days: Column) -> Column:
    return F.when(days.isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(0.5), F.greatest(days, F.lit(0.0)) / HALF_LIFE_DAYS))


def intent(opened: Column, pulled: Column, edited: Column, days: Column) -> Column:
    return clamp01(0.25 * F.log1p(opened) + 0.5 * F.log1p(pulled) + 0.7 * F.log1p(edited) + 0.3 * recency(days))

"""Whole numbers that stop at their limits, or tell that they would pass them, where plain ones raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest whole number of 64 bits; counts are never below zero.
MOST = (1 << 63) - 1


def saturating_add(a: Column, b: Column) -> Column:
    """The sum of two counts, or the largest number if it would be larger; null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_add(a.cast("long"), b.cast("long")), F.lit(MOST)))


def saturating_sub(a: Column, b: Column) -> Column:
    """The difference of two counts, or 0 if it would be less."""
    return F.greatest(a - b, F.when(a.isNotNull() & b.isNotNull(), F.lit(0)).cast("long"))


def checked_add(a: Column, b: Column) -> Column:
    """The sum of two counts, or null if it passes the largest number."""
    return F.try_add(a.cast("long"), b.cast("long"))


def saturating_sum(value: Column) -> Column:
    """The sum of counts in a group, or the largest number if it would be larger; sums are taken in decimals of 38 digits. Null without values."""
    total = F.sum(value.cast("decimal(28,0)"))
    return F.when(total.isNotNull(), F.least(total, F.lit(MOST))).cast("long")

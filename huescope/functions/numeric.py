"""Rounding and median rules shared by every stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column, places: int) -> Column:
    """Round the exact binary value of a double half-to-even.

    ``round`` and ``bround`` first turn the double into a short decimal and so
    round 81.25 or 1.005 differently; ``format_number`` works on the exact
    binary value.
    """
    pattern = "0." + "0" * places
    return F.call_function("format_number", value, F.lit(pattern)).cast("double")


def upper_median(column: str) -> Column:
    """Aggregate: the element at index n // 2 of the ascending values.

    Reading the discrete median from the descending side picks the upper of
    the two middle values. The buffer counts distinct values, so for ratios
    (2 places) and rates (1 place) it is bounded whatever the group size.
    """
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)")


def exact_mean(value: Column, places: int) -> Column:
    """Aggregate: mean of values already rounded to ``places`` decimals.

    The sum runs over integers, so the result does not depend on the order in
    which partial aggregates meet.
    """
    scale = 10**places
    total = F.sum(F.rint(value * F.lit(float(scale))).cast("bigint"))
    return total / F.lit(float(scale)) / F.count(value)


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100 rounded to one place, NULL for an empty whole."""
    ratio = part.cast("double") / F.when(whole != 0, whole.cast("double"))
    return round_half_even(ratio * F.lit(100.0), 1)

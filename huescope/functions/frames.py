"""Small helpers on whole frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, kept: list[Column], computed: dict[str, Column]) -> DataFrame:
    """Select ``kept`` plus expensive columns that later filters do not repeat.

    The optimizer pushes a filter on a computed column below its projection and
    so evaluates the expression again for every use in the filter. Passing the
    columns through a one-element ``inline`` keeps the filter above.
    """
    row = F.struct(*[c.alias(n) for n, c in computed.items()])
    return df.select(*kept, F.inline(F.array(row)))

"""Column helpers that keep generated code small."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Evaluate ``columns`` once and refer to them by name afterwards.

    The optimizer merges stacked projections by copying expressions into each other; an ``inline`` of a one-row array is a
    boundary it does not merge across, so long formulas stay linear in size.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))

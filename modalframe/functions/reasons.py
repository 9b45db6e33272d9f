"""Reason lists built from (condition, text) rules."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reason_array(*rules: tuple[Column, object]) -> Column:
    """The texts whose condition holds, in rule order."""
    items = [F.when(cond, text if isinstance(text, Column) else F.lit(text)) for cond, text in rules]
    return F.array_compact(F.array(*items))


def first_reason(*rules: tuple[Column, object]) -> Column:
    """The first text whose condition holds, else NULL."""
    return F.coalesce(*[F.when(cond, text if isinstance(text, Column) else F.lit(text)) for cond, text in rules],
                      F.lit(None).cast("string"))


def joined(array: Column) -> Column:
    return F.concat_ws(";", array)

"""Order-dependent operators that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(x)`` sorts a whole key in one task. Here the order axis is cut into bins first:
the window runs inside (key, bin), the bins themselves are summarised by an ordinary aggregate, and only that small
summary is ordered per key.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_bin(col: Column, width: float = 0.01) -> Column:
    """A bin along a positive axis; the number of bins is bounded by the axis range, not by the rows."""
    return F.floor(F.log(F.greatest(col, F.lit(1e-12))) / F.lit(width))


def with_order(df: DataFrame, keys: list[str], axis: Column, order: list[str], *, rank: str | None = None,
               previous: dict[str, str] | None = None, following: dict[str, str] | None = None) -> DataFrame:
    """Add a global 1-based rank and/or the previous / following row's columns along ``order`` within ``keys``.

    ``axis`` must be non-decreasing along ``order`` (its first column in practice). Rows where it is NULL come first.
    """
    df = df.withColumn("_bin", axis)
    part = Window.partitionBy(*keys, "_bin").orderBy(*order)
    whole = Window.partitionBy(*keys, "_bin")
    key_struct = F.struct(*order)
    summary_aggs = [F.count(F.lit(1)).alias("_n")]
    out = df
    if rank:
        out = out.withColumn("_rn", F.row_number().over(part))
    for name, src in (previous or {}).items():
        out = out.withColumn(name, F.lag(src).over(part)).withColumn(f"_f_{name}", F.row_number().over(part) == 1)
        summary_aggs.append(F.max_by(src, key_struct).alias(f"_s_{name}"))
    for name, src in (following or {}).items():
        out = out.withColumn(name, F.lead(src).over(part)).withColumn(
            f"_f_{name}", F.row_number().over(part) == F.count(F.lit(1)).over(whole))
        summary_aggs.append(F.min_by(src, key_struct).alias(f"_s_{name}"))
    bins = Window.partitionBy(*keys).orderBy("_bin")
    summary = df.groupBy(*keys, "_bin").agg(*summary_aggs)
    picks = [F.coalesce(F.sum("_n").over(bins.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")]
    picks += [F.lag(f"_s_{n}").over(bins).alias(f"_x_{n}") for n in (previous or {})]
    picks += [F.lead(f"_s_{n}").over(bins).alias(f"_x_{n}") for n in (following or {})]
    summary = summary.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bin").alias("_kbin"), *picks)
    cond = F.col("_bin").eqNullSafe(F.col("_kbin"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = out.join(summary, cond)
    drop = ["_bin", "_kbin", "_before", *[f"_k_{k}" for k in keys]]
    if rank:
        out = out.withColumn(rank, F.col("_rn") + F.col("_before"))
        drop.append("_rn")
    for name in [*(previous or {}), *(following or {})]:
        out = out.withColumn(name, F.when(F.col(f"_f_{name}"), F.col(f"_x_{name}")).otherwise(F.col(name)))
        drop += [f"_f_{name}", f"_x_{name}"]
    return out.drop(*drop)


def running_sum(df: DataFrame, keys: list[str], axis: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` along ``order`` within ``keys``: a bin-local sum plus the bin's offset."""
    marked = df.withColumn("_bin", axis).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    bins = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (marked.groupBy(*keys, "_bin").agg(F.sum("_value").alias("_total"))
               .withColumn("_before", F.coalesce(F.sum("_total").over(bins), F.lit(0)))
               .select(*keys, "_bin", "_before"))
    return (marked.withColumn("_run", F.sum("_value").over(inside)).join(offsets, [*keys, "_bin"])
            .withColumn(name, F.col("_run") + F.col("_before")).drop("_run", "_before", "_bin", "_value"))


def islands(df: DataFrame, keys: list[str], axis: Column, order: list[str], starts: Column, name: str,
            previous: dict[str, str]) -> DataFrame:
    """Gaps-and-islands: number the islands; ``starts`` marks a row that opens one (it may use ``previous`` columns)."""
    marked = with_order(df, keys, axis, order, previous=previous)
    return running_sum(marked, keys, axis, order, starts.cast("int"), name)


def top_rows(df: DataFrame, keys: list[str], order: list, k: int = 1, name: str = "_rank") -> DataFrame:
    """The k best rows per key. Spark limits each window group before the shuffle, so a hot key stays cheap."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return ranked.drop(name) if name == "_rank" else ranked

"""Repeated coverage experiments: how often do the intervals that a procedure reports hold the truth?

A repetition draws data from a known truth, estimates, draws realisations around the estimate, reports an interval and is counted.
All repetitions of all keys are rows of one plan; numbers come from digests of their identity, so a repetition is the same
whatever the partitioning, the attempt of a task or the engine.
"""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modalframe.session import dealt


def digest_uniform(*parts: Column) -> Column:
    """A number in (0, 1) with 52 bits of the MD5 of the parts, joined by '|'."""
    head = F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13), 16, 10)
    return (head.cast("double") + 0.5) / float(2**52)


def digest_normal(*parts: Column) -> Column:
    """A standard normal number from two digests of the parts (Box and Muller)."""
    return F.sqrt(-2 * F.log(digest_uniform(F.lit("r"), *parts))) * F.cos(2 * math.pi * digest_uniform(F.lit("t"), *parts))


def line_truth(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``keys, n, level, slope, se_level, se_slope`` of the line through each key's rows, the level taken at the mean of x.

    Standard errors use the residual deviation (n - 2). Rows with a NULL x or y are left out; fewer than three rows, or one x
    only, leave the errors NULL."""
    ok = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    g = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("level"), F.var_pop("_x").alias("_vx"), F.var_pop("_y").alias("_vy"), F.covar_pop("_x", "_y").alias("_c"))
    g = g.withColumn("slope", F.try_divide("_c", "_vx"))
    s2 = F.when((F.col("n") > 2) & (F.col("_vx") > 0), F.greatest(F.col("n") * (F.col("_vy") - F.col("slope") * F.col("_c")), F.lit(0.0)) / F.when(F.col("n") > 2, F.col("n") - 2))
    return g.withColumn("se_level", F.sqrt(s2 / F.col("n"))).withColumn("se_slope", F.sqrt(F.try_divide(s2, F.col("n") * F.col("_vx")))).drop("_vx", "_vy", "_c")


def line_experiment(keys: list[str], realisations: int = 200, seed: int = 1, widen: float = 1.0) -> Callable[[DataFrame], DataFrame]:
    """An experiment for `repeated_coverage` over `line_truth` rows: percentile intervals of level and slope.

    Level and slope of a line depend on the noise only through two independent normals, so a realisation draws two numbers
    whatever the number of rows. ``widen`` scales the reported spread against the true one (1: honest intervals)."""
    if realisations < 2:
        raise ValueError("at least two realisations are needed for an interval")

    def experiment(reps: DataFrame) -> DataFrame:
        names = F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).alias("truth"), F.col(f"se_{p}").alias("se")) for p in ("level", "slope")])
        d = reps.select(*keys, "rep", F.explode(names).alias("p")).select(*keys, "rep", "p.*")
        who = [F.lit(seed), *[F.col(k) for k in keys], F.col("rep"), F.col("parameter")]
        d = d.withColumn("_est", F.col("truth") + F.col("se") * digest_normal(*who, F.lit(0)))
        # The values of a repetition rise with their normals, so the sorted normals of one row give the percentiles.
        d = d.withColumn("_z", F.sort_array(F.transform(F.sequence(F.lit(1), F.lit(realisations)), lambda m: digest_normal(*who, m))))

        def percentile(p: float) -> Column:
            at = p * (realisations - 1)
            low, high = math.floor(at), math.ceil(at)
            value = lambda i: F.col("_est") + widen * F.col("se") * F.get("_z", F.lit(i))
            return value(low) if low == high else (high - at) * value(low) + (at - low) * value(high)

        return d.select(*keys, "rep", "parameter", "truth", percentile(0.025).alias("low"), percentile(0.975).alias("high"))

    return experiment


def repeated_coverage(truths: DataFrame, keys: list[str], experiment: Callable[[DataFrame], DataFrame], parameters: list[str],
                      repetitions: int = 100, target: float = 0.95, tolerance: float = 0.10) -> DataFrame:
    """``keys, parameter, n_ok, n_failed, n_covered, coverage, passed``: empirical coverage of an experiment's intervals.

    ``experiment`` maps the truth rows times ``rep`` (1 .. repetitions) to keys, rep, parameter, truth, low, high. A repetition
    counts only if it gives finite bounds for every one of ``parameters``; any other fails as a whole. Coverage is 0 where none
    counts. ``passed`` holds for a key if some repetition counts and every parameter is within ``tolerance`` of ``target``.
    Keys must be unique and not NULL; without truth rows there is no row."""
    if repetitions < 1 or not 0 < target < 1 or not 0 <= tolerance < 1 or not parameters:
        raise ValueError("repetitions, target, tolerance or parameters out of range")
    reps = dealt(truths.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repetitions)))), *keys, "rep")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = experiment(reps).filter(F.col("parameter").isin(parameters)).withColumn("_ok", finite("truth") & finite("low") & finite("high"))
    held = lambda p: F.max((F.col("_ok") & (F.col("parameter") == p) & F.col("truth").between(F.col("low"), F.col("high"))).cast("int"))
    per = rows.groupBy(*keys, "rep").agg(F.count_distinct(F.when(F.col("_ok"), F.col("parameter"))).alias("_n"), *[held(p).alias(f"_h{i}") for i, p in enumerate(parameters)])
    full = F.col("_n") == len(parameters)
    g = per.groupBy(*keys).agg(F.sum(full.cast("long")).alias("n_ok"), *[F.sum(F.when(full, F.col(f"_h{i}")).otherwise(0)).alias(f"_h{i}") for i in range(len(parameters))])
    g = truths.select(*keys).join(g, keys, "left").withColumn("n_ok", F.coalesce("n_ok", F.lit(0)))
    out = g.select(*keys, "n_ok", (F.lit(repetitions) - F.col("n_ok")).alias("n_failed"), F.explode(F.array(*[
        F.struct(F.lit(p).alias("parameter"), F.coalesce(f"_h{i}", F.lit(0)).alias("n_covered")) for i, p in enumerate(parameters)])).alias("c"),
        *[(F.abs(F.coalesce(F.try_divide(F.coalesce(f"_h{i}", F.lit(0)), "n_ok"), F.lit(0.0)) - target) <= tolerance).alias(f"_w{i}") for i in range(len(parameters))])
    every = F.col("n_ok") > 0
    for i in range(len(parameters)):
        every = every & F.col(f"_w{i}")
    return out.select(*keys, "c.parameter", "n_ok", "n_failed", "c.n_covered", F.coalesce(F.try_divide("c.n_covered", "n_ok"), F.lit(0.0)).alias("coverage"), every.alias("passed"))

"""Candidate pairs of computed and measured modes, their gates, labels and summaries."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modalframe.functions.reasons import reason_array
from modalframe.operators.ordered import log_bin, running_sum, top_rows, with_order


@dataclass(frozen=True)
class ComparatorPolicy:
    """Gates of the mode comparator (fixed values)."""

    max_error_percent: float = 15.0
    min_mac: float = 0.50
    max_frequency_only_percent: float = 10.0
    mac_weight: float = 0.75
    frequency_weight: float = 0.25
    unmatched_cost: float = 1.15


def frequency_error_percent(fe: Column, exp: Column) -> Column:
    """Signed error in percent; positive when the model is higher. NULL without a usable reference."""
    return (fe - exp) / F.when(F.abs(exp) > 1e-30, F.abs(exp)) * F.lit(100.0)


def pair_status(mac: Column, error: Column) -> Column:
    e = F.abs(error)
    return (F.when(mac.isNull(), F.when(e <= 5, "Frequency match").when(e <= 10, "Check frequency")
                   .otherwise("Large frequency difference"))
            .when((mac >= 0.90) & (e <= 5), "Excellent match")
            .when((mac >= 0.80) & (e <= 10), "Good match")
            .when((mac >= 0.60) & (e <= 15), "Review").otherwise("Poor match"))


def pair_cost(mac: Column, error: Column, policy: ComparatorPolicy = ComparatorPolicy()) -> Column:
    return (F.lit(policy.mac_weight) * (F.lit(1.0) - F.coalesce(mac, F.lit(0.0)))
            + F.lit(policy.frequency_weight) * F.least(F.abs(error) / 20, F.lit(5.0)))


def sides(modes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The FE and EXP halves of a mode table with side-specific names."""
    fe = modes.filter(F.col("role") == "FE").select("cmp_id", F.col("mode_no").alias("fe_mode"),
                                                    F.col("frequency_hz").alias("fe_hz"))
    exp = modes.filter(F.col("role") == "EXP").select("cmp_id", F.col("mode_no").alias("exp_mode"),
                                                      F.col("frequency_hz").alias("exp_hz"))
    return fe, exp


def frequency_window_pairs(modes: DataFrame, window: float = 0.15) -> DataFrame:
    """Range join |f_FE - f_EXP| / f_EXP <= window as an equi-join on logarithmic frequency bins.

    A bin is as wide as the window in ln f, so a partner lies in the same or a neighbouring bin; the exact predicate
    decides. The hash key is (comparison, bin), so one large comparison spreads over its bins.
    """
    if not 0 < window < 1:
        raise ValueError("the relative window must lie between 0 and 1")
    width = max(math.log1p(window), -math.log1p(-window)) * (1 + 1e-9)
    fe, exp = sides(modes)
    fe = fe.filter(F.col("fe_hz") > 0).withColumn("_b", log_bin(F.col("fe_hz"), width))
    fe = fe.withColumn("_bin", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1))).drop("_b")
    exp = exp.filter(F.col("exp_hz") > 0).withColumn("_bin", log_bin(F.col("exp_hz"), width))
    return (exp.join(fe, ["cmp_id", "_bin"])
            .filter(F.abs(F.col("fe_hz") - F.col("exp_hz")) <= F.lit(window) * F.col("exp_hz"))
            .drop("_bin").withColumn("err", frequency_error_percent(F.col("fe_hz"), F.col("exp_hz"))))


def all_pairs(modes: DataFrame) -> DataFrame:
    """Every FE mode with every measured mode of its comparison, for rankings that no frequency window may cut. A comparison is
    one model against one test run, so its modes are few and the rows spread over comparisons."""
    fe, exp = sides(modes)
    return exp.join(fe, "cmp_id").withColumn("err", frequency_error_percent(F.col("fe_hz"), F.col("exp_hz")))


def window_census(modes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per measured mode: how many FE modes its comparison has and how many the frequency gate rejects.

    Pairs outside the window can never be admissible, so they are counted here instead of being spelled out.
    """
    fe, exp = sides(modes)
    totals = fe.groupBy("cmp_id").agg(F.count(F.lit(1)).alias("fe_total"))
    inside = pairs.groupBy("cmp_id", "exp_mode").agg(F.count(F.lit(1)).alias("fe_inside"))
    return (exp.select("cmp_id", "exp_mode").join(totals, "cmp_id", "left")
            .join(inside, ["cmp_id", "exp_mode"], "left")
            .withColumn("fe_inside", F.coalesce("fe_inside", F.lit(0)))
            .withColumn("fe_rejected", F.coalesce("fe_total", F.lit(0)) - F.col("fe_inside")))


def gate_candidates(candidates: DataFrame, policy: ComparatorPolicy = ComparatorPolicy()) -> DataFrame:
    """Frequency, MAC and coverage gates with the list of failed ones. Needs err, mac, coverage_status."""
    err, mac = F.abs(F.col("err")), F.col("mac")
    freq_ok = err <= policy.max_error_percent
    only_ok = mac.isNull() & (err <= policy.max_frequency_only_percent)
    cover_ok = F.col("coverage_status") == "accepted"
    mac_ok = mac >= policy.min_mac
    return (candidates.withColumn("frequency_gate", freq_ok).withColumn("mac_gate", mac_ok)
            .withColumn("coverage_gate", cover_ok)
            .withColumn("admissible", cover_ok & ((freq_ok & F.coalesce(mac_ok, F.lit(False))) | only_ok))
            .withColumn("reasons", reason_array((~freq_ok, "frequency"), (mac.isNull() & ~only_ok, "mac_unavailable"),
                                                (F.coalesce(~mac_ok, F.lit(False)), "mac"), (~cover_ok, "coverage"))))


def best_by_mac(candidates: DataFrame, side: str = "exp", k: int = 2) -> DataFrame:
    """The k highest-MAC partners per measured (or computed) mode, with ``mac_rank``."""
    own, other = ("exp_mode", "fe_mode") if side == "exp" else ("fe_mode", "exp_mode")
    return top_rows(candidates.filter(F.col("mac").isNotNull()), ["cmp_id", own],
                    [F.col("mac").desc(), F.col(other)], k, "mac_rank")


def nearest_in_grid(candidates: DataFrame) -> DataFrame:
    """Nearest-frequency candidate per computed and per measured mode (ties: lower partner number)."""
    by_fe = top_rows(candidates, ["cmp_id", "fe_mode"], [F.abs("err"), "exp_mode"])
    by_exp = top_rows(candidates, ["cmp_id", "exp_mode"], [F.abs("err"), "fe_mode"])
    return by_fe.withColumn("side", F.lit("FE")).unionByName(by_exp.withColumn("side", F.lit("EXP")))


def order_changes(pairs: DataFrame) -> DataFrame:
    """Flag accepted pairs whose rank by FE frequency differs from their rank by measured frequency."""
    by_fe = with_order(pairs, ["cmp_id"], log_bin(F.col("fe_hz")), ["fe_hz", "fe_mode"], rank="fe_rank")
    both = with_order(by_fe, ["cmp_id"], log_bin(F.col("exp_hz")), ["exp_hz", "exp_mode"], rank="exp_rank")
    return both.withColumn("order_changed", F.col("fe_rank") != F.col("exp_rank"))


def unmatched_modes(modes: DataFrame, pairs: DataFrame) -> DataFrame:
    """FE modes without a pair, and measured modes without one inside 0.75 x min .. 1.25 x max of the FE range."""
    fe, exp = sides(modes)
    rng = fe.groupBy("cmp_id").agg((F.min("fe_hz") * 0.75).alias("lo"), (F.max("fe_hz") * 1.25).alias("hi"))
    left = (fe.join(pairs, ["cmp_id", "fe_mode"], "left_anti")
            .select("cmp_id", F.lit("FE").alias("role"), F.col("fe_mode").alias("mode_no"), F.col("fe_hz").alias("hz")))
    right = (exp.join(pairs, ["cmp_id", "exp_mode"], "left_anti").join(rng, "cmp_id")
             .filter(F.col("exp_hz").between(F.col("lo"), F.col("hi")))
             .select("cmp_id", F.lit("EXP").alias("role"), F.col("exp_mode").alias("mode_no"), F.col("exp_hz").alias("hz")))
    return left.unionByName(right)


def nearest_frequencies(modes: DataFrame, k: int = 2) -> DataFrame:
    """Nearest k FE frequencies per measured mode, ties by mode number; proximity only.

    FE frequencies are numbered along the axis; a measured mode that sits after ``r`` of them only needs the numbers
    ``r - k + 1 .. r + k``, an equi-join that forms 2k candidates per measured mode whatever the group size.
    """
    fe, exp = sides(modes.filter(F.col("frequency_hz") > 0))
    levels = (top_rows(fe, ["cmp_id", "fe_hz"], ["fe_mode"], k).groupBy("cmp_id", "fe_hz")
              .agg(F.sort_array(F.collect_list("fe_mode")).alias("fe_modes")))
    axis = levels.select("cmp_id", F.col("fe_hz").alias("hz"), F.lit(0).alias("after"), "fe_modes",
                         F.lit(None).cast("bigint").alias("exp_mode")).unionByName(
        exp.select("cmp_id", F.col("exp_hz").alias("hz"), F.lit(1).alias("after"),
                   F.lit(None).cast("array<bigint>").alias("fe_modes"), "exp_mode"))
    axis = running_sum(axis, ["cmp_id"], log_bin(F.col("hz")), ["hz", "after", "exp_mode"], 1 - F.col("after"), "number")
    steps = axis.filter("after = 1").select(
        "cmp_id", "exp_mode", F.col("hz").alias("exp_hz"),
        F.explode(F.sequence(F.col("number") - (k - 1), F.col("number") + k)).alias("number"))
    levels = axis.filter("after = 0").select("cmp_id", "number", F.col("hz").alias("fe_hz"),
                                             F.explode("fe_modes").alias("fe_mode"))
    near = steps.join(levels, ["cmp_id", "number"]).withColumn("gap_hz", F.abs(F.col("fe_hz") - F.col("exp_hz")))
    return top_rows(near, ["cmp_id", "exp_mode"], ["gap_hz", "fe_mode"], k, "nearness")


def scaling_rows(pairs: DataFrame, min_mac: float = 0.80, max_relative: float = 0.15) -> DataFrame:
    """Frequency ratio, its square and log, direction, category and warnings of each accepted pair."""
    fe = F.when(F.col("fe_hz") > 0, F.col("fe_hz"))
    exp = F.when(F.col("exp_hz") > 0, F.col("exp_hz"))
    ratio, mac = exp / fe, F.col("mac")
    bad = fe.isNull() | exp.isNull()
    flags = [(F.coalesce(mac.isNull(), F.lit(True)), "frequency_only"), (mac < min_mac, "low_mac"),
             (F.abs(fe - exp) / exp > max_relative, "outside_window"), (F.col("order_changed"), "order_changed"),
             (F.col("coverage_status") != "accepted", "coverage")]
    warnings = F.when(bad, F.array(F.lit("invalid_frequency"))).otherwise(reason_array(*flags))
    category = (F.when(bad, "INVALID_FREQUENCY").when(mac.isNull(), "FREQUENCY_ONLY").when(mac < min_mac, "LOW_MAC")
                .when(F.size("warnings") > 0, "QUESTIONABLE").otherwise("MAC_SUPPORTED"))
    direction = (F.when(bad, "not available").when(ratio > 1, "experiment higher than FE")
                 .when(ratio < 1, "experiment lower than FE").otherwise("equal"))
    return (pairs.withColumn("ratio", ratio).withColumn("ratio2", ratio * ratio).withColumn("log_ratio", F.log(ratio))
            .withColumn("direction", direction).withColumn("warnings", warnings).withColumn("category", category))


def scaling_summary(rows: DataFrame) -> DataFrame:
    """Median ratio, squared ratio and log, and the log range over the MAC-supported pairs of each comparison."""
    used = rows.filter(F.col("category") == "MAC_SUPPORTED")
    return used.groupBy("cmp_id").agg(
        F.count(F.lit(1)).alias("n"), F.percentile("ratio", F.lit(0.5)).alias("median_ratio"),
        F.percentile("ratio2", F.lit(0.5)).alias("median_ratio2"), F.percentile("log_ratio", F.lit(0.5)).alias("median_log"),
        F.min("log_ratio").alias("min_log"), F.max("log_ratio").alias("max_log"))


def frequency_regression(pairs: DataFrame) -> DataFrame:
    """Least squares through the origin f_FE = slope * f_EXP, R^2 about the mean and the stiffness direction.

    R^2 is taken about the mean of the FE frequencies, from the expanded sums, so one aggregate is enough.
    """
    x, y = F.col("exp_hz"), F.col("fe_hz")
    g = pairs.groupBy("cmp_id").agg(F.count(F.lit(1)).alias("n"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"),
                                    F.sum(y * y).alias("syy"), F.sum(y).alias("sy"))
    slope = F.col("sxy") / F.when(F.col("sxx") > 0, F.col("sxx"))
    residual = F.col("syy") - 2 * F.col("slope") * F.col("sxy") + F.col("slope") * F.col("slope") * F.col("sxx")
    total = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return (g.withColumn("slope", slope).withColumn("r2", F.when(total > 1e-9, 1 - residual / total).otherwise(1.0))
            .withColumn("direction", F.when(F.col("slope") > 1, "model generally higher/stiffer")
                        .otherwise("model generally lower/softer")))


def range_notes(modes: DataFrame) -> DataFrame:
    """Note measured modes below or above the FE frequency range of their comparison."""
    fe, exp = sides(modes)
    rng = fe.groupBy("cmp_id").agg(F.min("fe_hz").alias("lo"), F.max("fe_hz").alias("hi"))
    return exp.join(rng, "cmp_id", "left").withColumn(
        "note", F.when(F.col("exp_hz") < F.col("lo"), "below the lowest FE mode").when(F.col("exp_hz") > F.col("hi"),
                                                                             "above the highest FE mode").otherwise(""))

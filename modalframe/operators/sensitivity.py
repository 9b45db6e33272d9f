"""Sensitivities, identifiability, what-if, plate constants and sparse-matrix algebra.

Terms are reduced to parameter Gram entries by aggregates; only k x k results (k = number of parameters) are finished, in
closed form for two parameters and by a batched kernel otherwise.
"""
from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


RCOND, SD_LIMIT = 1.0e-3, 0.08
BOUND_FACTORS, LINEAR_RANGE = (0.5, 2.0), 0.05


# ------------------------------------------------------------------------------------------------ sensitivities
def nearest_states(states: DataFrame) -> DataFrame:
    """Closest solved state below and above the baseline value per family and parameter, with the missing sides."""
    below, above = F.col("value") < F.col("p0"), F.col("value") > F.col("p0")
    tie = lambda v: F.struct(v, -F.col("state_id"))
    g = states.groupBy("family_id", "parameter").agg(
        F.max_by(F.when(below, F.col("state_id")), F.when(below, tie(F.col("value")))).alias("minus_state"),
        F.max_by(F.when(above, F.col("state_id")), F.when(above, tie(-F.col("value")))).alias("plus_state"))
    missing = F.array_compact(F.array(F.when(F.col("minus_state").isNull(), F.lit("minus")), F.when(F.col("plus_state").isNull(), F.lit("plus"))))
    return g.withColumn("missing", F.concat_ws("/", missing))


def central_sensitivities(states: DataFrame) -> DataFrame:
    """Central ln-ln sensitivity from the minus and plus states, the one-sided values and their difference.

    ``states``: family_id, term_id, parameter, side, value, p0, f0, f (f NULL when the branch was lost)."""
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    g = states.groupBy("family_id", "term_id", "parameter").agg(
        F.max("p0").alias("p0"), F.max("f0").alias("f0"), pick("minus", "value").alias("pm"), pick("plus", "value").alias("pp"),
        pick("minus", "f").alias("fm"), pick("plus", "f").alias("fp"))
    ln = lambda c: F.log(F.when(F.col(c) > 0, F.col(c)))
    g = g.withColumn("s", (ln("fp") - ln("fm")) / (ln("pp") - ln("pm"))).withColumn("_lo", (ln("f0") - ln("fm")) / (ln("p0") - ln("pm"))).withColumn(
        "_hi", (ln("fp") - ln("f0")) / (ln("pp") - ln("p0")))
    both = F.col("s").isNotNull()
    status = (F.when(F.col("pm").isNull() | F.col("pp").isNull(), "INCOMPLETE").when(F.col("fm").isNull() | F.col("fp").isNull(), "UNAVAILABLE").otherwise("CENTRAL"))
    return (g.withColumn("s_minus", F.when(both, F.col("_lo"))).withColumn("s_plus", F.when(both, F.col("_hi")))
            .withColumn("one_sided_difference", F.col("s_plus") - F.col("s_minus")).withColumn("status", status).drop("_lo", "_hi"))


def secant_sensitivities(variants: DataFrame) -> DataFrame:
    """ln(f / f0) / ln(ratio) per branch from the first usable variant of each parameter; clusters use their mean ln f.

    ``variants``: family_id, term_id, cluster_id (NULL outside a cluster), parameter, variant_no, ratio, f0, f."""
    v = variants.withColumn("_unit", F.coalesce(F.concat(F.lit("c"), F.col("cluster_id")), F.concat(F.lit("t"), F.col("term_id"))))
    per = v.groupBy("family_id", "_unit", "parameter", "variant_no", "ratio").agg(
        F.avg(F.log("f")).alias("_lf"), F.avg(F.log("f0")).alias("_l0"), F.count("f").alias("_k"), F.count(F.lit(1)).alias("_n"))
    per = per.withColumn("_s", F.when(F.col("_k") == F.col("_n"), (F.col("_lf") - F.col("_l0")) / F.log("ratio")))
    used = per.groupBy("family_id", "_unit", "parameter").agg(
        F.min_by("_s", F.when(F.col("_s").isNotNull(), F.col("variant_no"))).alias("s"), F.min(F.when(F.col("_s").isNotNull(), F.col("variant_no"))).alias("used_variant"))
    return v.select("family_id", "term_id", "_unit", "parameter").distinct().join(used, ["family_id", "_unit", "parameter"], "left").drop("_unit")


def assemble_terms(sens: DataFrame, clusters: DataFrame) -> DataFrame:
    """Terms of the sensitivity matrix: single rows, and the mean over members for clusters; a term with a missing cell is
    refused. ``sens``: family_id, term_id, parameter, s; ``clusters``: family_id, cluster_id, members."""
    m = clusters.select("family_id", F.concat(F.lit("C"), "cluster_id").alias("row_id"), F.size("members").alias("_want"), F.explode("members").alias("term_id"))
    single = sens.join(m.select("family_id", "term_id"), ["family_id", "term_id"], "left_anti").withColumn("row_id", F.concat(F.lit("T"), "term_id")).withColumn("_want", F.lit(1))
    rows = single.select("family_id", "row_id", "_want", "parameter", "s").unionByName(sens.join(m, ["family_id", "term_id"]).select("family_id", "row_id", "_want", "parameter", "s"))
    g = rows.groupBy("family_id", "row_id", "parameter").agg(F.avg("s").alias("s"), F.count("s").alias("_k"), F.max("_want").alias("_want"))
    g = g.withColumn("_ok", F.col("_k") == F.col("_want"))
    n = sens.groupBy("family_id").agg(F.countDistinct("parameter").alias("_np"))
    good = g.groupBy("family_id", "row_id").agg(F.bool_and("_ok").alias("complete"), F.count(F.lit(1)).alias("_c")).join(n, "family_id")
    good = good.select("family_id", "row_id", (F.col("complete") & (F.col("_c") == F.col("_np"))).alias("complete"))
    return g.join(good, ["family_id", "row_id"]).select("family_id", "row_id", "parameter", F.when(F.col("complete"), F.col("s")).alias("s"), "complete")


def joint_parameter(sens: DataFrame, parts: tuple[str, str] = ("E1", "E2"), name: str = "E") -> DataFrame:
    """The rows with a joint parameter (both scaled by one ratio): s_E = s_E1 + s_E2, replacing its parts."""
    both = sens.filter(F.col("parameter").isin(*parts)).groupBy("family_id", "term_id").agg(F.sum("s").alias("s"), F.count("s").alias("_k")).filter("_k = 2")
    joint = both.select("family_id", "term_id", F.lit(name).alias("parameter"), "s", F.lit("joint").alias("variant"))
    return (sens.select("family_id", "term_id", "parameter", "s", F.lit("base").alias("variant"))
            .unionByName(joint).unionByName(sens.filter(~F.col("parameter").isin(*parts)).select("family_id", "term_id", "parameter", "s", F.lit("joint").alias("variant"))))


def combine_uncertainties(rows: DataFrame, parts: list[str], scale: str | None = None) -> DataFrame:
    """sigma = sqrt(sum of squares of the available parts) [/ scale]; a row without any, or with zero, is refused."""
    squares = F.array_compact(F.array(*[F.col(p) * F.col(p) for p in parts]))
    total = F.aggregate(squares, F.lit(0.0), lambda a, v: a + v)
    sigma = F.sqrt(F.when((F.size(squares) > 0) & (total > 0), total))
    if scale:
        sigma = sigma / F.when(F.col(scale) > 0, F.col(scale))
    reason = F.when(F.size(squares) == 0, "no uncertainty").when(total <= 0, "zero uncertainty")
    return rows.withColumn("sigma", sigma).withColumn("problem", reason)


def whiten(rows: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        rows = rows.withColumn(c, F.col(c) / F.col("sigma"))
    return rows


def whiten_full(rows: DataFrame, covariance: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Whitening by the inverse square root of each group's full covariance (rows: keys, row_no, columns; covariance: keys,
    row_no, cov array). A group is one observation vector, so its k x k block is small; indefinite blocks give NULL."""
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("row_no", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in columns])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_no")
        val, vec = np.linalg.eigh(np.vstack(pdf["cov"].to_numpy()))
        out = pdf[[*keys, "row_no"]].copy()
        bad = val.min() <= np.finfo(float).eps * len(val) * max(np.abs(val).max(), 1.0)
        out[columns] = np.nan if bad else (vec / np.sqrt(np.where(val > 0, val, np.nan))) @ vec.T @ pdf[columns].to_numpy(float)
        return out

    d = rows.join(covariance, [*keys, "row_no"]).withColumn("row_no", F.col("row_no").cast("long"))
    return d.select(*keys, "row_no", *columns, "cov").groupBy(*keys).applyInPandas(solve, schema)


# ------------------------------------------------------------------------------------------------ identifiability
def two_parameter_gram(sens: DataFrame, keys: list[str], names: tuple[str, str], sigma: float = 1.0) -> DataFrame:
    """Gram sums g11, g12, g22 of the complete terms of each group (one pass: terms are first folded to a row)."""
    pick = lambda n: F.max(F.when(F.col("parameter") == n, F.col("s")))
    row = sens.groupBy(*keys, "term_id").agg(pick(names[0]).alias("a"), pick(names[1]).alias("b")).filter("a is not null and b is not null")
    w = 1.0 / (sigma * sigma)
    a, b = F.col("a"), F.col("b")
    return row.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_terms"), (F.sum(a * a) * w).alias("g11"), (F.sum(a * b) * w).alias("g12"), (F.sum(b * b) * w).alias("g22"))


def spectrum_2x2(g: DataFrame, rcond: float = RCOND) -> DataFrame:
    """Singular values, rank, condition and weakest direction of a two-parameter design from its Gram entries."""
    mean, half = (F.col("g11") + F.col("g22")) / 2, (F.col("g11") - F.col("g22")) / 2
    root = F.sqrt(half * half + F.col("g12") * F.col("g12"))
    det = F.col("g11") * F.col("g22") - F.col("g12") * F.col("g12")
    g = g.withColumn("sv1", F.sqrt(mean + root))
    # the small eigenvalue from det / large one, which keeps its digits
    g = g.withColumn("sv2", F.when(F.col("sv1") > 0, F.sqrt(F.greatest(det, F.lit(0.0))) / F.when(F.col("sv1") > 0, F.col("sv1"))).otherwise(0.0))
    g = g.withColumn("rank", (F.col("sv1") > 0).cast("int") + ((F.col("sv2") > rcond * F.col("sv1")) & (F.col("sv1") > 0)).cast("int"))
    g = g.withColumn("condition", F.col("sv1") / F.when(F.col("sv2") > 0, F.col("sv2")))
    wx, wy = F.col("g12"), F.col("sv2") * F.col("sv2") - F.col("g11")
    size = F.hypot(wx, wy)
    return g.withColumn("weak_1", F.when(size > 0, F.abs(wx) / F.when(size > 0, size))).withColumn("weak_2", F.when(size > 0, F.abs(wy) / F.when(size > 0, size)))


def practical_identifiability(g: DataFrame, prior_precision: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Rank at 1e-3, posterior sd in ln p, correlation, data cosine, projection ratios and the 0.08 sd flags."""
    g = g.withColumn("cosine", F.col("g12") / F.sqrt(F.when((F.col("g11") > 0) & (F.col("g22") > 0), F.col("g11") * F.col("g22"))))
    g = spectrum_2x2(g.withColumn("g11", F.col("g11") + prior_precision[0]).withColumn("g22", F.col("g22") + prior_precision[1]))
    det = F.when(F.col("rank") == 2, F.col("g11") * F.col("g22") - F.col("g12") * F.col("g12"))
    g = g.withColumn("sd_1", F.sqrt(F.col("g22") / det)).withColumn("sd_2", F.sqrt(F.col("g11") / det))
    g = g.withColumn("correlation", -F.col("g12") / F.sqrt(F.when(det.isNotNull(), F.col("g11") * F.col("g22"))))
    left = lambda a, b: F.sqrt(F.greatest(F.col(a) - F.when(F.col(b) > 0, F.col("g12") * F.col("g12") / F.col(b)).otherwise(0.0), F.lit(0.0)) / F.when(F.col(a) > 0, F.col(a)))
    return (g.withColumn("q_1", left("g11", "g22")).withColumn("q_2", left("g22", "g11")).withColumn("over_1", F.col("sd_1") > SD_LIMIT)
            .withColumn("over_2", F.col("sd_2") > SD_LIMIT).withColumn("status", F.when(F.col("rank") == 2, "FULL_RANK").otherwise("RANK_DEFICIENT")))


def gram_arrays(sens: DataFrame, keys: list[str], value: str = "s") -> DataFrame:
    """Parameter names and row-major Gram of each group for any k: complete terms fold to an array, the products of its k
    entries are summed in Spark."""
    names = sens.groupBy(*keys).agg(F.sort_array(F.collect_set("parameter")).alias("names"))
    term = sens.filter(F.col(value).isNotNull()).groupBy(*keys, "term_id").agg(F.sort_array(F.collect_list(F.struct("parameter", value))).alias("v"))
    term = term.join(names, keys).filter(F.size("v") == F.size("names"))
    e = term.select(*keys, "term_id", F.posexplode(F.transform("v", lambda x: x[value])).alias("i", "a"), F.transform("v", lambda x: x[value]).alias("w"))
    e = e.select(*keys, "term_id", "i", "a", F.posexplode("w").alias("j", "b"))
    g = e.groupBy(*keys, "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("g"), F.count(F.lit(1)).alias("n_terms"))
    g = g.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "g"))), lambda x: x["g"]).alias("gram"), F.max("n_terms").alias("n_terms"))
    return g.join(names, keys)


_SPECTRUM = T.StructType([T.StructField("sv", T.ArrayType(T.DoubleType())), T.StructField("rank", T.IntegerType()), T.StructField("condition", T.DoubleType()),
                          T.StructField("weakest", T.ArrayType(T.DoubleType())), T.StructField("sd", T.ArrayType(T.DoubleType())), T.StructField("q", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(_SPECTRUM)
def _spectra(gram: pd.Series, rcond: pd.Series) -> pd.DataFrame:
    """Per Gram: singular values (descending), rank, condition, weakest direction, and for full rank the standard deviation
    and projection ratio of each parameter. Grams of one size are decomposed in one call."""
    out: list = [None] * len(gram)
    width = np.array([math.isqrt(len(g)) for g in gram])
    for k in np.unique(width):
        at = np.flatnonzero(width == k)
        m = np.stack([np.asarray(gram.iat[r], float).reshape(k, k) for r in at])
        val, vec = np.linalg.eigh(m)
        for r, g, e, v in zip(at, m, val[:, ::-1], vec[:, :, ::-1]):
            sv = np.sqrt(np.clip(e, 0, None))
            rank = int(((sv > rcond.iat[r] * sv[0]) & (sv[0] > 0)).sum())
            full = rank == k
            inv = (v**2 / np.where(e > 0, e, np.nan)).sum(axis=1) if full else None
            out[r] = (sv.tolist(), rank, float(sv[0] / sv[-1]) if sv[-1] > 0 else None, np.abs(v[:, -1]).tolist(), np.sqrt(inv).tolist() if full else None,
                      np.sqrt(1 / (np.diag(g) * inv)).tolist() if full else None)
    return pd.DataFrame(out, columns=[f.name for f in _SPECTRUM])


def spectrum(grams: DataFrame, rcond: float = RCOND) -> DataFrame:
    """Singular values, rank, condition and weakest direction of designs with any number of parameters.

    ``grams``: a table of `gram_arrays`; adds sv, rank, condition, weakest, sd and q."""
    return grams.withColumn("_s", _spectra("gram", F.lit(rcond))).select(*grams.columns, "_s.*")


def identifiability(grams: DataFrame, keys: list[str], sigma: float = 1.0, rcond: float = RCOND) -> DataFrame:
    """Per parameter of a design with any number of parameters: posterior sd in ln p, projection ratio and the sd flag;
    NULL where the design is rank-deficient."""
    d = spectrum(grams.withColumn("gram", F.transform("gram", lambda g: g / (sigma * sigma))), rcond)
    rows = d.select(*keys, "rank", F.size("names").alias("_k"), F.posexplode("names").alias("_i", "parameter"), "sd", "q")
    return rows.select(*keys, "parameter", "rank", F.when(F.col("rank") == F.col("_k"), "FULL_RANK").otherwise("RANK_DEFICIENT").alias("status"), F.get("sd", F.col("_i")).alias("sd"),
                       F.get("q", F.col("_i")).alias("q"), (F.get("sd", F.col("_i")) > SD_LIMIT).alias("over"))


_SUBSETS = T.ArrayType(T.StructType([
    T.StructField("subset", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("condition", T.DoubleType()),
    T.StructField("min_singular", T.DoubleType()), T.StructField("normalized_min", T.DoubleType()), T.StructField("gamma", T.DoubleType()),
    T.StructField("admissible", T.BooleanType())]))


@F.pandas_udf(_SUBSETS)
def _subset_metrics(names: pd.Series, gram: pd.Series, n_terms: pd.Series) -> pd.Series:
    out = []
    for ids, flat, n in zip(names, gram, n_terms):
        k = len(ids)
        g = np.asarray(flat, float).reshape(k, k)
        rows = []
        for size in range(1, k + 1):
            for ix in itertools.combinations(range(k), size):
                sub = g[np.ix_(ix, ix)]
                sv = np.sqrt(np.clip(np.linalg.eigvalsh(sub)[::-1], 0, None))
                norm = np.sqrt(np.diag(sub))
                unit = np.divide(sub, np.outer(norm, norm), out=np.zeros_like(sub), where=np.outer(norm, norm) > 0)
                low = max(float(np.linalg.eigvalsh(unit)[0]), 0.0)
                # Gram eigenvalues carry the square of the singular values, so zero is judged at sqrt(eps)
                rank = int((sv > sv[0] * max(n, size) * 1.5e-8).sum()) if sv[0] > 0 else 0
                full = rank == size
                cond = float(sv[0] / sv[-1]) if full and sv[-1] > 0 else None
                gamma = 1 / math.sqrt(low) if low > np.finfo(float).eps * max(n, size) else None
                rows.append({"subset": "+".join(ids[i] for i in ix), "size": size, "rank": rank, "condition": cond, "min_singular": float(sv[-1]) if full else 0.0,
                             "normalized_min": math.sqrt(low), "gamma": gamma,
                             "admissible": bool(full and cond is not None and cond <= 100 and gamma is not None and gamma <= 20)})
        out.append(rows)
    return pd.Series(out)


def parameter_subsets(grams: DataFrame, keys: list[str]) -> DataFrame:
    """Rank, condition and collinearity index of every non-empty parameter subset of each group."""
    return grams.select(*keys, F.explode(_subset_metrics("names", "gram", "n_terms")).alias("m")).select(*keys, "m.*")


def rank_subsets(subsets: DataFrame, keys: list[str], digits: int = 9) -> DataFrame:
    """Order of the subsets: admissible, size, normalised and plain smallest singular value, collinearity, condition."""
    big = F.lit(1e300)
    order = [F.desc("admissible"), F.desc("size"), F.desc(F.round("normalized_min", digits)), F.desc(F.round("min_singular", digits)),
             F.coalesce("gamma", big), F.coalesce("condition", big), "subset"]
    return subsets.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


_COV = T.StructType([T.StructField("sd", T.ArrayType(T.DoubleType())), T.StructField("fraction", T.ArrayType(T.DoubleType())), T.StructField("rank", T.IntegerType())])


@F.pandas_udf(_COV)
def _local_covariance(gram: pd.Series) -> pd.DataFrame:
    sd, fr, rk = [], [], []
    for flat in gram:
        k = int(round(len(flat) ** 0.5))
        val, vec = np.linalg.eigh(np.asarray(flat, float).reshape(k, k))
        keep = val > k * np.finfo(float).eps * max(np.abs(val).max(), 0)
        cov = (vec[:, keep] / val[keep]) @ vec[:, keep].T
        sd.append(np.sqrt(np.clip(np.diag(cov), 0, None)))
        fr.append(np.clip((vec[:, keep] ** 2).sum(1), 0, 1))
        rk.append(int(keep.sum()))
    return pd.DataFrame({"sd": sd, "fraction": fr, "rank": rk})


def local_covariance(grams: DataFrame, keys: list[str], estimates: DataFrame | None = None) -> DataFrame:
    """Standard deviation, observability status and 95 % interval per parameter of each weighted information matrix."""
    d = grams.withColumn("c", _local_covariance("gram"))
    d = d.select(*keys, F.col("c.rank").alias("rank"), F.posexplode("names").alias("_i", "parameter"), "c")
    d = d.withColumn("fraction", F.get("c.fraction", F.col("_i"))).withColumn("sd", F.get("c.sd", F.col("_i")))
    tol = 1e-10
    d = d.withColumn("status", F.when(F.col("fraction") <= tol, "UNOBSERVABLE").when(F.col("fraction") >= 1 - tol, "OBSERVABLE").otherwise("PARTIALLY_OBSERVABLE"))
    d = d.withColumn("sd", F.when(F.col("status") == "OBSERVABLE", F.col("sd"))).drop("c", "_i")
    centre = F.lit(0.0)
    if estimates is not None:
        d, centre = d.join(estimates, [*keys, "parameter"], "left"), F.coalesce("estimate", F.lit(0.0))
    return d.withColumn("low", centre - 1.96 * F.col("sd")).withColumn("high", centre + 1.96 * F.col("sd"))


def assess_precision(sds: DataFrame, requirements: DataFrame, keys: list[str]) -> DataFrame:
    """PASS / FAIL_IMPRECISE per parameter in the coordinate its requirement names; unobservable parameters keep their
    status, parameters without a requirement are NOT_ASSESSED.

    ``sds``: keys, parameter, status, scaled_sd, transformed_sd, physical_sd; ``requirements``: parameter, coordinate, maximum."""
    d = sds.join(requirements, "parameter", "left")
    got = (F.when(F.col("coordinate") == "scaled", F.col("scaled_sd")).when(F.col("coordinate") == "transformed", F.col("transformed_sd")).otherwise(F.col("physical_sd")))
    verdict = (F.when(F.col("status") != "OBSERVABLE", F.col("status")).when(F.col("maximum").isNull(), "NOT_ASSESSED")
               .when(got <= F.col("maximum"), "PASS").otherwise("FAIL_IMPRECISE"))
    return d.withColumn("achieved", F.when(F.col("maximum").isNotNull(), got)).withColumn("verdict", verdict)


# ------------------------------------------------------------------------------------------------ what-if and fits
def what_if(trials: DataFrame, sens: DataFrame, ranges: DataFrame) -> DataFrame:
    """Predicted frequency f0 exp(sum s ln(p / p0)) for each trial and term; refused outside the solved range.

    ``trials``: family_id, trial_id, parameter, value; ``ranges``: family_id, parameter, p0, lo, hi; ``sens``: family_id,
    term_id, parameter, s, f0. A trial names a few parameters, so the join grows with trials x terms of their own family."""
    tr = trials.join(ranges, ["family_id", "parameter"], "left")
    out = F.col("p0").isNull() | ~F.col("value").between(F.col("lo") - 1e-9 * F.abs("lo"), F.col("hi") + 1e-9 * F.abs("hi"))
    tr = tr.withColumn("_out", out).withColumn("_dl", F.log(F.col("value") / F.when(F.col("p0") > 0, F.col("p0"))))
    bad = tr.groupBy("family_id", "trial_id").agg(F.bool_or("_out").alias("_refused"))
    d = tr.join(sens, ["family_id", "parameter"]).groupBy("family_id", "trial_id", "term_id").agg(
        F.max("f0").alias("f0"), F.sum(F.col("s") * F.col("_dl")).alias("_x"), F.count("s").alias("_k"), F.count(F.lit(1)).alias("_n"))
    d = d.join(bad, ["family_id", "trial_id"])
    status = F.when(F.col("_refused"), "REFUSED_RANGE").when(F.col("_k") < F.col("_n"), "UNAVAILABLE").otherwise("PREDICTION")
    return d.withColumn("status", status).withColumn("predicted_hz", F.when(F.col("status") == "PREDICTION", F.col("f0") * F.exp("_x"))).drop("_refused", "_k", "_n", "_x")


def what_if_effect(predicted: DataFrame) -> DataFrame:
    """Effect of each prediction on its measured frequency (needs f_exp): improves, worsens or unchanged."""
    before, after = (F.col("f0") - F.col("f_exp")) / F.col("f_exp"), (F.col("predicted_hz") - F.col("f_exp")) / F.col("f_exp")
    effect = F.when(after.isNull(), None).when(F.abs(after) < F.abs(before), "improves").when(F.abs(after) > F.abs(before), "worsens").otherwise("unchanged")
    return predicted.withColumn("error_before", before).withColumn("error_after", after).withColumn("effect", effect)


def effect_summary(effects: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per role; MIXED only when one FIT row improves while another worsens."""
    n = lambda v: F.sum((F.col("effect") == v).cast("int"))
    g = effects.filter(F.col("effect").isNotNull()).groupBy(*keys, "role").agg(F.count(F.lit(1)).alias("n_rows"), n("improves").alias("n_improves"), n("worsens").alias("n_worsens"))
    mixed = (F.col("role") == "FIT") & (F.col("n_improves") > 0) & (F.col("n_worsens") > 0)
    return g.withColumn("summary", F.when(mixed, "MIXED").when(F.col("n_improves") > 0, "improves").when(F.col("n_worsens") > 0, "worsens").otherwise("no change"))


def bounded_fit(terms: DataFrame, keys: list[str], low: float = math.log(BOUND_FACTORS[0]), high: float = math.log(BOUND_FACTORS[1])) -> DataFrame:
    """Bounded least squares of ln(f_exp / f0) on two sensitivities for every scenario at once.

    ``terms``: keys, s1, s2, f0, f_exp. Rank is judged first. The objective is a convex quadratic of two variables, so its
    minimum in the box is the inner solution or the best of the four edges, each in closed form.
    """
    b = F.log(F.col("f_exp") / F.col("f0"))
    g = terms.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_terms"), F.sum(F.col("s1") * F.col("s1")).alias("g11"), F.sum(F.col("s1") * F.col("s2")).alias("g12"),
                                 F.sum(F.col("s2") * F.col("s2")).alias("g22"), F.sum(F.col("s1") * b).alias("b1"), F.sum(F.col("s2") * b).alias("b2"))
    g = spectrum_2x2(g)
    c = F.col
    det = F.when(c("rank") == 2, c("g11") * c("g22") - c("g12") * c("g12"))
    x1, x2 = (c("g22") * c("b1") - c("g12") * c("b2")) / det, (c("g11") * c("b2") - c("g12") * c("b1")) / det
    inside = x1.between(low, high) & x2.between(low, high)
    box = lambda v: F.least(F.greatest(v, F.lit(low)), F.lit(high))
    cost = lambda u, v: c("g11") * u * u + 2 * c("g12") * u * v + c("g22") * v * v - 2 * c("b1") * u - 2 * c("b2") * v
    edges = []
    for k, edge in enumerate((low, high)):
        e = F.lit(edge)
        v = box((c("b2") - c("g12") * e) / F.when(c("g22") > 0, c("g22")))
        u = box((c("b1") - c("g12") * e) / F.when(c("g11") > 0, c("g11")))
        edges += [F.struct(cost(e, v).alias("q"), F.lit(2 * k).alias("o"), e.alias("x1"), v.alias("x2")), F.struct(cost(u, e).alias("q"), F.lit(2 * k + 1).alias("o"), u.alias("x1"), e.alias("x2"))]
    best = F.array_min(F.array(*edges))
    g = g.withColumn("x1", F.when(c("rank") == 2, F.when(inside, x1).otherwise(best["x1"]))).withColumn("x2", F.when(c("rank") == 2, F.when(inside, x2).otherwise(best["x2"])))
    near = lambda v: (F.abs(v - low) <= 1e-9) | (F.abs(v - high) <= 1e-9)
    lim = math.log(1 + LINEAR_RANGE)
    return (g.withColumn("status", F.when(c("rank") == 2, "FITTED").otherwise("REFUSED_RANK_DEFICIENT")).withColumn("ratio_1", F.exp("x1")).withColumn("ratio_2", F.exp("x2"))
            .withColumn("at_bound", F.coalesce(near(c("x1")) | near(c("x2")), F.lit(False))).withColumn("beyond_range", F.coalesce((F.abs("x1") > lim) | (F.abs("x2") > lim), F.lit(False))))


def fit_residuals(terms: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    d = terms.join(fits.select(*keys, "x1", "x2"), keys)
    model = F.col("f0") * F.exp(F.col("s1") * F.col("x1") + F.col("s2") * F.col("x2"))
    return d.withColumn("f_fit", model).withColumn("error_before", 100 * (F.col("f0") / F.col("f_exp") - 1)).withColumn("error_after", 100 * (F.col("f_fit") / F.col("f_exp") - 1))


# ------------------------------------------------------------------------------------------------ plates and budgets
def plate_stiffness(p: DataFrame) -> DataFrame:
    """D11, D22, D66 from moduli, the moduli back, apparent flexural values and the sensitivities turned from E to D.

    Needs e1, e2, g12, nu12, h (and s_e1, s_e2, s_g12 for the last part)."""
    a = F.col("nu12") * F.col("nu12") * F.col("e2") / F.col("e1")
    h3 = F.pow("h", 3)
    p = p.withColumn("d11", F.col("e1") * h3 / (12 * (1 - a))).withColumn("d22", F.col("e2") * h3 / (12 * (1 - a))).withColumn("d66", F.col("g12") * h3 / 12)
    back = F.col("nu12") * F.col("nu12") * F.col("d22") / F.col("d11")
    p = p.withColumn("e1_back", 12 * (1 - back) * F.col("d11") / h3).withColumn("e2_back", 12 * (1 - back) * F.col("d22") / h3).withColumn("g12_back", 12 * F.col("d66") / h3)
    c = a / (1 - a)
    # inverse of [[1 - c, c], [-c, 1 + c]] has determinant 1
    return (p.withColumn("c", c).withColumn("s_d11", F.col("s_e1") * (1 + F.col("c")) + F.col("s_e2") * F.col("c"))
            .withColumn("s_d22", F.col("s_e2") * (1 - F.col("c")) - F.col("s_e1") * F.col("c")).withColumn("s_d66", F.col("s_g12")))


def apparent_flexural(d: DataFrame) -> DataFrame:
    """E_flex, G12_flex, nu12_flex from D11, D12, D66 and the thickness; NULL where they are not admissible."""
    ok = (F.col("d11") > 0) & (F.col("d66") > 0) & (F.col("h") > 0) & (F.abs("d12") < F.col("d11"))
    r = F.col("d12") / F.when(ok, F.col("d11"))
    return (d.withColumn("e_flex", 12 * F.col("d11") * (1 - r * r) / F.pow("h", 3)).withColumn("g12_flex", F.when(ok, 12 * F.col("d66") / F.pow("h", 3))).withColumn("nu12_flex", r))


def thickness_sensitivity(sens: DataFrame, keys: list[str]) -> DataFrame:
    return sens.groupBy(*keys).agg((3 * F.sum("s")).alias("s_h"))


def budget_lines(d: DataFrame, keys: list[str]) -> DataFrame:
    """Contributions to ln E: statistical, 3 x cv of thickness, mass, setup, model form; an absent one stays NULL."""
    lines = F.array(*[F.struct(F.lit(n).alias("source"), v.alias("ln_sd")) for n, v in (
        ("statistical", F.col("statistical_sd")), ("thickness", 3 * F.col("thickness_cv")), ("mass", F.col("mass_rel_sd")), ("setup", F.col("setup_sd")), ("model_form", F.col("model_form")))])
    return d.select(*keys, F.explode(lines).alias("l")).select(*keys, "l.source", "l.ln_sd", F.col("l.ln_sd").isNotNull().alias("available"))


def classify_constants(changes: DataFrame, keys: list[str], limit: float = 0.003) -> DataFrame:
    """Largest |df / f| per constant: below 0.3 % negligible, else include; a refused tracking leaves it unclassified."""
    g = changes.groupBy(*keys).agg(F.max(F.abs("relative_change")).alias("worst"), F.bool_or("refused").alias("refused"))
    return g.withColumn("worst", F.when(~F.col("refused"), F.coalesce("worst", F.lit(0.0)))).withColumn(
        "classification", F.when(F.col("refused"), "NOT_CLASSIFIED").when(F.col("worst") < limit, "NEGLIGIBLE").otherwise("INCLUDE"))


def stable_material(c: DataFrame) -> DataFrame:
    """Positive moduli and positive-definite compliance (leading minors of its 3 x 3 block)."""
    m1 = 1 / F.col("e1")
    o12, o13, o23 = -F.col("nu12") / F.col("e1"), -F.col("nu13") / F.col("e1"), -F.col("nu23") / F.col("e2")
    m2 = m1 / F.col("e2") - o12 * o12
    m3 = m1 * (1 / F.col("e2") / F.col("e3") - o23 * o23) - o12 * (o12 / F.col("e3") - o13 * o23) + o13 * (o12 * o23 - o13 / F.col("e2"))
    pos = F.least(*[F.col(x) for x in ("e1", "e2", "e3", "g12", "g13", "g23")]) > 0
    return c.withColumn("reason", F.when(~pos, "moduli must be positive").when((m2 <= 0) | (m3 <= 0), "compliance is not positive definite")).withColumn("stable", F.col("reason").isNull())


def reading_statistics(readings: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean, sd (n - 1), cv, min, max and the side means of each reading set."""
    return readings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), (F.stddev_samp("value") / F.avg("value")).alias("cv"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg(F.when(F.col("side") == "A", F.col("value"))).alias("mean_a"), F.avg(F.when(F.col("side") == "B", F.col("value"))).alias("mean_b"))


def derived_quantities(stats: DataFrame) -> DataFrame:
    """Areal density (kg/m2), density (kg/m3) and readiness (nine readings) from mass g, plan mm and mean thickness mm."""
    area = F.col("length_mm") * F.col("width_mm")
    return (stats.withColumn("areal_density", F.col("mass_g") / 1000.0 / (area / 1e6)).withColumn("density", F.col("mass_g") / 1000.0 / (area * F.col("mean") / 1e9))
            .withColumn("readiness", F.when(F.col("n") >= 9, "PASS").otherwise("BLOCKED")))


def reading_variants(readings: DataFrame, alternatives: DataFrame, keys: list[str]) -> DataFrame:
    """The readings as transcribed and, beside them, with the alternative value of each ambiguous reading."""
    d = readings.join(alternatives, [*keys, "position"], "left")
    both = F.array(F.struct(F.lit("as transcribed").alias("variant"), F.col("value").alias("value")),
                   F.struct(F.lit("alternative reading").alias("variant"), F.coalesce("alternative", "value").alias("value")))
    return d.withColumn("v", F.explode(both)).drop("value", "alternative").select("*", "v.variant", "v.value").drop("v")


# ------------------------------------------------------------------------------------------------ matrices
def symmetry_error(m: DataFrame) -> DataFrame:
    """Largest |a_ij - a_ji| of each matrix and whether it is symmetric within 1e-12 + 1e-10 x scale."""
    t = m.select("matrix_id", F.col("j").alias("i"), F.col("i").alias("j"), F.col("value").alias("_t"))
    d = m.join(t, ["matrix_id", "i", "j"], "full_outer")
    g = d.groupBy("matrix_id").agg(F.max(F.abs(F.coalesce("value", F.lit(0.0)) - F.coalesce("_t", F.lit(0.0)))).alias("symmetry_error"), F.max(F.abs("value")).alias("_s"))
    return g.withColumn("is_symmetric", F.col("symmetry_error") <= 1e-12 + 1e-10 * F.col("_s")).drop("_s")


def matrix_difference(actual: DataFrame, expected: DataFrame, rtol: float = 1e-10, atol: float = 1e-12) -> DataFrame:
    """Relative Frobenius error and element-wise closeness of two coordinate matrices."""
    d = actual.join(expected.withColumnRenamed("value", "_e"), ["matrix_id", "i", "j"], "full_outer")
    a, e = F.coalesce("value", F.lit(0.0)), F.coalesce("_e", F.lit(0.0))
    g = d.groupBy("matrix_id").agg(F.sqrt(F.sum(F.pow(a - e, 2))).alias("_d"), F.sqrt(F.sum(e * e)).alias("_n"), F.bool_and(F.abs(a - e) <= atol + rtol * F.abs(e)).alias("all_close"))
    return g.withColumn("relative_error", F.when(F.col("_n") > 0, F.col("_d") / F.when(F.col("_n") > 0, F.col("_n"))).otherwise(F.col("_d"))).drop("_d", "_n")


def affine_basis(reference: DataFrame, perturbed: DataFrame, deltas: list[list[float]]) -> DataFrame:
    """Contribution matrices K_i of an affine K(p) = K0 + sum dp_i K_i from one perturbed job per row of ``deltas``.

    ``perturbed``: sample_no, matrix_id, i, j, value. The small parameter matrix is inverted once on the driver."""
    inv = np.linalg.inv(np.asarray(deltas, float))
    n = len(deltas)
    d = perturbed.select("sample_no", "matrix_id", "i", "j", "value").unionByName(
        reference.select(F.explode(F.array(*[F.lit(s) for s in range(n)])).alias("sample_no"), "matrix_id", "i", "j", (-F.col("value")).alias("value")))
    weights = F.array(*[F.array(*[F.lit(float(inv[b, s])) for b in range(n)]) for s in range(n)])
    d = d.select("*", F.posexplode(F.get(weights, F.col("sample_no"))).alias("basis_no", "_w"))
    return d.groupBy("matrix_id", "basis_no", "i", "j").agg(F.sum(F.col("_w") * F.col("value")).alias("value"))


def reconstruct(reference: DataFrame, basis: DataFrame, delta: list[float]) -> DataFrame:
    """K0 + sum dp_i K_i as a union of scaled entries."""
    w = F.get(F.array(*[F.lit(float(v)) for v in delta]), F.col("basis_no"))
    parts = reference.select("matrix_id", "i", "j", "value").unionByName(basis.select("matrix_id", "i", "j", (w * F.col("value")).alias("value")))
    return parts.groupBy("matrix_id", "i", "j").agg(F.sum("value").alias("value"))


def eigen_derivatives(shapes: DataFrame, stiffness_slope: DataFrame, mass: DataFrame, mass_slope: DataFrame | None, keys: list[str], scale: float) -> DataFrame:
    """d(lambda)/dp = phi^H (K' - lambda M') phi / phi^H M phi, df/dp and the sensitivity scaled by parameter / f.

    ``shapes``: keys, matrix_id, mode, dof_index, re, im, frequency_hz."""
    def form(m: DataFrame, name: str) -> DataFrame:
        e = m.select("matrix_id", "i", F.col("j").alias("dof_index"), F.col("value").alias("_m"))
        y = shapes.join(e, ["matrix_id", "dof_index"]).groupBy(*keys, "matrix_id", "mode", F.col("i").alias("dof_index")).agg(
            F.sum(F.col("_m") * F.col("re")).alias("_yr"), F.sum(F.col("_m") * F.col("im")).alias("_yi"))
        return shapes.join(y, [*keys, "matrix_id", "mode", "dof_index"]).groupBy(*keys, "matrix_id", "mode").agg(
            F.sum(F.col("re") * F.col("_yr") + F.col("im") * F.col("_yi")).alias(name))

    modes = shapes.groupBy(*keys, "matrix_id", "mode").agg(F.max("frequency_hz").alias("frequency_hz"))
    d = modes.join(form(stiffness_slope, "_k"), [*keys, "matrix_id", "mode"]).join(form(mass, "_m"), [*keys, "matrix_id", "mode"])
    lam = F.pow(2 * math.pi * F.col("frequency_hz"), 2)
    top = F.col("_k")
    if mass_slope is not None:
        d, top = d.join(form(mass_slope, "_s"), [*keys, "matrix_id", "mode"], "left"), F.col("_k") - lam * F.coalesce("_s", F.lit(0.0))
    d = d.withColumn("eigen_derivative", top / F.when(F.abs("_m") > 1e-15, F.col("_m")))
    d = d.withColumn("frequency_derivative", F.col("eigen_derivative") / (4 * math.pi * F.sqrt(lam)))
    return d.withColumn("scaled", F.col("frequency_derivative") * scale / F.col("frequency_hz"))


def tied_modes(values: DataFrame, keys: list[str]) -> DataFrame:
    """Modes whose eigenvalues agree within 100 eps n scale, found through bins of that width.

    ``values``: keys, mode_no, eigenvalue, n_dof."""
    s = values.groupBy(*keys).agg((100 * float(np.finfo(float).eps) * F.greatest(F.max(F.abs("eigenvalue")), F.lit(1.0)) * F.greatest(F.max("n_dof"), F.lit(1))).alias("_r"))
    v = values.join(s, keys).withColumn("_bin", F.floor(F.col("eigenvalue") / F.col("_r")))
    o = v.select(*keys, F.col("mode_no").alias("partner"), F.col("eigenvalue").alias("_e"), F.explode(F.array(F.col("_bin") - 1, F.col("_bin"), F.col("_bin") + 1)).alias("_bin"))
    hit = v.join(o, [*keys, "_bin"]).filter((F.col("mode_no") != F.col("partner")) & (F.abs(F.col("eigenvalue") - F.col("_e")) <= F.col("_r")))
    return hit.select(*keys, "mode_no", "partner").distinct()


# ------------------------------------------------------------------------------------------------ declared and archived values
def check_declared(declared: DataFrame, parsed: DataFrame, rtol: float = 1e-6) -> DataFrame:
    """Declared against parsed constants per state, and the constants a state changes beyond its one parameter.

    ``declared``: family_id, state_id, name, value, is_parameter; ``parsed``: family_id, state_id, name, value, base."""
    j = parsed.join(declared.withColumnRenamed("value", "declared"), ["family_id", "state_id", "name"], "full_outer")
    differs = lambda a, b: a.isNull() | b.isNull() | (F.abs(a - b) > rtol * F.greatest(F.abs(a), F.abs(b)))
    wrong = F.col("declared").isNotNull() & differs(F.col("declared"), F.col("value"))
    moved = ~F.coalesce("is_parameter", F.lit(False)) & differs(F.col("value"), F.col("base"))
    g = j.groupBy("family_id", "state_id").agg(F.sum(F.coalesce(wrong, F.lit(False)).cast("int")).alias("n_wrong"), F.concat_ws(",", F.sort_array(F.collect_set(F.when(moved, F.col("name"))))).alias("also_changed"))
    return g.withColumn("verdict", F.when(F.col("n_wrong") > 0, "declared value differs").when(F.col("also_changed") != "", "not a one-parameter state").otherwise("ok"))


def compare_archive(live: DataFrame, archived: DataFrame, keys: list[str], tolerance: float = 1.5e-5) -> DataFrame:
    """Live against archived values: difference and agreement (both absent agrees)."""
    j = live.select(*keys, F.col("s").alias("live")).join(archived.select(*keys, F.col("s").alias("archived")), keys, "left")
    diff = F.col("live") - F.col("archived")
    agree = (F.col("live").isNull() & F.col("archived").isNull()) | F.coalesce(F.abs(diff) <= tolerance, F.lit(False))
    return j.withColumn("difference", diff).withColumn("agree", agree)

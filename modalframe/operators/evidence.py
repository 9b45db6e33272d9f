"""Assignment, frozen observations, objectives and consistency statistics over many specimens."""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modalframe.functions.reasons import first_reason
from modalframe.operators.matching import SCALE, Matching, exact
from modalframe.operators.ordered import top_rows, with_order
from modalframe.operators.shapes import connected_components
from modalframe.session import cut_lineage, dealt


@dataclass(frozen=True)
class StrictPolicy:
    """Gates of the strict identification pairing (fixed values)."""

    min_mac: float = 0.80
    max_relative: float = 0.15
    tie_tolerance: float = 1e-9
    min_observations: int = 2


# ------------------------------------------------------------------------------------------------ assignment
def _grouped(edges: DataFrame) -> DataFrame:
    """Assignment groups of the gated bipartite graph: ``component`` and ``n_edges``.

    Every comparison is split into its connected components (FE ids even, EXP ids odd), whatever its size. Components
    decouple the problem, so the split is exact.
    """
    e = cut_lineage(edges).withColumn("a", F.col("fe_mode") * 2).withColumn("b", F.col("exp_mode") * 2 + 1)
    v = e.select("cmp_id", F.explode(F.array("a", "b")).alias("id")).distinct()
    comp = connected_components(v, e, ["cmp_id"])
    e = e.join(comp.select("cmp_id", F.col("id").alias("a"), "component"), ["cmp_id", "a"]).drop("a", "b")
    return e.join(e.groupBy("cmp_id", "component").agg(F.count(F.lit(1)).alias("n_edges")), ["cmp_id", "component"])


def _match(pdf: pd.DataFrame, weights: list[int], useful) -> tuple[Matching, list[int], list[int]]:
    """Matching of one component, with the row and column number of each of its edges."""
    rows, cols = pd.factorize(pdf.fe_mode), pd.factorize(pdf.exp_mode)
    r, c = rows[0].tolist(), cols[0].tolist()
    return Matching(len(rows[1]), len(cols[1]), [e for e in zip(r, c, weights) if useful(e[2])]), r, c


def assign_pairs(candidates: DataFrame, unmatched_cost: float = 1.15) -> DataFrame:
    """Optimal one-to-one pairs of the admissible candidates (cmp_id, fe_mode, exp_mode, cost) of each comparison.

    One-edge groups are decided by a column expression, only the others reach the small matching kernel.
    """
    e = _grouped(candidates.select("cmp_id", "fe_mode", "exp_mode", "cost"))
    single = e.filter((F.col("n_edges") == 1) & (F.col("cost") < 2 * unmatched_cost)).select("cmp_id", "fe_mode", "exp_mode", "cost")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        # A pair saves the cost of two unmatched modes; only pairs that save something can be chosen.
        weight = [exact(c) - 2 * exact(unmatched_cost) for c in pdf.cost]
        m, rows, cols = _match(pdf, weight, lambda w: w < 0)
        return pdf[[m.column_of[r] == c for r, c in zip(rows, cols)]][["cmp_id", "fe_mode", "exp_mode", "cost"]]

    many = e.filter("n_edges > 1").groupBy("cmp_id", "component").applyInPandas(block, single.schema)
    return single.unionByName(many)


def strict_pairs(candidates: DataFrame, policy: StrictPolicy = StrictPolicy()) -> DataFrame:
    """Maximum-cardinality, then maximum-MAC pairs of the strict policy; ``tied`` marks pairs another optimum replaces.

    ``candidates``: cmp_id, fe_mode, exp_mode, fe_hz, exp_hz, mac inside the frequency window."""
    rel = F.abs(F.col("fe_hz") - F.col("exp_hz")) / F.col("exp_hz")
    ok = candidates.filter((rel <= policy.max_relative) & (F.col("mac") >= policy.min_mac)).select("cmp_id", "fe_mode", "exp_mode", "mac")
    e = _grouped(ok)
    single = e.filter("n_edges = 1").select("cmp_id", "fe_mode", "exp_mode", "mac", F.lit(False).alias("tied"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        one = (len(pdf) + 1) * SCALE  # a pair more weighs more than all MAC values together
        m, rows, cols = _match(pdf, [-(one + exact(x)) for x in pdf.mac], lambda w: True)
        tied = m.replaceable(exact(policy.tie_tolerance))
        chosen = [m.column_of[r] == c for r, c in zip(rows, cols)]
        out = pdf[chosen][["cmp_id", "fe_mode", "exp_mode", "mac"]].copy()
        out["tied"] = [tied[r] for r, c in zip(rows, chosen) if c]
        return out

    many = e.filter("n_edges > 1").groupBy("cmp_id", "component").applyInPandas(block, single.schema)
    return single.unionByName(many)


def pairing_status(pairs: DataFrame, candidates: DataFrame, comparisons: DataFrame, policy: StrictPolicy = StrictPolicy()) -> DataFrame:
    rel = F.abs(F.col("fe_hz") - F.col("exp_hz")) / F.col("exp_hz")
    unknown = candidates.filter((rel <= policy.max_relative) & F.col("mac").isNull()).groupBy("cmp_id").agg(F.count(F.lit(1)).alias("n_unknown"))
    p = pairs.groupBy("cmp_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.col("tied").cast("int")).alias("n_tied"))
    d = comparisons.select("cmp_id").distinct().join(p, "cmp_id", "left").join(unknown, "cmp_id", "left").fillna(0)
    status = (F.when(F.col("n_tied") > 0, "AMBIGUOUS").when(F.col("n_unknown") > 0, "INCOMPLETE_EVIDENCE")
              .when(F.col("n_pairs") < policy.min_observations, "INSUFFICIENT_COVERAGE").otherwise("COMPLETE"))
    return d.withColumn("status", status)


def unpaired_reasons(exp_modes: DataFrame, candidates: DataFrame, pairs: DataFrame, policy: StrictPolicy = StrictPolicy()) -> DataFrame:
    """Why each measured mode has no strict pair (exp_modes: cmp_id, exp_mode)."""
    rel = F.abs(F.col("fe_hz") - F.col("exp_hz")) / F.col("exp_hz") <= policy.max_relative
    g = candidates.filter(rel).groupBy("cmp_id", "exp_mode").agg(
        F.lit(True).alias("_in"), F.bool_or(F.col("mac").isNull()).alias("_unknown"), F.bool_or(F.coalesce(F.col("mac") >= policy.min_mac, F.lit(False))).alias("_ok"))
    d = exp_modes.join(pairs, ["cmp_id", "exp_mode"], "left_anti").join(g, ["cmp_id", "exp_mode"], "left")
    return d.withColumn("reason", F.coalesce(first_reason(
        (F.col("_in").isNull(), "no FE mode within the frequency gate"), (F.col("_unknown"), "MAC not available"), (~F.col("_ok"), "MAC below the policy minimum")),
        F.lit("assigned to other measured modes"))).drop("_in", "_unknown", "_ok")


# ------------------------------------------------------------------------------------------------ observations
def inclusion_status(status: Column, decision: Column) -> Column:
    """INCLUDED / DOWNWEIGHTED / EXCLUDED from the automatic status, unless a manual decision says otherwise."""
    d = F.lower(F.trim(F.coalesce(decision, F.lit("automatic"))))
    source = F.when(d == "automatic", F.lower(F.trim(status))).otherwise(d)
    return (F.when(source.isin("accepted", "included", "excellent match", "good match", "frequency match"), "INCLUDED")
            .when(source == "downweighted", "DOWNWEIGHTED").otherwise("EXCLUDED"))


def observations(pairs: DataFrame) -> DataFrame:
    """One observation per accepted pair with a stable composite id (design / specimen / run / pair / FE / EXP)."""
    head = F.concat_ws("/", F.url_encode("design_id"), F.url_encode(F.col("specimen_id").cast("string")), F.url_encode(F.col("test_run_id").cast("string")))
    out = with_order(pairs, ["cmp_id"], F.floor(F.log(F.col("fe_hz")) / 0.01), ["fe_hz", "fe_mode"], rank="_rk")
    ident = F.concat(head, F.lit("/pair/"), F.col("_rk") - 1, F.lit("/A"), F.col("fe_mode"), F.lit("/E"), F.col("exp_mode"))
    return out.withColumn("observation_id", ident).withColumn("inclusion", inclusion_status(F.col("status"), F.col("decision"))).drop("_rk")


def frozen_rows(pairs: DataFrame, excluded: DataFrame) -> DataFrame:
    """Stable ids R1..Rn of the frozen pairs by measured mode, plus the excluded modes with their reason."""
    rows = with_order(pairs, ["cmp_id"], F.floor(F.col("exp_mode") / 64), ["exp_mode"], rank="_rk")
    rows = rows.select("cmp_id", F.concat(F.lit("R"), "_rk").alias("row_id"), "exp_mode", "fe_mode", F.lit(None).cast("string").alias("reason"))
    return rows.unionByName(excluded.select("cmp_id", F.lit(None).cast("string").alias("row_id"), "exp_mode", F.lit(None).cast("bigint").alias("fe_mode"), "reason"))


def select_holdouts(rows: DataFrame, keys: list[str], k_int_enabled: bool = False) -> DataFrame:
    """FIT / HOLDOUT by physical family: the lowest torsion-dominated family and the highest accepted family are held out.

    ``rows``: keys, row_id, exp_hz, family, torsion."""
    order = F.struct("exp_hz", "row_id")
    g = rows.groupBy(*keys).agg(F.min_by(F.when(F.col("torsion"), F.col("family")), F.when(F.col("torsion"), order)).alias("torsion_family"),
                                F.max_by("family", order).alias("validation_family"))
    if k_int_enabled:
        g = g.withColumn("torsion_family", F.lit(None).cast("string"))
    held = (F.col("family") == F.col("validation_family")) | F.coalesce(F.col("family") == F.col("torsion_family"), F.lit(False))
    return rows.join(g, keys).withColumn("role", F.when(held, "HOLDOUT").otherwise("FIT"))


def straddling_clusters(rows: DataFrame, clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters whose members are split between FIT and HOLDOUT (clusters: keys, cluster_id, members)."""
    m = clusters.select(*keys, "cluster_id", F.explode("members").alias("row_id")).join(rows.select(*keys, "row_id", "role"), [*keys, "row_id"])
    g = m.groupBy(*keys, "cluster_id").agg(F.countDistinct("role").alias("n_roles"), F.min("role").alias("role"))
    return g.withColumn("verdict", F.when(F.col("n_roles") > 1, "SPLIT").otherwise(F.col("role")))


def objective_terms(rows: DataFrame, clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Whitened ln-ratio of each single row and of each cluster (mean ratio, sigma = sqrt(sum sigma^2) / n).

    ``rows``: keys, row_id, fe_hz, exp_hz, sigma, role; ``clusters``: keys, cluster_id, members."""
    m = clusters.select(*keys, F.concat(F.lit("C"), F.col("cluster_id").cast("string")).alias("term_id"), F.explode("members").alias("row_id"))
    j = rows.join(m, [*keys, "row_id"], "left").withColumn("term_id", F.coalesce("term_id", F.concat(F.lit("R"), F.col("row_id").cast("string"))))
    g = j.groupBy(*keys, "term_id", "role").agg(F.avg(F.log("fe_hz") - F.log("exp_hz")).alias("log_ratio"), F.sqrt(F.sum(F.col("sigma") * F.col("sigma"))).alias("_s"), F.count(F.lit(1)).alias("n_rows"))
    return g.withColumn("sigma", F.col("_s") / F.col("n_rows")).withColumn("residual", F.col("log_ratio") / F.col("sigma")).drop("_s")


def objective(terms: DataFrame, keys: list[str]) -> DataFrame:
    fit = F.col("role") == "FIT"
    return terms.groupBy(*keys).agg((0.5 * F.sum(F.when(fit, F.col("residual") * F.col("residual")).otherwise(0.0))).alias("phi"), F.sum(fit.cast("int")).alias("n_fit"), F.sum((~fit).cast("int")).alias("n_holdout"))


def observation_counts(terms: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Distinct FIT and HOLDOUT families, their overlap and the refusals (>= k + 1 FIT, >= 1 HOLDOUT, no overlap).

    Families are first folded to one row each, so nothing is gathered into sets."""
    fit = F.col("role") == "FIT"
    per = terms.groupBy(*keys, "family").agg(F.bool_or(fit).alias("_f"), F.bool_or(~fit).alias("_h"))
    n = lambda c: F.sum(c.cast("int"))
    g = per.groupBy(*keys).agg(n(F.col("_f")).alias("n_fit"), n(F.col("_h")).alias("n_holdout"), n(F.col("_f") & F.col("_h")).alias("n_overlap"))
    refusals = F.array_compact(F.array(F.when(F.col("n_fit") < k + 1, F.lit("INSUFFICIENT_FIT_FAMILIES")), F.when(F.col("n_holdout") == 0, F.lit("NO_HOLDOUT_FAMILY")),
                                       F.when(F.col("n_overlap") > 0, F.lit("HOLDOUT_FAMILY_OVERLAPS_FIT"))))
    return g.withColumn("refusals", F.concat_ws(";", refusals))


def residual_patterns(terms: DataFrame, keys: list[str], tau: float | None = None) -> DataFrame:
    """Systematic families (>= 2 FIT terms, one sign, every |r| above its limit) and failed holdouts per key."""
    limit = lambda m: F.lit(float(m)) if tau is None else F.greatest(F.lit(float(m)), tau / F.col("sigma"))
    fit = terms.filter("role = 'FIT'").groupBy(*keys, "family").agg(
        F.count(F.lit(1)).alias("n"), F.min("residual").alias("lo"), F.max("residual").alias("hi"), F.bool_and(F.abs("residual") > limit(2)).alias("_all"))
    fit = fit.withColumn("systematic", (F.col("n") >= 2) & ((F.col("lo") > 0) | (F.col("hi") < 0)) & F.col("_all"))
    f = fit.groupBy(*keys).agg(F.sum(F.col("systematic").cast("int")).alias("n_systematic"), F.count(F.lit(1)).alias("n_families"))
    h = terms.filter("role = 'HOLDOUT'").groupBy(*keys).agg(F.sum((F.abs("residual") > limit(3)).cast("int")).alias("n_holdout_failures"))
    d = f.join(h, keys, "full_outer").fillna(0)
    return d.withColumn("status", F.when((F.col("n_systematic") > 0) | (F.col("n_holdout_failures") > 0), "FAIL").otherwise("PASS"))


def birge(terms: DataFrame, patterns: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Birge factor sqrt(max(1, chi2 / dof)) over FIT terms; blocked on a failed pattern or dof <= 0."""
    g = terms.filter("role = 'FIT'").groupBy(*keys).agg(F.sum(F.col("residual") * F.col("residual")).alias("chi2"), F.count(F.lit(1)).alias("n_fit"))
    d = g.join(patterns.select(*keys, F.col("status").alias("_p")), keys, "left").withColumn("dof", F.col("n_fit") - k)
    ratio = F.col("chi2") / F.when(F.col("dof") > 0, F.col("dof"))
    status = F.when(F.col("dof") <= 0, "REFUSED_DOF").when(F.col("_p") == "FAIL", "BLOCKED_PATTERN").otherwise("AVAILABLE")
    return d.withColumn("chi2_per_dof", ratio).withColumn("status", status).withColumn("birge_factor", F.when(F.col("dof") > 0, F.sqrt(F.greatest(F.lit(1.0), ratio)))).drop("_p")


def agreement_change(candidate: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Largest |relative error| at the baseline and the candidate, and the change."""
    c = candidate.groupBy(*keys).agg(F.max(F.abs("relative_error")).alias("candidate_max"))
    b = baseline.groupBy(*keys).agg(F.max(F.abs("relative_error")).alias("baseline_max"))
    d = c.join(b, keys, "full_outer").withColumn("delta", F.col("candidate_max") - F.col("baseline_max"))
    return d.withColumn("change", F.when(F.col("delta").isNull(), "NOT_AVAILABLE").when(F.col("delta") < 0, "IMPROVED").when(F.col("delta") > 0, "WORSENED").otherwise("SAME"))


def agreement_rows(rows: DataFrame, preferred: float = 0.05, acceptable: float = 0.10) -> DataFrame:
    """f_FE = f_EXP exp(r sigma), its relative error and the practical-target label of every row."""
    rel = F.exp(F.col("residual") * F.col("sigma")) - 1
    label = (F.when(F.abs("relative_error") <= preferred, "WITHIN_PREFERRED_TARGET").when(F.abs("relative_error") <= acceptable, "WITHIN_ACCEPTABLE_TARGET")
             .otherwise("OUTSIDE_PRACTICAL_TARGET"))
    return rows.withColumn("relative_error", rel).withColumn("f_fe", F.col("f_exp") * (1 + F.col("relative_error"))).withColumn("target", label)


def excluded_with_shape(excluded: DataFrame, candidates: DataFrame, minimum: float) -> DataFrame:
    """Excluded measured modes whose best MAC reaches the minimum (diagnostic only)."""
    best = top_rows(candidates.join(excluded, ["cmp_id", "exp_mode"], "left_semi").filter(F.col("mac").isNotNull()), ["cmp_id", "exp_mode"], [F.desc("mac"), "fe_mode"])
    return best.filter(F.col("mac") >= minimum).join(excluded.select("cmp_id", "exp_mode", "reason"), ["cmp_id", "exp_mode"]).withColumn("relative_error", F.col("fe_hz") / F.col("exp_hz") - 1)


def governed_rows(frozen: DataFrame, roles: DataFrame, families: DataFrame, terms: DataFrame, candidates: DataFrame) -> DataFrame:
    """The governed table: frozen rows with role, family, term membership, baseline and candidate change, and guards."""
    m = terms.select("cmp_id", "term_id", F.size("members").alias("n_members"), F.explode("members").alias("row_id"))
    d = (frozen.join(roles, ["cmp_id", "row_id"], "left").join(families, ["cmp_id", "row_id"], "left").join(m, ["cmp_id", "row_id"], "left")
         .join(candidates, ["cmp_id", "row_id"], "left"))
    problem = first_reason((F.col("role").isNull(), "no role"), (F.col("family").isNull(), "no family"), (F.col("term_id").isNull(), "no term"))
    return (d.withColumn("baseline_delta", F.log(F.col("fe_hz") / F.col("exp_hz"))).withColumn("candidate_error", F.expm1("candidate_delta"))
            .withColumn("is_cluster", F.col("n_members") > 1).withColumn("problem", problem))


# ------------------------------------------------------------------------------------------------ consistency
def _sums(terms: DataFrame, keys: list[str]) -> DataFrame:
    c = F.col
    return terms.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(c("j1") * c("j1")).alias("g11"), F.sum(c("j1") * c("j2")).alias("g12"), F.sum(c("j2") * c("j2")).alias("g22"),
                                    F.sum(c("j1") * c("residual")).alias("b1"), F.sum(c("j2") * c("residual")).alias("b2"), F.sum(c("residual") * c("residual")).alias("rr"))


def _full_rank(g11="g11", g12="g12", g22="g22", rcond: float = 1e-3) -> Column:
    """Singular-value rank 2 at rcond, from det / trace of the Gram (smallest / largest eigenvalue > rcond^2)."""
    a, b, d = F.col(g11), F.col(g12), F.col(g22)
    top = (a + d) / 2 + F.sqrt(F.pow((a - d) / 2, 2) + b * b)
    return (top > 0) & ((a * d - b * b) > (rcond * rcond) * top * top)


def _explained(g11="g11", g12="g12", g22="g22", b1="b1", b2="b2") -> Column:
    a, b, d, p, q = (F.col(x) for x in (g11, g12, g22, b1, b2))
    det = a * d - b * b
    return (d * p * p - 2 * b * p * q + a * q * q) / F.when(det > 0, det)


@F.pandas_udf(T.DoubleType())
def chi2_survival(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution (regularised incomplete gamma: series below, continued fraction above)."""
    out = []
    for v, k in zip(x, dof):
        if v is None or k is None or not np.isfinite(v) or k <= 0:
            out.append(None)
            continue
        a, z = k / 2.0, max(v, 0.0) / 2.0
        if z == 0:
            out.append(1.0)
            continue
        front = math.exp(-z + a * math.log(z) - math.lgamma(a))
        if z < a + 1:
            term = total = 1 / a
            n = a
            while abs(term) > abs(total) * 1e-16:
                n += 1
                term *= z / n
                total += term
            out.append(max(0.0, 1 - front * total))
        else:
            b = z + 1 - a
            c, d = 1e300, 1 / b
            h = d
            for i in range(1, 10000):
                an = -i * (i - a)
                b += 2
                d, c = 1 / (an * d + b), b + an / c
                h *= d * c
                if abs(d * c - 1) < 1e-15:
                    break
            out.append(front * h)
    return pd.Series(out, dtype="float64")


def uniform(*parts) -> Column:
    """A uniform number in (0, 1) from a hash of its identity, so a draw never depends on partitioning."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(2 ** 53)


def normal(*parts) -> Column:
    return F.sqrt(-2 * F.log(uniform(F.lit("u"), *parts))) * F.cos(2 * math.pi * uniform(F.lit("v"), *parts))


def family_consistency(terms: DataFrame, campaign: str, specimen: str, chi2_valid: bool, draws: int = 2000, seed: int = 1, alpha: float = 0.01) -> DataFrame:
    """Shared against separate linear models over the specimens of each campaign: delta chi2, dof, chi2 and bootstrap p.

    Terms reduce to normal-equation sums per specimen. The bootstrap statistic depends on the noise only through its
    projections on each specimen's design, which are two independent standard normals per specimen; drawing those has the
    same distribution as drawing every term's noise, so the draws grow with specimens, not with terms.
    """
    if draws < 2000:
        raise ValueError("at least 2000 bootstrap draws are needed")
    s = _sums(terms.filter("role = 'FIT'"), [campaign, specimen]).withColumn("_ok", _full_rank())
    s = s.withColumn("_left", F.when(F.col("_ok"), F.col("rr") - _explained()))
    tot = s.groupBy(campaign).agg(*[F.sum(c).alias(f"t{c}") for c in ("g11", "g12", "g22", "b1", "b2", "rr", "n")], F.count(F.lit(1)).alias("n_specimens"),
                                  F.bool_and("_ok").alias("_all_ok"), F.sum("_left").alias("chi2_separate"))
    tot = tot.withColumn("_shared_ok", _full_rank("tg11", "tg12", "tg22")).withColumn("chi2_shared", F.when(F.col("_shared_ok"), F.col("trr") - _explained("tg11", "tg12", "tg22", "tb1", "tb2")))
    bad = ~F.col("_all_ok") | ~F.col("_shared_ok")
    tot = tot.withColumn("dof", 2 * (F.col("n_specimens") - 1)).withColumn("delta", F.when(~bad & (F.col("n_specimens") > 1), F.col("chi2_shared") - F.col("chi2_separate")))
    good = tot.filter(F.col("delta").isNotNull()).select(campaign, "tg11", "tg12", "tg22", "delta")
    d = s.join(good, campaign).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    ident = [F.lit(seed), F.col("draw"), F.col(campaign), F.col(specimen)]
    d = d.withColumn("u1", normal(F.lit(1), *ident)).withColumn("u2", normal(F.lit(2), *ident))
    l11 = F.sqrt("g11")
    l21 = F.col("g12") / l11
    l22 = F.sqrt(F.greatest(F.col("g22") - l21 * l21, F.lit(0.0)))
    b = d.groupBy(campaign, "draw", "tg11", "tg12", "tg22", "delta").agg(
        F.sum(F.col("u1") * F.col("u1") + F.col("u2") * F.col("u2")).alias("uu"), F.sum(l11 * F.col("u1")).alias("w1"), F.sum(l21 * F.col("u1") + l22 * F.col("u2")).alias("w2"))
    stat = F.col("uu") - _explained("tg11", "tg12", "tg22", "w1", "w2")
    p = b.groupBy(campaign).agg(((1 + F.sum((stat >= F.col("delta")).cast("int"))) / float(draws + 1)).alias("bootstrap_p"))
    out = tot.join(p, campaign, "left").withColumn("chi2_p", chi2_survival(F.col("delta"), F.col("dof")))
    decisive = F.col("chi2_p") if chi2_valid else F.col("bootstrap_p")
    status = (F.when(bad, "NOT_EVALUABLE_RANK_DEFICIENT").when(F.col("n_specimens") < 2, "NOT_EVALUABLE").when(decisive < alpha, "FAIL").otherwise("PASS"))
    return out.withColumn("status", status).select(campaign, "n_specimens", "chi2_shared", "chi2_separate", "delta", "dof", "chi2_p", "bootstrap_p", "status")


def leave_one_family_out(terms: DataFrame, keys: list[str]) -> DataFrame:
    """Parameter shifts when each family is left out: its sums are taken off the totals, so no fold is re-read.

    Returns one row per (key, family) with the shifts, or a refusal."""
    fam = _sums(terms.filter("role = 'FIT'"), [*keys, "family"])
    cols = ("n", "g11", "g12", "g22", "b1", "b2")
    tot = fam.groupBy(*keys).agg(*[F.sum(c).alias(f"t{c}") for c in cols])
    d = fam.join(tot, keys)
    for c in cols:
        d = d.withColumn(c, F.col(f"t{c}") - F.col(c)).drop(f"t{c}")
    ok = _full_rank()
    det = F.when(ok, F.col("g11") * F.col("g22") - F.col("g12") * F.col("g12"))
    d = d.withColumn("status", F.when(F.col("n") == 0, "REFUSED_NO_FIT_TERMS").when(ok, "VALID").otherwise("REFUSED_RANK_DEFICIENT"))
    return (d.withColumn("shift_1", -(F.col("g22") * F.col("b1") - F.col("g12") * F.col("b2")) / det)
            .withColumn("shift_2", -(F.col("g11") * F.col("b2") - F.col("g12") * F.col("b1")) / det)
            .select(*keys, "family", "n", "status", "shift_1", "shift_2"))


def robustness_range(cases: DataFrame, keys: list[str]) -> DataFrame:
    n = lambda v: F.sum((F.col("status") == v).cast("int"))
    g = cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_families"), n("VALID").alias("n_valid"), *[f(f"shift_{i}").alias(f"{nm}_{i}") for i in (1, 2) for nm, f in (("low", F.min), ("high", F.max))])
    for i in (1, 2):
        g = g.withColumn(f"half_range_{i}", 0.5 * (F.exp(f"high_{i}") - F.exp(f"low_{i}")))
    return g.withColumn("complete", (F.col("n_valid") == F.col("n_families")) & (F.col("n_valid") > 0))


# ------------------------------------------------------------------------------------------------ Monte Carlo
def draw_measurements(measurements: DataFrame, draws: int, seed: int, keys: list[str], attempts: int = 100) -> DataFrame:
    """Positive normal draws of every measurement (fixed where its uncertainty is 0); further attempts are made only for a
    non-positive draw, and a draw that never turns positive is NULL.

    ``measurements``: keys, name, value, std_unc."""
    # all names and draws of a key then share a partition, so a draw is put together without another shuffle
    d = dealt(measurements, *keys).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    at = lambda k: F.col("value") + F.col("std_unc") * normal(F.lit(seed), F.col("draw"), k, F.col("name"), *[F.col(c) for c in keys])
    first = at(F.lit(1))
    again = F.get(F.filter(F.transform(F.sequence(F.lit(2), F.lit(attempts)), lambda k: at(k)), lambda v: v > 0), F.lit(0))
    return d.withColumn("sample", F.when(F.col("std_unc") == 0, F.col("value")).when(first > 0, first).otherwise(again))


def derive_plate(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Areal mass (kg/m2) and thickness (m) of each draw from mass m (kg) and L, W, h (mm); a failed draw stays NULL."""
    pick = lambda n: F.max(F.when(F.col("name") == n, F.col("sample")))
    g = samples.groupBy(*keys, "draw").agg(pick("m").alias("m"), pick("L").alias("l"), pick("W").alias("w"), pick("h").alias("h"))
    return g.withColumn("areal_mass", F.col("m") / (F.col("l") * F.col("w") * 1e-6)).withColumn("h_m", F.col("h") * 1e-3)


def summarise_samples(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, median, sd (n - 1), 2.5 / 97.5 percentile and success counts (NULL = failed draw)."""
    g = samples.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("_p"),
                                   F.count(value).alias("n_ok"), F.count(F.lit(1)).alias("_n"))
    return (g.withColumn("low", F.get("_p", F.lit(0))).withColumn("median", F.get("_p", F.lit(1))).withColumn("high", F.get("_p", F.lit(2)))
            .withColumn("n_failed", F.col("_n") - F.col("n_ok")).withColumn("share_ok", F.col("n_ok") / F.col("_n")).drop("_p", "_n"))


def variance_shares(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of the variance of a log quantity from thickness (-3 ln h), stiffness and the rest (needs h, stiffness, total)."""
    g = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.var_samp(-3 * F.log("h")).alias("vh"), F.var_samp(F.log("stiffness")).alias("vs"), F.var_samp(F.log("total")).alias("vt"))
    rest = F.greatest(F.col("vt") - F.col("vh") - F.col("vs"), F.lit(0.0))
    den = F.col("vh") + F.col("vs") + rest
    share = lambda v: F.when((F.col("n") < 2) | (den == 0), 0.0).otherwise(v / F.when(den > 0, den))
    return g.withColumn("thickness_share", share(F.col("vh"))).withColumn("stiffness_share", share(F.col("vs"))).withColumn("rest_share", share(rest))


def interval_coverage(rows: DataFrame, keys: list[str], target: float = 0.95, tolerance: float = 0.05) -> DataFrame:
    g = rows.groupBy(*keys).agg(F.avg(F.col("truth").between(F.col("low"), F.col("high")).cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("passed", F.abs(F.col("coverage") - target) <= tolerance)

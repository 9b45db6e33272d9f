"""Queries of linear models with three parameters; the oracles solve them by Cramer's rule and walk all faces of the box."""
from __future__ import annotations

from pyspark.sql import functions as F

from modalframe.operators import linear as li
from modalframe.plans.registry import query

J = ["j1", "j2", "j3"]
TERMS = "SELECT *, specimen_id % 10 AS campaign_id, (f_exp - 130e0) / 30e0 AS j3 FROM fx_terms"
SUMS = "count(*) AS n, sum({0}1 * {0}1) AS a11, sum({0}1 * {0}2) AS a12, sum({0}1 * {0}3) AS a13, sum({0}2 * {0}2) AS a22, sum({0}2 * {0}3) AS a23, sum({0}3 * {0}3) AS a33, sum({0}1 * {1}) AS b1, sum({0}2 * {1}) AS b2, sum({0}3 * {1}) AS b3, sum({1} * {1}) AS rr"
NAMES = ("n", "a11", "a12", "a13", "a22", "a23", "a33", "b1", "b2", "b3")
DET = "(a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13))"
X1 = f"(b1 * (a22 * a33 - a23 * a23) - a12 * (b2 * a33 - a23 * b3) + a13 * (b2 * a23 - a22 * b3)) / {DET}"
X2 = f"(a11 * (b2 * a33 - a23 * b3) - b1 * (a12 * a33 - a23 * a13) + a13 * (a12 * b3 - b2 * a13)) / {DET}"
X3 = f"(a11 * (a22 * b3 - b2 * a23) - a12 * (a12 * b3 - b2 * a13) + b1 * (a12 * a23 - a22 * a13)) / {DET}"
FULL = f"n >= 3 AND {DET} > 1e-12 * pow(a11 + a22 + a33, 3)"
LEFT = f"rr - (b1 * {X1} + b2 * {X2} + b3 * {X3})"


@query("a45_shared_against_separate_k3", "campaign_id:i n_specimens:i chi2_shared:3 chi2_separate:3 delta:3 dof:i",
       f"""WITH t AS ({TERMS}), s AS (SELECT campaign_id, specimen_id, {SUMS.format('j', 'residual')} FROM t WHERE role = 'FIT' GROUP BY 1, 2),
 g AS (SELECT campaign_id, {SUMS.format('j', 'residual')} FROM t WHERE role = 'FIT' GROUP BY 1),
 own AS (SELECT campaign_id, count(*) AS n_specimens, bool_and({FULL}) AS every, sum({LEFT}) AS chi2_separate FROM s GROUP BY 1),
 both_ AS (SELECT campaign_id, n_specimens, every AND {FULL} AND n_specimens > 1 AS ok, CASE WHEN {FULL} THEN {LEFT} END AS chi2_shared, CASE WHEN every THEN chi2_separate END AS chi2_separate FROM own JOIN g USING (campaign_id))
 SELECT campaign_id, n_specimens, chi2_shared, chi2_separate, CASE WHEN ok THEN chi2_shared - chi2_separate END AS delta, 3 * (n_specimens - 1) AS dof FROM both_""")
def a45_chi2(t):
    return li.shared_against_separate(t.sql(TERMS), "campaign_id", "specimen_id", J)[1]


@query("a45_family_consistency_k3", "campaign_id:i n_specimens:i delta:3 dof:i chi2_p:6 bootstrap_p:6 status")
def a45(t):
    return li.consistency(t.sql(TERMS), "campaign_id", "specimen_id", J, chi2_valid=True)


LEFT_OUT = f"""t AS ({TERMS}), s AS (SELECT specimen_id, family, {SUMS.format('j', 'residual')} FROM t WHERE role = 'FIT' GROUP BY 1, 2),
 w AS (SELECT specimen_id, family, {', '.join(f'sum({c}) OVER x - {c} AS {c}' for c in NAMES)} FROM s WINDOW x AS (PARTITION BY specimen_id)),
 lo AS (SELECT specimen_id, family, n, CASE WHEN n = 0 THEN 'REFUSED_NO_FIT_TERMS' WHEN {FULL} THEN 'VALID' ELSE 'REFUSED_RANK_DEFICIENT' END AS status,
  CASE WHEN {FULL} THEN -{X1} END AS shift_1, CASE WHEN {FULL} THEN -{X2} END AS shift_2, CASE WHEN {FULL} THEN -{X3} END AS shift_3 FROM w)"""


@query("a46_leave_one_family_out_k3", "specimen_id:i family n:i status shift_1:5 shift_2:5 shift_3:5", f"WITH {LEFT_OUT} SELECT * FROM lo")
def a46(t):
    d = li.left_out_shifts(t.sql(TERMS), ["specimen_id"], J)
    return d.select("*", *[F.get("shift", F.lit(i)).alias(f"shift_{i + 1}") for i in range(3)])


@query("a46_robustness_range_k3", "specimen_id:i parameter n_families:i n_valid:i low:5 high:5 half_range:5 complete",
       f"""WITH {LEFT_OUT}, p AS (SELECT specimen_id, status, unnest(['j1', 'j2', 'j3']) AS parameter, unnest([shift_1, shift_2, shift_3]) AS v FROM lo)
 SELECT specimen_id, parameter, count(*) AS n_families, count(*) FILTER (status = 'VALID') AS n_valid, min(v) AS low, max(v) AS high, 0.5e0 * (exp(max(v)) - exp(min(v))) AS half_range,
 count(*) FILTER (status = 'VALID') = count(*) AS complete FROM p GROUP BY 1, 2""")
def a46_range(t):
    return li.shift_ranges(li.left_out_shifts(t.sql(TERMS), ["specimen_id"], J), ["specimen_id"], J)


S = ["s1", "s2", "s3"]
RAW = """SELECT family_id, term_id, max(f0) AS f0, max(CASE WHEN parameter = 'E1' THEN s END) AS s1, max(CASE WHEN parameter = 'E2' THEN s END) AS s2, (term_id % 11 - 5) / 40e0 AS s3 FROM fx_sens GROUP BY family_id, term_id"""
FIT_TERMS = f"SELECT *, f0 * exp((0.3e0 * (family_id % 5) - 0.5e0) * s1 + 0.4e0 * (family_id % 3) * s2 + (0.45e0 * (family_id % 4) - 0.9e0) * s3 + 0.002e0 * (term_id % 7 - 3)) AS f_exp FROM ({RAW}) AS raw_terms"
FACES = f"""t AS (SELECT *, ln(f_exp / f0) AS y FROM ({FIT_TERMS}) AS fit_terms), g AS (SELECT family_id, {SUMS.format('s', 'y')} FROM t GROUP BY 1),
 q AS (SELECT family_id, {FULL} AS ok FROM g), e AS (SELECT unnest([-1e0, 0e0, 1e0]) AS e),
 h AS (SELECT g.*, ln(2e0) * e1.e AS e1, ln(2e0) * e2.e AS e2, ln(2e0) * e3.e AS e3 FROM g CROSS JOIN e AS e1 CROSS JOIN e AS e2 CROSS JOIN e AS e3),
 m AS (SELECT family_id, a11 AS g11, a12 AS g12, a13 AS g13, a22 AS g22, a23 AS g23, a33 AS g33, b1 AS c1, b2 AS c2, b3 AS c3,
  CASE WHEN e1 = 0 THEN a11 ELSE 1e0 END AS a11, CASE WHEN e2 = 0 THEN a22 ELSE 1e0 END AS a22, CASE WHEN e3 = 0 THEN a33 ELSE 1e0 END AS a33,
  CASE WHEN e1 = 0 AND e2 = 0 THEN a12 ELSE 0e0 END AS a12, CASE WHEN e1 = 0 AND e3 = 0 THEN a13 ELSE 0e0 END AS a13, CASE WHEN e2 = 0 AND e3 = 0 THEN a23 ELSE 0e0 END AS a23,
  CASE WHEN e1 = 0 THEN b1 - a12 * e2 - a13 * e3 ELSE e1 END AS b1, CASE WHEN e2 = 0 THEN b2 - a12 * e1 - a23 * e3 ELSE e2 END AS b2, CASE WHEN e3 = 0 THEN b3 - a13 * e1 - a23 * e2 ELSE e3 END AS b3 FROM h),
 x AS (SELECT *, {X1} AS x1, {X2} AS x2, {X3} AS x3 FROM m),
 v AS (SELECT *, (g11 * x1 * x1 + g22 * x2 * x2 + g33 * x3 * x3) / 2 + g12 * x1 * x2 + g13 * x1 * x3 + g23 * x2 * x3 - c1 * x1 - c2 * x2 - c3 * x3 AS cost FROM x
  WHERE greatest(abs(x1), abs(x2), abs(x3)) <= ln(2e0) + 1e-12),
 best AS (SELECT family_id, arg_min(x1, cost) AS x1, arg_min(x2, cost) AS x2, arg_min(x3, cost) AS x3 FROM v GROUP BY 1),
 fit AS (SELECT q.family_id, ok, CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN x2 END AS x2, CASE WHEN ok THEN x3 END AS x3 FROM q LEFT JOIN best USING (family_id))"""


@query("a59_bounded_fit_k3", "family_id:i parameter status ratio:5 at_bound beyond_range",
       f"""WITH {FACES}, p AS (SELECT family_id, ok, unnest(['s1', 's2', 's3']) AS parameter, unnest([x1, x2, x3]) AS x FROM fit)
 SELECT family_id, parameter, CASE WHEN ok THEN 'FITTED' ELSE 'REFUSED_RANK_DEFICIENT' END AS status, exp(x) AS ratio, coalesce(abs(abs(x) - ln(2e0)) <= 1e-9, false) AS at_bound,
 coalesce(abs(x) > ln(1.05e0), false) AS beyond_range FROM p""")
def a59(t):
    return li.boxed_parameters(li.boxed_fit(t.sql(FIT_TERMS), ["family_id"], S), ["family_id"], S)


@query("a59_fit_residuals_k3", "family_id:i term_id:i error_before:5 error_after:4",
       f"WITH {FACES} SELECT family_id, term_id, 100 * (f0 / f_exp - 1) AS error_before, 100 * (f0 * exp(s1 * x1 + s2 * x2 + s3 * x3) / f_exp - 1) AS error_after FROM t JOIN fit USING (family_id)")
def a59_residuals(t):
    terms = t.sql(FIT_TERMS)
    return li.boxed_residuals(terms, li.boxed_fit(terms, ["family_id"], S), ["family_id"], S)

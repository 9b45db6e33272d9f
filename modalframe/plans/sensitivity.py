"""Queries of sensitivities, identifiability, what-if, plate constants and matrix algebra."""
from __future__ import annotations

from pyspark.sql import functions as F

from modalframe.operators import sensitivity as se
from modalframe.plans.registry import query

# Sensitivities -------------------------------------------------------------------------------------------------------
CENTRAL_SQL = """g AS (SELECT family_id, term_id, parameter, max(f0) AS f0, max(CASE WHEN side = 'minus' THEN f END) AS fm, max(CASE WHEN side = 'plus' THEN f END) AS fp FROM fx_states GROUP BY 1, 2, 3),
 cs AS (SELECT *, ln(fp / fm) / ln(1.05e0 / 0.95e0) AS s, CASE WHEN fm IS NULL OR fp IS NULL THEN 'UNAVAILABLE' ELSE 'CENTRAL' END AS status,
 CASE WHEN fp IS NOT NULL THEN ln(f0 / fm) / ln(1e0 / 0.95e0) END AS s_minus, CASE WHEN fp IS NOT NULL THEN ln(fp / f0) / ln(1.05e0) END AS s_plus FROM g)"""


@query("a32_central_sensitivity", "family_id:i term_id:i parameter s:6 s_minus:6 s_plus:6 one_sided_difference:6 status",
       f"WITH {CENTRAL_SQL} SELECT *, s_plus - s_minus AS one_sided_difference FROM cs")
def a32(t):
    return se.central_sensitivities(t.states)


VARIANTS = """SELECT family_id, term_id, CASE WHEN term_id % 10 IN (3, 4) THEN CAST(floor(term_id / 10) AS BIGINT) END AS cluster_id, parameter, v AS variant_no, 1e0 + 0.05e0 * v AS ratio, f0,
 CASE WHEN v = 1 AND term_id % 7 = 0 THEN NULL WHEN term_id % 35 = 5 THEN NULL ELSE f0 * pow(1e0 + 0.05e0 * v, s) END AS f FROM fx_sens CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 AS v) vs"""


@query("a33_secant_sensitivity", "family_id:i term_id:i parameter s:6 used_variant:i",
       f"""WITH v AS ({VARIANTS}), u AS (SELECT family_id, coalesce('c' || cluster_id, 't' || term_id) AS unit, parameter, variant_no, CASE WHEN count(f) = count(*) THEN (avg(ln(f)) - avg(ln(f0))) / ln(any_value(ratio)) END AS s FROM v GROUP BY 1, 2, 3, 4),
 k AS (SELECT family_id, unit, parameter, min(CASE WHEN s IS NOT NULL THEN variant_no END) AS used_variant FROM u GROUP BY 1, 2, 3)
 SELECT DISTINCT v.family_id, v.term_id, v.parameter, u.s, k.used_variant FROM v JOIN k ON k.family_id = v.family_id AND k.unit = coalesce('c' || cluster_id, 't' || term_id) AND k.parameter = v.parameter
 LEFT JOIN u ON u.family_id = k.family_id AND u.unit = k.unit AND u.parameter = k.parameter AND u.variant_no = k.used_variant""")
def a33(t):
    return se.secant_sensitivities(t.sql(VARIANTS))


HOLED = "SELECT family_id, term_id, parameter, f0, brand, CASE WHEN term_id % 23 = 0 AND parameter = 'E2' THEN NULL ELSE s END AS s FROM fx_sens"


@query("a35_sensitivity_matrix", "family_id:i row_id parameter s:6 complete",
       f"""WITH h AS ({HOLED}), r AS (SELECT family_id, CASE WHEN term_id % 10 IN (3, 4) THEN 'C' || CAST(floor(term_id / 10) AS BIGINT) ELSE 'T' || term_id END AS row_id, parameter, avg(s) AS s, count(s) = count(*) AS ok FROM h GROUP BY 1, 2, 3)
 SELECT family_id, row_id, parameter, CASE WHEN complete THEN s END AS s, complete FROM (SELECT *, bool_and(ok) OVER (PARTITION BY family_id, row_id) AS complete FROM r)""")
def a35(t):
    m = t.sens.filter("parameter = 'E1' and term_id % 10 in (3, 4)").groupBy("family_id", F.floor(F.col("term_id") / 10).cast("bigint").alias("cluster_id")).agg(F.collect_list("term_id").alias("members"))
    return se.assemble_terms(t.sql(HOLED), m)


@query("u05_joint_parameter_union", "family_id:i term_id:i parameter s:6 variant",
       """SELECT family_id, term_id, parameter, s, 'base' AS variant FROM fx_sens UNION ALL SELECT family_id, term_id, 'E', sum(s), 'joint' FROM fx_sens GROUP BY 1, 2""")
def u05(t):
    return se.joint_parameter(t.sens)


@query("p35_thickness_sensitivity", "family_id:i term_id:i s_h:6", "SELECT family_id, term_id, 3 * sum(s) AS s_h FROM fx_sens GROUP BY 1, 2")
def p35(t):
    return se.thickness_sensitivity(t.sens, ["family_id", "term_id"])


STATE_IN = """SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS family_id, CONCAT('P', p_partkey % 3) AS parameter, p_partkey AS state_id, 0.8e0 + 0.01e0 * p_size AS value, CASE WHEN p_partkey % 3 = 2 THEN 0.805e0 ELSE 1.05e0 END AS p0 FROM part"""


@query("j38_nearest_states", "family_id:i parameter minus_state:i plus_state:i missing",
       f"""WITH s AS ({STATE_IN}), m AS (SELECT family_id, parameter, arg_max(state_id, (value, -state_id)) AS minus_state FROM s WHERE value < p0 GROUP BY 1, 2), p AS (SELECT family_id, parameter, arg_min(state_id, (value, state_id)) AS plus_state FROM s WHERE value > p0 GROUP BY 1, 2)
 SELECT DISTINCT s.family_id, s.parameter, minus_state, plus_state, concat_ws('/', CASE WHEN minus_state IS NULL THEN 'minus' END, CASE WHEN plus_state IS NULL THEN 'plus' END) AS missing
 FROM s LEFT JOIN m USING (family_id, parameter) LEFT JOIN p USING (family_id, parameter)""")
def j38(t):
    return se.nearest_states(t.sql(STATE_IN))


@query("a36_combined_uncertainty", "family_id:i term_id:i parameter sigma:8 whitened:4 problem",
       """WITH u AS (SELECT *, CASE WHEN term_id % 5 = 0 THEN NULL ELSE 0.2e0 + 0.01e0 * (term_id % 9) END AS a, CASE WHEN term_id % 7 = 0 THEN NULL ELSE 0.3e0 END AS b FROM fx_sens)
 SELECT family_id, term_id, parameter, sqrt(CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce(a * a, 0e0) + coalesce(b * b, 0e0) END) / f0 AS sigma, s / (sqrt(CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce(a * a, 0e0) + coalesce(b * b, 0e0) END) / f0) AS whitened,
 CASE WHEN a IS NULL AND b IS NULL THEN 'no uncertainty' END AS problem FROM u""")
def a36(t):
    u = t.sens.withColumn("a", F.expr("CASE WHEN term_id % 5 = 0 THEN NULL ELSE 0.2D + 0.01D * (term_id % 9) END")).withColumn("b", F.expr("CASE WHEN term_id % 7 = 0 THEN NULL ELSE 0.3D END"))
    return se.whiten(se.combine_uncertainties(u, ["a", "b"], "f0").withColumn("whitened", F.col("s")), ["whitened"])


@query("a36_full_covariance_whitening", "family_id:i row_no:i s1:6 s2:6")
def a36_full(t):
    s = t.sens.groupBy("family_id", (F.col("term_id") % 40).alias("row_no")).agg(
        F.max(F.when(F.col("parameter") == "E1", F.col("s"))).alias("s1"), F.max(F.when(F.col("parameter") == "E2", F.col("s"))).alias("s2"))
    terms = s.groupBy("family_id").agg(F.sort_array(F.collect_set("row_no")).alias("terms"))  # the first and last family may have fewer
    cov = s.join(terms, "family_id").select("family_id", "row_no", F.transform("terms", lambda c: F.when(c == F.col("row_no"), 1.0).otherwise(0.2)).alias("cov"))
    return se.whiten_full(s, cov, ["family_id"], ["s1", "s2"])


GRAM_SQL = """r AS (SELECT family_id, term_id, max(CASE WHEN parameter = 'E1' THEN s END) AS a, max(CASE WHEN parameter = 'E2' THEN s END) AS b FROM fx_sens GROUP BY 1, 2),
 g AS (SELECT family_id, count(*) AS n_terms, sum(a * a) * {w} AS g11, sum(a * b) * {w} AS g12, sum(b * b) * {w} AS g22 FROM r GROUP BY 1),
 sp AS (SELECT *, sqrt((g11 + g22) / 2 + sqrt(pow((g11 - g22) / 2, 2) + g12 * g12)) AS sv1, sqrt(greatest((g11 + g22) / 2 - sqrt(pow((g11 - g22) / 2, 2) + g12 * g12), 0e0)) AS sv2 FROM g)"""


@query("a37_fisher_spectrum", "family_id:i n_terms:i sv1:6 sv2:6 rank:i condition:4",
       f"WITH {GRAM_SQL.format(w='1e0')} SELECT *, CASE WHEN sv1 > 0 THEN 1 ELSE 0 END + CASE WHEN sv2 > 1e-3 * sv1 THEN 1 ELSE 0 END AS rank, sv1 / nullif(sv2, 0e0) AS condition FROM sp")
def a37(t):
    return se.spectrum_2x2(se.two_parameter_gram(t.sens, ["family_id"], ("E1", "E2")))


@query("a38_practical_identifiability", "family_id:i rank:i status sd_1:6 sd_2:6 correlation:6 cosine:6 q_1:6 q_2:6 over_1 over_2",
       f"""WITH {GRAM_SQL.format(w='(1e0 / (0.003e0 * 0.003e0))')}, x AS (SELECT *, g11 * g22 - g12 * g12 AS det, 1 + CASE WHEN sv2 > 1e-3 * sv1 THEN 1 ELSE 0 END AS rank FROM sp)
 SELECT family_id, rank, CASE WHEN rank = 2 THEN 'FULL_RANK' ELSE 'RANK_DEFICIENT' END AS status, sqrt(g22 / det) AS sd_1, sqrt(g11 / det) AS sd_2, -g12 / sqrt(g11 * g22) AS correlation, g12 / sqrt(g11 * g22) AS cosine,
 sqrt((g11 - g12 * g12 / g22) / g11) AS q_1, sqrt((g22 - g12 * g12 / g11) / g22) AS q_2, sqrt(g22 / det) > 0.08 AS over_1, sqrt(g11 / det) > 0.08 AS over_2 FROM x""")
def a38(t):
    return se.practical_identifiability(se.two_parameter_gram(t.sens, ["family_id"], ("E1", "E2"), 0.003))


def three_parameters(t):
    extra = t.sens.filter("parameter = 'E1'").withColumn("parameter", F.lit("G12")).withColumn("s", 0.5 - F.col("s") + 0.01 * (F.col("term_id") % 3))
    return t.sens.unionByName(extra)


GRAM3_SQL = """w AS (SELECT family_id, term_id, max(CASE WHEN parameter = 'E1' THEN s END) AS a, max(CASE WHEN parameter = 'E2' THEN s END) AS b FROM fx_sens GROUP BY 1, 2),
 r3 AS (SELECT family_id, a, b, 0.5e0 - a + 0.01e0 * (term_id % 3) AS c FROM w WHERE a IS NOT NULL AND b IS NOT NULL),
 g AS (SELECT family_id, count(*) AS n_terms, sum(a * a) * {w} AS aa, sum(b * b) * {w} AS bb, sum(c * c) * {w} AS cc, sum(a * b) * {w} AS ab, sum(a * c) * {w} AS ac, sum(b * c) * {w} AS bc FROM r3 GROUP BY 1),
 h AS (SELECT *, (aa + bb + cc) / 3 AS q, aa * bb * cc + 2 * ab * ac * bc - aa * bc * bc - bb * ac * ac - cc * ab * ab AS det FROM g),
 i AS (SELECT *, sqrt((pow(aa - q, 2) + pow(bb - q, 2) + pow(cc - q, 2) + 2 * (ab * ab + ac * ac + bc * bc)) / 6) AS p FROM h),
 j AS (SELECT *, acos(greatest(-1e0, least(1e0, ((aa - q) * (bb - q) * (cc - q) + 2 * ab * ac * bc - (aa - q) * bc * bc - (bb - q) * ac * ac - (cc - q) * ab * ab) / (2 * p * p * p)))) / 3 AS phi FROM i),
 k AS (SELECT *, q + 2 * p * cos(phi) AS e1, q + 2 * p * cos(phi + 2 * pi() / 3) AS e3 FROM j),
 sp3 AS (SELECT *, sqrt(e1) AS sv1, sqrt(3 * q - e1 - e3) AS sv2, sqrt(greatest(e3, 0e0)) AS sv3 FROM k)"""


@query("a37_three_parameter_spectrum", "family_id:i n_terms:i sv1:5 sv2:5 sv3:5 rank:i condition:2",
       f"WITH {GRAM3_SQL.format(w='1e0')} SELECT family_id, n_terms, sv1, sv2, sv3, 1 + CASE WHEN sv2 > 1e-3 * sv1 THEN 1 ELSE 0 END + CASE WHEN sv3 > 1e-3 * sv1 THEN 1 ELSE 0 END AS rank, sv1 / nullif(sv3, 0e0) AS condition FROM sp3")
def a37_three(t):
    return se.spectrum(se.gram_arrays(three_parameters(t), ["family_id"])).withColumns({f"sv{i + 1}": F.get("sv", F.lit(i)) for i in range(3)})


@query("a38_three_parameter_identifiability", "family_id:i parameter rank:i status sd:5 q:5 over",
       f"""WITH {GRAM3_SQL.format(w='(1e0 / (0.003e0 * 0.003e0))')}, m AS (SELECT *, 1 + CASE WHEN sv2 > 1e-3 * sv1 THEN 1 ELSE 0 END + CASE WHEN sv3 > 1e-3 * sv1 THEN 1 ELSE 0 END AS rank FROM sp3),
 n AS (SELECT family_id, rank, 'E1' AS parameter, aa AS own, (bb * cc - bc * bc) / det AS inv FROM m UNION ALL SELECT family_id, rank, 'E2', bb, (aa * cc - ac * ac) / det FROM m UNION ALL SELECT family_id, rank, 'G12', cc, (aa * bb - ab * ab) / det FROM m)
 SELECT family_id, parameter, rank, CASE WHEN rank = 3 THEN 'FULL_RANK' ELSE 'RANK_DEFICIENT' END AS status, CASE WHEN rank = 3 THEN sqrt(inv) END AS sd, CASE WHEN rank = 3 THEN sqrt(1 / (own * inv)) END AS q, CASE WHEN rank = 3 THEN sqrt(inv) > 0.08 END AS over FROM n""")
def a38_three(t):
    return se.identifiability(se.gram_arrays(three_parameters(t), ["family_id"]), ["family_id"], 0.003)


@query("a39_parameter_subsets", "family_id:i subset size:i rank:i condition:3 gamma:3 admissible")
def a39(t):
    return se.parameter_subsets(se.gram_arrays(three_parameters(t), ["family_id"]), ["family_id"])


@query("k05_ranked_subsets", "family_id:i subset position:i normalized_min:5 min_singular:5",
       f"""WITH {GRAM_SQL.format(w='1e0')}, u AS (SELECT family_id, 'E1' AS subset, 1 AS size, sqrt(g11) AS min_singular, 1e0 AS nm FROM sp UNION ALL SELECT family_id, 'E2', 1, sqrt(g22), 1e0 FROM sp
 UNION ALL SELECT family_id, 'E1+E2', 2, sv2, sqrt(1e0 - g12 / sqrt(g11 * g22)) FROM sp)
 SELECT family_id, subset, nm AS normalized_min, min_singular, row_number() OVER (PARTITION BY family_id ORDER BY size DESC, round(nm, 9) DESC, round(min_singular, 9) DESC, subset) AS position FROM u""")
def k05(t):
    return se.rank_subsets(se.parameter_subsets(se.gram_arrays(t.sens, ["family_id"]), ["family_id"]), ["family_id"])


@query("a40_local_covariance", "family_id:i parameter rank:i status sd:6 low:6 high:6")
def a40(t):
    est = t.sens.select("family_id", "parameter").distinct().withColumn("estimate", F.when(F.col("parameter") == "E1", 0.5).otherwise(0.2))
    weighted = t.sens.withColumn("s", F.col("s") * F.sqrt(1.0 + F.col("term_id") % 3))
    return se.local_covariance(se.gram_arrays(weighted, ["family_id"]), ["family_id"], est)


@query("p31_precision_assessment", "family_id:i parameter achieved:6 verdict",
       f"""WITH {GRAM_SQL.format(w='1e0')}, d AS (SELECT family_id, 'E1' AS parameter, sqrt(g22 / (g11 * g22 - g12 * g12)) AS sd FROM sp UNION ALL SELECT family_id, 'E2', sqrt(g11 / (g11 * g22 - g12 * g12)) FROM sp)
 SELECT family_id, parameter, CASE WHEN parameter = 'E1' THEN sd * 2e0 END AS achieved, CASE WHEN parameter = 'E2' THEN 'NOT_ASSESSED' WHEN sd * 2e0 <= 1.5 THEN 'PASS' ELSE 'FAIL_IMPRECISE' END AS verdict FROM d""")
def p31(t):
    c = se.local_covariance(se.gram_arrays(t.sens, ["family_id"]), ["family_id"])
    c = c.withColumn("scaled_sd", F.col("sd")).withColumn("transformed_sd", F.col("sd")).withColumn("physical_sd", F.col("sd") * 2.0)
    req = t.sens.select("parameter").distinct().filter("parameter = 'E1'").withColumn("coordinate", F.lit("physical")).withColumn("maximum", F.lit(1.5))
    return se.assess_precision(c, req, ["family_id"])


# What-if and fits ----------------------------------------------------------------------------------------------------
TRIALS = """SELECT family_id, k AS trial_id, parameter, CASE k WHEN 0 THEN 1.02e0 WHEN 1 THEN 0.97e0 ELSE 1.1e0 END + CASE WHEN parameter = 'E2' THEN 0.01e0 ELSE 0e0 END AS value FROM (SELECT DISTINCT family_id, parameter FROM fx_sens) f
 CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k) ks WHERE NOT (k = 0 AND parameter = 'E2')"""
WHAT_SQL = f"""tr AS ({TRIALS}), h AS ({HOLED}), pr AS (SELECT tr.family_id, trial_id, term_id, max(f0) AS f0, CASE WHEN trial_id = 2 THEN 'REFUSED_RANGE' WHEN count(s) < count(*) THEN 'UNAVAILABLE' ELSE 'PREDICTION' END AS status,
 CASE WHEN trial_id <> 2 AND count(s) = count(*) THEN max(f0) * exp(sum(s * ln(value))) END AS predicted_hz FROM tr JOIN h USING (family_id, parameter) GROUP BY 1, 2, 3)"""


def predictions(t):
    ranges = t.sens.select("family_id", "parameter").distinct().select("family_id", "parameter", F.lit(1.0).alias("p0"), F.lit(0.95).alias("lo"), F.lit(1.05).alias("hi"))
    return se.what_if(t.sql(TRIALS), t.sql(HOLED), ranges)


@query("a54_what_if", "family_id:i trial_id:i term_id:i status predicted_hz:4", f"WITH {WHAT_SQL} SELECT * FROM pr")
def a54(t):
    return predictions(t)


@query("a54_what_if_summary", "family_id:i trial_id:i role n_rows:i n_improves:i n_worsens:i summary",
       f"""WITH {WHAT_SQL}, e AS (SELECT *, f0 * (1e0 + 0.01e0 * (term_id % 5 - 2)) AS fe, CASE WHEN term_id % 4 = 0 THEN 'HOLDOUT' ELSE 'FIT' END AS role FROM pr WHERE predicted_hz IS NOT NULL),
 x AS (SELECT *, CASE WHEN abs((predicted_hz - fe) / fe) < abs((f0 - fe) / fe) THEN 'improves' WHEN abs((predicted_hz - fe) / fe) > abs((f0 - fe) / fe) THEN 'worsens' ELSE 'unchanged' END AS effect FROM e),
 g AS (SELECT family_id, trial_id, role, count(*) AS n_rows, count(*) FILTER (effect = 'improves') AS n_improves, count(*) FILTER (effect = 'worsens') AS n_worsens FROM x GROUP BY 1, 2, 3)
 SELECT *, CASE WHEN role = 'FIT' AND n_improves > 0 AND n_worsens > 0 THEN 'MIXED' WHEN n_improves > 0 THEN 'improves' WHEN n_worsens > 0 THEN 'worsens' ELSE 'no change' END AS summary FROM g""")
def a54_summary(t):
    p = predictions(t).withColumn("f_exp", F.col("f0") * (1.0 + 0.01 * (F.col("term_id") % 5 - 2))).withColumn("role", F.when(F.col("term_id") % 4 == 0, "HOLDOUT").otherwise("FIT"))
    return se.effect_summary(se.what_if_effect(p), ["family_id", "trial_id"])


FIT_TERMS = """SELECT family_id, term_id, max(f0) AS f0, max(CASE WHEN parameter = 'E1' THEN s END) AS s1, max(CASE WHEN parameter = 'E2' THEN s END) AS s2,
 max(f0) * exp((0.3e0 * (family_id % 5) - 0.5e0) * max(CASE WHEN parameter = 'E1' THEN s END) + 0.4e0 * (family_id % 3) * max(CASE WHEN parameter = 'E2' THEN s END) + 0.002e0 * (term_id % 7 - 3)) AS f_exp FROM fx_sens GROUP BY 1, 2"""
FIT_SQL = f"""t AS ({FIT_TERMS}), g AS (SELECT family_id, count(*) AS n_terms, sum(s1 * s1) AS g11, sum(s1 * s2) AS g12, sum(s2 * s2) AS g22, sum(s1 * ln(f_exp / f0)) AS b1, sum(s2 * ln(f_exp / f0)) AS b2 FROM t GROUP BY 1),
 i AS (SELECT *, (g22 * b1 - g12 * b2) / (g11 * g22 - g12 * g12) AS u, (g11 * b2 - g12 * b1) / (g11 * g22 - g12 * g12) AS v, ln(2e0) AS m FROM g),
 c AS (SELECT family_id, u AS x1, v AS x2, g11, g12, g22, b1, b2, 0 AS o FROM i WHERE abs(u) <= m AND abs(v) <= m
  UNION ALL SELECT family_id, e * m, least(greatest((b2 - g12 * e * m) / g22, -m), m), g11, g12, g22, b1, b2, 1 FROM i, (SELECT unnest([-1e0, 1e0]) AS e)
  UNION ALL SELECT family_id, least(greatest((b1 - g12 * e * m) / g11, -m), m), e * m, g11, g12, g22, b1, b2, 1 FROM i, (SELECT unnest([-1e0, 1e0]) AS e)),
 fit AS (SELECT family_id, arg_min(x1, g11 * x1 * x1 + 2 * g12 * x1 * x2 + g22 * x2 * x2 - 2 * b1 * x1 - 2 * b2 * x2) AS x1, arg_min(x2, g11 * x1 * x1 + 2 * g12 * x1 * x2 + g22 * x2 * x2 - 2 * b1 * x1 - 2 * b2 * x2) AS x2 FROM c GROUP BY 1)"""


@query("a59_bounded_fit", "family_id:i status ratio_1:5 ratio_2:5 at_bound beyond_range",
       f"""WITH {FIT_SQL} SELECT family_id, 'FITTED' AS status, exp(x1) AS ratio_1, exp(x2) AS ratio_2, abs(abs(x1) - ln(2e0)) <= 1e-9 OR abs(abs(x2) - ln(2e0)) <= 1e-9 AS at_bound,
 abs(x1) > ln(1.05e0) OR abs(x2) > ln(1.05e0) AS beyond_range FROM fit""")
def a59(t):
    return se.bounded_fit(t.sql(FIT_TERMS), ["family_id"])


@query("a59_fit_residuals", "family_id:i term_id:i error_before:5 error_after:4",
       f"WITH {FIT_SQL} SELECT family_id, term_id, 100 * (f0 / f_exp - 1) AS error_before, 100 * (f0 * exp(s1 * x1 + s2 * x2) / f_exp - 1) AS error_after FROM t JOIN fit USING (family_id)")
def a59_residuals(t):
    terms = t.sql(FIT_TERMS)
    return se.fit_residuals(terms, se.bounded_fit(terms, ["family_id"]), ["family_id"])


# Plates --------------------------------------------------------------------------------------------------------------
PLATES = """SELECT p_partkey AS part_id, 40000e0 + 10e0 * p_size AS e1, 38000e0 + p_retailprice AS e2, 4000e0 + p_size AS g12, 0.05e0 + 0.001e0 * p_size AS nu12, 0.5e0 + 0.01e0 * p_size AS h,
 0.3e0 AS s_e1, 0.15e0 AS s_e2, 0.05e0 AS s_g12 FROM part"""


@query("p26_plate_stiffness", "part_id:i d11:3 d22:3 d66:3 e1_back:3 e2_back:3 g12_back:3 s_d11:6 s_d22:6 s_d66:6",
       f"""WITH p AS ({PLATES}), a AS (SELECT *, nu12 * nu12 * e2 / e1 AS a FROM p), c AS (SELECT *, a / (1 - a) AS c FROM a)
 SELECT part_id, e1 * h * h * h / (12 * (1 - a)) AS d11, e2 * h * h * h / (12 * (1 - a)) AS d22, g12 * h * h * h / 12 AS d66, e1 AS e1_back, e2 AS e2_back, g12 AS g12_back, s_e1 * (1 + c) + s_e2 * c AS s_d11, s_e2 * (1 - c) - s_e1 * c AS s_d22, s_g12 AS s_d66 FROM c""")
def p26(t):
    return se.plate_stiffness(t.sql(PLATES))


@query("p26_apparent_flexural", "part_id:i e_flex:3 g12_flex:3 nu12_flex:6",
       f"""WITH p AS (SELECT part_id, e1 * h AS d11, e1 * h * (nu12 * 30e0 - 1.6e0) AS d12, g12 * h AS d66, h FROM ({PLATES})), ok AS (SELECT *, abs(d12) < d11 AS k FROM p)
 SELECT part_id, CASE WHEN k THEN 12 * d11 * (1 - pow(d12 / d11, 2)) / pow(h, 3) END AS e_flex, CASE WHEN k THEN 12 * d66 / pow(h, 3) END AS g12_flex, CASE WHEN k THEN d12 / d11 END AS nu12_flex FROM ok""")
def p26_flex(t):
    d = t.sql(PLATES).select("part_id", (F.col("e1") * F.col("h")).alias("d11"), (F.col("e1") * F.col("h") * (F.col("nu12") * 30.0 - 1.6)).alias("d12"), (F.col("g12") * F.col("h")).alias("d66"), "h")
    return se.apparent_flexural(d)


STATS_SQL = """st AS (SELECT specimen_id, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, stddev_samp(value) / avg(value) AS cv, min(value) AS min, max(value) AS max, avg(CASE WHEN side = 'A' THEN value END) AS mean_a, avg(CASE WHEN side = 'B' THEN value END) AS mean_b FROM fx_meas GROUP BY 1)"""


@query("a51_reading_statistics", "specimen_id:i n:i mean:6 sd:6 cv:6 min:6 max:6 mean_a:6 mean_b:6", f"WITH {STATS_SQL} SELECT * FROM st")
def a51(t):
    return se.reading_statistics(t.meas, ["specimen_id"])


@query("a51_derived_quantities", "specimen_id:i areal_density:6 density:4 readiness",
       f"""WITH {STATS_SQL} SELECT specimen_id, (200e0 + specimen_id % 50) / 1000e0 / (250e0 * 180e0 / 1e6) AS areal_density, (200e0 + specimen_id % 50) / 1000e0 / (250e0 * 180e0 * mean / 1e9) AS density, CASE WHEN n >= 9 THEN 'PASS' ELSE 'BLOCKED' END AS readiness FROM st""")
def a51_derived(t):
    s = se.reading_statistics(t.meas, ["specimen_id"])
    return se.derived_quantities(s.withColumn("mass_g", 200.0 + F.col("specimen_id") % 50).withColumn("length_mm", F.lit(250.0)).withColumn("width_mm", F.lit(180.0)))


@query("a51_reading_variants", "specimen_id:i variant n:i mean:6 cv:6",
       """WITH v AS (SELECT specimen_id, side, value, 'as transcribed' AS variant FROM fx_meas UNION ALL SELECT specimen_id, side, CASE WHEN position = 3 AND specimen_id % 2 = 0 THEN 1.5e0 ELSE value END, 'alternative reading' FROM fx_meas)
 SELECT specimen_id, variant, count(*) AS n, avg(value) AS mean, stddev_samp(value) / avg(value) AS cv FROM v GROUP BY 1, 2""")
def a51_variants(t):
    alt = t.meas.select("specimen_id").distinct().filter("specimen_id % 2 = 0").select("specimen_id", F.lit(3).alias("position"), F.lit(1.5).alias("alternative"))
    return se.reading_statistics(se.reading_variants(t.meas, alt, ["specimen_id"]), ["specimen_id", "variant"])


@query("p27_uncertainty_budget", "specimen_id:i source ln_sd:6 available",
       f"""WITH {STATS_SQL}, x AS (SELECT specimen_id, cv, CASE WHEN specimen_id % 3 = 0 THEN NULL ELSE 0.01e0 END AS st_sd FROM st)
 SELECT specimen_id, source, ln_sd, ln_sd IS NOT NULL AS available FROM (SELECT specimen_id, 'statistical' AS source, st_sd AS ln_sd FROM x UNION ALL SELECT specimen_id, 'thickness', 3 * cv FROM x UNION ALL SELECT specimen_id, 'mass', 0.002e0 FROM x
 UNION ALL SELECT specimen_id, 'setup', 0.003e0 FROM x UNION ALL SELECT specimen_id, 'model_form', NULL FROM x)""")
def p27(t):
    d = se.reading_statistics(t.meas, ["specimen_id"]).select("specimen_id", F.when(F.col("specimen_id") % 3 != 0, 0.01).alias("statistical_sd"), F.col("cv").alias("thickness_cv"),
                                                              F.lit(0.002).alias("mass_rel_sd"), F.lit(0.003).alias("setup_sd"), F.lit(None).cast("double").alias("model_form"))
    return se.budget_lines(d, ["specimen_id"])


CHANGES = """SELECT family_id, CONCAT('c', term_id % 4) AS constant, 0.0005e0 * ((term_id * 7) % (3 + term_id % 4 * 2)) * CASE WHEN term_id % 2 = 0 THEN -1e0 ELSE 1e0 END AS relative_change, term_id % 39 = 0 AS refused FROM fx_sens WHERE parameter = 'E1'"""


@query("p25_constant_classification", "family_id:i constant worst:6 classification",
       f"""WITH c AS ({CHANGES}), g AS (SELECT family_id, constant, max(abs(relative_change)) AS w, bool_or(refused) AS r FROM c GROUP BY 1, 2)
 SELECT family_id, constant, CASE WHEN NOT r THEN w END AS worst, CASE WHEN r THEN 'NOT_CLASSIFIED' WHEN w < 0.003e0 THEN 'NEGLIGIBLE' ELSE 'INCLUDE' END AS classification FROM g""")
def p25(t):
    return se.classify_constants(t.sql(CHANGES), ["family_id", "constant"])


CONSTANTS = """SELECT p_partkey AS part_id, 100e0 + p_size AS e1, 90e0 + p_size AS e2, 10e0 - CASE WHEN p_partkey % 31 = 0 THEN 20e0 ELSE 0e0 END AS e3, 5e0 AS g12, 4e0 AS g13, 4e0 AS g23,
 0.3e0 + 0.02e0 * (p_partkey % 50) AS nu12, 0.3e0 + 0.05e0 * (p_partkey % 60) AS nu13, 0.2e0 + 0.05e0 * (p_partkey % 70) AS nu23 FROM part"""


@query("p32_material_stability", "part_id:i stable reason",
       f"""WITH c AS ({CONSTANTS}), m AS (SELECT *, 1 / e1 AS a, 1 / e2 AS b, 1 / e3 AS d, -nu12 / e1 AS x, -nu13 / e1 AS y, -nu23 / e2 AS z FROM c),
 r AS (SELECT part_id, CASE WHEN e3 <= 0 THEN 'moduli must be positive' WHEN a * b - x * x <= 0 OR a * (b * d - z * z) - x * (x * d - y * z) + y * (x * z - y * b) <= 0 THEN 'compliance is not positive definite' END AS reason FROM m)
 SELECT part_id, reason IS NULL AS stable, reason FROM r""")
def p32(t):
    return se.stable_material(t.sql(CONSTANTS))


# Matrices ------------------------------------------------------------------------------------------------------------
SYMM = "SELECT matrix_id, i, j, value FROM fx_matrix UNION ALL SELECT matrix_id + 1000 AS matrix_id, i, j, sum(v) AS value FROM (SELECT matrix_id, i, j, value AS v FROM fx_matrix UNION ALL SELECT matrix_id, j AS i, i AS j, value AS v FROM fx_matrix) q GROUP BY 1, 2, 3"


@query("a57_symmetry_error", "matrix_id:i symmetry_error:4 is_symmetric",
       f"""WITH m AS ({SYMM}), d AS (SELECT coalesce(a.matrix_id, b.matrix_id) AS matrix_id, abs(coalesce(a.value, 0e0) - coalesce(b.value, 0e0)) AS e, abs(a.value) AS s FROM m a FULL JOIN m b ON a.matrix_id = b.matrix_id AND a.i = b.j AND a.j = b.i)
 SELECT matrix_id, max(e) AS symmetry_error, max(e) <= 1e-12 + 1e-10 * max(s) AS is_symmetric FROM d GROUP BY 1""")
def a57(t):
    return se.symmetry_error(t.sql(SYMM))


OTHER = "SELECT matrix_id, i, j, value * CASE WHEN matrix_id % 2 = 0 THEN 1e0 ELSE 1e0 + 0.001e0 * ((i + j) % 3) END AS value FROM fx_matrix WHERE NOT (matrix_id % 3 = 2 AND i = 4)"


@query("a57_frobenius_error", "matrix_id:i relative_error:8 all_close",
       f"""WITH o AS ({OTHER}), d AS (SELECT f.matrix_id, f.value AS e, coalesce(o.value, 0e0) AS a FROM fx_matrix f LEFT JOIN o USING (matrix_id, i, j))
 SELECT matrix_id, sqrt(sum(pow(a - e, 2))) / sqrt(sum(e * e)) AS relative_error, bool_and(abs(a - e) <= 1e-12 + 1e-10 * abs(e)) AS all_close FROM d GROUP BY 1""")
def a57_frobenius(t):
    return se.matrix_difference(t.sql(OTHER), t.matrix.select("matrix_id", "i", "j", "value"))


@query("a57_affine_reconstruction", "matrix_id:i i:i j:i value:4", "SELECT matrix_id, i, j, value * (1e0 + 0.3e0 * 0.5e0) - 0.2e0 * mass AS value FROM fx_matrix")
def a57_affine(t):
    # two jobs with dp = (2, 0) and (1, 4) of K(p) = K0 + p1 (0.3 K0) - p2 M
    k0 = t.matrix.select("matrix_id", "i", "j", "value")
    jobs = t.matrix.select(F.lit(0).alias("sample_no"), "matrix_id", "i", "j", (F.col("value") * (1 + 0.3 * 2.0)).alias("value")).unionByName(
        t.matrix.select(F.lit(1).alias("sample_no"), "matrix_id", "i", "j", (F.col("value") * (1 + 0.3 * 1.0) - 4.0 * F.col("mass")).alias("value")))
    return se.reconstruct(k0, se.affine_basis(k0, jobs, [[2.0, 0.0], [1.0, 4.0]]), [0.5, 0.2])


@query("a58_eigen_derivatives", "cmp_id:i mode:i eigen_derivative:4 frequency_derivative:6 scaled:6",
       """WITH s AS (SELECT s.cmp_id, s.mode_no AS mode, CAST(node_id * 3 + dof - 1 AS INT) AS k, re, im, s.cmp_id % 4 AS matrix_id, frequency_hz FROM fx_shapes s JOIN fx_modes m ON m.cmp_id = s.cmp_id AND m.role = s.role AND m.mode_no = s.mode_no WHERE s.role = 'FE'),
 y AS (SELECT s.cmp_id, s.mode, m.i AS k, sum(m.value * re) AS kr, sum(m.value * im) AS ki, sum((m.mass + CASE WHEN m.i = m.j THEN 50e0 ELSE 0e0 END) * re) AS mr, sum((m.mass + CASE WHEN m.i = m.j THEN 50e0 ELSE 0e0 END) * im) AS mi FROM s JOIN fx_matrix m ON m.matrix_id = s.matrix_id AND m.j = s.k GROUP BY 1, 2, 3),
 q AS (SELECT s.cmp_id, s.mode, max(frequency_hz) AS f, sum(re * kr + im * ki) AS k, sum(re * mr + im * mi) AS m FROM s JOIN y USING (cmp_id, mode, k) GROUP BY 1, 2)
 SELECT cmp_id, mode, k / m AS eigen_derivative, k / m / (4e0 * pi() * 2e0 * pi() * f) AS frequency_derivative, k / m / (4e0 * pi() * 2e0 * pi() * f) * 100e0 / f AS scaled FROM q""")
def a58(t):
    s = t.shapes.filter("role = 'FE'").join(t.modes.select("cmp_id", "role", "mode_no", "frequency_hz"), ["cmp_id", "role", "mode_no"])
    s = s.select("cmp_id", (F.col("cmp_id") % 4).alias("matrix_id"), F.col("mode_no").alias("mode"), (F.col("node_id") * 3 + F.col("dof") - 1).cast("int").alias("dof_index"), "re", "im", "frequency_hz")
    mass = t.matrix.select("matrix_id", "i", "j", (F.col("mass") + F.when(F.col("i") == F.col("j"), 50.0).otherwise(0.0)).alias("value"))
    return se.eigen_derivatives(s, t.matrix.select("matrix_id", "i", "j", "value"), mass, None, ["cmp_id"], 100.0)


TIES = "SELECT CAST(floor(vec_id / 200) AS BIGINT) AS run_id, vec_id AS mode_no, pow(6e0 * (20e0 + floor((vec_id % 200) / 2) + CASE WHEN vec_id % 10 = 3 THEN 0.25e0 ELSE 0e0 END), 2) AS eigenvalue, 30 AS n_dof FROM embeddings"


@query("j37_tied_modes", "run_id:i mode_no:i partner:i", f"WITH v AS ({TIES}) SELECT a.run_id, a.mode_no, b.mode_no AS partner FROM v a JOIN v b ON a.run_id = b.run_id AND a.mode_no <> b.mode_no AND a.eigenvalue = b.eigenvalue")
def j37(t):
    return se.tied_modes(t.sql(TIES), ["run_id"])


# Declared and archived values ----------------------------------------------------------------------------------------
PARSED = """SELECT family_id, term_id AS state_id, name, CASE WHEN name = 'E1' AND term_id % 11 = 0 THEN base * 1.01e0 WHEN name = CONCAT('E', term_id % 2 + 1) THEN base * 1.05e0 WHEN name = 'nu12' AND term_id % 13 = 0 THEN base + 0.1e0 ELSE base END AS value, base FROM (SELECT DISTINCT family_id, term_id FROM fx_sens) s
 CROSS JOIN (SELECT 'E1' AS name, 50000e0 AS base UNION ALL SELECT 'E2' AS name, 48000e0 AS base UNION ALL SELECT 'nu12' AS name, 0.3e0 AS base) n"""
DECL = "SELECT DISTINCT family_id, term_id AS state_id, CONCAT('E', term_id % 2 + 1) AS name, CASE WHEN term_id % 2 = 0 THEN 50000e0 ELSE 48000e0 END * 1.05e0 AS value, true AS is_parameter FROM fx_sens"


@query("j22_declared_values", "family_id:i state_id:i n_wrong:i also_changed verdict",
       f"""WITH p AS ({PARSED}), d AS ({DECL}), j AS (SELECT p.*, d.value AS dv FROM p LEFT JOIN d USING (family_id, state_id, name)),
 x AS (SELECT family_id, state_id, name, dv IS NOT NULL AND abs(dv - value) > 1e-6 * greatest(abs(dv), abs(value)) AS wrong, dv IS NULL AND abs(value - base) > 1e-6 * greatest(abs(value), abs(base)) AS moved FROM j),
 g AS (SELECT family_id, state_id, sum(CASE WHEN wrong THEN 1 ELSE 0 END) AS n_wrong, coalesce(string_agg(CASE WHEN moved THEN name END, ',' ORDER BY name), '') AS also_changed FROM x GROUP BY 1, 2)
 SELECT *, CASE WHEN n_wrong > 0 THEN 'declared value differs' WHEN also_changed <> '' THEN 'not a one-parameter state' ELSE 'ok' END AS verdict FROM g""")
def j22(t):
    return se.check_declared(t.sql(DECL), t.sql(PARSED))


@query("j23_archive_comparison", "family_id:i term_id:i parameter live:6 archived:6 difference:6 agree",
       f"""WITH {CENTRAL_SQL}, a AS (SELECT family_id, term_id, parameter, CASE WHEN term_id % 19 = 0 THEN s + 0.001e0 ELSE round(s, 5) END AS archived FROM cs WHERE term_id % 29 <> 1)
 SELECT family_id, term_id, parameter, s AS live, archived, s - archived AS difference, (s IS NULL AND archived IS NULL) OR coalesce(abs(s - archived) <= 1.5e-5, false) AS agree FROM cs LEFT JOIN a USING (family_id, term_id, parameter)""")
def j23(t):
    live = se.central_sensitivities(t.states)
    old = live.filter("term_id % 29 <> 1").withColumn("s", F.when(F.col("term_id") % 19 == 0, F.col("s") + 0.001).otherwise(F.round("s", 5)))
    return se.compare_archive(live, old, ["family_id", "term_id", "parameter"])

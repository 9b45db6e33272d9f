"""Queries of assignment, observations, objectives, consistency statistics and Monte Carlo."""
from __future__ import annotations

from pyspark.sql import functions as F

from modalframe.operators import coverage as cv
from modalframe.operators import evidence as ev
from modalframe.operators import frf, mac, pairing
from modalframe.plans.correlation import ALL_MAC_SQL, CAND_SQL, STATUS_SQL
from modalframe.plans.registry import query


def gated(t):
    c = mac.coverage(pairing.frequency_window_pairs(t.modes), t.shapes, t.nodes)
    return pairing.gate_candidates(c)


def window_macs(t):
    return mac.masked_mac(pairing.frequency_window_pairs(t.modes), t.shapes)


# Assignment ----------------------------------------------------------------------------------------------------------
@query("j18_optimal_assignment", "cmp_id:i fe_mode:i exp_mode:i cost:6")
def j18(t):
    c = gated(t).filter("admissible")
    return ev.assign_pairs(c.withColumn("cost", pairing.pair_cost(F.col("mac"), F.col("err"))))


@query("j19_strict_pairing", "cmp_id:i fe_mode:i exp_mode:i mac:6 tied")
def j19(t):
    return ev.strict_pairs(window_macs(t))


@query("j19_strict_pairing_status", "cmp_id:i n_pairs:i n_tied:i n_unknown:i status")
def j19_status(t):
    c = window_macs(t)
    return ev.pairing_status(ev.strict_pairs(c), c, t.modes)


STRICT = "SELECT * FROM fx_pairs WHERE mac >= 0.8 AND abs(err) <= 15"
REASON_SQL = f"""{CAND_SQL}, sp AS ({STRICT}), rs AS (SELECT m.cmp_id, m.mode_no AS exp_mode, count(c.fe_mode) AS k, bool_or(c.mac >= 0.8) AS ok FROM fx_modes m LEFT JOIN cand c ON c.cmp_id = m.cmp_id AND c.exp_mode = m.mode_no
 WHERE m.role = 'EXP' AND NOT EXISTS (SELECT 1 FROM sp WHERE sp.cmp_id = m.cmp_id AND sp.exp_mode = m.mode_no) GROUP BY 1, 2),
 ex AS (SELECT cmp_id, exp_mode, CASE WHEN k = 0 THEN 'no FE mode within the frequency gate' WHEN NOT ok THEN 'MAC below the policy minimum' ELSE 'assigned to other measured modes' END AS reason FROM rs)"""


def strict_given(t):
    return t.pairs.filter("mac >= 0.8 and abs(err) <= 15")


def excluded(t):
    exp = t.modes.filter("role = 'EXP'").select("cmp_id", F.col("mode_no").alias("exp_mode"))
    return ev.unpaired_reasons(exp, window_macs(t), strict_given(t))


@query("p24_unpaired_reason", "cmp_id:i exp_mode:i reason", REASON_SQL + " SELECT * FROM ex")
def p24(t):
    return excluded(t)


@query("w15_frozen_rows", "cmp_id:i row_id exp_mode:i fe_mode:i reason",
       REASON_SQL + """ SELECT cmp_id, 'R' || row_number() OVER (PARTITION BY cmp_id ORDER BY exp_mode) AS row_id, exp_mode, fe_mode, NULL AS reason FROM sp
 UNION ALL SELECT cmp_id, NULL, exp_mode, NULL, reason FROM ex""")
def w15(t):
    return ev.frozen_rows(strict_given(t), excluded(t))


@query("j28_excluded_with_shape", "cmp_id:i exp_mode:i fe_mode:i mac:6 relative_error:6 reason",
       REASON_SQL + ", " + ALL_MAC_SQL + """ SELECT ex.cmp_id, ex.exp_mode, fe_mode, mac, fe_hz / exp_hz - 1 AS relative_error, reason FROM ex JOIN (SELECT *, row_number() OVER (PARTITION BY cmp_id, exp_mode ORDER BY mac DESC, fe_mode) AS k FROM all_m) c
 ON c.cmp_id = ex.cmp_id AND c.exp_mode = ex.exp_mode AND k = 1 WHERE mac >= 0.5""")
def j28(t):
    return ev.excluded_with_shape(excluded(t), mac.masked_mac(pairing.all_pairs(t.modes), t.shapes), 0.5)


@query("p23_matching_status", "cmp_id:i exp_mode:i best_mac:6 second_mac:6 status",
       f"""WITH {ALL_MAC_SQL},
 k AS (SELECT *, row_number() OVER (PARTITION BY cmp_id, exp_mode ORDER BY mac DESC, fe_mode) AS k FROM all_m),
 cl AS (SELECT DISTINCT a.cmp_id, a.mode_no FROM fx_modes a JOIN fx_modes b ON a.cmp_id = b.cmp_id AND a.role = 'FE' AND b.role = 'FE' AND a.mode_no <> b.mode_no AND abs(a.frequency_hz - b.frequency_hz) / least(a.frequency_hz, b.frequency_hz) < 0.005),
 p AS (SELECT x.cmp_id, x.exp_mode, x.mac AS best_mac, coalesce(y.mac, 0e0) AS second_mac, abs(x.fe_hz - x.exp_hz) / x.exp_hz <= 0.15 AS inw, cl.mode_no IS NOT NULL AS grouped FROM k x LEFT JOIN k y ON y.cmp_id = x.cmp_id AND y.exp_mode = x.exp_mode AND y.k = 2
 LEFT JOIN cl ON cl.cmp_id = x.cmp_id AND cl.mode_no = x.fe_mode WHERE x.k = 1)
 SELECT e.cmp_id, e.mode_no AS exp_mode, best_mac, second_mac, CASE WHEN best_mac IS NULL THEN 'NO_MATCH' WHEN best_mac >= 0.8 AND second_mac < 0.5 AND inw AND NOT grouped THEN 'CANDIDATE' WHEN best_mac >= 0.5 AND (grouped OR second_mac >= 0.5) THEN 'AMBIGUOUS_CLUSTER' ELSE 'NO_MATCH' END AS status
 FROM fx_modes e LEFT JOIN p ON p.cmp_id = e.cmp_id AND p.exp_mode = e.mode_no WHERE e.role = 'EXP'""")
def p23(t):
    c = mac.masked_mac(pairing.all_pairs(t.modes), t.shapes)
    fe = t.modes.filter("role = 'FE'")
    close = frf.close_groups(fe, ["cmp_id"], 0.0, 0.005 / 1.0025, singletons=False).select("cmp_id", F.col("mode_no").alias("fe_mode"), F.lit(True).alias("grouped"))
    exp = t.modes.filter("role = 'EXP'").select("cmp_id", F.col("mode_no").alias("exp_mode"))
    return matching_status(exp, c, close)


def matching_status(exp, candidates, grouped):
    """Candidate, ambiguous cluster or no match per measured mode from its best and second MAC, the 15 % window and
    membership of the best FE mode in a close group."""
    r = pairing.best_by_mac(candidates, "exp", 2).join(grouped, ["cmp_id", "fe_mode"], "left")
    inside = F.abs(F.col("fe_hz") - F.col("exp_hz")) / F.col("exp_hz") <= 0.15
    one = F.col("mac_rank") == 1
    g = r.groupBy("cmp_id", "exp_mode").agg(F.max(F.when(one, F.col("mac"))).alias("best_mac"), F.coalesce(F.max(F.when(~one, F.col("mac"))), F.lit(0.0)).alias("second_mac"),
                                            F.max(F.when(one, inside)).alias("_in"), F.coalesce(F.max(F.when(one, F.col("grouped"))), F.lit(False)).alias("_grp"))
    b, s = F.col("best_mac"), F.col("second_mac")
    status = (F.when(b.isNull(), "NO_MATCH").when((b >= 0.8) & (s < 0.5) & F.col("_in") & ~F.col("_grp"), "CANDIDATE")
              .when((b >= 0.5) & (F.col("_grp") | (s >= 0.5)), "AMBIGUOUS_CLUSTER").otherwise("NO_MATCH"))
    return exp.join(g, ["cmp_id", "exp_mode"], "left").withColumn("status", status)


# Observations --------------------------------------------------------------------------------------------------------
DECIDED = f"""SELECT *, {STATUS_SQL} AS status, CASE fe_mode % 7 WHEN 0 THEN 'Accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'downweighted' WHEN 3 THEN NULL ELSE 'automatic' END AS decision FROM fx_pairs"""
INCL_SQL = f"""d AS ({DECIDED}), i AS (SELECT *, CASE WHEN coalesce(decision, 'automatic') = 'automatic' THEN lower(status) ELSE lower(decision) END AS src FROM d),
 o AS (SELECT *, CASE WHEN src IN ('accepted', 'included', 'excellent match', 'good match', 'frequency match') THEN 'INCLUDED' WHEN src = 'downweighted' THEN 'DOWNWEIGHTED' ELSE 'EXCLUDED' END AS inclusion FROM i)"""


def decided(t):
    d = F.expr("CASE fe_mode % 7 WHEN 0 THEN 'Accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'downweighted' WHEN 3 THEN NULL ELSE 'automatic' END")
    return t.pairs.withColumn("status", pairing.pair_status(F.col("mac"), F.col("err"))).withColumn("decision", d)


@query("p17_inclusion_status", "cmp_id:i fe_mode:i inclusion", f"WITH {INCL_SQL} SELECT * FROM o")
def p17(t):
    return decided(t).withColumn("inclusion", ev.inclusion_status(F.col("status"), F.col("decision")))


@query("p18_observations", "cmp_id:i observation_id fe_mode:i exp_mode:i mac:6 inclusion",
       f"WITH {INCL_SQL} SELECT *, 'design+1/' || cmp_id % 100 || '/run+' || CAST(floor(cmp_id / 100) AS BIGINT) || '/pair/' || (row_number() OVER (PARTITION BY cmp_id ORDER BY fe_hz, fe_mode) - 1) || '/A' || fe_mode || '/E' || exp_mode AS observation_id FROM o")
def p18(t):
    p = decided(t).withColumn("design_id", F.lit("design 1")).withColumn("specimen_id", F.col("cmp_id") % 100).withColumn("test_run_id", F.concat(F.lit("run "), F.floor(F.col("cmp_id") / 100)))
    return ev.observations(p)


@query("p30_validated_records", "record_index:i valid problem",
       """SELECT record_index, freq > 0 AND analysis_type IS NOT NULL AS valid, CASE WHEN NOT freq > 0 THEN 'frequency must be positive' WHEN analysis_type IS NULL THEN 'a reason is required' END AS problem FROM fx_records""")
def p30(t):
    r = t.records.withColumn("frequency_hz", F.col("freq")).withColumn("mac", F.lit(None).cast("double"))
    r = r.withColumn("inclusion", F.when(F.col("analysis_type").isNull(), "EXCLUDED").otherwise("INCLUDED")).withColumn("reason", F.lit(None).cast("string"))
    good, bad = validation_split(r)
    return good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))


def validation_split(rows):
    """(valid, quarantine): positive finite frequency, MAC in [0, 1], a reason unless included."""
    f, m = F.col("frequency_hz"), F.col("mac")
    ok_f = f.isNotNull() & ~F.isnan(f) & (f > 0) & (f < F.lit(float("inf")))
    problem = F.when(~F.coalesce(ok_f, F.lit(False)), "frequency must be positive").when(m.isNotNull() & ~m.between(0, 1), "MAC must lie in [0, 1]").when(
        (F.col("inclusion") != "INCLUDED") & F.coalesce(F.trim("reason") == "", F.lit(True)), "a reason is required")
    d = rows.withColumn("problem", problem)
    return d.filter(F.col("problem").isNull()), d.filter(F.col("problem").isNotNull())


FAMILIES = """SELECT cmp_id, exp_mode AS row_id, exp_hz, CONCAT('Px:', CASE exp_mode % 3 WHEN 0 THEN 'E' WHEN 1 THEN 'O' ELSE 'M' END, '|Py:', CASE exp_mode % 2 WHEN 0 THEN 'E' ELSE 'O' END, '|nx:', exp_mode % 4) AS family,
 exp_mode % 3 = 1 AND exp_mode % 2 = 1 AS torsion, fe_hz, fe_mode, mac FROM fx_pairs"""
ROLE_SQL = f"""f AS ({FAMILIES}), h AS (SELECT cmp_id, arg_min(CASE WHEN torsion THEN family END, (exp_hz, row_id)) FILTER (torsion) AS tf, arg_max(family, (exp_hz, row_id)) AS vf FROM f GROUP BY 1),
 ro AS (SELECT f.*, tf AS torsion_family, vf AS validation_family, CASE WHEN family = vf OR coalesce(family = tf, false) THEN 'HOLDOUT' ELSE 'FIT' END AS role FROM f JOIN h USING (cmp_id))"""


@query("w17_holdout_families", "cmp_id:i row_id:i family torsion_family validation_family role", f"WITH {ROLE_SQL} SELECT * FROM ro")
def w17(t):
    return ev.select_holdouts(t.sql(FAMILIES), ["cmp_id"])


def cluster_members(t):
    g = frf.close_groups(t.pairs.select("cmp_id", F.col("exp_mode").alias("mode_no"), F.col("exp_hz").alias("frequency_hz")), ["cmp_id"], 0.0, 0.01)
    return g.groupBy("cmp_id", F.col("group_no").alias("cluster_id")).agg(F.sort_array(F.collect_list("mode_no")).alias("members"))


CLUS_SQL = """cg AS (SELECT cmp_id, exp_mode, g FROM (SELECT *, count(*) OVER (PARTITION BY cmp_id, g) AS n FROM (SELECT *, sum(CASE WHEN p IS NULL OR exp_hz - p > 0.01e0 * 0.5e0 * (exp_hz + p) THEN 1 ELSE 0 END) OVER (PARTITION BY cmp_id ORDER BY exp_hz, exp_mode) AS g FROM (
 SELECT *, lag(exp_hz) OVER (PARTITION BY cmp_id ORDER BY exp_hz, exp_mode) AS p FROM fx_pairs))) WHERE n > 1)"""


@query("u04_fit_holdout_split", "cmp_id:i cluster_id:i n_roles:i verdict",
       f"""WITH {ROLE_SQL}, {CLUS_SQL} SELECT cg.cmp_id, g AS cluster_id, count(DISTINCT role) AS n_roles, CASE WHEN count(DISTINCT role) > 1 THEN 'SPLIT' ELSE min(role) END AS verdict
 FROM cg JOIN ro ON ro.cmp_id = cg.cmp_id AND ro.row_id = cg.exp_mode GROUP BY cg.cmp_id, g""")
def u04(t):
    return ev.straddling_clusters(ev.select_holdouts(t.sql(FAMILIES), ["cmp_id"]), cluster_members(t), ["cmp_id"])


OBJ_SQL = f"""{CLUS_SQL}, r AS (SELECT p.*, 0.003e0 * (1e0 + exp_mode % 3) AS sigma, CASE WHEN exp_mode % 5 = 0 THEN 'HOLDOUT' ELSE 'FIT' END AS role FROM fx_pairs p),
 tm AS (SELECT r.cmp_id, CASE WHEN cg.g IS NULL THEN 'R' || r.exp_mode ELSE 'C' || cg.g END AS term_id, role, avg(ln(fe_hz) - ln(exp_hz)) AS log_ratio, sqrt(sum(sigma * sigma)) / count(*) AS sigma, count(*) AS n_rows FROM r LEFT JOIN cg ON cg.cmp_id = r.cmp_id AND cg.exp_mode = r.exp_mode GROUP BY 1, 2, 3)"""


def objective_terms(t):
    r = t.pairs.select("cmp_id", F.col("exp_mode").alias("row_id"), "fe_hz", "exp_hz", (0.003 * (1 + F.col("exp_mode") % 3)).alias("sigma"), F.when(F.col("exp_mode") % 5 == 0, "HOLDOUT").otherwise("FIT").alias("role"))
    return ev.objective_terms(r, cluster_members(t), ["cmp_id"])


@query("a41_objective_terms", "cmp_id:i term_id role log_ratio:6 sigma:6 residual:4 n_rows:i", f"WITH {OBJ_SQL} SELECT *, log_ratio / sigma AS residual FROM tm")
def a41(t):
    return objective_terms(t)


@query("a41_objective", "cmp_id:i phi:4 n_fit:i n_holdout:i", f"WITH {OBJ_SQL} SELECT cmp_id, 0.5e0 * sum(CASE WHEN role = 'FIT' THEN pow(log_ratio / sigma, 2) ELSE 0e0 END) AS phi, count(*) FILTER (role = 'FIT') AS n_fit, count(*) FILTER (role <> 'FIT') AS n_holdout FROM tm GROUP BY 1")
def a41_objective(t):
    return ev.objective(objective_terms(t), ["cmp_id"])


@query("j36_governed_rows", "cmp_id:i row_id:i role family term_id is_cluster baseline_delta:6 candidate_error:6 problem",
       f"""WITH {ROLE_SQL}, {CLUS_SQL} SELECT ro.cmp_id, ro.row_id, ro.role, CASE WHEN ro.row_id % 17 = 3 THEN NULL ELSE family END AS family, 'C' || g AS term_id, CASE WHEN g IS NOT NULL THEN true END AS is_cluster, ln(fe_hz / exp_hz) AS baseline_delta, exp(0.001e0 * (ro.row_id % 7)) - 1 AS candidate_error,
 CASE WHEN ro.row_id % 17 = 3 THEN 'no family' WHEN g IS NULL THEN 'no term' END AS problem FROM ro LEFT JOIN cg ON cg.cmp_id = ro.cmp_id AND cg.exp_mode = ro.row_id""")
def j36(t):
    h = ev.select_holdouts(t.sql(FAMILIES), ["cmp_id"])
    fam = t.sql(FAMILIES).filter("row_id % 17 <> 3").select("cmp_id", "row_id", "family")
    terms = cluster_members(t).withColumn("term_id", F.concat(F.lit("C"), "cluster_id"))
    cand = t.sql(FAMILIES).select("cmp_id", "row_id", (0.001 * (F.col("row_id") % 7)).alias("candidate_delta"))
    return ev.governed_rows(t.sql(FAMILIES).select("cmp_id", "row_id", "fe_hz", "exp_hz"), h.select("cmp_id", "row_id", "role"), fam, terms, cand)


# Statistics over specimens -------------------------------------------------------------------------------------------
@query("a42_observation_counts", "specimen_id:i n_fit:i n_holdout:i n_overlap:i refusals",
       """WITH t AS (SELECT specimen_id, family, CASE WHEN family = 4 OR (family = 3 AND specimen_id % 2 = 0) THEN role ELSE 'FIT' END AS role FROM
 (SELECT *, CASE WHEN specimen_id % 7 = 0 THEN part_id % 2 ELSE part_id % 5 END AS family FROM (SELECT specimen_id, part_id, role FROM fx_terms))),
 f AS (SELECT specimen_id, family, bool_or(role = 'FIT') AS f, bool_or(role = 'HOLDOUT') AS h FROM t GROUP BY 1, 2), g AS (SELECT specimen_id, count(*) FILTER (f) AS n_fit, count(*) FILTER (h) AS n_holdout, count(*) FILTER (f AND h) AS n_overlap FROM f GROUP BY 1)
 SELECT *, concat_ws(';', CASE WHEN n_fit < 3 THEN 'INSUFFICIENT_FIT_FAMILIES' END, CASE WHEN n_holdout = 0 THEN 'NO_HOLDOUT_FAMILY' END, CASE WHEN n_overlap > 0 THEN 'HOLDOUT_FAMILY_OVERLAPS_FIT' END) AS refusals FROM g""")
def a42(t):
    d = t.terms.withColumn("family", F.expr("CASE WHEN specimen_id % 7 = 0 THEN part_id % 2 ELSE part_id % 5 END"))
    d = d.withColumn("role", F.expr("CASE WHEN family = 4 OR (family = 3 AND specimen_id % 2 = 0) THEN role ELSE 'FIT' END"))
    return ev.observation_counts(d, ["specimen_id"], 2)


PAT_IN = "SELECT specimen_id, part_id AS family, CASE WHEN specimen_id % 3 = 0 THEN 'FIT' ELSE role END AS role, residual * CASE WHEN specimen_id % 2 = 0 THEN 1.31e0 ELSE 0.7e0 END AS residual, sigma FROM fx_terms"
PAT_SQL = """t AS ({src}), fa AS (SELECT specimen_id, family, count(*) >= 2 AND (min(residual) > 0 OR max(residual) < 0) AND bool_and(abs(residual) > {l2}) AS s FROM t WHERE role = 'FIT' GROUP BY 1, 2),
 ff AS (SELECT specimen_id, count(*) FILTER (s) AS n_systematic, count(*) AS n_families FROM fa GROUP BY 1), hh AS (SELECT specimen_id, count(*) FILTER (abs(residual) > {l3}) AS n_holdout_failures FROM t WHERE role = 'HOLDOUT' GROUP BY 1),
 pt AS (SELECT coalesce(ff.specimen_id, hh.specimen_id) AS specimen_id, coalesce(n_systematic, 0) AS n_systematic, coalesce(n_families, 0) AS n_families, coalesce(n_holdout_failures, 0) AS n_holdout_failures,
 CASE WHEN coalesce(n_systematic, 0) > 0 OR coalesce(n_holdout_failures, 0) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM ff FULL JOIN hh ON ff.specimen_id = hh.specimen_id)"""


@query("a43_residual_patterns", "specimen_id:i n_systematic:i n_families:i n_holdout_failures:i status", f"WITH {PAT_SQL.format(src=PAT_IN, l2='2', l3='3')} SELECT * FROM pt")
def a43(t):
    return ev.residual_patterns(t.sql(PAT_IN), ["specimen_id"])


@query("a43_residual_patterns_with_tolerance", "specimen_id:i n_systematic:i n_families:i n_holdout_failures:i status",
       f"WITH {PAT_SQL.format(src=PAT_IN, l2='greatest(2e0, 0.0091e0 / sigma)', l3='greatest(3e0, 0.0091e0 / sigma)')} SELECT * FROM pt")
def a43_tau(t):
    return ev.residual_patterns(t.sql(PAT_IN), ["specimen_id"], 0.0091)


@query("a44_birge_factor", "specimen_id:i chi2:4 n_fit:i dof:i chi2_per_dof:6 birge_factor:6 status",
       f"""WITH {PAT_SQL.format(src=PAT_IN, l2='2', l3='3')}, g AS (SELECT specimen_id, sum(residual * residual) AS chi2, count(*) AS n_fit FROM t WHERE role = 'FIT' GROUP BY 1)
 SELECT g.*, n_fit - 2 AS dof, chi2 / CASE WHEN n_fit > 2 THEN n_fit - 2 END AS chi2_per_dof, CASE WHEN n_fit > 2 THEN sqrt(greatest(1e0, chi2 / (n_fit - 2))) END AS birge_factor,
 CASE WHEN n_fit <= 2 THEN 'REFUSED_DOF' WHEN status = 'FAIL' THEN 'BLOCKED_PATTERN' ELSE 'AVAILABLE' END AS status FROM g LEFT JOIN pt USING (specimen_id)""")
def a44(t):
    d = t.sql(PAT_IN)
    return ev.birge(d, ev.residual_patterns(d, ["specimen_id"]), ["specimen_id"], 2)


@query("a45_family_consistency", "campaign_id:i n_specimens:i delta:4 dof:i chi2_p:6 bootstrap_p:6 status")
def a45(t):
    return ev.family_consistency(t.terms.withColumn("campaign_id", F.col("specimen_id") % 10), "campaign_id", "specimen_id", chi2_valid=True)


LOFO_SQL = """s AS (SELECT specimen_id, family, count(*) AS n, sum(j1 * j1) AS a, sum(j1 * j2) AS b, sum(j2 * j2) AS d, sum(j1 * residual) AS p, sum(j2 * residual) AS q FROM fx_terms WHERE role = 'FIT' GROUP BY 1, 2),
 w AS (SELECT specimen_id, family, sum(n) OVER x - n AS n, sum(a) OVER x - a AS a, sum(b) OVER x - b AS b, sum(d) OVER x - d AS d, sum(p) OVER x - p AS p, sum(q) OVER x - q AS q FROM s WINDOW x AS (PARTITION BY specimen_id)),
 lo AS (SELECT *, -(d * p - b * q) / (a * d - b * b) AS shift_1, -(a * q - b * p) / (a * d - b * b) AS shift_2 FROM w)"""


@query("a46_leave_one_family_out", "specimen_id:i family n:i status shift_1:5 shift_2:5", f"WITH {LOFO_SQL} SELECT *, 'VALID' AS status FROM lo")
def a46(t):
    return ev.leave_one_family_out(t.terms, ["specimen_id"])


@query("a46_robustness_range", "specimen_id:i n_families:i n_valid:i low_1:5 high_1:5 half_range_1:5 half_range_2:5 complete",
       f"""WITH {LOFO_SQL} SELECT specimen_id, count(*) AS n_families, count(*) AS n_valid, min(shift_1) AS low_1, max(shift_1) AS high_1, 0.5e0 * (exp(max(shift_1)) - exp(min(shift_1))) AS half_range_1, 0.5e0 * (exp(max(shift_2)) - exp(min(shift_2))) AS half_range_2, true AS complete FROM lo GROUP BY 1""")
def a46_range(t):
    return ev.robustness_range(ev.leave_one_family_out(t.terms, ["specimen_id"]), ["specimen_id"])


@query("p34_agreement_rows", "specimen_id:i term_id:i relative_error:8 f_fe:6 target",
       """SELECT specimen_id, term_id, exp(residual * sigma) - 1 AS relative_error, f_exp * exp(residual * sigma) AS f_fe, CASE WHEN abs(exp(residual * sigma) - 1) <= 0.0033 THEN 'WITHIN_PREFERRED_TARGET' WHEN abs(exp(residual * sigma) - 1) <= 0.0071 THEN 'WITHIN_ACCEPTABLE_TARGET' ELSE 'OUTSIDE_PRACTICAL_TARGET' END AS target FROM fx_terms""")
def p34(t):
    return ev.agreement_rows(t.terms, 0.0033, 0.0071)


@query("a52_specimen_agreement", "specimen_id:i baseline_max:8 candidate_max:8 delta:8 change",
       """WITH c AS (SELECT specimen_id, max(abs(exp(residual * sigma) - 1)) AS candidate_max FROM fx_terms WHERE specimen_id % 11 <> 4 GROUP BY 1), b AS (SELECT specimen_id, max(abs(exp(residual * sigma * (0.8e0 + 0.1e0 * (specimen_id % 5))) - 1)) AS baseline_max FROM fx_terms GROUP BY 1)
 SELECT b.specimen_id, baseline_max, candidate_max, candidate_max - baseline_max AS delta, CASE WHEN candidate_max IS NULL THEN 'NOT_AVAILABLE' WHEN candidate_max < baseline_max THEN 'IMPROVED' WHEN candidate_max > baseline_max THEN 'WORSENED' ELSE 'SAME' END AS change
 FROM b LEFT JOIN c USING (specimen_id)""")
def a52(t):
    c = t.terms.filter("specimen_id % 11 <> 4").withColumn("relative_error", F.exp(F.col("residual") * F.col("sigma")) - 1)
    b = t.terms.withColumn("relative_error", F.exp(F.col("residual") * F.col("sigma") * (0.8 + 0.1 * (F.col("specimen_id") % 5))) - 1)
    return ev.agreement_change(c, b, ["specimen_id"])


# Monte Carlo ---------------------------------------------------------------------------------------------------------
MEASURED = """SELECT s_suppkey AS specimen_id, name, CASE name WHEN 'm' THEN 0.2e0 + 0.001e0 * (s_suppkey % 50) WHEN 'L' THEN 250e0 WHEN 'W' THEN 180e0 ELSE 0.8e0 + 0.01e0 * (s_suppkey % 9) END AS value,
 CASE name WHEN 'm' THEN 0.0005e0 WHEN 'L' THEN 0e0 WHEN 'W' THEN 0.2e0 ELSE 0.3e0 END AS std_unc FROM supplier CROSS JOIN (SELECT 'm' AS name UNION ALL SELECT 'L' AS name UNION ALL SELECT 'W' AS name UNION ALL SELECT 'h' AS name) n"""


def draws(t):
    return ev.derive_plate(ev.draw_measurements(t.sql(MEASURED), 200, 7, ["specimen_id"]), ["specimen_id"])


@query("a47_measurement_draws", "specimen_id:i draw:i areal_mass:6 h_m:8")
def a47(t):
    return draws(t)


@query("a47_draw_summary", "specimen_id:i mean:6 sd:6 low:6 high:6 n_ok:i n_failed:i")
def a47_summary(t):
    return ev.summarise_samples(draws(t), ["specimen_id"], "areal_mass")


@query("a48_sample_summary", "specimen_id:i mean:6 median:6 sd:6 low:6 high:6 n_ok:i n_failed:i share_ok:6",
       """SELECT specimen_id, avg(v) AS mean, median(v) AS median, stddev_samp(v) AS sd, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high, count(v) AS n_ok, count(*) - count(v) AS n_failed, count(v) / count(*) AS share_ok
 FROM (SELECT specimen_id, CASE WHEN position = 2 THEN NULL ELSE value END AS v FROM fx_meas) GROUP BY 1""")
def a48(t):
    return ev.summarise_samples(t.meas.withColumn("v", F.when(F.col("position") != 2, F.col("value"))), ["specimen_id"], "v")


VAR_IN = "SELECT l_suppkey AS specimen_id, l_quantity / 10e0 AS h, l_extendedprice AS stiffness, l_extendedprice * pow(l_quantity / 10e0, -3) * (1e0 + l_tax) AS total FROM lineitem"


@query("a49_variance_shares", "specimen_id:i thickness_share:6 stiffness_share:6 rest_share:6",
       f"""WITH g AS (SELECT specimen_id, var_samp(-3 * ln(h)) AS vh, var_samp(ln(stiffness)) AS vs, var_samp(ln(total)) AS vt FROM ({VAR_IN}) GROUP BY 1), r AS (SELECT *, greatest(vt - vh - vs, 0e0) AS rest FROM g)
 SELECT specimen_id, vh / (vh + vs + rest) AS thickness_share, vs / (vh + vs + rest) AS stiffness_share, rest / (vh + vs + rest) AS rest_share FROM r""")
def a49(t):
    return ev.variance_shares(t.sql(VAR_IN), ["specimen_id"])


@query("a50_interval_coverage", "specimen_id:i coverage:6 n:i passed",
       "SELECT specimen_id, avg(CASE WHEN value BETWEEN 0.17 AND 4.93 THEN 1e0 ELSE 0e0 END) AS coverage, count(*) AS n, abs(avg(CASE WHEN value BETWEEN 0.17 AND 4.93 THEN 1e0 ELSE 0e0 END) - 0.95e0) <= 0.0203 AS passed FROM fx_meas GROUP BY 1")
def a50(t):
    return ev.interval_coverage(t.meas.select("specimen_id", F.col("value").alias("truth"), F.lit(0.17).alias("low"), F.lit(4.93).alias("high")), ["specimen_id"], tolerance=0.0203)


# Repeated coverage ---------------------------------------------------------------------------------------------------
def _normal(*parts: str) -> str:
    u = [f"((CAST('0x' || substr(md5(concat_ws('|', '{k}', {', '.join(parts)})), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0)" for k in "rt"]
    return f"(sqrt(-2e0 * ln({u[0]})) * cos(2e0 * pi() * {u[1]}))"


def coverage_sql(widen: float) -> str:
    return f"""WITH g AS (SELECT specimen_id, count(*) AS n, avg(value) AS level, regr_slope(value, position) AS slope, regr_sxx(value, position) AS sxx,
 regr_syy(value, position) - regr_slope(value, position) * regr_sxy(value, position) AS sse FROM fx_meas WHERE value IS NOT NULL AND position IS NOT NULL GROUP BY 1),
 tr AS (SELECT specimen_id, 'level' AS parameter, level AS truth, CASE WHEN n > 2 AND sxx > 0 THEN sqrt(greatest(sse, 0e0) / (n - 2) / n) END AS se FROM g
 UNION ALL SELECT specimen_id, 'slope', slope, CASE WHEN n > 2 AND sxx > 0 THEN sqrt(greatest(sse, 0e0) / (n - 2) / sxx) END FROM g),
 e AS MATERIALIZED (SELECT tr.*, rep, truth + se * {_normal("11", "specimen_id", "rep", "parameter", "0")} AS est FROM tr CROSS JOIN (SELECT unnest(range(1, 41)) AS rep)),
 v AS (SELECT specimen_id, parameter, rep, truth, est + {widen}e0 * se * {_normal("11", "specimen_id", "rep", "parameter", "m")} AS v FROM e CROSS JOIN (SELECT unnest(range(1, 101)) AS m)),
 i AS (SELECT specimen_id, parameter, rep, max(truth) AS truth, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM v GROUP BY 1, 2, 3),
 o AS (SELECT *, bool_and(lo IS NOT NULL) OVER (PARTITION BY specimen_id, rep) AS ok FROM i),
 c AS (SELECT specimen_id, parameter, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS n_ok, sum(CASE WHEN ok AND truth BETWEEN lo AND hi THEN 1 ELSE 0 END) AS n_covered FROM o GROUP BY 1, 2),
 s AS (SELECT *, 40 - n_ok AS n_failed, coalesce(n_covered / nullif(n_ok, 0), 0e0) AS coverage FROM c)
 SELECT *, n_ok > 0 AND bool_and(abs(coverage - 0.95e0) <= 0.1e0) OVER (PARTITION BY specimen_id) AS passed FROM s"""


COVERED = "specimen_id:i parameter n_ok:i n_failed:i n_covered:i coverage:6 passed"


def covered(t, widen: float):
    key = ["specimen_id"]
    return cv.repeated_coverage(cv.line_truth(t.meas, key, "position", "value"), key, cv.line_experiment(key, 100, 11, widen), ["level", "slope"], 40)


@query("x04_repeated_coverage", COVERED, coverage_sql(1.0))
def x04(t):
    return covered(t, 1.0)


@query("x04_coverage_of_narrow_intervals", COVERED, coverage_sql(0.5))
def x04_narrow(t):
    """Intervals of half the honest width must be found out."""
    return covered(t, 0.5)

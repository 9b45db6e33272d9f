"""Queries of the correlation suite: candidates, gates, MAC family, pair summaries."""
from __future__ import annotations

from pyspark.sql import functions as F

from modalframe.operators import mac, pairing
from modalframe.plans.registry import query

# Shared oracle fragments -------------------------------------------------------------------------------------------
WINDOW_SQL = """
SELECT f.cmp_id, f.mode_no AS fe_mode, e.mode_no AS exp_mode, f.frequency_hz AS fe_hz, e.frequency_hz AS exp_hz,
       (f.frequency_hz - e.frequency_hz) / e.frequency_hz * 100e0 AS err
FROM fx_modes f JOIN fx_modes e ON f.cmp_id = e.cmp_id AND f.role = 'FE' AND e.role = 'EXP'
WHERE abs(f.frequency_hz - e.frequency_hz) <= 0.15e0 * e.frequency_hz"""
SUMS_SQL = """
SELECT p.cmp_id, p.fe_mode, p.exp_mode, sum(a.re * b.re + a.im * b.im) AS xr, sum(a.re * b.im - a.im * b.re) AS xi,
       sum(a.re * a.re + a.im * a.im) AS na, sum(b.re * b.re + b.im * b.im) AS nb, count(*) AS n_dof,
       count(DISTINCT a.node_id) AS n_points, max(n.x) - min(n.x) AS sx, max(n.y) - min(n.y) AS sy, max(n.z) - min(n.z) AS sz
FROM win p JOIN fx_shapes a ON a.cmp_id = p.cmp_id AND a.mode_no = p.fe_mode AND a.role = 'FE'
JOIN fx_shapes b ON b.cmp_id = p.cmp_id AND b.mode_no = p.exp_mode AND b.role = 'EXP' AND b.measured
     AND b.node_id = a.node_id AND b.dof = a.dof
JOIN fx_nodes n ON n.cmp_id = a.cmp_id AND n.node_id = a.node_id GROUP BY 1, 2, 3"""
CAND_SQL = f"""
WITH win AS ({WINDOW_SQL}), sums AS ({SUMS_SQL}),
own AS (SELECT cmp_id, mode_no AS exp_mode, count(*) AS own_dof FROM fx_shapes WHERE role = 'EXP' AND measured GROUP BY 1, 2),
grid AS (SELECT cmp_id, count(*) AS gp, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)) AS ge
         FROM fx_nodes GROUP BY 1),
c0 AS (SELECT w.*, least(1e0, (xr * xr + xi * xi) / (na * nb)) AS mac, s.n_dof, s.n_points, own_dof,
              s.n_dof / own_dof AS dof_coverage, s.n_points / gp AS point_coverage,
              sqrt(sx * sx + sy * sy + sz * sz) / ge AS spatial_coverage
       FROM win w JOIN sums s USING (cmp_id, fe_mode, exp_mode) JOIN own USING (cmp_id, exp_mode) JOIN grid USING (cmp_id)),
cand AS (SELECT *, CASE WHEN n_dof < 3 OR dof_coverage < 0.05 THEN 'insufficient DOF coverage'
                        WHEN n_points < 3 OR point_coverage < 0.02 THEN 'insufficient point coverage'
                        WHEN spatial_coverage < 0.02 THEN 'insufficient spatial coverage' ELSE 'accepted' END AS coverage_status
         FROM c0)"""
STATUS_SQL = """CASE WHEN mac IS NULL THEN CASE WHEN abs(err) <= 5 THEN 'Frequency match' WHEN abs(err) <= 10
 THEN 'Check frequency' ELSE 'Large frequency difference' END WHEN mac >= 0.9 AND abs(err) <= 5 THEN 'Excellent match'
 WHEN mac >= 0.8 AND abs(err) <= 10 THEN 'Good match' WHEN mac >= 0.6 AND abs(err) <= 15 THEN 'Review' ELSE 'Poor match' END"""
COMMON_SQL = """
r0 AS (SELECT p.cmp_id, p.fe_mode, p.exp_mode, a.node_id, a.dof, a.re AS ar, a.im AS ai, b.re AS er, b.im AS ei
       FROM pairs p JOIN fx_shapes a ON a.cmp_id = p.cmp_id AND a.mode_no = p.fe_mode AND a.role = 'FE'
       JOIN fx_shapes b ON b.cmp_id = p.cmp_id AND b.mode_no = p.exp_mode AND b.role = 'EXP' AND b.measured
            AND b.node_id = a.node_id AND b.dof = a.dof),
np AS (SELECT cmp_id, count(*) AS n FROM pairs GROUP BY 1),
good AS (SELECT cmp_id FROM (SELECT cmp_id, fe_mode, count(DISTINCT node_id) AS k FROM r0 GROUP BY 1, 2)
         JOIN (SELECT cmp_id, count(DISTINCT node_id) AS n_all FROM r0 GROUP BY 1) USING (cmp_id)
         GROUP BY cmp_id HAVING min(k) = max(n_all)),
keep AS (SELECT cmp_id, node_id, dof FROM (SELECT cmp_id, node_id, dof, count(*) AS k FROM r0 GROUP BY 1, 2, 3)
         JOIN np USING (cmp_id) JOIN good USING (cmp_id) WHERE k = n),
rows_ AS (SELECT r0.* FROM r0 JOIN keep USING (cmp_id, node_id, dof))"""
ALL_MAC_SQL = """all_w AS (SELECT f.cmp_id, f.mode_no AS fe_mode, e.mode_no AS exp_mode, f.frequency_hz AS fe_hz, e.frequency_hz AS exp_hz FROM fx_modes f JOIN fx_modes e ON f.cmp_id = e.cmp_id AND f.role = 'FE' AND e.role = 'EXP'),
all_m AS (SELECT w.cmp_id, fe_mode, exp_mode, fe_hz, exp_hz, (pow(sum(a.re * b.re + a.im * b.im), 2) + pow(sum(a.re * b.im - a.im * b.re), 2)) / (sum(a.re * a.re + a.im * a.im) * sum(b.re * b.re + b.im * b.im)) AS mac
 FROM all_w w JOIN fx_shapes a ON a.cmp_id = w.cmp_id AND a.role = 'FE' AND a.mode_no = fe_mode JOIN fx_shapes b ON b.cmp_id = w.cmp_id AND b.role = 'EXP' AND b.mode_no = exp_mode AND b.measured AND a.node_id = b.node_id AND a.dof = b.dof GROUP BY 1, 2, 3, 4, 5)"""
ACCEPTED = "SELECT * FROM fx_pairs WHERE mac >= 0.5 AND abs(err) <= 15"


def accepted(t):
    return t.pairs.filter("mac >= 0.5 and abs(err) <= 15")


def candidates(t):
    return mac.coverage(pairing.frequency_window_pairs(t.modes), t.shapes, t.nodes)


# Projections ---------------------------------------------------------------------------------------------------------
@query("p01_frequency_error", "cmp_id:i fe_mode:i err:6",
       "SELECT cmp_id, fe_mode, (fe_hz - exp_hz) / abs(exp_hz) * 100e0 AS err FROM fx_pairs")
def p01(t):
    return t.pairs.withColumn("err", pairing.frequency_error_percent(F.col("fe_hz"), F.col("exp_hz")))


@query("p02_pair_status", "cmp_id:i fe_mode:i exp_mode:i status",
       f"SELECT cmp_id, fe_mode, exp_mode, {STATUS_SQL} AS status FROM "
       "(SELECT * REPLACE (CASE WHEN fe_mode % 9 = 0 THEN NULL ELSE mac END AS mac) FROM fx_pairs)")
def p02(t):
    p = t.pairs.withColumn("mac", F.when(F.col("fe_mode") % 9 != 0, F.col("mac")))
    return p.withColumn("status", pairing.pair_status(F.col("mac"), F.col("err")))


@query("j03_mode_candidates",
       "cmp_id:i fe_mode:i exp_mode:i err:6 mac:6 n_dof:i n_points:i dof_coverage:6 coverage_status admissible reasons",
       CAND_SQL + """ SELECT *, coverage_status = 'accepted' AND abs(err) <= 15 AND mac >= 0.5 AS admissible,
 concat_ws(';', CASE WHEN abs(err) > 15 THEN 'frequency' END, CASE WHEN mac < 0.5 THEN 'mac' END,
 CASE WHEN coverage_status <> 'accepted' THEN 'coverage' END) AS reasons FROM cand""")
def j03(t):
    """Candidate pairs in the frequency window with MAC, coverage, gates and reasons (the flagship query)."""
    return pairing.gate_candidates(candidates(t)).withColumn("reasons", F.concat_ws(";", "reasons"))


@query("j03_window_census", "cmp_id:i exp_mode:i fe_total:i fe_inside:i fe_rejected:i",
       f"""WITH win AS ({WINDOW_SQL}), tot AS (SELECT cmp_id, count(*) AS fe_total FROM fx_modes WHERE role = 'FE' GROUP BY 1),
 ins AS (SELECT cmp_id, exp_mode, count(*) AS k FROM win GROUP BY 1, 2)
 SELECT m.cmp_id, m.mode_no AS exp_mode, fe_total, coalesce(k, 0) AS fe_inside, fe_total - coalesce(k, 0) AS fe_rejected
 FROM fx_modes m JOIN tot USING (cmp_id) LEFT JOIN ins ON ins.cmp_id = m.cmp_id AND ins.exp_mode = m.mode_no
 WHERE m.role = 'EXP'""")
def j03_census(t):
    return pairing.window_census(t.modes, pairing.frequency_window_pairs(t.modes))


@query("p03_admissibility_gates", "cmp_id:i fe_mode:i exp_mode:i frequency_gate mac_gate admissible reasons",
       """SELECT cmp_id, fe_mode, exp_mode, abs(e2) <= 15 AS frequency_gate, m2 >= 0.5 AS mac_gate,
 cov = 'accepted' AND ((abs(e2) <= 15 AND coalesce(m2 >= 0.5, false)) OR (m2 IS NULL AND abs(e2) <= 10)) AS admissible,
 concat_ws(';', CASE WHEN abs(e2) > 15 THEN 'frequency' END,
   CASE WHEN m2 IS NULL AND NOT abs(e2) <= 10 THEN 'mac_unavailable' END, CASE WHEN m2 < 0.5 THEN 'mac' END,
   CASE WHEN cov <> 'accepted' THEN 'coverage' END) AS reasons
 FROM (SELECT *, err * 4e0 AS e2, CASE WHEN fe_mode % 6 = 1 THEN NULL ELSE mac END AS m2,
       CASE WHEN fe_mode % 10 = 0 THEN 'insufficient point coverage' ELSE 'accepted' END AS cov FROM fx_pairs)""")
def p03(t):
    p = (t.pairs.withColumn("err", F.col("err") * 4.0).withColumn("mac", F.when(F.col("fe_mode") % 6 != 1, F.col("mac")))
         .withColumn("coverage_status", F.when(F.col("fe_mode") % 10 == 0, "insufficient point coverage").otherwise("accepted")))
    return pairing.gate_candidates(p).withColumn("reasons", F.concat_ws(";", "reasons"))


@query("p04_pair_cost", "cmp_id:i fe_mode:i cost:6",
       "SELECT cmp_id, fe_mode, 0.75e0 * (1e0 - coalesce(mac, 0e0)) + 0.25e0 * least(abs(err) / 20, 5e0) AS cost FROM fx_pairs")
def p04(t):
    return t.pairs.withColumn("cost", pairing.pair_cost(F.col("mac"), F.col("err")))


MASK_IN = """SELECT cmp_id, role, mode_no, node_id, dof, CASE WHEN dof = 2 AND mode_no % 5 = 0 THEN 0e0 ELSE re END AS re,
 CASE WHEN dof = 2 AND mode_no % 5 = 0 THEN 0e0 ELSE im END AS im, CASE WHEN mode_no % 2 = 0 THEN measured END AS measured
 FROM fx_shapes WHERE role = 'EXP'"""


@query("p05_measured_mask", "cmp_id:i mode_no:i node_id:i dof:i measured",
       f"""WITH s AS ({MASK_IN}) SELECT cmp_id, mode_no, node_id, dof, coalesce(measured,
 sqrt(sum(re * re + im * im) OVER (PARTITION BY cmp_id, mode_no, dof)) >
 1e-6 * sqrt(sum(re * re + im * im) OVER (PARTITION BY cmp_id, mode_no))) AS measured FROM s""")
def p05(t):
    return mac.measurement_mask(t.sql(MASK_IN))


@query("p06_dataset_mask", "cmp_id:i node_id:i dof:i measured",
       """WITH s AS (SELECT cmp_id, mode_no, node_id, dof, CASE WHEN (node_id + cmp_id) % 4 = 0 AND dof = 3 THEN 0e0
 ELSE re END AS re, CASE WHEN (node_id + cmp_id) % 4 = 0 AND dof = 3 THEN 0e0 ELSE im END AS im FROM fx_shapes WHERE role = 'EXP'),
 m AS (SELECT *, sqrt(re * re + im * im) > 1e-12 * greatest(max(sqrt(re * re + im * im)) OVER (PARTITION BY cmp_id, mode_no), 1e-30) AS hit FROM s),
 u AS (SELECT cmp_id, node_id, dof, bool_or(hit) AS hit FROM m GROUP BY 1, 2, 3)
 SELECT cmp_id, node_id, dof, hit OR NOT bool_or(hit) OVER (PARTITION BY cmp_id) AS measured FROM u""")
def p06(t):
    dead = ((F.col("node_id") + F.col("cmp_id")) % 4 == 0) & (F.col("dof") == 3)
    s = t.shapes.filter("role = 'EXP'")
    return mac.dataset_mask(s.withColumn("re", F.when(dead, 0.0).otherwise(F.col("re")))
                            .withColumn("im", F.when(dead, 0.0).otherwise(F.col("im"))))


@query("p19_frequency_scaling_rows", "cmp_id:i fe_mode:i ratio:6 ratio2:6 log_ratio:6 direction category warnings",
       """SELECT cmp_id, fe_mode, exp_hz / fe_hz AS ratio, pow(exp_hz / fe_hz, 2) AS ratio2, ln(exp_hz / fe_hz) AS log_ratio,
 CASE WHEN exp_hz > fe_hz THEN 'experiment higher than FE' WHEN exp_hz < fe_hz THEN 'experiment lower than FE' ELSE 'equal' END AS direction,
 CASE WHEN mac < 0.8 THEN 'LOW_MAC' WHEN w <> '' THEN 'QUESTIONABLE' ELSE 'MAC_SUPPORTED' END AS category, w AS warnings
 FROM (SELECT *, concat_ws(';', CASE WHEN mac < 0.8 THEN 'low_mac' END, CASE WHEN abs(fe_hz - exp_hz) / exp_hz > 0.15 THEN 'outside_window' END,
       CASE WHEN oc THEN 'order_changed' END) AS w
       FROM (SELECT *, row_number() OVER (PARTITION BY cmp_id ORDER BY fe_hz, fe_mode)
                    <> row_number() OVER (PARTITION BY cmp_id ORDER BY exp_hz, exp_mode) AS oc FROM fx_pairs))""")
def p19(t):
    p = pairing.order_changes(t.pairs).withColumn("coverage_status", F.lit("accepted"))
    return pairing.scaling_rows(p).withColumn("warnings", F.concat_ws(";", "warnings"))


@query("a53_frequency_scaling_summary", "cmp_id:i n:i median_ratio:6 median_ratio2:6 median_log:6 min_log:6 max_log:6",
       """SELECT cmp_id, count(*) AS n, median(r) AS median_ratio, median(r * r) AS median_ratio2, median(ln(r)) AS median_log,
 min(ln(r)) AS min_log, max(ln(r)) AS max_log FROM (SELECT *, exp_hz / fe_hz AS r FROM (SELECT *,
 row_number() OVER (PARTITION BY cmp_id ORDER BY fe_hz, fe_mode) <> row_number() OVER (PARTITION BY cmp_id ORDER BY exp_hz, exp_mode) AS oc
 FROM fx_pairs)) WHERE mac >= 0.8 AND abs(fe_hz - exp_hz) / exp_hz <= 0.15 AND NOT oc GROUP BY 1""")
def a53(t):
    p = pairing.order_changes(t.pairs).withColumn("coverage_status", F.lit("accepted"))
    return pairing.scaling_summary(pairing.scaling_rows(p))


@query("a67_frequency_regression", "cmp_id:i n:i slope:6 r2:5 direction",
       """WITH g AS (SELECT cmp_id, count(*) AS n, sum(exp_hz * fe_hz) / sum(exp_hz * exp_hz) AS slope, avg(fe_hz) AS m FROM fx_pairs GROUP BY 1)
 SELECT cmp_id, any_value(n) AS n, any_value(slope) AS slope,
 CASE WHEN sum(pow(fe_hz - m, 2)) > 1e-9 THEN 1e0 - sum(pow(fe_hz - slope * exp_hz, 2)) / sum(pow(fe_hz - m, 2)) ELSE 1e0 END AS r2,
 CASE WHEN any_value(slope) > 1 THEN 'model generally higher/stiffer' ELSE 'model generally lower/softer' END AS direction
 FROM fx_pairs JOIN g USING (cmp_id) GROUP BY cmp_id""")
def a67(t):
    return pairing.frequency_regression(t.pairs)


@query("p20_range_note", "cmp_id:i exp_mode:i note",
       """SELECT e.cmp_id, e.mode_no AS exp_mode, CASE WHEN e.frequency_hz < lo THEN 'below the lowest FE mode'
 WHEN e.frequency_hz > hi THEN 'above the highest FE mode' ELSE '' END AS note FROM fx_modes e
 JOIN (SELECT cmp_id, min(frequency_hz) AS lo, max(frequency_hz) AS hi FROM fx_modes WHERE role = 'FE' GROUP BY 1) USING (cmp_id)
 WHERE role = 'EXP'""")
def p20(t):
    return pairing.range_notes(t.modes)


@query("p29_real_field", "cmp_id:i mode_no:i node_id:i u1:6 u2:6 u3:6 magnitude:6",
       """WITH big AS (SELECT cmp_id, mode_no, re AS br, im AS bi FROM (SELECT *, row_number() OVER (PARTITION BY cmp_id, mode_no
 ORDER BY re * re + im * im DESC, node_id, dof) AS k FROM fx_shapes WHERE role = 'EXP') WHERE k = 1),
 t AS (SELECT s.*, (re * br + im * bi) / sqrt(br * br + bi * bi) AS v FROM fx_shapes s JOIN big USING (cmp_id, mode_no) WHERE role = 'EXP')
 SELECT cmp_id, mode_no, node_id, max(CASE WHEN dof = 1 THEN v END) AS u1, max(CASE WHEN dof = 2 THEN v END) AS u2,
 max(CASE WHEN dof = 3 THEN v END) AS u3, sqrt(sum(re * re + im * im)) AS magnitude FROM t GROUP BY 1, 2, 3""")
def p29(t):
    return mac.real_field(t.shapes.filter("role = 'EXP'"))


# Joins ---------------------------------------------------------------------------------------------------------------
@query("j04_frequency_window_join", "cmp_id:i fe_mode:i exp_mode:i err:6", WINDOW_SQL)
def j04(t):
    return pairing.frequency_window_pairs(t.modes)


@query("j05_nearest_frequency", "cmp_id:i exp_mode:i nearness:i fe_mode:i gap_hz:6 err:6",
       """SELECT * FROM (SELECT e.cmp_id, e.mode_no AS exp_mode, f.mode_no AS fe_mode, abs(f.frequency_hz - e.frequency_hz) AS gap_hz,
 (f.frequency_hz - e.frequency_hz) / e.frequency_hz * 100e0 AS err, row_number() OVER (PARTITION BY e.cmp_id, e.mode_no
 ORDER BY abs(f.frequency_hz - e.frequency_hz), f.mode_no) AS nearness
 FROM fx_modes e JOIN fx_modes f ON e.cmp_id = f.cmp_id AND e.role = 'EXP' AND f.role = 'FE') WHERE nearness <= 2""")
def j05(t):
    near = pairing.nearest_frequencies(t.modes)
    return near.withColumn("err", pairing.frequency_error_percent(F.col("fe_hz"), F.col("exp_hz")))


@query("j10_unmatched_modes", "cmp_id:i role mode_no:i hz:6",
       f"""WITH p AS ({ACCEPTED}), rng AS (SELECT cmp_id, 0.75e0 * min(frequency_hz) AS lo, 1.25e0 * max(frequency_hz) AS hi
 FROM fx_modes WHERE role = 'FE' GROUP BY 1)
 SELECT m.cmp_id, m.role, m.mode_no, m.frequency_hz AS hz FROM fx_modes m JOIN rng USING (cmp_id)
 WHERE (role = 'FE' AND NOT EXISTS (SELECT 1 FROM p WHERE p.cmp_id = m.cmp_id AND p.fe_mode = m.mode_no))
 OR (role = 'EXP' AND frequency_hz BETWEEN lo AND hi AND NOT EXISTS (SELECT 1 FROM p WHERE p.cmp_id = m.cmp_id AND p.exp_mode = m.mode_no))""")
def j10(t):
    return pairing.unmatched_modes(t.modes, accepted(t))


# MAC family ----------------------------------------------------------------------------------------------------------
@query("a01_mac_per_pair", "cmp_id:i fe_mode:i mac:6", "SELECT cmp_id, fe_mode, mac FROM fx_pairs")
def a01(t):
    fe, exp = pairing.sides(t.modes)
    pairs = fe.join(exp, ["cmp_id"]).filter("fe_mode = exp_mode")
    return mac.masked_mac(pairs, t.shapes)


@query("a02_masked_mac_matrix", "cmp_id:i fe_mode:i exp_mode:i mac:6 n_dof:i", CAND_SQL + " SELECT * FROM cand")
def a02(t):
    return mac.masked_mac(pairing.frequency_window_pairs(t.modes), t.shapes)


@query("a03_coverage", "cmp_id:i fe_mode:i exp_mode:i n_dof:i own_dof:i n_points:i dof_coverage:6 point_coverage:6 spatial_coverage:6 coverage_status",
       CAND_SQL + " SELECT * FROM cand")
def a03(t):
    return candidates(t)


@query("a04_automac", "cmp_id:i side mode_i:i mode_j:i mac:6",
       f"""WITH pairs AS ({ACCEPTED}), {COMMON_SQL},
 v AS (SELECT cmp_id, 'FE' AS side, fe_mode AS m, node_id, dof, ar AS r, ai AS i FROM rows_ UNION ALL
       SELECT cmp_id, 'EXP', exp_mode, node_id, dof, er, ei FROM rows_)
 SELECT p.cmp_id, p.side, p.m AS mode_i, q.m AS mode_j, (pow(sum(p.r * q.r + p.i * q.i), 2) + pow(sum(p.r * q.i - p.i * q.r), 2))
 / (sum(p.r * p.r + p.i * p.i) * sum(q.r * q.r + q.i * q.i)) AS mac
 FROM v p JOIN v q ON p.cmp_id = q.cmp_id AND p.side = q.side AND p.node_id = q.node_id AND p.dof = q.dof AND p.m < q.m GROUP BY 1, 2, 3, 4""")
def a04(t):
    rows = mac.common_rows(accepted(t), t.shapes)
    return (mac.auto_mac(rows, "a").withColumn("side", F.lit("FE"))
            .unionByName(mac.auto_mac(rows, "e").withColumn("side", F.lit("EXP"))))


COMAC_SQL = f"""WITH pairs AS ({ACCEPTED}), {COMMON_SQL},
 per AS (SELECT cmp_id, fe_mode, sqrt(sum(ar * ar + ai * ai)) AS sa, sqrt(sum(er * er + ei * ei)) AS se,
   sum(ar * er + ai * ei) AS cr, sum(ar * ei - ai * er) AS ci FROM rows_ GROUP BY 1, 2),
 u AS (SELECT r.cmp_id, node_id, dof, (ar * cr - ai * ci) / sqrt(cr * cr + ci * ci) / sa AS xr, (ar * ci + ai * cr) / sqrt(cr * cr + ci * ci) / sa AS xi,
   er / se AS yr, ei / se AS yi FROM rows_ r JOIN per USING (cmp_id, fe_mode)),
 d AS (SELECT cmp_id, node_id, dof, (pow(sum(xr * yr + xi * yi), 2) + pow(sum(xr * yi - xi * yr), 2)) /
   (sum(xr * xr + xi * xi) * sum(yr * yr + yi * yi)) AS s FROM u GROUP BY 1, 2, 3),
 comac AS (SELECT cmp_id, node_id, least(avg(s), 1e0) AS comac FROM d GROUP BY 1, 2)"""


@query("a05_comac", "cmp_id:i node_id:i comac:6", COMAC_SQL + " SELECT * FROM comac")
def a05(t):
    return mac.comac(mac.common_rows(accepted(t), t.shapes))


@query("a05_comparison_status", "cmp_id:i n_pairs:i status",
       f"""WITH pairs AS ({ACCEPTED}), {COMMON_SQL} SELECT np.cmp_id, n AS n_pairs, CASE WHEN good.cmp_id IS NULL THEN 'REFUSED_DIFFERENT_GRIDS' ELSE 'COMMON_GRID' END AS status FROM np LEFT JOIN good USING (cmp_id)""")
def a05_status(t):
    return mac.comparison_status(accepted(t), t.shapes)


@query("a06_correlation_summary", "cmp_id:i fe_automac_max:6 exp_automac_max:6 mean_comac:6 min_comac:6",
       COMAC_SQL + """, v AS (SELECT cmp_id, 'FE' AS side, fe_mode AS m, node_id, dof, ar AS r, ai AS i FROM rows_ UNION ALL
       SELECT cmp_id, 'EXP', exp_mode, node_id, dof, er, ei FROM rows_),
 am AS (SELECT p.cmp_id, p.side, p.m AS mi, q.m AS mj, (pow(sum(p.r * q.r + p.i * q.i), 2) + pow(sum(p.r * q.i - p.i * q.r), 2))
 / (sum(p.r * p.r + p.i * p.i) * sum(q.r * q.r + q.i * q.i)) AS mac
 FROM v p JOIN v q ON p.cmp_id = q.cmp_id AND p.side = q.side AND p.node_id = q.node_id AND p.dof = q.dof AND p.m < q.m GROUP BY 1, 2, 3, 4)
 SELECT c.cmp_id, avg(comac) AS mean_comac, min(comac) AS min_comac,
 coalesce((SELECT max(mac) FROM am WHERE am.cmp_id = c.cmp_id AND side = 'FE'), 0e0) AS fe_automac_max,
 coalesce((SELECT max(mac) FROM am WHERE am.cmp_id = c.cmp_id AND side = 'EXP'), 0e0) AS exp_automac_max FROM comac c GROUP BY 1""")
def a06(t):
    return mac.correlation_summary(mac.common_rows(accepted(t), t.shapes))


@query("a07_pair_scaling", "cmp_id:i fe_mode:i coef_re:6 coef_im:6 unit_re:6 unit_im:6 real_re:6 real_im:6 plot_scale:6",
       f"""WITH pairs AS ({ACCEPTED}), {COMMON_SQL.split("np AS")[0].rstrip().rstrip(",")},
 g AS (SELECT cmp_id, fe_mode, sum(ar * er + ai * ei) / sum(ar * ar + ai * ai) AS cr, sum(ar * ei - ai * er) / sum(ar * ar + ai * ai) AS ci,
   -0.5e0 * atan2(sum(2e0 * er * ei), sum(er * er - ei * ei)) AS th FROM r0 GROUP BY 1, 2)
 SELECT cmp_id, fe_mode, any_value(cr) AS coef_re, any_value(ci) AS coef_im, any_value(cr / sqrt(cr * cr + ci * ci)) AS unit_re,
 any_value(ci / sqrt(cr * cr + ci * ci)) AS unit_im, any_value(cos(th)) AS real_re, any_value(sin(th)) AS real_im,
 greatest(max(abs((ar * cr - ai * ci) * cos(th) - (ar * ci + ai * cr) * sin(th))), max(abs(er * cos(th) - ei * sin(th)))) AS plot_scale
 FROM r0 JOIN g USING (cmp_id, fe_mode) GROUP BY 1, 2""")
def a07(t):
    return mac.pair_scaling(accepted(t), t.shapes)


MPC_SQL = """WITH g AS (SELECT cmp_id, role, mode_no, sum(re * re) AS sxx, sum(re * im) AS sxy, sum(im * im) AS syy FROM fx_shapes GROUP BY 1, 2, 3),
 big AS (SELECT cmp_id, role, mode_no, atan2(im, re) AS th FROM (SELECT *, row_number() OVER (PARTITION BY cmp_id, role, mode_no
 ORDER BY re * re + im * im DESC, node_id, dof) AS k FROM fx_shapes) WHERE k = 1)
 SELECT s.cmp_id, s.role, s.mode_no, any_value((pow(sxx - syy, 2) + 4e0 * sxy * sxy) / pow(sxx + syy, 2)) AS mpc,
 sqrt(sum(pow(im * cos(th) - re * sin(th), 2))) / sqrt(sum(pow(re * cos(th) + im * sin(th), 2))) AS phase_complexity
 FROM fx_shapes s JOIN g USING (cmp_id, role, mode_no) JOIN big USING (cmp_id, role, mode_no) GROUP BY 1, 2, 3"""


@query("a08_phase_collinearity", "cmp_id:i role mode_no:i mpc:6", MPC_SQL)
def a08(t):
    return mac.phase_measures(t.shapes)


@query("a09_phase_complexity", "cmp_id:i role mode_no:i phase_complexity:6", MPC_SQL)
def a09(t):
    return mac.phase_measures(t.shapes)


DUP_SQL = """WITH p AS (SELECT a.cmp_id, a.mode_no AS candidate, b.mode_no AS existing FROM fx_modes a JOIN fx_modes b
 ON a.cmp_id = b.cmp_id AND a.role = 'EXP' AND b.role = 'EXP' AND a.mode_no % 4 = 3 AND b.mode_no % 4 <> 3
 AND abs(a.frequency_hz - b.frequency_hz) <= greatest(3e0, 0.04e0 * a.frequency_hz)),
 m AS (SELECT p.cmp_id, candidate, existing, (pow(sum(a.re * b.re + a.im * b.im), 2) + pow(sum(a.re * b.im - a.im * b.re), 2)) /
 (sum(a.re * a.re + a.im * a.im) * sum(b.re * b.re + b.im * b.im)) AS mac FROM p
 JOIN fx_shapes a ON a.cmp_id = p.cmp_id AND a.mode_no = candidate AND a.role = 'EXP' AND a.measured
 JOIN fx_shapes b ON b.cmp_id = p.cmp_id AND b.mode_no = existing AND b.role = 'EXP' AND b.measured AND a.node_id = b.node_id AND a.dof = b.dof
 GROUP BY 1, 2, 3) SELECT cmp_id, candidate, max(mac) AS max_mac FROM m GROUP BY 1, 2"""


@query("a70_duplicate_mac", "cmp_id:i candidate:i max_mac:6", DUP_SQL)
def a70(t):
    from modalframe.operators.frf import interval_association

    exp = t.modes.filter("role = 'EXP'")
    cand = exp.filter("mode_no % 4 = 3").select("cmp_id", F.col("mode_no").alias("candidate"), F.col("frequency_hz").alias("lo_hz"),
                                               F.col("frequency_hz").alias("hi_hz"))
    base = exp.filter("mode_no % 4 <> 3").select("cmp_id", F.col("mode_no").alias("existing"), F.col("frequency_hz").alias("peak_hz"))
    pairs = interval_association(cand, base, ["cmp_id"], 3.0, 0.04).select("cmp_id", "candidate", "existing")
    return mac.duplicate_mac(t.shapes, pairs)


# Ranking -------------------------------------------------------------------------------------------------------------
@query("w01_order_changed", "cmp_id:i fe_mode:i fe_rank:i exp_rank:i order_changed",
       """SELECT *, fe_rank <> exp_rank AS order_changed FROM (SELECT cmp_id, fe_mode, row_number() OVER (PARTITION BY cmp_id ORDER BY fe_hz, fe_mode) AS fe_rank,
 row_number() OVER (PARTITION BY cmp_id ORDER BY exp_hz, exp_mode) AS exp_rank FROM fx_pairs)""")
def w01(t):
    return pairing.order_changes(t.pairs)


@query("w04_best_mac", "side cmp_id:i own:i other:i mac_rank:i mac:6",
       "WITH " + ALL_MAC_SQL + """ SELECT * FROM (SELECT 'EXP' AS side, cmp_id, exp_mode AS own, fe_mode AS other, mac,
 row_number() OVER (PARTITION BY cmp_id, exp_mode ORDER BY mac DESC, fe_mode) AS mac_rank FROM all_m) WHERE mac_rank <= 2
 UNION ALL SELECT * FROM (SELECT 'FE' AS side, cmp_id, fe_mode AS own, exp_mode AS other, mac,
 row_number() OVER (PARTITION BY cmp_id, fe_mode ORDER BY mac DESC, exp_mode) AS mac_rank FROM all_m) WHERE mac_rank <= 1""")
def w04(t):
    c = mac.masked_mac(pairing.all_pairs(t.modes), t.shapes)
    e = pairing.best_by_mac(c, "exp", 2).select(F.lit("EXP").alias("side"), "cmp_id", F.col("exp_mode").alias("own"),
                                                F.col("fe_mode").alias("other"), "mac_rank", "mac")
    f = pairing.best_by_mac(c, "fe", 1).select(F.lit("FE").alias("side"), "cmp_id", F.col("fe_mode").alias("own"),
                                               F.col("exp_mode").alias("other"), "mac_rank", "mac")
    return e.unionByName(f)


@query("w05_nearest_in_grid", "side cmp_id:i fe_mode:i exp_mode:i err:6",
       f"""WITH win AS ({WINDOW_SQL}) SELECT 'FE' AS side, * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY cmp_id, fe_mode
 ORDER BY abs(err), exp_mode) AS k FROM win) WHERE k = 1 UNION ALL SELECT 'EXP' AS side, * EXCLUDE k FROM (SELECT *, row_number() OVER
 (PARTITION BY cmp_id, exp_mode ORDER BY abs(err), fe_mode) AS k FROM win) WHERE k = 1""")
def w05(t):
    return pairing.nearest_in_grid(pairing.frequency_window_pairs(t.modes))


@query("k06_pairs_in_order", "cmp_id:i position:i fe_mode:i",
       "SELECT cmp_id, row_number() OVER (PARTITION BY cmp_id ORDER BY fe_hz, fe_mode) AS position, fe_mode FROM fx_pairs")
def k06(t):
    return pairing.order_changes(t.pairs).withColumnRenamed("fe_rank", "position").orderBy("cmp_id", "position")

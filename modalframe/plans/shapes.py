"""Queries of Gram-based shape operators, clusters, tracking and quality roll-ups."""
from __future__ import annotations

from pyspark.sql import functions as F

from modalframe.operators import frf, mac, pairing
from modalframe.operators import shapes as sh
from modalframe.operators import spatial as sp
from modalframe.plans import frequency as fq
from modalframe.plans.correlation import STATUS_SQL, WINDOW_SQL
from modalframe.plans.registry import query

CMP = "CAST(floor(vec_id / 200) AS BIGINT) * 100 + label"
# Reference state = the real part a; two perturbed states. In even comparisons the modes 4n+1 and 4n+2 are mixed by a
# rotation, so they are lost one by one but kept as a subspace.
VV = f"""SELECT {CMP} AS cmp_id, vec_id, p, a, c, row_number() OVER (PARTITION BY {CMP}, p ORDER BY vec_id) AS k, lead(a) OVER (PARTITION BY {CMP}, p ORDER BY vec_id) AS an,
 lag(a) OVER (PARTITION BY {CMP}, p ORDER BY vec_id) AS ap FROM fx_vec"""
REFS = f"SELECT {CMP} AS cmp_id, vec_id AS i, CAST(floor(p / 3) AS BIGINT) AS node_id, CAST(p % 3 + 1 AS INT) AS dof, a AS value FROM fx_vec"
STATES = f"""SELECT cmp_id, d AS direction, vec_id AS j, CAST(floor(p / 3) AS BIGINT) AS node_id, CAST(p % 3 + 1 AS INT) AS dof,
 CASE WHEN cmp_id % 2 = 0 AND k % 4 = 1 AND an IS NOT NULL THEN cos(0.5e0) * a + sin(0.5e0) * an WHEN cmp_id % 2 = 0 AND k % 4 = 2 THEN cos(0.5e0) * a - sin(0.5e0) * ap ELSE a END
 + 0.09e0 * ((vec_id * d) % 6) * c AS value FROM ({VV}) vv CROSS JOIN (SELECT 1 AS d UNION ALL SELECT 2 AS d) dd"""
CLUST = f"""SELECT cmp_id, min(vec_id) AS i1, max(vec_id) AS i2, CAST(floor(k / 4) AS BIGINT) AS cluster_id FROM (SELECT DISTINCT cmp_id, vec_id, k FROM ({VV}) z WHERE cmp_id % 2 = 0 AND k % 4 IN (1, 2)) y
 GROUP BY cmp_id, CAST(floor(k / 4) AS BIGINT) HAVING count(*) = 2"""
FREQ = """SELECT cmp_id, mode_no AS i, frequency_hz AS ref_hz, frequency_hz * (1e0 + 0.02e0 * ((mode_no * 5) % 9 - 4)) AS cand_hz FROM fx_modes WHERE role = 'FE'"""
MACS_SQL = f"""refs AS ({REFS}), states AS ({STATES}), macs AS (SELECT r.cmp_id, direction, i, j, pow(sum(r.value * s.value), 2) / (sum(r.value * r.value) * sum(s.value * s.value)) AS mac
 FROM refs r JOIN states s USING (cmp_id, node_id, dof) GROUP BY 1, 2, 3, 4),
 hits AS (SELECT cmp_id, direction, i, count(*) AS n, min(j) AS j FROM macs WHERE mac >= 0.9 GROUP BY 1, 2, 3), claims AS (SELECT cmp_id, direction, j, count(*) AS nc FROM hits WHERE n = 1 GROUP BY 1, 2, 3),
 best AS (SELECT cmp_id, direction, i, max(mac) AS best_mac FROM macs GROUP BY 1, 2, 3),
 tr AS (SELECT b.*, CASE WHEN n = 1 AND nc = 1 THEN h.j END AS j, CASE WHEN coalesce(n, 0) = 0 THEN 'LOSS' WHEN n > 1 THEN 'AMBIGUOUS' WHEN nc > 1 THEN 'EXCHANGE' ELSE 'TRACKED' END AS status
 FROM best b LEFT JOIN hits h USING (cmp_id, direction, i) LEFT JOIN claims c ON c.cmp_id = b.cmp_id AND c.direction = b.direction AND c.j = h.j)"""
SUB_SQL = f"""cl AS ({CLUST}), bs AS (SELECT cl.cmp_id, cluster_id, i1, i2, a.node_id, a.dof, a.value AS p1, b.value AS p2 FROM cl JOIN refs a ON a.cmp_id = cl.cmp_id AND a.i = i1 JOIN refs b ON b.cmp_id = cl.cmp_id AND b.i = i2 AND b.node_id = a.node_id AND b.dof = a.dof),
 g1 AS (SELECT *, p1 / sqrt(sum(p1 * p1) OVER w) AS q1, sum(p1 * p2) OVER w / sum(p1 * p1) OVER w AS t FROM bs WINDOW w AS (PARTITION BY cmp_id, cluster_id)),
 g2 AS (SELECT cmp_id, cluster_id, node_id, dof, q1, (p2 - t * p1) / sqrt(sum(pow(p2 - t * p1, 2)) OVER (PARTITION BY cmp_id, cluster_id)) AS q2 FROM g1),
 c1 AS (SELECT g.cmp_id, cluster_id, direction, j, sum(q1 * value) AS u1, sum(q2 * value) AS u2 FROM g2 g JOIN states USING (cmp_id, node_id, dof) GROUP BY 1, 2, 3, 4),
 gg AS (SELECT a.cmp_id, a.direction, a.j, b.j AS j2, sum(a.value * b.value) AS s FROM states a JOIN states b USING (cmp_id, direction, node_id, dof) WHERE a.j <= b.j GROUP BY 1, 2, 3, 4),
 c2 AS (SELECT x.cmp_id, x.cluster_id, x.direction, x.j, y.j AS j2, x.u1, x.u2, (y.u1 - ab.s / aa.s * x.u1) AS v1, (y.u2 - ab.s / aa.s * x.u2) AS v2, aa.s AS n1, bb.s - ab.s * ab.s / aa.s AS n2
 FROM c1 x JOIN c1 y ON x.cmp_id = y.cmp_id AND x.cluster_id = y.cluster_id AND x.direction = y.direction AND x.j < y.j
 JOIN gg aa ON aa.cmp_id = x.cmp_id AND aa.direction = x.direction AND aa.j = x.j AND aa.j2 = x.j JOIN gg bb ON bb.cmp_id = x.cmp_id AND bb.direction = x.direction AND bb.j = y.j AND bb.j2 = y.j
 JOIN gg ab ON ab.cmp_id = x.cmp_id AND ab.direction = x.direction AND ab.j = x.j AND ab.j2 = y.j),
 c3 AS (SELECT *, (u1 * u1 + u2 * u2) / n1 + (v1 * v1 + v2 * v2) / n2 AS s, pow(u1 * v2 - u2 * v1, 2) / (n1 * n2) AS d FROM c2),
 c4 AS (SELECT *, least(s / 2 + sqrt(greatest(s * s / 4 - d, 0e0)), 1e0) AS k1, s / 2 - sqrt(greatest(s * s / 4 - d, 0e0)) AS k2 FROM c3),
 sb AS (SELECT cl.cmp_id, cl.cluster_id, dir.direction, i1, i2, count(c4.j) AS n_pairs, CASE WHEN count(c4.j) = 1 THEN min(c4.j) END AS j, CASE WHEN count(c4.j) = 1 THEN min(c4.j2) END AS j2,
 CASE WHEN count(c4.j) = 1 THEN min(k1) END AS cos2_1, CASE WHEN count(c4.j) = 1 THEN min(k2) END AS cos2_2
 FROM cl CROSS JOIN (SELECT 1 AS direction UNION ALL SELECT 2) dir LEFT JOIN c4 ON c4.cmp_id = cl.cmp_id AND c4.cluster_id = cl.cluster_id AND c4.direction = dir.direction AND k2 > 0.95 GROUP BY 1, 2, 3, 4, 5)"""


def branch_macs(t):
    """FE-to-FE MACs of the reference rows with every mode of each state on the shared node set."""
    refs, states = t.sql(REFS), t.sql(STATES)
    dirs = states.select("cmp_id", "direction").distinct()
    return sh.real_mac(sh.real_products(None, refs.join(dirs, "cmp_id"), states, ["cmp_id", "direction"])), refs, states


def tracked(t):
    macs, _, _ = branch_macs(t)
    return sh.track_branches(macs, None, ["cmp_id", "direction"])


def subspaces(t):
    refs, states = t.sql(REFS), t.sql(STATES)
    cl = t.sql(CLUST).withColumn("direction", F.explode(F.array(F.lit(1), F.lit(2))))
    left = refs.withColumn("direction", F.explode(F.array(F.lit(1), F.lit(2))))
    return sh.track_subspaces(cl, left, states, ["cmp_id", "direction"])


@query("j16_branch_tracking", "cmp_id:i direction:i i:i j:i best_mac:6 status", f"WITH {MACS_SQL} SELECT * FROM tr")
def j16(t):
    return tracked(t)


@query("j17_subspace_tracking", "cmp_id:i cluster_id:i direction:i n_pairs:i j:i j2:i cos2_1:6 cos2_2:6", f"WITH {MACS_SQL}, {SUB_SQL} SELECT * FROM sb")
def j17(t):
    return subspaces(t)


@query("a34_cluster_confirmation", "cmp_id:i cluster_id:i n_directions:i verdict",
       f"""WITH {MACS_SQL}, {SUB_SQL}, ind AS (SELECT sb.cmp_id, sb.cluster_id, sb.direction, n_pairs, bool_and(tr.status = 'TRACKED') AS stable FROM sb JOIN tr ON tr.cmp_id = sb.cmp_id AND tr.direction = sb.direction AND tr.i IN (sb.i1, sb.i2) GROUP BY 1, 2, 3, 4)
 SELECT cmp_id, cluster_id, count(*) AS n_directions, CASE WHEN NOT bool_and(n_pairs = 1) THEN 'UNSTABLE' WHEN bool_and(stable) THEN 'INDEPENDENT' ELSE 'CONFIRMED' END AS verdict FROM ind GROUP BY 1, 2""")
def a34(t):
    s = subspaces(t)
    m = s.select("cmp_id", "cluster_id", "direction", F.explode(F.array("i1", "i2")).alias("i"))
    ind = m.join(tracked(t), ["cmp_id", "direction", "i"]).withColumn("stable", F.col("status") == "TRACKED")
    return sh.confirm_clusters(ind, s, ["cmp_id"])


@query("w11_order_swaps", "cmp_id:i i:i k:i",
       f"""WITH f AS ({FREQ}) SELECT a.cmp_id, a.i, b.i AS k FROM f a JOIN f b ON a.cmp_id = b.cmp_id AND (a.ref_hz < b.ref_hz OR (a.ref_hz = b.ref_hz AND a.i < b.i)) AND a.cand_hz > b.cand_hz""")
def w11(t):
    return sh.order_swaps(t.sql(FREQ), ["cmp_id"])


@query("a68_weighted_real_mac", "cmp_id:i direction:i i:i j:i mac:6",
       f"""WITH refs AS ({REFS}), states AS ({STATES}) SELECT cmp_id, direction, i, j, pow(sum((1e0 + node_id) * r.value * s.value), 2) / (sum((1e0 + node_id) * r.value * r.value) * sum((1e0 + node_id) * s.value * s.value)) AS mac
 FROM refs r JOIN states s USING (cmp_id, node_id, dof) WHERE i = j GROUP BY 1, 2, 3, 4""")
def a68(t):
    states = t.sql(STATES)
    directions = states.select("cmp_id", "direction").distinct()
    pairs = t.modes.filter("role = 'FE'").select("cmp_id", F.col("mode_no").alias("i"), F.col("mode_no").alias("j")).join(directions, "cmp_id")
    weights = t.nodes.select("cmp_id", "node_id", (1.0 + F.col("node_id")).alias("weight"))
    return sh.real_mac(sh.real_products(pairs, t.sql(REFS).join(directions, "cmp_id"), states, ["cmp_id", "direction"], weights.join(directions, "cmp_id")))


@query("a17_principal_angles", "cmp_id:i cluster_id:i direction:i cos2_1:6 cos2_2:6",
       f"""WITH {MACS_SQL}, {SUB_SQL} SELECT cl.cmp_id, cl.cluster_id, c4.direction, k1 AS cos2_1, k2 AS cos2_2 FROM cl JOIN c4 ON c4.cmp_id = cl.cmp_id AND c4.cluster_id = cl.cluster_id AND c4.j = i1 AND c4.j2 = i2""")
def a17(t):
    cl = t.sql(CLUST)
    refs, st = t.sql(REFS), t.sql(STATES)
    pick = lambda df, src, mode, name: df.join(src.select(*[c for c in ("cmp_id", "direction") if c in src.columns], F.col(mode[0]).alias(mode[1]), "node_id", "dof", F.col("value").alias(name)),
                                               ["cmp_id", mode[1], *[c for c in ("node_id", "dof", "direction") if c in df.columns and c in src.columns]])
    d = pick(pick(pick(pick(cl, refs, ("i", "i1"), "p1"), refs, ("i", "i2"), "p2"), st, ("j", "i1"), "q1"), st, ("j", "i2"), "q2")
    s = lambda a, b: F.sum(F.col(a) * F.col(b)).alias(a + b)
    g = d.groupBy("cmp_id", "cluster_id", "direction").agg(s("p1", "p1"), s("p1", "p2"), s("p2", "p2"), s("q1", "q1"), s("q1", "q2"), s("q2", "q2"),
                                              s("p1", "q1"), s("p1", "q2"), s("p2", "q1"), s("p2", "q2"))
    hi, lo = sh.cos2_columns(*[F.col(c) for c in ("p1p1", "p1p2", "p2p2", "q1q1", "q1q2", "q2q2", "p1q1", "p1q2", "p2q1", "p2q2")])
    return g.withColumn("cos2_1", hi).withColumn("cos2_2", lo)


GROUPS = """SELECT cmp_id, CAST(floor((k - 1) / 2) AS BIGINT) AS group_id, min(exp_mode) AS m1, max(exp_mode) AS m2 FROM (SELECT *, row_number() OVER (PARTITION BY cmp_id ORDER BY exp_mode) AS k FROM fx_pairs) z
 GROUP BY cmp_id, CAST(floor((k - 1) / 2) AS BIGINT) HAVING count(*) = 2"""
GROUP_ROWS = f"""SELECT g.cmp_id, g.group_id, a.node_id, a.dof, a.re AS p1r, a.im AS p1i, b.re AS p2r, b.im AS p2i, c.re AS q1r, c.im AS q1i, d.re AS q2r, d.im AS q2i FROM ({GROUPS}) g
 JOIN fx_shapes a ON a.cmp_id = g.cmp_id AND a.mode_no = m1 AND a.role = 'FE' JOIN fx_shapes b ON b.cmp_id = g.cmp_id AND b.mode_no = m2 AND b.role = 'FE' AND b.node_id = a.node_id AND b.dof = a.dof
 JOIN fx_shapes c ON c.cmp_id = g.cmp_id AND c.mode_no = m1 AND c.role = 'EXP' AND c.measured AND c.node_id = a.node_id AND c.dof = a.dof
 JOIN fx_shapes d ON d.cmp_id = g.cmp_id AND d.mode_no = m2 AND d.role = 'EXP' AND d.measured AND d.node_id = a.node_id AND d.dof = a.dof"""


@query("a16_subspace_mac", "cmp_id:i group_id:i n_dof:i rank_p:i rank_q:i subspace_mac:6",
       f"""WITH r AS ({GROUP_ROWS}), w1 AS (SELECT *, sum(p1r * p1r + p1i * p1i) OVER w AS np, sum(q1r * q1r + q1i * q1i) OVER w AS nq, sum(p1r * p2r + p1i * p2i) OVER w AS ar, sum(p1r * p2i - p1i * p2r) OVER w AS ai,
 sum(q1r * q2r + q1i * q2i) OVER w AS br, sum(q1r * q2i - q1i * q2r) OVER w AS bi FROM r WINDOW w AS (PARTITION BY cmp_id, group_id)),
 w2 AS (SELECT *, p2r - (ar * p1r - ai * p1i) / np AS e2r, p2i - (ar * p1i + ai * p1r) / np AS e2i, q2r - (br * q1r - bi * q1i) / nq AS f2r, q2i - (br * q1i + bi * q1r) / nq AS f2i FROM w1),
 s AS (SELECT cmp_id, group_id, count(*) AS n_dof, any_value(np) AS np, any_value(nq) AS nq, sum(e2r * e2r + e2i * e2i) AS ne, sum(f2r * f2r + f2i * f2i) AS nf,
 pow(sum(p1r * q1r + p1i * q1i), 2) + pow(sum(p1r * q1i - p1i * q1r), 2) AS x11, pow(sum(p1r * f2r + p1i * f2i), 2) + pow(sum(p1r * f2i - p1i * f2r), 2) AS x12,
 pow(sum(e2r * q1r + e2i * q1i), 2) + pow(sum(e2r * q1i - e2i * q1r), 2) AS x21, pow(sum(e2r * f2r + e2i * f2i), 2) + pow(sum(e2r * f2i - e2i * f2r), 2) AS x22 FROM w2 GROUP BY 1, 2)
 SELECT cmp_id, group_id, n_dof, 2 AS rank_p, 2 AS rank_q, (x11 / (np * nq) + x12 / (np * nf) + x21 / (ne * nq) + x22 / (ne * nf)) / 2 AS subspace_mac FROM s""")
def a16(t):
    return sh.subspace_mac_pairs(t.sql(GROUP_ROWS), ["cmp_id", "group_id"])


@query("a18_energy_in_span", "cmp_id:i group_id:i share:6",
       f"""WITH r AS (SELECT cmp_id, group_id, p1r AS b1, p2r AS b2, q1r AS er, q1i AS ei FROM ({GROUP_ROWS})), g AS (SELECT *, sum(b1 * b1) OVER w AS n1, sum(b1 * b2) OVER w AS n12 FROM r WINDOW w AS (PARTITION BY cmp_id, group_id)),
 h AS (SELECT *, b2 - n12 / n1 * b1 AS c2 FROM g) SELECT cmp_id, group_id, ((pow(sum(b1 * er), 2) + pow(sum(b1 * ei), 2)) / any_value(n1) + (pow(sum(c2 * er), 2) + pow(sum(c2 * ei), 2)) / sum(c2 * c2)) / sum(er * er + ei * ei) AS share FROM h GROUP BY 1, 2""")
def a18(t):
    r = t.sql(GROUP_ROWS).select("cmp_id", "group_id", F.col("p1r").alias("b1"), F.col("p2r").alias("b2"), F.col("q1r").alias("er"), F.col("q1i").alias("ei"))
    return sh.span_share(r, ["cmp_id", "group_id"])


@query("a61_two_mode_features", "cmp_id:i group_id:i centre_residual:6 splitting_residual:6",
       f"""SELECT g.cmp_id, g.group_id, avg(ln(fe_hz)) - avg(ln(exp_hz)) AS centre_residual, pow(max(ln(fe_hz)) - min(ln(fe_hz)), 2) / 4 - pow(max(ln(exp_hz)) - min(ln(exp_hz)), 2) / 4 AS splitting_residual
 FROM ({GROUPS}) g JOIN fx_pairs p ON p.cmp_id = g.cmp_id AND p.exp_mode IN (m1, m2) GROUP BY 1, 2""")
def a61(t):
    m = t.sql(GROUPS).select("cmp_id", "group_id", F.explode(F.array("m1", "m2")).alias("exp_mode"))
    return two_mode_features(m.join(t.pairs, ["cmp_id", "exp_mode"]), ["cmp_id", "group_id"])


def two_mode_features(rows, keys):
    """Centre and squared splitting in ln f of each two-mode family, FE minus measured."""
    f = lambda c: (F.avg(F.log(c)), F.pow(F.max(F.log(c)) - F.min(F.log(c)), 2) / 4)
    (cf, sf), (ce, se) = f("fe_hz"), f("exp_hz")
    return rows.groupBy(*keys).agg((cf - ce).alias("centre_residual"), (sf - se).alias("splitting_residual"), F.count(F.lit(1)).alias("n")).filter("n = 2")


@query("a62_binned_field", "dataset_id:i cell_x:i cell_y:i mean:6 n:i",
       """WITH b AS (SELECT dataset_id, min(x) AS x0, max(x) AS x9, min(y) AS y0, max(y) AS y9 FROM fx_fe_points GROUP BY 1),
 c AS (SELECT p.*, x0, x9, y0, y9, greatest(2, round_even(8e0 * (x9 - x0) / greatest(x9 - x0, y9 - y0), 0)) AS nx, greatest(2, round_even(8e0 * (y9 - y0) / greatest(x9 - x0, y9 - y0), 0)) AS ny FROM fx_fe_points p JOIN b USING (dataset_id))
 SELECT dataset_id, CAST(least(floor((x - x0) / (x9 - x0) * nx), nx - 1) AS INT) AS cell_x, CAST(least(floor((y - y0) / (y9 - y0) * ny), ny - 1) AS INT) AS cell_y, avg(z) AS mean, count(*) AS n FROM c GROUP BY 1, 2, 3""")
def a62(t):
    return sh.binned_field(t.fe_points, ["dataset_id"], "z", 8)


@query("a69_mass_weighted_mac", "cmp_id:i i_mode:i j_mode:i mac:6",
       f"""WITH win AS ({WINDOW_SQL}), s AS (SELECT cmp_id, role, mode_no, CAST(node_id * 3 + dof - 1 AS INT) AS k, re AS v, cmp_id % 4 AS matrix_id FROM fx_shapes),
 my AS (SELECT s.cmp_id, s.role, s.mode_no, m.i AS k, sum(m.mass * s.v) AS y FROM s JOIN fx_matrix m ON m.matrix_id = s.matrix_id AND m.j = s.k GROUP BY 1, 2, 3, 4),
 q AS (SELECT s.cmp_id, s.role, s.mode_no, sum(s.v * y) AS n FROM s JOIN my USING (cmp_id, role, mode_no, k) GROUP BY 1, 2, 3),
 x AS (SELECT w.cmp_id, fe_mode, exp_mode, sum(s.v * y) AS x FROM win w JOIN s ON s.cmp_id = w.cmp_id AND s.role = 'FE' AND s.mode_no = fe_mode JOIN my ON my.cmp_id = w.cmp_id AND my.role = 'EXP' AND my.mode_no = exp_mode AND my.k = s.k GROUP BY 1, 2, 3)
 SELECT x.cmp_id, fe_mode AS i_mode, exp_mode AS j_mode, CASE WHEN a.n > 0 AND b.n > 0 THEN least(x * x / (a.n * b.n), 1e0) END AS mac FROM x JOIN q a ON a.cmp_id = x.cmp_id AND a.role = 'FE' AND a.mode_no = fe_mode
 JOIN q b ON b.cmp_id = x.cmp_id AND b.role = 'EXP' AND b.mode_no = exp_mode""")
def a69(t):
    pairs = pairing.frequency_window_pairs(t.modes).select("cmp_id", F.col("fe_mode").alias("i_mode"), F.col("exp_mode").alias("j_mode"))
    s = t.shapes.select("cmp_id", "role", F.col("mode_no").alias("mode"), (F.col("node_id") * 3 + F.col("dof") - 1).cast("int").alias("dof_index"),
                        F.col("re").alias("value"), (F.col("cmp_id") % 4).alias("matrix_id"))
    mass = t.matrix.select("matrix_id", "i", "j", F.col("mass").alias("value"))
    return sh.mass_weighted_mac(pairs, s.filter("role = 'FE'").drop("role"), s.filter("role = 'EXP'").drop("role"), mass, ["cmp_id"])


# Modes ---------------------------------------------------------------------------------------------------------------
@query("a15_rigid_body_residual", "cmp_id:i role mode_no:i rigid_residual:6 rigid")
def a15(t):
    return sh.rigid_residuals(t.shapes, t.nodes)


@query("a19_shape_invariants", "cmp_id:i role mode_no:i rigid_plane:6 saddle:6 dome:6 saddle_on_axes:6 saddle_on_diagonals:6")
def a19(t):
    return sh.shape_invariants(t.shapes, t.nodes)


@query("a71_principal_plane", "dataset_id:i n:i planarity_ratio:6 planar collinear")
def a71(t):
    return sh.principal_planes(t.fe_points, ["dataset_id"])


@query("a71_plane_projection", "dataset_id:i node_id:i distance:6")
def a71_projection(t):
    planes = sh.principal_planes(t.fe_points, ["dataset_id"])
    return sh.project_points(t.fe_points, planes, ["dataset_id"]).withColumn("distance", F.abs("pn"))


TRIG = "SELECT cmp_id, exp_mode AS id, exp_hz, fe_hz FROM fx_pairs"
REACH = """e AS (SELECT a.cmp_id, a.id AS a, b.id AS b FROM v a JOIN v b ON a.cmp_id = b.cmp_id AND {cond}),
 reach AS (SELECT cmp_id, id AS a, id AS b FROM v UNION SELECT r.cmp_id, r.a, e.b FROM reach r JOIN e ON e.cmp_id = r.cmp_id AND e.a = r.b),
 comp AS (SELECT cmp_id, a AS id, min(b) AS component, count(*) AS size FROM reach GROUP BY 1, 2)"""


@query("a31_trigger_groups", "cmp_id:i id:i component:i size:i exp_spacing:6 fe_spacing:6",
       f"""WITH RECURSIVE v AS ({TRIG}), {REACH.format(cond="(abs(a.exp_hz - b.exp_hz) / least(a.exp_hz, b.exp_hz) < 0.03 OR abs(a.fe_hz - b.fe_hz) / least(a.fe_hz, b.fe_hz) < 0.03)")},
 g AS (SELECT v.*, component, size, (exp_hz - lag(exp_hz) OVER x) / lag(exp_hz) OVER x AS ge, (fe_hz - lag(fe_hz) OVER y) / lag(fe_hz) OVER y AS gf FROM v JOIN comp USING (cmp_id, id)
 WINDOW x AS (PARTITION BY cmp_id, component ORDER BY exp_hz, id), y AS (PARTITION BY cmp_id, component ORDER BY fe_hz, id))
 SELECT cmp_id, id, component, size, max(ge) OVER (PARTITION BY cmp_id, component) AS exp_spacing, max(gf) OVER (PARTITION BY cmp_id, component) AS fe_spacing FROM g WHERE size > 1""")
def a31(t):
    return sh.trigger_groups(t.sql(TRIG), ["cmp_id"])


@query("a30_modal_clusters", "cmp_id:i cluster:i size:i members fe_splitting:6 exp_splitting:6 frequency_residual:6 inclusion",
       f"""WITH RECURSIVE v AS (SELECT *, exp_mode AS id, {STATUS_SQL} AS status FROM fx_pairs), {REACH.format(cond="abs(a.exp_hz - b.exp_hz) / (0.5e0 * (a.exp_hz + b.exp_hz)) <= 0.03 AND abs(a.fe_hz - b.fe_hz) / (0.5e0 * (a.fe_hz + b.fe_hz)) <= 0.03")}
 SELECT cmp_id, component AS cluster, count(*) AS size, string_agg(CAST(id AS VARCHAR), '-' ORDER BY id) AS members, max(fe_hz) - min(fe_hz) AS fe_splitting, max(exp_hz) - min(exp_hz) AS exp_splitting,
 avg(ln(fe_hz / exp_hz)) AS frequency_residual, CASE WHEN bool_and(status IN ('Excellent match', 'Good match', 'Frequency match')) THEN 'INCLUDED' ELSE 'EXCLUDED' END AS inclusion
 FROM v JOIN comp USING (cmp_id, id) WHERE comp.size > 1 GROUP BY 1, 2""")
def a30(t):
    p = t.pairs.withColumn("status", pairing.pair_status(F.col("mac"), F.col("err")))
    return modal_clusters(p, 0.03).withColumn("members", F.concat_ws("-", "members"))


def modal_clusters(pairs, gap):
    """Near-degenerate groups of accepted pairs (close in FE and measured frequency) with splitting and inclusion."""
    comp = sh.connected_components(pairs.select("cmp_id", F.col("exp_mode").alias("id")), sh.close_pair_edges(pairs, gap), ["cmp_id"])
    d = pairs.join(comp.withColumnRenamed("id", "exp_mode"), ["cmp_id", "exp_mode"])
    g = d.groupBy("cmp_id", F.col("component").alias("cluster")).agg(
        F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list("exp_mode")).alias("members"), (F.max("fe_hz") - F.min("fe_hz")).alias("fe_splitting"),
        (F.max("exp_hz") - F.min("exp_hz")).alias("exp_splitting"), F.avg(F.log(F.col("fe_hz") / F.col("exp_hz"))).alias("frequency_residual"),
        F.bool_and(F.col("status").isin("Excellent match", "Good match", "Frequency match")).alias("_ok")).filter("size > 1")
    return g.withColumn("inclusion", F.when(F.col("_ok"), "INCLUDED").otherwise("EXCLUDED"))


# Quality -------------------------------------------------------------------------------------------------------------
CONF_SQL = """am AS (SELECT a.cmp_id, a.mode_no AS i, b.mode_no AS j, (pow(sum(a.re * b.re + a.im * b.im), 2) + pow(sum(a.re * b.im - a.im * b.re), 2)) / (sum(a.re * a.re + a.im * a.im) * sum(b.re * b.re + b.im * b.im)) AS mac
 FROM fx_shapes a JOIN fx_shapes b ON a.cmp_id = b.cmp_id AND a.role = 'EXP' AND b.role = 'EXP' AND a.node_id = b.node_id AND a.dof = b.dof AND a.mode_no < b.mode_no WHERE a.dof IN (1, 3) GROUP BY 1, 2, 3),
 conf AS (SELECT cmp_id, max(mac) AS automac_max, sum(CASE WHEN mac > 0.5 THEN 1 ELSE 0 END) AS n_flagged, CASE WHEN sum(CASE WHEN mac > 0.5 THEN 1 ELSE 0 END) > 0 THEN 'WARNING' ELSE 'NOT_AVAILABLE' END AS status FROM am GROUP BY 1)"""


def confidence(t):
    rows = t.shapes.filter("role = 'EXP' and dof in (1, 3)").select("cmp_id", "node_id", "dof", F.col("mode_no").alias("exp_mode"), F.col("re").alias("er"), F.col("im").alias("ei"))
    g = mac.auto_mac(rows, "e").groupBy("cmp_id").agg(F.max("mac").alias("automac_max"), F.sum((F.col("mac") > 0.5).cast("int")).alias("n_flagged"))
    return g.withColumn("status", F.when(F.col("n_flagged") > 0, "WARNING").otherwise("NOT_AVAILABLE"))


@query("a28_modal_confidence", "cmp_id:i automac_max:6 n_flagged:i status", f"WITH {CONF_SQL} SELECT * FROM conf")
def a28(t):
    return confidence(t)


def worst_status(checks, keys):
    """Worst status over the checks of each key; a check that is not available does not degrade the result."""
    g = checks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_checks"), F.bool_or(F.col("status") == "FAIL").alias("_f"),
                                  F.bool_or(F.col("status") == "WARNING").alias("_w"))
    return g.withColumn("overall", F.when(F.col("_f"), "FAIL").when(F.col("_w"), "WARNING").otherwise("PASS")).drop("_f", "_w")


@query("a29_qc_rollup", "cmp_id:i n_checks:i overall",
       f"""WITH {CONF_SQL}, res AS ({fq.RES_SQL}), c AS (SELECT cmp_id, status FROM conf UNION ALL SELECT cmp_id, CASE WHEN bool_or(coalesce(unresolved, false) OR coalesce(close, false) OR NOT damping_available) THEN 'WARNING' ELSE 'PASS' END FROM res GROUP BY 1)
 SELECT cmp_id, count(*) AS n_checks, CASE WHEN bool_or(status = 'WARNING') THEN 'WARNING' ELSE 'PASS' END AS overall FROM c GROUP BY 1""")
def a29(t):
    bad = F.coalesce("unresolved", F.lit(False)) | F.coalesce("close", F.lit(False)) | ~F.col("damping_available")
    res = fq.resolved(t).groupBy("cmp_id").agg(F.bool_or(bad).alias("_b")).select("cmp_id", F.when(F.col("_b"), "WARNING").otherwise("PASS").alias("status"))
    return worst_status(confidence(t).select("cmp_id", "status").unionByName(res), ["cmp_id"])


@query("a72_series_summary", "cmp_id:i mode_no:i frequency_hz:6 mpc:6 axes saddle:6 dome:6 group_size:i pitch:6")
def a72(t):
    exp = t.modes.filter("role = 'EXP'")
    shapes = t.shapes.filter("role = 'EXP'")
    pitch = sp.grid_pitch(t.nodes, ["cmp_id"], "node_id")
    axes = shapes.filter("measured and (re <> 0 or im <> 0)").groupBy("cmp_id", "mode_no").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_set("dof")), lambda d: F.get(F.array(F.lit("X"), F.lit("Y"), F.lit("Z")), d - 1))).alias("axes"))
    groups = frf.close_groups(exp, ["cmp_id"], 0.0, 0.03, singletons=True).select("cmp_id", "mode_no", "group_size")
    out = exp.join(mac.phase_measures(shapes).select("cmp_id", "mode_no", "mpc"), ["cmp_id", "mode_no"], "left").join(axes, ["cmp_id", "mode_no"], "left")
    out = out.join(sh.shape_invariants(shapes, t.nodes, pitch.select("cmp_id", "angle_deg")).drop("role"), ["cmp_id", "mode_no"], "left")
    return out.join(groups, ["cmp_id", "mode_no"], "left").join(pitch, "cmp_id", "left")



"""Queries of geometry: nearest nodes, orientations, registrations, symmetry and grids."""
from __future__ import annotations

from pyspark.sql import functions as F

from modalframe.functions.policies import ShapeFamilyPolicy, policy_text, require_policy
from modalframe.functions.cplx import abs2, dot_im, dot_re, mac_value
from modalframe.operators import spatial as sp
from modalframe.plans.registry import query

# Inputs shared by both engines ---------------------------------------------------------------------------------------
REG = """SELECT DISTINCT dataset_id, cos(0.02e0 * (dataset_id % 5)) AS c, sin(0.02e0 * (dataset_id % 5)) AS s,
 1e0 + 0.01e0 * (dataset_id % 3) AS k, 0.5e0 * (dataset_id % 4) AS tx, 0.25e0 * (dataset_id % 7) AS ty FROM fx_fe_points"""
MAP = """SELECT dataset_id, point_id, dataset_id * 100 + point_id % 75 + CASE WHEN point_id % 29 = 7 THEN 1 ELSE 0 END + CASE WHEN dataset_id % 6 = 5 AND point_id % 75 = 3 THEN 900000000 ELSE 0 END AS node_id
 FROM fx_exp_points WHERE NOT (dataset_id % 6 = 4 AND point_id % 75 = 9)"""
GRID = """SELECT dataset_id, point_id, gx * cos(0.5e0) - gy * sin(0.5e0) AS x, gx * sin(0.5e0) + gy * cos(0.5e0) AS y FROM (
 SELECT CAST(floor(c_custkey / 75) AS BIGINT) AS dataset_id, c_custkey AS point_id, 10e0 * (c_custkey % 75 % 8) + 0.000001e0 * c_acctbal AS gx,
 10e0 * floor(c_custkey % 75 / 8) + 0.0000007e0 * c_acctbal AS gy FROM customer)"""
GRID2 = f"""SELECT dataset_id, CASE WHEN dataset_id % 3 = 1 AND point_id % 75 < 2 THEN point_id + 1 - 2 * (point_id % 75) ELSE point_id END AS point_id, -y AS x,
 CASE WHEN dataset_id % 4 = 3 THEN -x ELSE x END AS y FROM ({GRID})"""
SYM = """SELECT CAST(floor(p_partkey / 100) AS BIGINT) AS dataset_id, p_partkey AS node_id, 10e0 * (p_partkey % 10) + 0.01e0 * (p_size % 7) AS x,
 (10e0 - 2e0 * (CAST(floor(p_partkey / 100) AS BIGINT) % 2)) * floor((p_partkey % 100) / 10) + 0.01e0 * (p_size % 9) AS y,
 sin(0.3e0 * (p_partkey % 10 - 4.5e0) * (1 + CAST(floor(p_partkey / 100) AS BIGINT) % 3)) * cos(0.35e0 * (floor((p_partkey % 100) / 10) - 4.5e0)) + 0.002e0 * (p_size % 11) AS w FROM part
 WHERE NOT (CAST(floor(p_partkey / 100) AS BIGINT) % 5 = 4 AND p_partkey % 100 IN (0, 1, 2, 3, 12, 13, 14, 15))"""


def registrations(t):
    r = t.sql(REG)
    zero, one = F.lit(0.0), F.lit(1.0)
    rot = F.array(F.array(F.col("c"), -F.col("s"), zero), F.array(F.col("s"), F.col("c"), zero), F.array(zero, zero, one))
    return r.select("dataset_id", rot.alias("rotation"), F.array("k", "k", "k").alias("scales"), F.array(F.col("tx"), F.col("ty"), zero).alias("translation"))


# Projections ---------------------------------------------------------------------------------------------------------
@query("p14_points_to_fe", "dataset_id:i point_id:i fx:6 fy:6 fz:6",
       f"WITH r AS ({REG}) SELECT p.dataset_id, point_id, ((x - tx) * c - (y - ty) * s) / k AS fx, ((x - tx) * s + (y - ty) * c) / k AS fy, z / k AS fz FROM fx_exp_points p JOIN r USING (dataset_id)")
def p14(t):
    return sp.points_to_fe(t.exp_points.join(registrations(t), "dataset_id"))


@query("p14_points_to_exp", "dataset_id:i node_id:i ex:6 ey:6 ez:6",
       f"WITH r AS ({REG}) SELECT p.dataset_id, node_id, (x * c + y * s) * k + tx AS ex, (y * c - x * s) * k + ty AS ey, z * k AS ez FROM fx_fe_points p JOIN r USING (dataset_id)")
def p14_back(t):
    return sp.points_to_exp(t.fe_points.join(registrations(t), "dataset_id"))


@query("p14_rotated_shapes", "cmp_id:i mode_no:i node_id:i v1:6 v2:6 v3:6 w1:6 w2:6 w3:6",
       """WITH w AS (SELECT cmp_id, mode_no, node_id, max(CASE WHEN dof = 1 THEN re END) AS a, max(CASE WHEN dof = 2 THEN re END) AS b, max(CASE WHEN dof = 3 THEN re END) AS c,
 max(CASE WHEN dof = 1 THEN im END) AS d, max(CASE WHEN dof = 2 THEN im END) AS e, max(CASE WHEN dof = 3 THEN im END) AS f
 FROM fx_shapes WHERE role = 'FE' GROUP BY 1, 2, 3)
 SELECT cmp_id, mode_no, node_id, a * cos(0.1e0 * (cmp_id % 10)) + b * sin(0.1e0 * (cmp_id % 10)) AS v1, b * cos(0.1e0 * (cmp_id % 10)) - a * sin(0.1e0 * (cmp_id % 10)) AS v2, c AS v3,
 d * cos(0.1e0 * (cmp_id % 10)) + e * sin(0.1e0 * (cmp_id % 10)) AS w1, e * cos(0.1e0 * (cmp_id % 10)) - d * sin(0.1e0 * (cmp_id % 10)) AS w2, f AS w3 FROM w""")
def p14_shapes(t):
    w = t.shapes.filter("role = 'FE'").groupBy("cmp_id", "mode_no", "node_id").agg(*[F.max(F.when(F.col("dof") == d, F.col(p))).alias(f"{n}{d}") for p, n in (("re", "u"), ("im", "i")) for d in (1, 2, 3)])
    ang = 0.1 * (F.col("cmp_id") % 10)
    zero, one = F.lit(0.0), F.lit(1.0)
    w = w.withColumn("rotation", F.array(F.array(F.cos(ang), -F.sin(ang), zero), F.array(F.sin(ang), F.cos(ang), zero), F.array(zero, zero, one)))
    return sp.vectors_to_exp(sp.vectors_to_exp(w, ("u1", "u2", "u3"), ("v1", "v2", "v3")), ("i1", "i2", "i3"), ("w1", "w2", "w3"))


EVID = """SELECT DISTINCT dataset_id, 40e0 AS centre_x, 30e0 AS centre_y, cos(0.1e0 * dataset_id) AS u_x, sin(0.1e0 * dataset_id) AS u_y, -sin(0.1e0 * dataset_id) AS v_x, cos(0.1e0 * dataset_id) AS v_y,
 2e0 AS mm_per_unit, -80e0 AS su_min, -60e0 AS sv_min, 5e0 AS off_u, 6e0 AS off_v, 200e0 AS plan_x, 160e0 AS plan_y, dataset_id % 2 AS flip FROM fx_exp_points"""


@query("p15_evidence_point_map", "dataset_id:i point_id:i fe_x:6 fe_y:6",
       f"""WITH e AS ({EVID}), q AS (SELECT p.dataset_id, point_id, flip, ((x - 40e0) * u_x + (y - 30e0) * u_y) * 2e0 + 80e0 + 5e0 AS su, ((x - 40e0) * v_x + (y - 30e0) * v_y) * 2e0 + 60e0 + 6e0 AS sv
 FROM fx_exp_points p JOIN e USING (dataset_id))
 SELECT dataset_id, point_id, CASE WHEN flip = 0 THEN su ELSE 200e0 - sv END - 10e0 AS fe_x, CASE WHEN flip = 0 THEN sv ELSE su END - 20e0 AS fe_y FROM q""")
def p15(t):
    e = t.sql(EVID)
    row = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    straight = F.array(row(1, 0, 0), row(0, 1, 0), row(0, 0, 1))
    turned = F.array(row(0, -1, 0), row(1, 0, 0), row(0, 0, 1))
    e = e.withColumn("scan_to_phi", F.when(F.col("flip") == 0, straight).otherwise(turned)).withColumn("phi_to_fe", straight).withColumn("origin", row(10, 20, 0))
    return sp.evidence_map(t.exp_points, e)


@query("p16_unit_normalisation", "reading_id:i position:i value_mm:6 refused",
       """SELECT reading_id, position, CASE unit WHEN 'mm' THEN value WHEN 'm' THEN value * 1000e0 END AS value_mm, unit NOT IN ('mm', 'm', 'cm') AS refused FROM fx_meas""")
def p16(t):
    return t.meas.withColumn("value_mm", F.col("value") * sp.length_factor(F.col("unit"))).withColumn("refused", sp.length_factor(F.col("unit")).isNull())


@query("p09_surface_nodes", "dataset_id:i node_id:i instance z:6",
       "SELECT dataset_id, node_id, instance, z FROM (SELECT *, max(z) OVER (PARTITION BY dataset_id, instance) AS m FROM fx_fe_points) WHERE abs(z - m) <= 1e-6")
def p09(t):
    return sp.surface_nodes(t.fe_points)


WANTED = """SELECT dataset_id, node_id + CASE WHEN dataset_id % 5 = 3 AND node_id % 100 = 4 THEN 700000000 ELSE 0 END AS node_id FROM fx_fe_points WHERE node_id % 100 < CASE WHEN dataset_id % 5 = 1 THEN 2 ELSE 12 END
 UNION ALL SELECT dataset_id, node_id FROM fx_fe_points WHERE dataset_id % 5 = 2 AND node_id % 100 = 7"""


@query("p10_mapping_node_subset", "dataset_id:i n_requested:i n_duplicates:i n_unknown:i verdict",
       f"""WITH w AS (SELECT dataset_id, node_id, count(*) AS k FROM ({WANTED}) GROUP BY 1, 2), g AS (SELECT w.dataset_id, sum(k) AS n_requested, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS n_duplicates,
 sum(CASE WHEN f.node_id IS NULL THEN 1 ELSE 0 END) AS n_unknown FROM w LEFT JOIN fx_fe_points f ON f.dataset_id = w.dataset_id AND f.node_id = w.node_id GROUP BY 1)
 SELECT *, CASE WHEN n_duplicates > 0 THEN 'duplicate node ids' WHEN n_requested < 3 THEN 'fewer than three nodes' WHEN n_unknown > 0 THEN 'unknown node ids' ELSE 'ok' END AS verdict FROM g""")
def p10(t):
    return sp.mapping_subset(t.fe_points, t.sql(WANTED))


# Nearest -------------------------------------------------------------------------------------------------------------
NEAR_SQL = """SELECT p.dataset_id, p.point_id, f.node_id, sqrt(pow(p.x - f.x, 2) + pow(p.y - f.y, 2) + pow(p.z - f.z, 2)) AS distance, row_number() OVER (PARTITION BY p.dataset_id, p.point_id
 ORDER BY pow(p.x - f.x, 2) + pow(p.y - f.y, 2) + pow(p.z - f.z, 2), f.node_id) AS nearness FROM fx_exp_points p JOIN fx_fe_points f USING (dataset_id)"""


@query("j06_nearest_node", "dataset_id:i point_id:i node_id:i distance:6", f"SELECT * FROM ({NEAR_SQL}) WHERE nearness = 1")
def j06(t):
    return sp.nearest_points(t.exp_points, t.fe_points, ["dataset_id"], ["point_id"], "node_id")


@query("j06_nearest_eight_nodes", "dataset_id:i point_id:i node_id:i nearness:i distance:6", f"SELECT * FROM ({NEAR_SQL}) WHERE nearness <= 8")
def j06_eight(t):
    return sp.nearest_points(t.exp_points, t.fe_points, ["dataset_id"], ["point_id"], "node_id", 8)


QUADS = """SELECT a.dataset_id, a.node_id AS element_id, a.node_id AS n1, a.node_id + 1 AS n2, a.node_id + 11 AS n3, a.node_id + 10 AS n4 FROM fx_fe_points a WHERE a.node_id % 10 < 9 AND a.node_id % 100 < 90"""


# The same mesh and one element over the whole plan of each dataset, which takes the points that no small one holds.
QUADS_MIXED = f"""{QUADS} UNION ALL SELECT a.dataset_id, a.node_id + 900000000 AS element_id, a.node_id AS n1, a.node_id + 9 AS n2, a.node_id + 99 AS n3, a.node_id + 90 AS n4 FROM fx_fe_points a
 WHERE a.node_id % 100 = 0"""


def quad_sql(quads: str) -> str:
    """Every point against every element of its dataset; the quadratic in eta, where the operator solves the one in xi."""
    corners = " UNION ALL ".join(f"SELECT dataset_id, element_id, {i} AS i, n{i} AS node_id FROM q" for i in (1, 2, 3, 4))
    picked = ", ".join(f"max(CASE WHEN i = {i} THEN {e} END) AS {c}{i}" for i in (1, 2, 3, 4) for c, e in (("x", "x"), ("y", "y"), ("v", "sin(x / 20e0) * cos(y / 15e0)")))
    mixes = ", ".join(f"({w.format(c='x')}) / 4e0 AS a{k}, ({w.format(c='y')}) / 4e0 AS b{k}" for k, w in enumerate(
        ("{c}1 + {c}2 + {c}3 + {c}4", "{c}2 + {c}3 - {c}1 - {c}4", "{c}3 + {c}4 - {c}1 - {c}2", "{c}1 + {c}3 - {c}2 - {c}4")))
    return f"""WITH q AS ({quads}), co AS ({corners}),
 el AS (SELECT dataset_id, element_id, {picked} FROM co JOIN fx_fe_points USING (dataset_id, node_id) GROUP BY 1, 2 HAVING count(*) = 4), m AS MATERIALIZED (SELECT *, {mixes} FROM el),
 c AS (SELECT m.*, point_id, x - a0 AS px, y - b0 AS py FROM fx_exp_points p JOIN m USING (dataset_id) WHERE x BETWEEN least(x1, x2, x3, x4) - 1e-6 AND greatest(x1, x2, x3, x4) + 1e-6
 AND y BETWEEN least(y1, y2, y3, y4) - 1e-6 AND greatest(y1, y2, y3, y4) + 1e-6),
 k AS MATERIALIZED (SELECT *, a3 * b2 - a2 * b3 AS qa, px * b3 - py * a3 + a1 * b2 - a2 * b1 AS qb, px * b1 - py * a1 AS qc FROM c),
 e AS MATERIALIZED (SELECT *, -2e0 * qc / (qb + sqrt(qb * qb - 4e0 * qa * qc)) AS eta FROM k WHERE qb * qb >= 4e0 * qa * qc),
 s AS MATERIALIZED (SELECT *, CASE WHEN abs(a1 + a3 * eta) > abs(b1 + b3 * eta) THEN (px - a2 * eta) / (a1 + a3 * eta) ELSE (py - b2 * eta) / (b1 + b3 * eta) END AS xi FROM e),
 h AS (SELECT dataset_id, point_id, element_id, ((1e0 - xi) * ((1e0 - eta) * v1 + (1e0 + eta) * v4) + (1e0 + xi) * ((1e0 - eta) * v2 + (1e0 + eta) * v3)) / 4e0 AS value,
 row_number() OVER (PARTITION BY dataset_id, point_id ORDER BY element_id) AS r FROM s WHERE abs(xi) <= 1.000000001e0 AND abs(eta) <= 1.000000001e0)
 SELECT p.dataset_id, p.point_id, element_id, value, element_id IS NULL AS refused FROM fx_exp_points p LEFT JOIN h ON h.dataset_id = p.dataset_id AND h.point_id = p.point_id AND r = 1"""


def sampled(t, quads: str):
    nodes = t.fe_points.withColumn("w", F.sin(F.col("x") / 20) * F.cos(F.col("y") / 15))
    return sp.sample_quads(t.exp_points, t.sql(quads), nodes, "w")


@query("j07_quad_interpolation", "dataset_id:i point_id:i element_id:i value:6 refused", quad_sql(QUADS))
def j07(t):
    return sampled(t, QUADS)


@query("j07_quads_of_mixed_sizes", "dataset_id:i point_id:i element_id:i value:6 refused", quad_sql(QUADS_MIXED))
def j07_mixed(t):
    return sampled(t, QUADS_MIXED)


PLANE_SQL = f"""pts AS ({SYM}), box AS (SELECT dataset_id, min(x) AS x0, max(x) AS x9, min(y) AS y0, max(y) AS y9 FROM pts GROUP BY 1),
 pl AS (SELECT p.*, (x - (x0 + x9) / 2) / ((x9 - x0) / 2) AS u, (y - (y0 + y9) / 2) / ((y9 - y0) / 2) AS v, 0.02e0 * 2e0 * least((x9 - x0) / 2, (y9 - y0) / 2) / greatest((x9 - x0) / 2, (y9 - y0) / 2) AS tol,
 abs((x9 - x0) / 2 - (y9 - y0) / 2) / greatest((x9 - x0) / 2, (y9 - y0) / 2) <= 0.05 AS sq FROM pts p JOIN box USING (dataset_id)),
 fl AS (SELECT *, 'x' AS reflection, -u AS a, v AS b FROM pl UNION ALL SELECT *, 'y', u, -v FROM pl UNION ALL SELECT *, 'diagonal', v, u FROM pl UNION ALL SELECT *, 'antidiagonal', -v, -u FROM pl),
 mi AS (SELECT f.dataset_id, f.reflection, f.node_id, arg_min(p.node_id, (pow(f.a - p.u, 2) + pow(f.b - p.v, 2), p.node_id)) AS mirror_id FROM fl f JOIN pl p ON p.dataset_id = f.dataset_id
 AND pow(f.a - p.u, 2) + pow(f.b - p.v, 2) <= f.tol * f.tol GROUP BY 1, 2, 3),
 mir AS (SELECT f.*, mi.mirror_id FROM fl f LEFT JOIN mi USING (dataset_id, reflection, node_id))"""


@query("j08_mirror_nodes", "dataset_id:i reflection node_id:i mirror_id:i", f"WITH {PLANE_SQL} SELECT * FROM mir")
def j08(t):
    return sp.mirror_nodes(sp.normalised_plane(t.sql(SYM), ["dataset_id"]), ["dataset_id"])


@query("j08_mirror_coverage", "dataset_id:i reflection coverage:6",
       f"WITH {PLANE_SQL} SELECT dataset_id, reflection, avg(CASE WHEN mirror_id IS NOT NULL THEN 1e0 ELSE 0e0 END) AS coverage FROM mir GROUP BY 1, 2")
def j08_coverage(t):
    return sp.mirror_coverage(sp.mirror_nodes(sp.normalised_plane(t.sql(SYM), ["dataset_id"]), ["dataset_id"]), ["dataset_id"])


def parity_sql(p: ShapeFamilyPolicy = ShapeFamilyPolicy()) -> str:
    plane = PLANE_SQL.replace("0.02e0", f"{p.mirror_tolerance}e0").replace("<= 0.05", f"<= {p.near_square_tolerance}")
    return f"""WITH {plane}, g AS (SELECT m.dataset_id, m.reflection, avg(CASE WHEN mirror_id IS NOT NULL THEN 1e0 ELSE 0e0 END) AS coverage, sum(m.w * q.w) AS num,
 sum(CASE WHEN mirror_id IS NOT NULL THEN m.w * m.w END) AS den, bool_or(m.sq) AS sq FROM mir m LEFT JOIN pl q ON q.dataset_id = m.dataset_id AND q.node_id = m.mirror_id GROUP BY 1, 2),
 h AS (SELECT *, CASE WHEN coverage >= {p.minimum_mirror_coverage} AND den > 0 AND (sq OR reflection IN ('x', 'y')) THEN num / den END AS parity FROM g)
 SELECT *, CASE WHEN parity >= {p.parity_threshold} THEN 'E' WHEN parity <= -{p.parity_threshold} THEN 'O' WHEN parity IS NOT NULL THEN 'M' END AS parity_class FROM h"""


@query("a20_parity_classes", "dataset_id:i reflection coverage:6 parity:6 parity_class", parity_sql())
def a20(t):
    return sp.parity_classes(sp.normalised_plane(t.sql(SYM), ["dataset_id"]), ["dataset_id"])


def nodal_sql(p: ShapeFamilyPolicy = ShapeFamilyPolicy()) -> str:
    """Every grid point against every node; a line's sign changes by a lag over its points above the floor."""
    n = p.nodal_grid_points
    return f"""WITH {PLANE_SQL}, ax AS (SELECT unnest(range(0, {n})) AS i), top AS (SELECT dataset_id, max(abs(w)) * {p.nodal_amplitude_floor}e0 AS floor FROM pl GROUP BY 1),
 gr AS (SELECT dataset_id, a.i AS gi, b.i AS gj, a.i * {2.0 / (n - 1)!r}e0 - 1e0 AS x, b.i * {2.0 / (n - 1)!r}e0 - 1e0 AS y FROM top CROSS JOIN ax a CROSS JOIN ax b),
 ne AS MATERIALIZED (SELECT gr.dataset_id, gi, gj, arg_min(w, (pow(x - u, 2) + pow(y - v, 2), node_id)) AS w FROM gr JOIN (SELECT dataset_id, node_id, u, v, w FROM pl) q ON q.dataset_id = gr.dataset_id GROUP BY 1, 2, 3),
 sg AS (SELECT dataset_id, gi, gj, sign(w) AS s FROM ne JOIN top USING (dataset_id) WHERE abs(w) > floor),
 ch AS (SELECT dataset_id, gi, gj, s <> lag(s) OVER (PARTITION BY dataset_id, gj ORDER BY gi) AS cx, s <> lag(s) OVER (PARTITION BY dataset_id, gi ORDER BY gj) AS cy FROM sg),
 inner_lines AS (SELECT dataset_id, i FROM top CROSS JOIN ax WHERE i BETWEEN 1 AND {n - 2}),
 px AS (SELECT dataset_id, gj AS i, sum(CASE WHEN cx THEN 1 ELSE 0 END) AS c FROM ch GROUP BY 1, 2), py AS (SELECT dataset_id, gi AS i, sum(CASE WHEN cy THEN 1 ELSE 0 END) AS c FROM ch GROUP BY 1, 2)
 SELECT l.dataset_id, floor(median(coalesce(px.c, 0))) AS nodal_x, floor(median(coalesce(py.c, 0))) AS nodal_y FROM inner_lines l LEFT JOIN px ON px.dataset_id = l.dataset_id AND px.i = l.i
 LEFT JOIN py ON py.dataset_id = l.dataset_id AND py.i = l.i GROUP BY 1"""


FAMILY_SQL = f"""WITH par AS (SELECT dataset_id, max(CASE WHEN reflection = 'x' THEN parity_class END) AS parity_x, max(CASE WHEN reflection = 'y' THEN parity_class END) AS parity_y FROM ({parity_sql()}) GROUP BY 1)
 SELECT *, 'Px:' || parity_x || '|Py:' || parity_y || '|nx:' || CAST(nodal_x AS BIGINT) || '|ny:' || CAST(nodal_y AS BIGINT) AS family, coalesce(parity_x = 'O' AND parity_y = 'O', false) AS torsion,
 sha256('{policy_text(ShapeFamilyPolicy())}') AS policy_hash FROM par JOIN ({nodal_sql()}) USING (dataset_id)"""
FAMILY_POLICIES = (ShapeFamilyPolicy(), ShapeFamilyPolicy(parity_threshold=0.5, mirror_tolerance=0.05, minimum_mirror_coverage=0.6))


@query("x05_classifier_policies", "dataset_id:i reflection parity:6 parity_class policy_hash",
       " UNION ALL ".join(f"SELECT dataset_id, reflection, parity, parity_class, sha256('{policy_text(p)}') AS policy_hash FROM ({parity_sql(p)})" for p in FAMILY_POLICIES))
def x05(t):
    """Both results in one table: rows of different gates stay apart by the hash that they carry."""
    first, second = (sp.classify_shapes(t.sql(SYM), ["dataset_id"], p) for p in FAMILY_POLICIES)
    return require_policy(first, FAMILY_POLICIES[0]).unionByName(second)


@query("x05_shape_families", "dataset_id:i parity_x parity_y nodal_x:i nodal_y:i family torsion policy_hash", FAMILY_SQL)
def x05_families(t):
    return sp.shape_families(t.sql(SYM), ["dataset_id"])


@query("a21_nodal_lines", "dataset_id:i nodal_x:i nodal_y:i", nodal_sql())
def a21(t):
    return sp.nodal_lines(sp.normalised_plane(t.sql(SYM), ["dataset_id"]), ["dataset_id"])


PITCH_SQL = """SELECT dataset_id, median(d) AS pitch, median(((a % 90e0) + 90e0) % 90e0) AS angle_deg FROM (SELECT p.dataset_id, p.point_id, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS d, degrees(atan2(q.y - p.y, q.x - p.x)) AS a,
 row_number() OVER (PARTITION BY p.dataset_id, p.point_id ORDER BY pow(p.x - q.x, 2) + pow(p.y - q.y, 2), q.point_id) AS k FROM g p JOIN g q ON p.dataset_id = q.dataset_id AND p.point_id <> q.point_id) WHERE k = 1 GROUP BY 1"""


@query("a60_grid_pitch", "dataset_id:i pitch:6 angle_deg:4", f"WITH g AS ({GRID}) {PITCH_SQL}")
def a60(t):
    return sp.grid_pitch(t.sql(GRID), ["dataset_id"], "point_id")


@query("j27_scan_grid_symmetry", "dataset_id:i symmetry proper ids_preserved:i n_points:i status",
       f"""WITH d AS (SELECT dataset_id, count(*) AS n FROM ({GRID}) GROUP BY 1)
 SELECT dataset_id, CASE WHEN dataset_id % 3 = 1 THEN NULL WHEN dataset_id % 4 = 3 THEN 'mirror' ELSE 'turn' END AS symmetry, CASE WHEN dataset_id % 3 = 1 THEN NULL ELSE dataset_id % 4 <> 3 END AS proper,
 CASE WHEN dataset_id % 3 = 1 THEN n - 2 ELSE n END AS ids_preserved, n AS n_points, CASE WHEN dataset_id % 3 <> 1 AND dataset_id % 4 <> 3 THEN 'MAPPING_DERIVED' ELSE 'MAPPING_REFUSED' END AS status FROM d""")
def j27(t):
    out = sp.grid_symmetry(t.sql(GRID), t.sql(GRID2), ["dataset_id"], "point_id")
    # which of the four turns is named depends on the two grid angles; the oracle states turn or mirror only
    return out.withColumn("symmetry", F.when(F.col("symmetry") == "identity", "turn").otherwise(F.regexp_extract("symmetry", "^(turn|mirror)", 1)))


# Extents and scales --------------------------------------------------------------------------------------------------
@query("a10_extents", "dataset_id:i n:i x_min:6 x_max:6 y_span:6 z_mid:6 radius:6 span:6",
       """WITH b AS (SELECT dataset_id, count(*) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max FROM fx_fe_points GROUP BY 1),
 r AS (SELECT dataset_id, sqrt(avg(pow(x - (x_min + x_max) / 2, 2) + pow(y - (y_min + y_max) / 2, 2) + pow(z - (z_min + z_max) / 2, 2))) AS radius FROM fx_fe_points JOIN b USING (dataset_id) GROUP BY 1)
 SELECT b.*, y_max - y_min AS y_span, (z_min + z_max) / 2 AS z_mid, radius, greatest(radius, sqrt(pow(x_max - x_min, 2) + pow(y_max - y_min, 2) + pow(z_max - z_min, 2))) AS span FROM b JOIN r USING (dataset_id)""")
def a10(t):
    return sp.extents(t.fe_points, ["dataset_id"])


SCALE_SQL = """WITH a AS (SELECT dataset_id, list_sort([max(x) - min(x), max(y) - min(y), max(z) - min(z)]) AS s FROM fx_fe_points GROUP BY 1),
 e AS (SELECT dataset_id, list_sort([max(x) - min(x), max(y) - min(y), max(z) - min(z)]) AS s FROM fx_exp_points GROUP BY 1),
 r AS (SELECT dataset_id, e.s[i] / a.s[i] AS r FROM a JOIN e USING (dataset_id), (SELECT unnest([1, 2, 3]) AS i) WHERE a.s[i] > 1e-30 AND e.s[i] > 1e-30),
 m AS (SELECT dataset_id, median(r) AS b FROM r GROUP BY 1),
 c AS (SELECT DISTINCT dataset_id, round(v, 15) AS scale FROM (SELECT dataset_id, b AS v FROM m UNION ALL SELECT dataset_id, u FROM m, (SELECT unnest([1e-6, 1e-3, 1e0, 1e3, 1e6]) AS u) WHERE b / u BETWEEN 0.2 AND 5))
 SELECT dataset_id, scale, row_number() OVER (PARTITION BY dataset_id ORDER BY scale) - 1 AS scale_no FROM c"""


@query("a11_scale_candidates", "dataset_id:i scale_no:i scale:6", SCALE_SQL)
def a11(t):
    return sp.scale_candidates(t.fe_points, t.exp_points, ["dataset_id"])


@query("a11_camera_grid_scales", "dataset_id:i axes_swapped sx:6 sy:6 sz:6",
       """WITH b AS (SELECT dataset_id, max(x) - min(x) AS w, max(y) - min(y) AS h FROM fx_exp_points GROUP BY 1),
 c AS (SELECT dataset_id, s AS axes_swapped, w / CASE WHEN s THEN 500e0 ELSE 900e0 END AS sx, h / CASE WHEN s THEN 900e0 ELSE 500e0 END AS sy FROM b, (SELECT false AS s UNION ALL SELECT true) WHERE w > 0 AND h > 0)
 SELECT *, sqrt(sx * sy) AS sz FROM c""")
def a11_camera(t):
    cal = t.exp_points.select("dataset_id").distinct().select("dataset_id", F.lit(90.0).alias("width"), F.lit(50.0).alias("height"), F.lit("cm").alias("dimension_unit"), F.lit("mm").alias("model_unit"))
    return sp.camera_grid_scales(cal, t.exp_points, ["dataset_id"])


def scored(t):
    s = sp.scale_candidates(t.fe_points, t.exp_points, ["dataset_id"])
    s = s.select("dataset_id", "scale_no", *[F.col("scale").alias(c) for c in ("sx", "sy", "sz")])
    return sp.score_orientations(t.fe_points, t.exp_points, s)


ORIENT_SQL = f"""WITH sc AS ({SCALE_SQL}), s0 AS (SELECT dataset_id, scale_no, scale FROM sc),
 pm AS (SELECT * FROM (VALUES (0, [1, 2, 3], 1), (1, [1, 3, 2], -1), (2, [2, 1, 3], -1), (3, [2, 3, 1], 1), (4, [3, 1, 2], 1), (5, [3, 2, 1], -1)) v(pi, perm, par)),
 sg AS (SELECT k AS si, [CASE WHEN k >= 4 THEN 1e0 ELSE -1e0 END, CASE WHEN k % 4 >= 2 THEN 1e0 ELSE -1e0 END, CASE WHEN k % 2 = 1 THEN 1e0 ELSE -1e0 END] AS sign FROM (SELECT unnest(range(8)) AS k)),
 orn AS (SELECT pi * 8 + si AS orientation, perm, sign, CAST(par * sign[1] * sign[2] * sign[3] AS INT) AS det FROM pm, sg),
 fc AS (SELECT f.dataset_id, f.node_id, [x - (x0 + x9) / 2, y - (y0 + y9) / 2, z - (z0 + z9) / 2] AS n FROM fx_fe_points f JOIN (SELECT dataset_id, min(x) AS x0, max(x) AS x9, min(y) AS y0, max(y) AS y9, min(z) AS z0, max(z) AS z9 FROM fx_fe_points GROUP BY 1) USING (dataset_id)),
 eb AS (SELECT dataset_id, min(x) AS x0, max(x) AS x9, min(y) AS y0, max(y) AS y9, min(z) AS z0, max(z) AS z9 FROM fx_exp_points GROUP BY 1),
 ec AS (SELECT e.dataset_id, point_id, x - (x0 + x9) / 2 AS ex, y - (y0 + y9) / 2 AS ey, z - (z0 + z9) / 2 AS ez, sqrt(pow(x9 - x0, 2) + pow(y9 - y0, 2) + pow(z9 - z0, 2)) AS dg FROM fx_exp_points e JOIN eb USING (dataset_id)),
 sp AS (SELECT dataset_id, greatest(max(dg), sqrt(avg(ex * ex + ey * ey + ez * ez))) AS span FROM ec GROUP BY 1),
 d AS (SELECT ec.dataset_id, scale_no, orientation, det, point_id, min(sqrt(pow(n[perm[1]] * sign[1] * scale - ex, 2) + pow(n[perm[2]] * sign[2] * scale - ey, 2) + pow(n[perm[3]] * sign[3] * scale - ez, 2))) AS r
  FROM ec JOIN s0 USING (dataset_id) JOIN fc USING (dataset_id), orn GROUP BY 1, 2, 3, 4, 5)
 SELECT d.dataset_id, scale_no, orientation, det, sqrt(avg(r * r)) / max(span) AS rms, avg(CASE WHEN r <= 0.03e0 * span THEN 1e0 ELSE 0e0 END) AS matched FROM d JOIN sp USING (dataset_id) GROUP BY 1, 2, 3, 4"""


@query("a12_orientation_scores", "dataset_id:i scale_no:i orientation:i det:i rms:6 matched:6", ORIENT_SQL)
def a12(t):
    return scored(t)[0]


CANDS = """SELECT d.dataset_id, k AS candidate_no, 0.01e0 * (1e0 + 0.3e0 * ((k + d.dataset_id) % 4)) AS rms, 1e0 - 0.05e0 * (k % 3) AS matched, CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS det,
 1e0 AS sx, 1e0 AS sy, 1e0 AS sz FROM (SELECT DISTINCT dataset_id FROM fx_exp_points) d CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) c"""
CMAPS = """SELECT dataset_id, k AS candidate_no, point_id, point_id + CASE WHEN k >= 2 AND dataset_id % 2 = 0 THEN 1 ELSE 0 END AS node_id FROM fx_exp_points
 CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) c"""
K1_SQL = f"""c AS ({CANDS}), rk AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY rms, matched DESC, det < 0, candidate_no) AS rank FROM (
 SELECT *, min(rms) OVER (PARTITION BY dataset_id) AS best FROM c) WHERE rms <= greatest(best * 1.5e0, best + 1e-8)),
 ds AS (SELECT dataset_id, arg_min(candidate_no, rank) AS candidate_no, count(*) AS merged FROM rk GROUP BY dataset_id, CASE WHEN dataset_id % 2 = 0 THEN candidate_no >= 2 ELSE false END),
 dn AS (SELECT *, count(*) OVER (PARTITION BY dataset_id) AS n_distinct FROM ds)"""


@query("k01_ranked_orientations", "dataset_id:i candidate_no:i rank:i rms:6", f"WITH {K1_SQL} SELECT * FROM rk")
def k01(t):
    return sp.rank_orientations(t.sql(CANDS))


@query("a13_distinct_registrations", "dataset_id:i candidate_no:i merged:i n_distinct:i status",
       f"WITH {K1_SQL} SELECT *, CASE WHEN n_distinct = 1 THEN 'UNAMBIGUOUS' ELSE 'AMBIGUOUS' END AS status FROM dn")
def a13(t):
    return sp.collapse_equivalent(sp.rank_orientations(t.sql(CANDS)), t.sql(CMAPS))


SELECTED = "SELECT DISTINCT dataset_id, CASE WHEN dataset_id % 8 = 0 THEN 99 ELSE 1 END AS wanted FROM fx_exp_points WHERE dataset_id % 4 = 0"


@query("p33_confirmed_orientation", "dataset_id:i candidate_no:i orientation_source",
       f"""WITH {K1_SQL}, s AS ({SELECTED}), v AS (SELECT s.* FROM s JOIN rk ON rk.dataset_id = s.dataset_id AND rk.candidate_no = s.wanted),
 g AS (SELECT dataset_id, max(n_distinct) AS n, min(candidate_no) AS c FROM dn GROUP BY 1)
 SELECT g.dataset_id, coalesce(wanted, CASE WHEN n = 1 THEN c END) AS candidate_no, CASE WHEN wanted IS NOT NULL THEN 'user_confirmed' WHEN n = 1 THEN 'geometry' ELSE 'ambiguous' END AS orientation_source
 FROM g LEFT JOIN v USING (dataset_id)""")
def p33(t):
    ranked = sp.rank_orientations(t.sql(CANDS))
    return sp.take_confirmed(sp.collapse_equivalent(ranked, t.sql(CMAPS)), ranked, t.sql(SELECTED))


# Registrations -------------------------------------------------------------------------------------------------------
APPLY_SQL = f"""m AS ({MAP}), r AS ({REG}), a AS (SELECT coalesce(m.dataset_id, p.dataset_id) AS dataset_id, coalesce(m.point_id, p.point_id) AS point_id, m.node_id, p.x AS px, p.y AS py, p.z AS pz
 FROM m FULL JOIN fx_exp_points p ON p.dataset_id = m.dataset_id AND p.point_id = m.point_id),
 ap AS (SELECT a.*, sqrt(pow((f.x * c + f.y * s) * k + tx - px, 2) + pow((f.y * c - f.x * s) * k + ty - py, 2) + pow(f.z * k - pz, 2)) AS residual,
 CASE WHEN a.node_id IS NULL THEN 'point not in the registration' WHEN px IS NULL THEN 'frozen point not measured' WHEN f.x IS NULL THEN 'FE node absent' END AS problem
 FROM a LEFT JOIN fx_fe_points f ON f.dataset_id = a.dataset_id AND f.node_id = a.node_id LEFT JOIN r ON r.dataset_id = a.dataset_id)"""


def applied(t):
    return sp.apply_registration(registrations(t), t.sql(MAP), t.fe_points, t.exp_points)


@query("j02_frozen_registration", "dataset_id:i point_id:i node_id:i residual:6 problem", f"WITH {APPLY_SQL} SELECT * FROM ap")
def j02(t):
    return applied(t)


@query("a14_mapping_diagnostics", "dataset_id:i rms:6 matched:6 max_residual:6 n_points:i n_unique:i n_duplicates:i status determinant:6",
       f"""WITH {APPLY_SQL}, b AS (SELECT dataset_id, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) AS dg FROM fx_exp_points GROUP BY 1),
 sp AS (SELECT dataset_id, greatest(any_value(dg), sqrt(avg(pow(x - mx, 2) + pow(y - my, 2)))) AS span FROM fx_exp_points JOIN b USING (dataset_id) GROUP BY 1),
 g AS (SELECT dataset_id, sqrt(avg(residual * residual)) / max(span) AS rms, avg(CASE WHEN residual IS NULL THEN NULL WHEN residual <= 0.03e0 * span THEN 1e0 ELSE 0e0 END) AS matched, max(residual) AS max_residual,
 count(node_id) AS n_points, count(DISTINCT node_id) AS n_unique, count(problem) AS n_problems FROM ap JOIN sp USING (dataset_id) GROUP BY 1)
 SELECT *, n_points - n_unique AS n_duplicates, CASE WHEN n_problems > 0 THEN 'REFUSED' ELSE 'APPLIED' END AS status, 1e0 AS determinant FROM g""")
def a14(t):
    q = sp.registration_quality(applied(t), t.exp_points)
    return q.join(registrations(t).select("dataset_id", sp.determinant().alias("determinant")), "dataset_id")


@query("j31_registration_equivalence", "dataset_id:i n_frozen:i n_same:i same_rotation equivalent",
       f"""WITH m AS ({MAP}), g AS (SELECT dataset_id, count(*) AS n_frozen, sum(CASE WHEN dataset_id % 3 = 1 AND point_id % 10 = 0 THEN 0 ELSE 1 END) AS n_same FROM m GROUP BY 1)
 SELECT *, dataset_id % 5 <> 2 AS same_rotation, n_frozen = n_same AND dataset_id % 5 <> 2 AS equivalent FROM g""")
def j31(t):
    frozen = t.sql(MAP).join(registrations(t).select("dataset_id", "rotation"), "dataset_id")
    live = frozen.withColumn("node_id", F.when((F.col("dataset_id") % 3 == 1) & (F.col("point_id") % 10 == 0), F.col("node_id") + 1).otherwise(F.col("node_id")))
    bump = F.when(F.col("dataset_id") % 5 == 2, 1e-3).otherwise(0.0)
    live = live.withColumn("_b", bump).withColumn("rotation", F.transform("rotation", lambda r: F.transform(r, lambda v: v + F.col("_b")))).drop("_b")
    return sp.registration_equivalence(live, frozen)


CORNER = "SELECT dataset_id, min(point_id) AS corner_point, min(point_id) + CASE WHEN dataset_id % 4 = 1 THEN 10 ELSE 3 END AS marker_point, 2e0 AS fe_x, 3e0 AS fe_y FROM fx_exp_points GROUP BY dataset_id"


@query("j30_corner_registration", "dataset_id:i tx:6 ty:6 tz:6 angle:4 status",
       f"""WITH r AS ({REG}), k AS ({CORNER}), sf AS (SELECT dataset_id, avg(z) AS z FROM (SELECT *, max(z) OVER (PARTITION BY dataset_id, instance) AS m FROM fx_fe_points) WHERE abs(z - m) <= 1e-6 GROUP BY 1)
 SELECT k.dataset_id, a.x - (2e0 * c + 3e0 * s) * r.k AS tx, a.y - (3e0 * c - 2e0 * s) * r.k AS ty, a.z - sf.z * r.k AS tz,
 degrees(atan2((b.x - a.x) * s + (b.y - a.y) * c, (b.x - a.x) * c - (b.y - a.y) * s)) AS angle,
 CASE WHEN abs(degrees(atan2((b.x - a.x) * s + (b.y - a.y) * c, (b.x - a.x) * c - (b.y - a.y) * s))) >= 45 THEN 'marker contradicts the documented axes' ELSE 'ok' END AS status
 FROM k JOIN r USING (dataset_id) JOIN sf USING (dataset_id) JOIN fx_exp_points a ON a.dataset_id = k.dataset_id AND a.point_id = corner_point JOIN fx_exp_points b ON b.dataset_id = k.dataset_id AND b.point_id = marker_point""")
def j30(t):
    out = sp.calibrated_translation(registrations(t), sp.surface_nodes(t.fe_points), t.exp_points, corners=t.sql(CORNER))
    return out.select("*", *[F.get("translation", F.lit(i)).alias(c) for i, c in enumerate(("tx", "ty", "tz"))])


EDGE_SQL = f"""WITH r AS ({REG}), sf AS (SELECT dataset_id, node_id, x, y, z FROM (SELECT *, max(z) OVER (PARTITION BY dataset_id, instance) AS m FROM fx_fe_points) WHERE abs(z - m) <= 1e-6),
 sb AS (SELECT dataset_id, min(x) AS sx, min(y) AS sy, avg(z) AS sz FROM sf GROUP BY 1), f AS (SELECT p.dataset_id, point_id, k, (x * c - y * s) / k AS fx, (x * s + y * c) / k AS fy, z / k AS fz FROM fx_exp_points p JOIN r USING (dataset_id)),
 fb AS (SELECT dataset_id, min(fx) AS mx, min(fy) AS my, avg(fz) AS mz FROM f GROUP BY 1), q AS (SELECT f.dataset_id, point_id, k, fx + sx + 1.5e0 - mx AS qx, fy + sy + 0.5e0 - my AS qy, fz + sz - mz AS qz FROM f JOIN sb USING (dataset_id) JOIN fb USING (dataset_id))
 SELECT dataset_id, point_id, node_id, residual FROM (SELECT q.dataset_id, point_id, node_id, k * sqrt(pow(qx - x, 2) + pow(qy - y, 2) + pow(qz - z, 2)) AS residual, row_number() OVER (PARTITION BY q.dataset_id, point_id ORDER BY pow(qx - x, 2) + pow(qy - y, 2) + pow(qz - z, 2), node_id) AS n
 FROM q JOIN sf USING (dataset_id)) WHERE n = 1"""


@query("j30_edge_registration_map", "dataset_id:i point_id:i node_id:i residual:6", EDGE_SQL)
def j30_edges(t):
    surface = sp.surface_nodes(t.fe_points)
    off = t.fe_points.select("dataset_id").distinct().select("dataset_id", F.lit(1.5).alias("off_x"), F.lit(0.5).alias("off_y"))
    reg = sp.calibrated_translation(registrations(t), surface, t.exp_points, offsets=off).select("dataset_id", "rotation", "scales", "translation")
    return sp.map_to_surface(reg, surface, t.exp_points)


PERTURB = [("+x", 0.6, 0, 0, 0), ("-x", -0.6, 0, 0, 0), ("+y", 0, 0.6, 0, 0), ("-y", 0, -0.6, 0, 0), ("+scale", 0, 0, 0.05, 0), ("-scale", 0, 0, -0.05, 0), ("+turn", 0, 0, 0, 12.0), ("-turn", 0, 0, 0, -12.0)]


RANGE_SQL = """WITH c AS (SELECT cmp_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM fx_nodes GROUP BY 1),
 pe AS (SELECT * FROM (VALUES ('nominal', 0e0, 0e0, 0e0, 0e0), ('+x', 0.6e0, 0e0, 0e0, 0e0), ('-x', -0.6e0, 0e0, 0e0, 0e0), ('+y', 0e0, 0.6e0, 0e0, 0e0), ('-y', 0e0, -0.6e0, 0e0, 0e0), ('+s', 0e0, 0e0, 0.05e0, 0e0), ('-s', 0e0, 0e0, -0.05e0, 0e0), ('+t', 0e0, 0e0, 0e0, 12e0), ('-t', 0e0, 0e0, 0e0, -12e0)) v(name, dx, dy, s, deg)),
 q AS (SELECT n.cmp_id, name, node_id, ((x - mx) * cos(radians(deg)) - (y - my) * sin(radians(deg))) / (1 + s) + mx + dx AS qx, ((x - mx) * sin(radians(deg)) + (y - my) * cos(radians(deg))) / (1 + s) + my + dy AS qy, (z - mz) / (1 + s) + mz AS qz FROM fx_nodes n JOIN c USING (cmp_id), pe),
 m AS (SELECT q.cmp_id, name, q.node_id, arg_min(n.node_id, (pow(qx - x, 2) + pow(qy - y, 2) + pow(qz - z, 2), n.node_id)) AS fe_node FROM q JOIN fx_nodes n ON n.cmp_id = q.cmp_id GROUP BY 1, 2, 3),
 g AS (SELECT p.cmp_id, fe_mode, exp_mode, name, (pow(sum(a.re * b.re + a.im * b.im), 2) + pow(sum(a.re * b.im - a.im * b.re), 2)) / (sum(a.re * a.re + a.im * a.im) * sum(b.re * b.re + b.im * b.im)) AS mac
 FROM fx_pairs p JOIN fx_shapes b ON b.cmp_id = p.cmp_id AND b.role = 'EXP' AND b.measured AND b.mode_no = exp_mode JOIN m ON m.cmp_id = p.cmp_id AND m.node_id = b.node_id JOIN fx_shapes a ON a.cmp_id = p.cmp_id AND a.role = 'FE' AND a.mode_no = fe_mode AND a.node_id = fe_node AND a.dof = b.dof WHERE p.mac >= 0.5 GROUP BY 1, 2, 3, 4)
 SELECT cmp_id, fe_mode, exp_mode, max(CASE WHEN name = 'nominal' THEN mac END) AS nominal, min(mac) AS low, max(mac) AS high, min(mac) < 0.5 AND max(mac) >= 0.5 AS crosses FROM g GROUP BY 1, 2, 3"""


@query("a55_registration_mac_range", "cmp_id:i fe_mode:i exp_mode:i nominal:6 low:6 high:6 crosses", RANGE_SQL)
def a55(t):
    """MAC range of the accepted pairs under perturbed registrations."""
    pts = sp.perturb_points(t.nodes, ["cmp_id"], [("nominal", 0, 0, 0, 0), *PERTURB])
    near = sp.nearest_points(pts, t.nodes.withColumnRenamed("node_id", "fe_node"), ["cmp_id"], ["perturbation", "node_id"], "fe_node")
    return registration_mac_range(t.pairs.filter("mac >= 0.5"), t.shapes, near)


def registration_mac_range(pairs, shapes, mapped, threshold: float = 0.5):
    """Lowest and highest MAC of each pair over the maps of ``mapped`` (cmp_id, perturbation, node_id, fe_node)."""
    e = shapes.filter("role = 'EXP' and measured").select("cmp_id", F.col("mode_no").alias("exp_mode"), "node_id", "dof", F.col("re").alias("er"), F.col("im").alias("ei"))
    a = shapes.filter("role = 'FE'").select("cmp_id", F.col("mode_no").alias("fe_mode"), F.col("node_id").alias("fe_node"), "dof", F.col("re").alias("ar"), F.col("im").alias("ai"))
    m = mapped.select("cmp_id", "perturbation", "node_id", "fe_node")
    j = pairs.select("cmp_id", "fe_mode", "exp_mode").join(e, ["cmp_id", "exp_mode"]).join(m, ["cmp_id", "node_id"]).join(a, ["cmp_id", "fe_mode", "fe_node", "dof"])
    ar, ai, er, ei = (F.col(c) for c in ("ar", "ai", "er", "ei"))
    g = j.groupBy("cmp_id", "fe_mode", "exp_mode", "perturbation").agg(
        F.sum(dot_re(ar, ai, er, ei)).alias("xr"), F.sum(dot_im(ar, ai, er, ei)).alias("xi"), F.sum(abs2(ar, ai)).alias("na"), F.sum(abs2(er, ei)).alias("nb"))
    g = g.withColumn("mac", mac_value(F.col("xr"), F.col("xi"), F.col("na"), F.col("nb")))
    out = g.groupBy("cmp_id", "fe_mode", "exp_mode").agg(F.max(F.when(F.col("perturbation") == "nominal", F.col("mac"))).alias("nominal"), F.min("mac").alias("low"), F.max("mac").alias("high"))
    return out.withColumn("crosses", F.col("nominal").isNotNull() & (F.col("low") < threshold) & (F.col("high") >= threshold))


# Id and node agreement -----------------------------------------------------------------------------------------------
@query("j01_shape_alignment", "cmp_id:i mode_no:i node_id:i dof:i re:6",
       """WITH ref AS (SELECT DISTINCT cmp_id, node_id + 2 AS node_id, d AS dof FROM fx_nodes CROSS JOIN (SELECT 1 AS d UNION ALL SELECT 2 UNION ALL SELECT 3))
 SELECT m.cmp_id, m.mode_no, r.node_id, r.dof, s.re FROM fx_modes m JOIN ref r USING (cmp_id) LEFT JOIN fx_shapes s ON s.cmp_id = m.cmp_id AND s.role = 'FE' AND s.mode_no = m.mode_no AND s.node_id = r.node_id AND s.dof = r.dof WHERE m.role = 'FE'""")
def j01(t):
    ref = t.nodes.select("cmp_id", (F.col("node_id") + 2).alias("node_id")).withColumn("dof", F.explode(F.array(*[F.lit(d) for d in (1, 2, 3)])))
    return align_shapes(t.modes.filter("role = 'FE'"), t.shapes.filter("role = 'FE'"), ref)


def align_shapes(modes, shapes, reference):
    """Every mode on the reference node / DOF list (matched by id); absent rows stay NULL."""
    return (modes.select("cmp_id", "mode_no").join(reference.select("cmp_id", "node_id", "dof"), "cmp_id")
            .join(shapes.select("cmp_id", "mode_no", "node_id", "dof", "re", "im"), ["cmp_id", "mode_no", "node_id", "dof"], "left"))


IDS2 = "SELECT dataset_id, point_id + CASE WHEN point_id % 41 = 0 THEN 500000 ELSE 0 END AS point_id FROM fx_exp_points UNION ALL SELECT dataset_id, point_id FROM fx_exp_points WHERE point_id % 53 = 1"


@query("j09_id_set_agreement", "dataset_id:i n_missing:i n_extra:i n_duplicate:i agree",
       f"""WITH b AS (SELECT dataset_id, point_id, count(*) AS k FROM ({IDS2}) GROUP BY 1, 2), j AS (SELECT coalesce(a.dataset_id, b.dataset_id) AS dataset_id, a.point_id AS pa, b.point_id AS pb, b.k
 FROM fx_exp_points a FULL JOIN b ON a.dataset_id = b.dataset_id AND a.point_id = b.point_id)
 SELECT dataset_id, sum(CASE WHEN pb IS NULL THEN 1 ELSE 0 END) AS n_missing, sum(CASE WHEN pa IS NULL THEN 1 ELSE 0 END) AS n_extra, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS n_duplicate,
 sum(CASE WHEN pb IS NULL OR pa IS NULL OR k > 1 THEN 1 ELSE 0 END) = 0 AS agree FROM j GROUP BY 1""")
def j09(t):
    return id_agreement(t.exp_points, t.sql(IDS2))


def id_agreement(reference, other):
    """Missing, extra and duplicated ids of ``other`` against ``reference`` per dataset."""
    count = lambda df, n: df.groupBy("dataset_id", "point_id").agg(F.count(F.lit(1)).alias(n))
    j = count(reference, "_a").join(count(other, "_b"), ["dataset_id", "point_id"], "full_outer")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    g = j.groupBy("dataset_id").agg(n(F.col("_b").isNull()).alias("n_missing"), n(F.col("_a").isNull()).alias("n_extra"), n((F.col("_a") > 1) | (F.col("_b") > 1)).alias("n_duplicate"))
    return g.withColumn("agree", F.col("n_missing") + F.col("n_extra") + F.col("n_duplicate") == 0)


DECK = "SELECT dataset_id, node_id, x + CASE WHEN dataset_id % 4 = 1 AND node_id % 100 = 5 THEN 0.02e0 ELSE 0e0 END AS x, y, z FROM fx_fe_points WHERE NOT (dataset_id % 7 = 3 AND node_id % 100 = 8)"


@query("j33_input_deck_nodes", "dataset_id:i n_nodes:i n_unmatched:i max_difference:6 verdict",
       f"""WITH d AS ({DECK}), j AS (SELECT f.dataset_id, d.node_id AS dn, greatest(abs(f.x - d.x), abs(f.y - d.y), abs(f.z - d.z)) AS df FROM fx_fe_points f LEFT JOIN d USING (dataset_id, node_id)),
 g AS (SELECT dataset_id, count(*) AS n_nodes, sum(CASE WHEN dn IS NULL THEN 1 ELSE 0 END) AS n_unmatched, max(df) AS max_difference FROM j GROUP BY 1)
 SELECT *, CASE WHEN n_unmatched > 0 THEN 'labels differ' WHEN max_difference > 0.001 THEN 'coordinates differ' ELSE 'bound' END AS verdict FROM g""")
def j33(t):
    return compare_nodes(t.fe_points, t.sql(DECK), 1e-3)


def compare_nodes(loaded, deck, tolerance):
    """Input-deck nodes against the loaded geometry: equal labels, then the largest coordinate difference."""
    d = deck.select("dataset_id", "node_id", *[F.col(c).alias(f"d{c}") for c in "xyz"], F.lit(True).alias("_d"))
    j = loaded.select("dataset_id", "node_id", "x", "y", "z", F.lit(True).alias("_l")).join(d, ["dataset_id", "node_id"], "full_outer")
    g = j.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum((F.col("_d").isNull() | F.col("_l").isNull()).cast("int")).alias("n_unmatched"),
                                    F.max(F.greatest(*[F.abs(F.col(c) - F.col(f"d{c}")) for c in "xyz"])).alias("max_difference"))
    return g.withColumn("verdict", F.when(F.col("n_unmatched") > 0, "labels differ").when(F.col("max_difference") > tolerance, "coordinates differ").otherwise("bound"))


@query("j29_missing_coordinates", "dataset_id:i n_missing:i example:i",
       "SELECT dataset_id, count(*) AS n_missing, min(rsp_node) AS example FROM (SELECT DISTINCT dataset_id, rsp_node FROM fx_frf) WHERE NOT (rsp_node <= 3 + dataset_id % 3) GROUP BY 1")
def j29(t):
    geo = t.frf.select("dataset_id", "rsp_node").distinct().filter("rsp_node <= 3 + dataset_id % 3").withColumnRenamed("rsp_node", "node_id")
    return missing_coordinates(t.frf.withColumnRenamed("rsp_node", "node_id"), geo)


def missing_coordinates(used, geometry):
    """Nodes used by vectors or channels that the geometry lacks: count and lowest example per dataset."""
    m = used.select("dataset_id", "node_id").distinct().join(geometry, ["dataset_id", "node_id"], "left_anti")
    return m.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_missing"), F.min("node_id").alias("example"))


LIVE_SRC = "SELECT c_custkey AS dataset_id, c_custkey % 97 AS source_hash, c_custkey % 89 AS geometry_hash, c_nationkey AS set_hash FROM customer"
FIX_SRC = "SELECT s_suppkey AS registration_id, s_suppkey % 97 AS source_hash, s_suppkey % 89 AS geometry_hash, s_nationkey AS set_hash FROM supplier"


@query("j34_registration_lookup", "dataset_id:i registration_id:i verdict",
       f"""WITH l AS ({LIVE_SRC}), f AS ({FIX_SRC}), s AS (SELECT source_hash, count(*) AS n, min(registration_id) AS registration_id, min(geometry_hash) AS gh, min(set_hash) AS sh FROM f GROUP BY 1),
 v AS (SELECT l.*, s.registration_id AS r, CASE WHEN n IS NULL THEN 'source unknown' WHEN n > 1 THEN 'source of several registrations' WHEN gh <> l.geometry_hash THEN 'FE geometry differs' WHEN sh <> l.set_hash THEN 'modal set differs' ELSE 'bound' END AS verdict
 FROM l LEFT JOIN s USING (source_hash)) SELECT dataset_id, CASE WHEN verdict = 'bound' THEN r END AS registration_id, verdict FROM v""")
def j34(t):
    return lookup_registration(t.sql(LIVE_SRC), t.sql(FIX_SRC))


def lookup_registration(live, fixtures):
    """The one accepted registration whose source, FE geometry and modal set all match, or the first reason it is refused."""
    s = fixtures.groupBy("source_hash").agg(F.count(F.lit(1)).alias("_n"), F.min("registration_id").alias("_r"), F.min("geometry_hash").alias("_g"), F.min("set_hash").alias("_s"))
    j = live.join(s, "source_hash", "left")
    verdict = (F.when(F.col("_n").isNull(), "source unknown").when(F.col("_n") > 1, "source of several registrations")
               .when(F.col("_g") != F.col("geometry_hash"), "FE geometry differs").when(F.col("_s") != F.col("set_hash"), "modal set differs").otherwise("bound"))
    return j.withColumn("verdict", verdict).withColumn("registration_id", F.when(F.col("verdict") == "bound", F.col("_r")))



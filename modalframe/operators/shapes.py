"""Gram-based shape operators: rigid body, invariants, subspaces, clusters, branch tracking.

The node dimension is reduced to a handful of sums per mode or pair by one aggregate; two-mode subspaces are finished in
closed form from those sums.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modalframe.functions.columns import settle
from modalframe.functions.cplx import abs2, clip, finite
from modalframe.operators.graph import exchanged, star_components
from modalframe.operators.ordered import log_bin, with_order

RIGID_LIMIT = 0.02
TRACK_MAC, TRACK_COS2 = 0.90, 0.95
#: Neighbouring node numbers whose rows meet in one task; only their share of a sum is sent on.
NODES_PER_BLOCK = 64
MODE = ["cmp_id", "role", "mode_no"]


# ------------------------------------------------------------------------------------------------ one-mode sums
def component_rows(shapes: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per (mode, node) with the three complex components and coordinates; non-finite nodes are dropped."""
    d = shapes.groupBy(*MODE, "node_id").agg(
        *[F.max(F.when(F.col("dof") == k, F.col(p))).alias(f"{p[0]}{k}") for k in (1, 2, 3) for p in ("re", "im")])
    d = d.join(nodes.select("cmp_id", "node_id", "x", "y", "z"), ["cmp_id", "node_id"])
    return d.filter(finite(*[F.col(c) for c in ("r1", "i1", "r2", "i2", "r3", "i3", "x", "y", "z")]))


def rigid_residuals(shapes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Share of each shape outside the six rigid-body vectors (1 for fewer than two points or no energy).

    About the centroid the translations and rotations decouple, so the projection needs the sum of the shape, its moment
    and the 3 x 3 inertia only. Coordinates are first shifted by the comparison's mean to keep the moments well scaled.
    """
    c = nodes.groupBy("cmp_id").agg(*[F.avg(a).alias(f"_m{a}") for a in "xyz"])
    d = component_rows(shapes, nodes).join(c, "cmp_id")
    for a in "xyz":
        d = d.withColumn(a, F.col(a) - F.col(f"_m{a}"))
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(a).alias(f"s{a}") for a in "xyz"]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    aggs += [F.sum(f"{p}{k}").alias(f"t{p}{k}") for p in "ri" for k in (1, 2, 3)]
    aggs += [F.sum(F.col(a) * F.col(f"{p}{k}")).alias(f"m{p}{a}{k}") for p in "ri" for a in "xyz" for k in (1, 2, 3) if (a, k) not in (("x", 1), ("y", 2), ("z", 3))]
    aggs.append(F.sum(sum((abs2(F.col(f"r{k}"), F.col(f"i{k}")) for k in (2, 3)), abs2(F.col("r1"), F.col("i1")))).alias("energy"))
    g = d.groupBy(*MODE).agg(*aggs)
    n = F.col("n")
    cov = lambda a, b: F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / n
    mom = lambda p, a, k: F.col(f"m{p}{a}{k}") - F.col(f"s{a}") * F.col(f"t{p}{k}") / n
    inertia = {"jxx": cov("y", "y") + cov("z", "z"), "jyy": cov("x", "x") + cov("z", "z"), "jzz": cov("x", "x") + cov("y", "y"),
               "jxy": -cov("x", "y"), "jxz": -cov("x", "z"), "jyz": -cov("y", "z")}
    moments = {f"q{p}{c}": v for p in "ri" for c, v in (("x", mom(p, "y", 3) - mom(p, "z", 2)), ("y", mom(p, "z", 1) - mom(p, "x", 3)), ("z", mom(p, "x", 2) - mom(p, "y", 1)))}
    shift = sum((F.pow(f"t{p}{k}", 2) for p, k in (("r", 2), ("r", 3), ("i", 1), ("i", 2), ("i", 3))), F.pow("tr1", 2)) / n
    g = settle(g, [*MODE, "n", "energy"], shift=shift, **inertia, **moments)
    # A tiny multiple of the trace keeps collinear point sets invertible; the moment has no part in that direction.
    eps = (F.col("jxx") + F.col("jyy") + F.col("jzz")) * 1e-13
    g = settle(g, [*MODE, "n", "energy", "shift", *moments], a=F.col("jxx") + eps, b=F.col("jyy") + eps, c=F.col("jzz") + eps, d=F.col("jxy"), e=F.col("jxz"), f=F.col("jyz"))
    a, b, c, d, e, f = (F.col(k) for k in "abcdef")
    det = a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)
    quad = F.lit(0.0)
    for p in "ri":
        x, y, z = F.col(f"q{p}x"), F.col(f"q{p}y"), F.col(f"q{p}z")
        quad = quad + (x * x * (b * c - f * f) + y * y * (a * c - e * e) + z * z * (a * b - d * d) + 2 * x * y * (e * f - d * c) + 2 * x * z * (d * f - b * e) + 2 * y * z * (d * e - a * f))
    g = settle(g, [*MODE, "n", "energy"], inside=F.col("shift") + quad / F.when(det > 0, det))
    left = F.sqrt(F.greatest(F.col("energy") - F.col("inside"), F.lit(0.0))) / F.sqrt("energy")
    g = settle(g, [*MODE, "n"], rigid_residual=F.when((n < 2) | (F.col("energy") <= 1e-60), 1.0).otherwise(left))
    return g.withColumn("rigid", F.col("rigid_residual") <= RIGID_LIMIT)


def elastic_modes(modes: DataFrame, residuals: DataFrame) -> DataFrame:
    """FE modes that are not rigid-body modes, plus every measured mode."""
    rigid = residuals.filter("rigid and role = 'FE'").select(*MODE)
    return modes.join(rigid, MODE, "left_anti")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _block_energies(gram: pd.Series, load: pd.Series) -> pd.Series:
    """Energies of the sequentially orthogonalised six basis functions (a batched 6 x 6 Cholesky)."""
    if not len(gram):
        return pd.Series([], dtype=object)
    g, b = np.vstack(gram.to_numpy()).reshape(-1, 6, 6), np.vstack(load.to_numpy())
    scale = np.trace(g, axis1=1, axis2=2)[:, None, None] * 1e-14
    low = np.linalg.cholesky(g + scale * np.eye(6))
    y = np.linalg.solve(low, b[..., None])[..., 0]
    return pd.Series(list(y * y))


def shape_invariants(shapes: DataFrame, nodes: DataFrame, grid_angles: DataFrame | None = None) -> DataFrame:
    """Rigid-plane, saddle and dome energy fractions of the out-of-plane shape (turned most real, scaled plan).

    With ``grid_angles`` (cmp_id, angle_deg) the saddle part is also split along the grid axes and diagonals.
    """
    box = nodes.groupBy("cmp_id").agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"), F.greatest(
        F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-12)).alias("_s"))
    w = shapes.filter("dof = 3")
    re, im = F.col("re"), F.col("im")
    m = w.groupBy(*MODE).agg(F.sum(re * re).alias("sxx"), F.sum(re * im).alias("sxy"), F.sum(im * im).alias("syy"))
    m = m.withColumn("_phi", 0.5 * F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy"))).select(*MODE, "_phi")
    d = w.join(m, MODE).join(nodes.select("cmp_id", "node_id", "x", "y"), ["cmp_id", "node_id"]).join(box, "cmp_id")
    d = d.withColumn("w", re * F.cos("_phi") + im * F.sin("_phi")).withColumn("px", (F.col("x") - F.col("_mx")) / F.col("_s")).withColumn(
        "py", (F.col("y") - F.col("_my")) / F.col("_s"))
    if grid_angles is not None:
        d = d.join(grid_angles, "cmp_id")
        c, s = F.cos(F.radians("angle_deg")), F.sin(F.radians("angle_deg"))
        d = d.withColumn("_u", F.col("px") * c + F.col("py") * s).withColumn("_v", F.col("py") * c - F.col("px") * s).withColumn(
            "px", F.col("_u")).withColumn("py", F.col("_v"))
    x, y = F.col("px"), F.col("py")
    basis = [F.lit(1.0), x, y, x * x - y * y, 2 * x * y, x * x + y * y]
    gram = [F.sum(basis[i] * basis[j]).alias(f"g{i}{j}") for i in range(6) for j in range(i, 6)]
    load = [F.sum(basis[i] * F.col("w")).alias(f"b{i}") for i in range(6)]
    g = d.groupBy(*MODE).agg(*gram, *load, F.sum(F.col("w") * F.col("w")).alias("energy"))
    full = F.array(*[F.col(f"g{min(i, j)}{max(i, j)}") for i in range(6) for j in range(6)])
    g = g.withColumn("e", _block_energies(full, F.array(*[f"b{i}" for i in range(6)])))
    total = F.when(F.col("energy") > 0, F.col("energy")).otherwise(1.0)
    part = lambda *ix: sum((F.get("e", F.lit(i)) for i in ix[1:]), F.get("e", F.lit(ix[0]))) / total
    return g.select(*MODE, part(0, 1, 2).alias("rigid_plane"), part(3, 4).alias("saddle"), part(5).alias("dome"),
                    part(4).alias("saddle_on_axes"), part(3).alias("saddle_on_diagonals"))


@F.pandas_udf(T.StructType([T.StructField("normal", T.ArrayType(T.DoubleType())), T.StructField("u", T.ArrayType(T.DoubleType())),
                            T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("s", T.ArrayType(T.DoubleType()))]))
def _principal_axes(cov: pd.Series) -> pd.DataFrame:
    """Axes (largest first) and singular values of each 3 x 3 scatter matrix, all rows of the batch at once."""
    if not len(cov):
        return pd.DataFrame({"normal": [], "u": [], "v": [], "s": []})
    val, vec = np.linalg.eigh(np.vstack(cov.to_numpy()).reshape(-1, 3, 3))
    flip = np.take_along_axis(vec, np.abs(vec).argmax(axis=1)[:, None, :], axis=1)
    vec = vec * np.sign(flip)
    return pd.DataFrame({"normal": list(vec[:, :, 0]), "u": list(vec[:, :, 2]), "v": list(vec[:, :, 1]),
                         "s": list(np.sqrt(np.clip(val[:, ::-1], 0, None)))})


def principal_planes(points: DataFrame, keys: list[str]) -> DataFrame:
    """Best-fit plane per key: centre, normal, in-plane axes, planarity ratio (planar up to 0.05) and collinearity."""
    m = points.groupBy(*keys).agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"], F.count(F.lit(1)).alias("n"))
    d = points.join(m, keys)
    c = {a: F.col(a) - F.col(f"m{a}") for a in "xyz"}
    g = d.groupBy(*keys).agg(F.first("n").alias("n"), *[F.first(f"m{a}").alias(f"m{a}") for a in "xyz"],
                             F.array(*[F.sum(c[a] * c[b]) for a in "xyz" for b in "xyz"]).alias("cov"))
    g = g.withColumn("p", _principal_axes("cov"))
    s = lambda i: F.get("p.s", F.lit(i))
    ratio = F.when(s(0) > 1e-30, s(2) / s(0)).otherwise(0.0)
    return g.select(*keys, "n", "mx", "my", "mz", F.col("p.normal").alias("normal"), F.col("p.u").alias("axis_u"), F.col("p.v").alias("axis_v"),
                    ratio.alias("planarity_ratio"), (ratio <= 0.05).alias("planar"),
                    ((F.col("n") < 3) | (s(0) <= 0) | (s(1) <= 1e-6 * s(0))).alias("collinear"))


def project_points(points: DataFrame, planes: DataFrame, keys: list[str]) -> DataFrame:
    d = points.join(planes, keys)
    dot = lambda v: sum(((F.col(a) - F.col(f"m{a}")) * F.get(v, F.lit(i)) for i, a in ((1, "y"), (2, "z"))), (F.col("x") - F.col("mx")) * F.get(v, F.lit(0)))
    return d.withColumn("pu", dot("axis_u")).withColumn("pv", dot("axis_v")).withColumn("pn", dot("normal"))


def binned_field(field: DataFrame, keys: list[str], value: str, cells: int = 220) -> DataFrame:
    """Mean of a field per display cell; the longer side gets ``cells`` cells, and the last cell keeps its upper edge."""
    b = field.groupBy(*keys).agg(F.min("x").alias("_x0"), F.max("x").alias("_x9"), F.min("y").alias("_y0"), F.max("y").alias("_y9"))
    d = field.join(b, keys)
    sx, sy = F.col("_x9") - F.col("_x0"), F.col("_y9") - F.col("_y0")
    span = F.greatest(sx, sy, F.lit(1e-30))
    nx, ny = (F.greatest(F.lit(2), F.rint(cells * s / span)) for s in (sx, sy))
    bx = F.least(F.floor((F.col("x") - F.col("_x0")) / F.when(sx > 0, sx) * nx), nx - 1)
    by = F.least(F.floor((F.col("y") - F.col("_y0")) / F.when(sy > 0, sy) * ny), ny - 1)
    return (d.withColumn("cell_x", F.coalesce(bx, F.lit(0)).cast("int")).withColumn("cell_y", F.coalesce(by, F.lit(0)).cast("int"))
            .groupBy(*keys, "cell_x", "cell_y").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")))


# ------------------------------------------------------------------------------------------------ pair sums
def meetings(left: DataFrame, right: DataFrame, keys: list[str], left_columns: list[str], right_columns: list[str]) -> DataFrame:
    """Every left row beside every right row of the same keys, node and DOF: keys, _block, then the named columns of both.

    Both sides are dealt once by keys and block of nodes, and a DOF lists its rows of either side. The result stays dealt like
    that, so that sums per (keys, _block, ...) add up in the same task, however many rows meet."""
    at = [*keys, "node_id", "dof"]
    kinds = [df.select(F.struct(*columns).alias("_s")).schema["_s"].dataType for df, columns in ((left, left_columns), (right, right_columns))]
    both = left.select(*at, F.struct(*left_columns).alias("_l"), F.lit(None).cast(kinds[1]).alias("_r")).unionByName(
        right.select(*at, F.lit(None).cast(kinds[0]).alias("_l"), F.struct(*right_columns).alias("_r")))
    for c in at:
        both = both.filter(F.col(c).isNotNull())
    d = both.withColumn("_block", F.floor(F.col("node_id") / NODES_PER_BLOCK)).repartition(*keys, "_block")
    d = d.groupBy(*keys, "_block", "node_id", "dof").agg(F.collect_list("_l").alias("_ls"), F.collect_list("_r").alias("_rs"))
    d = d.select(*keys, "_block", F.explode("_ls").alias("_l"), "_rs").select(*keys, "_block", "_l", F.explode("_rs").alias("_r"))
    return d.select(*keys, "_block", "_l.*", "_r.*")


def sums_of_meetings(rows: DataFrame, keys: list[str], left_id: str, right_id: str, sums: dict[str, Column]) -> DataFrame:
    """Sums per (keys, left_id, right_id) of `meetings`: first per block, where the rows are, then over the blocks. The result is
    dealt by keys and ``left_id``."""
    part = rows.groupBy(*keys, "_block", left_id, right_id).agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    return part.drop("_block").repartition(*keys, left_id).groupBy(*keys, left_id, right_id).agg(*[F.sum(n).alias(n) for n in sums])


def real_products(pairs: DataFrame | None, left: DataFrame, right: DataFrame, keys: list[str], weights: DataFrame | None = None) -> DataFrame:
    """Sums of a*b, a*a and b*b over shared DOFs of each (i, j) pair of real shapes, optionally node-weighted.

    ``pairs``: keys, i, j, or None for every i with every j of the same keys, whose products are then summed where they meet;
    ``left``: keys, i, node_id, dof, value; ``right``: keys, j, node_id, dof, value."""
    l, r = left.withColumnRenamed("value", "_a"), right.withColumnRenamed("value", "_b")
    if pairs is not None:
        l = pairs.join(l, [*keys, "i"])
    wgt = F.lit(1.0)
    if weights is not None:
        l, wgt = l.join(weights, [*[k for k in keys if k in weights.columns], "node_id"]), F.col("weight")
    a, b = F.col("_a"), F.col("_b")
    sums = {"ab": wgt * a * b, "aa": wgt * a * a, "bb": wgt * b * b}
    if pairs is None:
        d = meetings(l.filter("i is not null"), r.filter("j is not null"), keys, ["i", "_a"] if weights is None else ["i", "_a", "weight"], ["j", "_b"])
        return sums_of_meetings(d, keys, "i", "j", sums)
    return l.join(r, [*keys, "j", "node_id", "dof"]).groupBy(*keys, "i", "j").agg(*[F.sum(v).alias(n) for n, v in sums.items()])


def real_mac(products: DataFrame) -> DataFrame:
    den = F.col("aa") * F.col("bb")
    return products.withColumn("mac", F.col("ab") * F.col("ab") / F.when(den > 0, den))


def cos2_columns(a11, a12, a22, b11, b12, b22, c11, c12, c21, c22) -> tuple[Column, Column]:
    """Squared cosines (largest first) between two 2-mode real subspaces from their Gram entries; NULL below rank 2."""
    da, db = a11 * a22 - a12 * a12, b11 * b22 - b12 * b12
    ok = (da > 1e-12 * a11 * a22) & (db > 1e-12 * b11 * b22)
    da, db = F.when(ok, da), F.when(ok, db)
    # M = A^-1 C B^-1 C^T
    p11, p12 = (a22 * c11 - a12 * c21) / da, (a22 * c12 - a12 * c22) / da
    p21, p22 = (a11 * c21 - a12 * c11) / da, (a11 * c22 - a12 * c12) / da
    q11, q12 = (b22 * c11 - b12 * c12) / db, (b22 * c21 - b12 * c22) / db
    q21, q22 = (b11 * c12 - b12 * c11) / db, (b11 * c22 - b12 * c21) / db
    tr = p11 * q11 + p12 * q21 + p21 * q12 + p22 * q22
    det = (p11 * p22 - p12 * p21) * (q11 * q22 - q12 * q21)
    root = F.sqrt(F.greatest(tr * tr / 4 - det, F.lit(0.0)))
    return clip(tr / 2 + root), clip(tr / 2 - root)


def subspace_mac_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Subspace MAC of two-member groups from complex rows (p1, p2 | q1, q2): mean squared canonical correlation.

    ``rows``: keys, p1r, p1i, p2r, p2i, q1r, q1i, q2r, q2i (one row per shared DOF)."""
    h = lambda a, b: (F.sum(F.col(f"{a}r") * F.col(f"{b}r") + F.col(f"{a}i") * F.col(f"{b}i")), F.sum(F.col(f"{a}r") * F.col(f"{b}i") - F.col(f"{a}i") * F.col(f"{b}r")))
    aggs = [F.count(F.lit(1)).alias("n_dof")]
    for a, b in (("p1", "p1"), ("p1", "p2"), ("p2", "p2"), ("q1", "q1"), ("q1", "q2"), ("q2", "q2"), ("p1", "q1"), ("p1", "q2"), ("p2", "q1"), ("p2", "q2")):
        re, im = h(a, b)
        aggs += [re.alias(f"{a}{b}r"), im.alias(f"{a}{b}i")]
    g = rows.groupBy(*keys).agg(*aggs)
    c = lambda n: (F.col(f"{n}r"), F.col(f"{n}i"))
    n2 = lambda n: abs2(*c(n))
    da = F.col("p1p1r") * F.col("p2p2r") - n2("p1p2")
    db = F.col("q1q1r") * F.col("q2q2r") - n2("q1q2")
    limit = 1e-12  # squared rank tolerance of a two-column basis, relative to the product of its energies
    g = g.withColumn("rank_p", F.when(F.col("p1p1r") + F.col("p2p2r") <= 0, 0).when(da > limit * F.col("p1p1r") * F.col("p2p2r"), 2).otherwise(1))
    g = g.withColumn("rank_q", F.when(F.col("q1q1r") + F.col("q2q2r") <= 0, 0).when(db > limit * F.col("q1q1r") * F.col("q2q2r"), 2).otherwise(1))
    # trace(A^-1 C B^-1 C^H): expand with the adjugates of the 2 x 2 Hermitian A and B
    mul = lambda u, v: (u[0] * v[0] - u[1] * v[1], u[0] * v[1] + u[1] * v[0])
    conj = lambda u: (u[0], -u[1])
    add = lambda u, v: (u[0] + v[0], u[1] + v[1])
    sub = lambda u, v: (u[0] - v[0], u[1] - v[1])
    sc = lambda s, u: (s * u[0], s * u[1])
    a11, a22, a12 = F.col("p1p1r"), F.col("p2p2r"), c("p1p2")
    b11, b22, b12 = F.col("q1q1r"), F.col("q2q2r"), c("q1q2")
    k = [[c("p1q1"), c("p1q2")], [c("p2q1"), c("p2q2")]]
    # X = adj(A) C, Y = adj(B) C^H; the trace is sum_ij X_ij Y_ji
    x = [[sub(sc(a22, k[0][j]), mul(a12, k[1][j])) for j in (0, 1)], [sub(sc(a11, k[1][j]), mul(conj(a12), k[0][j])) for j in (0, 1)]]
    y = [[sub(sc(b22, conj(k[j][0])), mul(b12, conj(k[j][1]))) for j in (0, 1)], [sub(sc(b11, conj(k[j][1])), mul(conj(b12), conj(k[j][0]))) for j in (0, 1)]]
    tr = (F.lit(0.0), F.lit(0.0))
    for i in (0, 1):
        for j in (0, 1):
            tr = add(tr, mul(x[i][j], y[j][i]))
    full = (F.col("rank_p") == 2) & (F.col("rank_q") == 2)
    return g.withColumn("subspace_mac", F.when(full, clip(tr[0] / F.when(full, da * db) / 2)))


def span_share(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Share of a complex shape e inside the span of two real modes b1, b2 (rows: keys, er, ei, b1, b2)."""
    g = rows.groupBy(*keys).agg(
        F.sum(F.col("b1") * F.col("b1")).alias("b11"), F.sum(F.col("b1") * F.col("b2")).alias("b12"), F.sum(F.col("b2") * F.col("b2")).alias("b22"),
        *[F.sum(F.col(f"b{k}") * F.col(f"e{p}")).alias(f"c{k}{p}") for k in (1, 2) for p in "ri"], F.sum(abs2(F.col("er"), F.col("ei"))).alias("ee"))
    det = F.col("b11") * F.col("b22") - F.col("b12") * F.col("b12")
    ok = (det > 1e-24 * F.col("b11") * F.col("b22")) & (F.col("ee") > 0)
    quad = F.lit(0.0)
    for p in "ri":
        quad = quad + F.col("b22") * F.pow(f"c1{p}", 2) - 2 * F.col("b12") * F.col(f"c1{p}") * F.col(f"c2{p}") + F.col("b11") * F.pow(f"c2{p}", 2)
    return g.withColumn("share", quad / F.when(ok, det * F.col("ee")))


def matrix_times_shapes(matrix: DataFrame, shapes: DataFrame, keys: list[str]) -> DataFrame:
    """y = M x for every mode from coordinate entries (matrix_id, i, j, value); shapes: keys, matrix_id, mode, dof_index, value."""
    m = matrix.select("matrix_id", "i", F.col("j").alias("dof_index"), F.col("value").alias("_m"))
    return (shapes.join(m, ["matrix_id", "dof_index"]).groupBy(*keys, "matrix_id", "mode", F.col("i").alias("dof_index"))
            .agg(F.sum(F.col("_m") * F.col("value")).alias("value")))


def mass_weighted_mac(pairs: DataFrame, left: DataFrame, right: DataFrame, mass: DataFrame, keys: list[str]) -> DataFrame:
    """|phi^T M psi|^2 / (phi^T M phi psi^T M psi) for the given pairs (keys, i_mode, j_mode).

    M is applied once per mode; the pairs then meet the product vectors DOF by DOF.
    """
    key = [*keys, "matrix_id"]
    ml, mr = matrix_times_shapes(mass, left, keys), matrix_times_shapes(mass, right, keys)

    def own(x: DataFrame, y: DataFrame, mode: str, name: str) -> DataFrame:
        d = x.join(y.withColumnRenamed("value", "_y"), [*key, "mode", "dof_index"])
        return d.groupBy(*key, F.col("mode").alias(mode)).agg(F.sum(F.col("value") * F.col("_y")).alias(name))

    d = pairs.join(left.select(*key, F.col("mode").alias("i_mode"), "dof_index", F.col("value").alias("_x")), [*keys, "i_mode"])
    d = d.join(mr.select(*key, F.col("mode").alias("j_mode"), "dof_index", F.col("value").alias("_y")), [*key, "j_mode", "dof_index"])
    x = d.groupBy(*key, "i_mode", "j_mode").agg(F.sum(F.col("_x") * F.col("_y")).alias("x"))
    out = x.join(own(left, ml, "i_mode", "ll"), [*key, "i_mode"]).join(own(right, mr, "j_mode", "rr"), [*key, "j_mode"])
    good = (F.col("ll") > 0) & (F.col("rr") > 0)
    return out.withColumn("mac", clip(F.col("x") * F.col("x") / F.when(good, F.col("ll") * F.col("rr"))))


# ------------------------------------------------------------------------------------------------ components
def connected_components(vertices: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest member id of each connected component: keys, id, component. No limit on rounds (see `star_components`)."""
    stars = star_components(edges, keys)
    v = vertices.select(*keys, "id").distinct()
    return v.join(exchanged(stars, *keys, "id"), [*keys, "id"], "left").select(*keys, "id", F.coalesce("component", "id").alias("component"))


def trigger_groups(rows: DataFrame, keys: list[str], spacing: float = 0.03) -> DataFrame:
    """Groups of rows linked by |df| / min(f) < spacing in measured **or** FE frequency, with their largest adjacent gaps.

    Along one axis, closeness is generated by neighbours, so the edges are the close neighbours of the two orders (two per
    row at most) instead of all close pairs. ``rows``: keys, id, exp_hz, fe_hz.
    """
    def close(col: str) -> DataFrame:
        o = with_order(rows, keys, log_bin(F.col(col)), [col, "id"], previous={"_pid": "id", "_phz": col})
        return o.filter((F.col(col) - F.col("_phz")) / F.col("_phz") < spacing).select(*keys, F.col("_pid").alias("a"), F.col("id").alias("b"))

    comp = connected_components(rows, close("exp_hz").unionByName(close("fe_hz")), keys)
    d = rows.join(comp, [*keys, "id"])
    out = d.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    for col, name in (("exp_hz", "exp_spacing"), ("fe_hz", "fe_spacing")):
        o = with_order(d, [*keys, "component"], log_bin(F.col(col)), [col, "id"], previous={"_phz": col})
        out = out.join(o.groupBy(*keys, "component").agg(F.max((F.col(col) - F.col("_phz")) / F.col("_phz")).alias(name)), [*keys, "component"])
    return d.select(*keys, "id", "component").join(out, [*keys, "component"])


def close_pair_edges(pairs: DataFrame, gap: float) -> DataFrame:
    """Edges between accepted pairs that are close in FE **and** measured frequency (relative to the mean), through bins
    on the measured frequency."""
    width = (2 * gap / (2 - gap)) * (1 + 1e-9)
    p = pairs.select("cmp_id", F.col("exp_mode").alias("id"), "fe_hz", "exp_hz").withColumn("_bin", log_bin(F.col("exp_hz"), max(width, 1e-6)))
    q = p.select("cmp_id", F.col("id").alias("b"), F.col("fe_hz").alias("fe2"), F.col("exp_hz").alias("exp2"), F.explode(F.array(F.col("_bin"), F.col("_bin") + 1, F.col("_bin") - 1)).alias("_bin"))
    rel = lambda a, b: F.abs(F.col(a) - F.col(b)) / (0.5 * (F.col(a) + F.col(b)))
    return (p.withColumnRenamed("id", "a").join(q, ["cmp_id", "_bin"]).filter((F.col("a") < F.col("b")) & (rel("exp_hz", "exp2") <= gap) & (rel("fe_hz", "fe2") <= gap))
            .select("cmp_id", "a", "b"))


# ------------------------------------------------------------------------------------------------ tracking
def track_branches(macs: DataFrame, rows: DataFrame | None, keys: list[str], minimum: float = TRACK_MAC) -> DataFrame:
    """Follow reference rows into a candidate state from their MACs: TRACKED, LOSS, AMBIGUOUS or EXCHANGE.

    ``macs``: keys, i, j, mac; ``rows``: keys, i (the frozen reference rows), or None for those that have a MAC."""
    hit = F.col("mac") >= minimum
    per_row = macs.groupBy(*keys, "i").agg(F.count(F.when(hit, 1)).alias("n_hits"), F.min(F.when(hit, F.col("j"))).alias("j"), F.max("mac").alias("best_mac"))
    claims = per_row.filter("n_hits = 1").groupBy(*keys, "j").agg(F.count(F.lit(1)).alias("n_claims"))
    d = per_row if rows is None else rows.join(per_row, [*keys, "i"], "left")
    d = d.join(claims, [*keys, "j"], "left")
    status = (F.when(F.coalesce("n_hits", F.lit(0)) == 0, "LOSS").when(F.col("n_hits") > 1, "AMBIGUOUS")
              .when(F.col("n_claims") > 1, "EXCHANGE").otherwise("TRACKED"))
    d = d.withColumn("status", status)
    return d.select(*keys, "i", F.when(F.col("status") == "TRACKED", F.col("j")).alias("j"), "best_mac", "status")


def track_subspaces(clusters: DataFrame, left: DataFrame, right: DataFrame, keys: list[str], used: DataFrame | None = None,
                    minimum: float = TRACK_COS2) -> DataFrame:
    """For each two-mode cluster the candidate pairs that span its subspace (both cos^2 above the limit).

    If both squared cosines exceed the limit, so does the share of each candidate alone inside the cluster's span; the
    candidates are therefore filtered one by one first and only the few survivors are paired. Exact, and linear in
    candidates. ``clusters``: keys, cluster_id, i1, i2.
    """
    key = [*keys, "cluster_id"]
    l1 = left.select(*keys, F.col("i").alias("i1"), "node_id", "dof", F.col("value").alias("p1"))
    l2 = left.select(*keys, F.col("i").alias("i2"), "node_id", "dof", F.col("value").alias("p2"))
    basis = clusters.join(l1, [*keys, "i1"]).join(l2, [*keys, "i2", "node_id", "dof"]).select(*key, "node_id", "dof", "p1", "p2")
    a = basis.groupBy(*key).agg(F.sum(F.col("p1") * F.col("p1")).alias("a11"), F.sum(F.col("p1") * F.col("p2")).alias("a12"), F.sum(F.col("p2") * F.col("p2")).alias("a22"))
    free = right if used is None else right.join(used, [*keys, "j"], "left_anti")
    one = sums_of_meetings(meetings(basis, free, keys, ["cluster_id", "p1", "p2"], ["j", "value"]), keys, "cluster_id", "j", {
        "c1": F.col("p1") * F.col("value"), "c2": F.col("p2") * F.col("value"), "b": F.col("value") * F.col("value")})
    det = F.col("a11") * F.col("a22") - F.col("a12") * F.col("a12")
    share = (F.col("a22") * F.col("c1") * F.col("c1") - 2 * F.col("a12") * F.col("c1") * F.col("c2") + F.col("a11") * F.col("c2") * F.col("c2")) / F.when(det > 0, det * F.col("b"))
    near = one.join(a, key).filter(share > minimum)
    duo = near.alias("u").join(near.select(*key, F.col("j").alias("j2"), F.col("c1").alias("d1"), F.col("c2").alias("d2"), F.col("b").alias("b2")), key).filter(F.col("j") < F.col("j2"))
    cross = duo.join(free.select(*keys, "j", "node_id", "dof", F.col("value").alias("v1")), [*keys, "j"]).join(
        free.select(*keys, F.col("j").alias("j2"), "node_id", "dof", F.col("value").alias("v2")), [*keys, "j2", "node_id", "dof"]).groupBy(*key, "j", "j2").agg(
        F.sum(F.col("v1") * F.col("v2")).alias("b12"))
    duo = duo.join(cross, [*key, "j", "j2"])
    c = F.col
    hi, lo = cos2_columns(c("a11"), c("a12"), c("a22"), c("b"), c("b12"), c("b2"), c("c1"), c("d1"), c("c2"), c("d2"))
    passing = duo.withColumn("cos2_1", hi).withColumn("cos2_2", lo).filter(F.col("cos2_2") > minimum)
    g = passing.groupBy(*key).agg(F.count(F.lit(1)).alias("n_pairs"), F.max_by(F.struct("j", "j2", "cos2_1", "cos2_2"), F.struct("cos2_2", -F.col("j"), -F.col("j2"))).alias("b"))
    out = clusters.join(g, key, "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))
    one_pair = F.col("n_pairs") == 1
    return out.select(*key, "i1", "i2", "n_pairs", *[F.when(one_pair, F.col(f"b.{n}")).alias(n) for n in ("j", "j2", "cos2_1", "cos2_2")],
                      F.when(one_pair, "TRACKED_CLUSTER").otherwise("CLUSTER_LOSS").alias("status"))


def confirm_clusters(individual: DataFrame, subspaces: DataFrame, keys: list[str]) -> DataFrame:
    """Cluster verdict over all directions: UNSTABLE when a subspace is lost or not unique, INDEPENDENT when every mode is
    stable on its own, else CONFIRMED.

    ``individual``: keys, cluster_id, direction, stable; ``subspaces``: keys, cluster_id, direction, n_pairs."""
    i = individual.groupBy(*keys, "cluster_id", "direction").agg(F.bool_and("stable").alias("stable"))
    j = subspaces.join(i, [*keys, "cluster_id", "direction"], "left")
    g = j.groupBy(*keys, "cluster_id").agg(F.bool_and(F.col("n_pairs") == 1).alias("subspace_ok"), F.bool_and(F.coalesce("stable", F.lit(False))).alias("all_stable"),
                                           F.count(F.lit(1)).alias("n_directions"))
    return g.withColumn("verdict", F.when(~F.col("subspace_ok"), "UNSTABLE").when(F.col("all_stable"), "INDEPENDENT").otherwise("CONFIRMED"))


def judge_larger_groups(groups: DataFrame, branches: DataFrame, keys: list[str]) -> DataFrame:
    """Verdict on close groups of three and more modes: INDEPENDENT when every member is tracked on its own in every
    direction, else UNSUPPORTED, for only two-mode subspaces can be followed.

    ``groups``: keys, component, id, size; ``branches``: keys, direction, i, status."""
    members = groups.filter("size > 2").select(*keys, F.col("component").alias("cluster_id"), F.col("id").alias("i"))
    d = members.join(branches.select(*keys, "direction", "i", "status"), [*keys, "i"], "left")
    g = d.groupBy(*keys, "cluster_id").agg(F.coalesce(F.bool_and(F.coalesce(F.col("status") == "TRACKED", F.lit(False))), F.lit(False)).alias("all_stable"),
                                           F.count_distinct("direction").alias("n_directions"))
    return g.withColumn("verdict", F.when(F.col("all_stable"), "INDEPENDENT").otherwise("UNSUPPORTED"))


def order_swaps(tracked: DataFrame, keys: list[str]) -> DataFrame:
    """Row pairs whose frequency order inverts between two states (i before k in the reference, after it in the candidate).

    ``tracked``: keys, i, ref_hz, cand_hz. An inversion needs the two frequency intervals [ref, cand] of a pair to overlap,
    so rows only meet through the logarithmic bins both intervals touch.
    """
    lo, hi = F.least("ref_hz", "cand_hz"), F.greatest("ref_hz", "cand_hz")
    d = tracked.withColumn("_bin", F.explode(F.sequence(log_bin(lo, 0.02), log_bin(hi, 0.02))))
    e = d.select(*keys, F.col("i").alias("k"), F.col("ref_hz").alias("_r2"), F.col("cand_hz").alias("_c2"), "_bin")
    before = (F.col("ref_hz") < F.col("_r2")) | ((F.col("ref_hz") == F.col("_r2")) & (F.col("i") < F.col("k")))
    return d.join(e, [*keys, "_bin"]).filter(before & (F.col("cand_hz") > F.col("_c2"))).select(*keys, "i", "k").distinct()

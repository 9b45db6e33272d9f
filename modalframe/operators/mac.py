"""Shape correlation: masked MAC, coverage, AutoMAC, COMAC, scale and phase measures.

The node x DOF dimension is always reduced by join + aggregate. Shapes are first folded to one row per (mode, node) with
the three directions side by side, so a pair meets a node once instead of once per DOF.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modalframe.functions.cplx import TINY, abs2, clip, dot_im, dot_re, finite, mac_value
from modalframe.session import keep

DOFS = (1, 2, 3)
MODE = ["cmp_id", "role", "mode_no"]


def measurement_mask(shapes: DataFrame, relative: float = 1e-6) -> DataFrame:
    """Fill a NULL ``measured`` from the mode's own energy: a direction counts when its norm exceeds 1e-6 of the norm
    of the same mode; a mode without energy has no measured DOF."""
    ok = finite(F.col("re"), F.col("im"))
    e = F.when(ok, abs2(F.col("re"), F.col("im"))).otherwise(0.0)
    energy = shapes.groupBy(*MODE).agg(*[F.sum(F.when(F.col("dof") == d, e).otherwise(0.0)).alias(f"_e{d}") for d in DOFS])
    own = F.element_at(F.array("_e1", "_e2", "_e3"), F.col("dof"))
    total = F.sqrt(F.col("_e1") + F.col("_e2") + F.col("_e3"))
    inferred = ok & (total > TINY) & (F.sqrt(own) > total * F.lit(relative))
    return (shapes.join(energy, MODE).withColumn("measured", F.coalesce(F.col("measured") & ok, inferred))
            .drop("_e1", "_e2", "_e3"))


def dataset_mask(shapes: DataFrame, relative: float = 1e-12) -> DataFrame:
    """(cmp_id, node_id, dof, measured): DOFs that are non-zero in any mode; all of them when none is."""
    amp = F.when(finite(F.col("re"), F.col("im")), F.sqrt(abs2(F.col("re"), F.col("im"))))
    scale = shapes.groupBy(*MODE).agg(F.greatest(F.max(amp), F.lit(TINY)).alias("_scale"))
    union = (shapes.join(scale, MODE).groupBy("cmp_id", "node_id", "dof")
             .agg(F.max(F.coalesce(amp > F.col("_scale") * relative, F.lit(False))).alias("hit")))
    some = union.groupBy("cmp_id").agg(F.max("hit").alias("_some"))
    return union.join(some, "cmp_id").withColumn("measured", F.col("hit") | ~F.col("_some")).drop("hit", "_some")


def fold(shapes: DataFrame, role: str, mode: str, prefix: str, masked: bool) -> DataFrame:
    """One row per (mode, node): r1..r3, i1..i3 (NULL where absent, non-finite or, for the masked side, unmeasured)."""
    ok = finite(F.col("re"), F.col("im"))
    if masked:
        ok = ok & F.col("measured")
    aggs = []
    for d in DOFS:
        here = ok & (F.col("dof") == d)
        aggs += [F.max(F.when(here, F.col("re"))).alias(f"{prefix}r{d}"), F.max(F.when(here, F.col("im"))).alias(f"{prefix}i{d}")]
    return (shapes.filter(F.col("role") == role).groupBy("cmp_id", F.col("mode_no").alias(mode), "node_id").agg(*aggs))


def _total(term) -> Column:
    out = None
    for d in DOFS:
        piece = F.coalesce(term(d), F.lit(0.0))
        out = piece if out is None else out + piece
    return out


def _valid(d: int) -> Column:
    return F.col(f"ar{d}").isNotNull() & F.col(f"er{d}").isNotNull()


def pair_sums(pairs: DataFrame, shapes: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Per pair: the four MAC sums, common DOF and point counts and (with ``nodes``) the spatial extent of the points."""
    exp = fold(shapes, "EXP", "exp_mode", "e", True)
    fe = fold(shapes, "FE", "fe_mode", "a", False)
    rows = (pairs.select("cmp_id", "fe_mode", "exp_mode").join(exp, ["cmp_id", "exp_mode"])
            .join(fe, ["cmp_id", "fe_mode", "node_id"]))
    some = _valid(1) | _valid(2) | _valid(3)
    a = lambda d: (F.col(f"ar{d}"), F.col(f"ai{d}"))
    e = lambda d: (F.col(f"er{d}"), F.col(f"ei{d}"))
    aggs = [F.sum(_total(lambda d: dot_re(*a(d), *e(d)))).alias("xr"), F.sum(_total(lambda d: dot_im(*a(d), *e(d)))).alias("xi"),
            F.sum(_total(lambda d: F.when(_valid(d), abs2(*a(d))))).alias("na"),
            F.sum(_total(lambda d: F.when(_valid(d), abs2(*e(d))))).alias("nb"),
            F.sum(sum((_valid(d).cast("int") for d in DOFS[1:]), _valid(1).cast("int"))).alias("n_dof"),
            F.sum(some.cast("int")).alias("n_points")]
    if nodes is not None:
        rows = rows.join(nodes.select("cmp_id", "node_id", "x", "y", "z"), ["cmp_id", "node_id"], "left")
        for c in "xyz":
            aggs.append((F.max(F.when(some, F.col(c))) - F.min(F.when(some, F.col(c)))).alias(f"span_{c}"))
    return rows.groupBy("cmp_id", "fe_mode", "exp_mode").agg(*aggs)


def masked_mac(pairs: DataFrame, shapes: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """MAC of every given pair on the DOFs of the measured mode's own mask; the pair columns are kept."""
    sums = pair_sums(pairs, shapes, nodes)
    out = pairs.join(sums, ["cmp_id", "fe_mode", "exp_mode"], "left")
    return (out.withColumn("mac", mac_value(F.col("xr"), F.col("xi"), F.col("na"), F.col("nb")))
            .withColumn("n_dof", F.coalesce("n_dof", F.lit(0))).withColumn("n_points", F.coalesce("n_points", F.lit(0))))


def coverage(pairs: DataFrame, shapes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Masked MAC plus DOF, point and spatial coverage and its status (floors 3 / 5 %, 3 / 2 %, 2 %)."""
    own = (shapes.filter((F.col("role") == "EXP") & F.col("measured")).groupBy("cmp_id", F.col("mode_no").alias("exp_mode"))
           .agg(F.count(F.lit(1)).alias("own_dof")))
    grid = nodes.groupBy("cmp_id").agg(
        F.count(F.lit(1)).alias("grid_points"),
        F.sqrt(sum((F.pow(F.max(c) - F.min(c), 2) for c in "yz"), F.pow(F.max("x") - F.min("x"), 2))).alias("grid_extent"))
    out = (masked_mac(pairs, shapes, nodes).join(own, ["cmp_id", "exp_mode"], "left").join(grid, "cmp_id", "left"))
    share = lambda n, of: F.coalesce(F.col(n) / F.when(F.col(of) > 0, F.col(of)), F.lit(0.0))
    extent = F.sqrt(F.pow("span_x", 2) + F.pow("span_y", 2) + F.pow("span_z", 2))
    out = (out.withColumn("own_dof", F.coalesce("own_dof", F.lit(0))).withColumn("dof_coverage", share("n_dof", "own_dof"))
           .withColumn("point_coverage", share("n_points", "grid_points"))
           .withColumn("spatial_coverage", F.when((F.col("grid_extent") > 0) & (F.col("n_points") >= 2),
                                                  extent / F.col("grid_extent")).otherwise(0.0)))
    status = (F.when((F.col("n_dof") < 3) | ((F.col("own_dof") > 0) & (F.col("dof_coverage") < 0.05)), "insufficient DOF coverage")
              .when((F.col("n_points") < 3) | ((F.col("grid_points") > 0) & (F.col("point_coverage") < 0.02)),
                    "insufficient point coverage")
              .when((F.col("grid_extent") > 0) & (F.col("spatial_coverage") < 0.02), "insufficient spatial coverage")
              .otherwise("accepted"))
    return out.withColumn("coverage_status", status)


def pair_rows(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """One row per (pair, node, dof) with both values (a = FE, e = EXP) on the measured finite DOFs."""
    ok = finite(F.col("re"), F.col("im"))
    fe = shapes.filter((F.col("role") == "FE") & ok).select(
        "cmp_id", F.col("mode_no").alias("fe_mode"), "node_id", "dof", F.col("re").alias("ar"), F.col("im").alias("ai"))
    exp = shapes.filter((F.col("role") == "EXP") & ok & F.col("measured")).select(
        "cmp_id", F.col("mode_no").alias("exp_mode"), "node_id", "dof", F.col("re").alias("er"), F.col("im").alias("ei"))
    return (pairs.select("cmp_id", "fe_mode", "exp_mode").join(exp, ["cmp_id", "exp_mode"])
            .join(fe, ["cmp_id", "fe_mode", "node_id", "dof"]))


def _grids(pairs: DataFrame, rows: DataFrame, per_node: DataFrame) -> DataFrame:
    """Per comparison: n_pairs, and whether every pair covers all nodes that any of its pairs covers."""
    n = pairs.groupBy("cmp_id").agg(F.count(F.lit(1)).alias("n_pairs"))
    per_pair = rows.groupBy("cmp_id", "fe_mode", "exp_mode").agg(F.countDistinct("node_id").alias("n_nodes"))
    grid = per_pair.groupBy("cmp_id").agg(F.min("n_nodes").alias("least"), F.count(F.lit(1)).alias("n_seen"))
    all_nodes = per_node.groupBy("cmp_id").agg(F.countDistinct("node_id").alias("n_all"))
    same = F.coalesce((F.col("least") == F.col("n_all")) & (F.col("n_seen") == F.col("n_pairs")), F.lit(False))
    return n.join(grid, "cmp_id", "left").join(all_nodes, "cmp_id", "left").select("cmp_id", "n_pairs", same.alias("one_grid"))


def comparison_status(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """COMMON_GRID or REFUSED_DIFFERENT_GRIDS for every comparison with pairs; refused ones have no AutoMAC, COMAC or summary."""
    rows = pair_rows(pairs, shapes)
    g = _grids(pairs, rows, rows.groupBy("cmp_id", "node_id", "dof").agg(F.count(F.lit(1)).alias("n_here")))
    return g.select("cmp_id", "n_pairs", F.when(F.col("one_grid"), "COMMON_GRID").otherwise("REFUSED_DIFFERENT_GRIDS").alias("status"))


def common_rows(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """``pair_rows`` on the DOFs shared by all pairs of a comparison; comparisons whose pairs use different measurement
    grids have no rows (`comparison_status` lists them)."""
    rows = keep(pair_rows(pairs, shapes))
    per_node = rows.groupBy("cmp_id", "node_id", "dof").agg(F.count(F.lit(1)).alias("n_here"))
    good = _grids(pairs, rows, per_node).filter("one_grid").select("cmp_id", "n_pairs")
    common = per_node.join(good, "cmp_id").filter(F.col("n_here") == F.col("n_pairs")).select("cmp_id", "node_id", "dof")
    return keep(rows.join(common, ["cmp_id", "node_id", "dof"]))


def auto_mac(rows: DataFrame, side: str = "a") -> DataFrame:
    """AutoMAC of the paired modes of each comparison over its common DOFs (upper triangle; the diagonal is 1).

    The result is square in the accepted pairs of one comparison by definition; rows meet on (comparison, node, dof).
    """
    label = "fe_mode" if side == "a" else "exp_mode"
    left = rows.select("cmp_id", "node_id", "dof", F.col(label).alias("mode_i"), F.col(f"{side}r").alias("pr"), F.col(f"{side}i").alias("pi"))
    right = rows.select("cmp_id", "node_id", "dof", F.col(label).alias("mode_j"), F.col(f"{side}r").alias("qr"), F.col(f"{side}i").alias("qi"))
    g = (left.join(right, ["cmp_id", "node_id", "dof"]).filter(F.col("mode_i") < F.col("mode_j"))
         .groupBy("cmp_id", "mode_i", "mode_j").agg(
            F.sum(dot_re(F.col("pr"), F.col("pi"), F.col("qr"), F.col("qi"))).alias("xr"),
            F.sum(dot_im(F.col("pr"), F.col("pi"), F.col("qr"), F.col("qi"))).alias("xi"),
            F.sum(abs2(F.col("pr"), F.col("pi"))).alias("na"), F.sum(abs2(F.col("qr"), F.col("qi"))).alias("nb")))
    return g.withColumn("mac", F.coalesce(mac_value(F.col("xr"), F.col("xi"), F.col("na"), F.col("nb")), F.lit(0.0)))


def comac(rows: DataFrame) -> DataFrame:
    """COMAC per node: pairs are unit-normalised and phase-aligned first, then DOF scores are averaged per node."""
    ar, ai, er, ei = (F.col(c) for c in ("ar", "ai", "er", "ei"))
    per = rows.groupBy("cmp_id", "fe_mode", "exp_mode").agg(
        F.sqrt(F.sum(abs2(ar, ai))).alias("norm_a"), F.sqrt(F.sum(abs2(er, ei))).alias("norm_e"),
        F.sum(dot_re(ar, ai, er, ei)).alias("cr"), F.sum(dot_im(ar, ai, er, ei)).alias("ci"))
    use = (F.col("norm_a") > TINY) & (F.col("norm_e") > TINY)
    size = F.hypot(F.col("cr") / (F.col("norm_a") * F.col("norm_e")), F.col("ci") / (F.col("norm_a") * F.col("norm_e")))
    turn = use & (size > TINY)
    per = per.select("cmp_id", "fe_mode", "exp_mode", F.when(use, F.col("norm_a")).otherwise(1.0).alias("sa"),
                     F.when(use, F.col("norm_e")).otherwise(1.0).alias("se"),
                     F.when(turn, F.col("cr") / F.hypot("cr", "ci")).otherwise(1.0).alias("pr"),
                     F.when(turn, F.col("ci") / F.hypot("cr", "ci")).otherwise(0.0).alias("pi"))
    r = rows.join(per, ["cmp_id", "fe_mode", "exp_mode"]).withColumn(
        "xr", (ar * F.col("pr") - ai * F.col("pi")) / F.col("sa")).withColumn(
        "xi", (ar * F.col("pi") + ai * F.col("pr")) / F.col("sa")).withColumn("yr", er / F.col("se")).withColumn("yi", ei / F.col("se"))
    xr, xi, yr, yi = (F.col(c) for c in ("xr", "xi", "yr", "yi"))
    dof = r.groupBy("cmp_id", "node_id", "dof").agg(
        F.sum(dot_re(xr, xi, yr, yi)).alias("gr"), F.sum(dot_im(xr, xi, yr, yi)).alias("gi"),
        F.sum(abs2(xr, xi)).alias("gx"), F.sum(abs2(yr, yi)).alias("gy"))
    den = F.col("gx") * F.col("gy")
    dof = dof.withColumn("score", abs2(F.col("gr"), F.col("gi")) / F.when(den > TINY, den))
    return dof.groupBy("cmp_id", "node_id").agg(clip(F.avg("score")).alias("comac"))


def correlation_summary(rows: DataFrame) -> DataFrame:
    """Largest off-diagonal AutoMAC of each side, mean and minimum COMAC per comparison."""
    fe = auto_mac(rows, "a").groupBy("cmp_id").agg(F.max("mac").alias("fe_automac_max"))
    exp = auto_mac(rows, "e").groupBy("cmp_id").agg(F.max("mac").alias("exp_automac_max"))
    nodes = comac(rows).groupBy("cmp_id").agg(F.avg("comac").alias("mean_comac"), F.min("comac").alias("min_comac"))
    out = nodes.join(fe, "cmp_id", "left").join(exp, "cmp_id", "left")
    return out.withColumn("fe_automac_max", F.coalesce("fe_automac_max", F.lit(0.0))).withColumn(
        "exp_automac_max", F.coalesce("exp_automac_max", F.lit(0.0)))


def pair_scaling(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """Least-squares complex scale FE -> EXP, unit aligning phase, most-real phase of EXP and the common plot scale."""
    rows = pair_rows(pairs, shapes)
    ar, ai, er, ei = (F.col(c) for c in ("ar", "ai", "er", "ei"))
    key = ["cmp_id", "fe_mode", "exp_mode"]
    g = rows.groupBy(*key).agg(
        F.sum(abs2(ar, ai)).alias("aa"), F.sum(dot_re(ar, ai, er, ei)).alias("cr"), F.sum(dot_im(ar, ai, er, ei)).alias("ci"),
        F.sum(er * er - ei * ei).alias("mr"), F.sum(2 * er * ei).alias("mi"),
        F.max_by(F.struct(er, ei), F.struct(abs2(er, ei), -F.col("node_id"), -F.col("dof"))).alias("big"))
    has = F.col("aa") > TINY
    coef_r = F.when(has, F.col("cr") / F.col("aa")).otherwise(1.0)
    coef_i = F.when(has, F.col("ci") / F.col("aa")).otherwise(0.0)
    g = g.withColumn("coef_re", coef_r).withColumn("coef_im", coef_i)
    size = F.hypot("coef_re", "coef_im")
    moment = F.hypot("mr", "mi")
    angle = (F.when(moment > TINY, -0.5 * F.atan2("mi", "mr"))
             .when(F.hypot("big.er", "big.ei") > TINY, -F.atan2("big.ei", "big.er")).otherwise(0.0))
    g = (g.withColumn("unit_re", F.when(has & (size > TINY), F.col("coef_re") / size).otherwise(1.0))
         .withColumn("unit_im", F.when(has & (size > TINY), F.col("coef_im") / size).otherwise(0.0))
         .withColumn("real_re", F.cos(angle)).withColumn("real_im", F.sin(angle)))
    r = rows.join(g.select(*key, "coef_re", "coef_im", "real_re", "real_im"), key)
    fr, fi = ar * F.col("coef_re") - ai * F.col("coef_im"), ar * F.col("coef_im") + ai * F.col("coef_re")
    peak = r.groupBy(*key).agg(F.greatest(
        F.max(F.abs(fr * F.col("real_re") - fi * F.col("real_im"))), F.max(F.abs(er * F.col("real_re") - ei * F.col("real_im"))),
        F.lit(TINY)).alias("plot_scale"))
    return g.join(peak, key)


def phase_measures(shapes: DataFrame) -> DataFrame:
    """Per mode: phase collinearity (MPC) and phase complexity (imaginary / real norm after turning the largest
    component real), from one aggregate of three moments."""
    re, im = F.col("re"), F.col("im")
    ok = finite(re, im)
    g = shapes.filter(ok).groupBy(*MODE).agg(
        F.sum(re * re).alias("sxx"), F.sum(re * im).alias("sxy"), F.sum(im * im).alias("syy"),
        F.max_by(F.struct(re, im), F.struct(abs2(re, im), -F.col("node_id"), -F.col("dof"))).alias("big"))
    sxx, sxy, syy = F.col("sxx"), F.col("sxy"), F.col("syy")
    total = sxx + syy
    amp = F.hypot("big.re", "big.im")
    c, s = F.col("big.re") / F.when(amp > 0, amp), F.col("big.im") / F.when(amp > 0, amp)
    real2 = sxx * c * c + 2 * sxy * c * s + syy * s * s
    imag2 = F.greatest(syy * c * c - 2 * sxy * c * s + sxx * s * s, F.lit(0.0))
    return (g.withColumn("mpc", (F.pow(sxx - syy, 2) + 4 * sxy * sxy) / F.when(total > 0, total * total))
            .withColumn("phase_complexity", F.when(amp <= TINY, 1.0).otherwise(
                F.sqrt(imag2) / F.greatest(F.sqrt(real2), F.lit(TINY)))))


def real_field(shapes: DataFrame) -> DataFrame:
    """Phase-aligned real components u1..u3 and the magnitude per (mode, node)."""
    re, im = F.col("re"), F.col("im")
    ok = finite(re, im)
    big = shapes.filter(ok).groupBy(*MODE).agg(
        F.max_by(F.struct(re, im), F.struct(abs2(re, im), -F.col("node_id"), -F.col("dof"))).alias("big"))
    amp = F.hypot("big.re", "big.im")
    turned = F.when(amp > TINY, (re * F.col("big.re") + im * F.col("big.im")) / amp).otherwise(re)
    rows = shapes.join(big, MODE).withColumn("_t", turned)
    return rows.groupBy(*MODE, "node_id").agg(
        *[F.max(F.when(F.col("dof") == d, F.col("_t"))).alias(f"u{d}") for d in DOFS],
        F.sqrt(F.sum(abs2(re, im))).alias("magnitude"))


def duplicate_mac(shapes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Largest MAC of each candidate mode against the existing modes of its list (0 when none is defined).

    ``pairs`` names (cmp_id, candidate, existing); both masks apply."""
    ok = finite(F.col("re"), F.col("im")) & F.col("measured")
    base = shapes.filter(ok & (F.col("role") == "EXP"))
    a = base.select("cmp_id", F.col("mode_no").alias("candidate"), "node_id", "dof", F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = base.select("cmp_id", F.col("mode_no").alias("existing"), "node_id", "dof", F.col("re").alias("er"), F.col("im").alias("ei"))
    ar, ai, er, ei = (F.col(c) for c in ("ar", "ai", "er", "ei"))
    g = (pairs.join(a, ["cmp_id", "candidate"]).join(b, ["cmp_id", "existing", "node_id", "dof"])
         .groupBy("cmp_id", "candidate", "existing").agg(
            F.sum(dot_re(ar, ai, er, ei)).alias("xr"), F.sum(dot_im(ar, ai, er, ei)).alias("xi"),
            F.sum(abs2(ar, ai)).alias("na"), F.sum(abs2(er, ei)).alias("nb")))
    g = g.withColumn("mac", mac_value(F.col("xr"), F.col("xi"), F.col("na"), F.col("nb")))
    best = g.groupBy("cmp_id", "candidate").agg(F.max("mac").alias("max_mac"))
    return (pairs.select("cmp_id", "candidate").distinct().join(best, ["cmp_id", "candidate"], "left")
            .withColumn("max_mac", F.coalesce("max_mac", F.lit(0.0))))

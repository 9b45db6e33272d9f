"""Spatial operators: nearest nodes, quads, orientations, registrations.

Points meet through grid cells, never through all pairs: both sides carry a cell key, one side is copied into the
neighbouring cells, and the exact metric decides. Points without a near enough neighbour go through a wider pass and, last,
through their whole (small remaining) group, so results stay complete.
"""
from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modalframe.functions.policies import ShapeFamilyPolicy, stamp
from modalframe.operators.ordered import top_rows
from modalframe.session import cut_lineage, dealt, keep

XYZ = ("x", "y", "z")
# Metres per length unit, MPa per modulus unit, unit scales tried, geometry limits.
UNIT_TO_METRES = {"mm": 1.0e-3, "m": 1.0, "cm": 1.0e-2, "µm": 1.0e-6}
MODULUS_TO_MPA = {"MPa": 1.0, "N/mm2": 1.0, "N/mm^2": 1.0, "N/mm²": 1.0, "GPa": 1.0e3, "kPa": 1.0e-3, "Pa": 1.0e-6,
                  "N/m2": 1.0e-6, "N/m^2": 1.0e-6, "N/m²": 1.0e-6}
# Targets that one cell row holds at most; queries of fuller cells go down the octree.
CELL_TARGETS = 1024
# Nodes of a cell that the kernel of orientations holds; fuller cells are left to the octree.
CELL_HELD = 8 * CELL_TARGETS
# Nodes of a key that one task passes over at first, and rows that it holds while it looks for the nodes nearest to a grid.
GRID_PART, GRID_ROWS = 65536, 8192
UNIT_SCALES = (1.0e-6, 1.0e-3, 1.0, 1.0e3, 1.0e6)
RMS_FACTOR, RMS_WINDOW, MATCH_FRACTION = 1.5, 1.0e-8, 0.03
SQUARE_SYMMETRIES = {
    "identity": ((1, 0), (0, 1)), "turn 90": ((0, -1), (1, 0)), "turn 180": ((-1, 0), (0, -1)), "turn 270": ((0, 1), (-1, 0)),
    "mirror i": ((-1, 0), (0, 1)), "mirror j": ((1, 0), (0, -1)), "mirror diagonal": ((0, 1), (1, 0)),
    "mirror antidiagonal": ((0, -1), (-1, 0))}


def _factor(unit: Column, table: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, value in table.items():
        out = F.when(unit == name, value).otherwise(out)
    return out


def length_factor(unit: Column, to: str = "mm") -> Column:
    """Factor from a length unit to ``to``; NULL (refused) for an unknown unit."""
    return _factor(unit, UNIT_TO_METRES) / F.lit(UNIT_TO_METRES[to])


def modulus_factor(unit: Column) -> Column:
    return _factor(F.trim(unit), MODULUS_TO_MPA)


# ------------------------------------------------------------------------------------------------ nearest points
def _distance2(a: str, b: str) -> Column:
    return sum((F.pow(F.col(f"{a}{c}") - F.col(f"{b}{c}"), 2) for c in XYZ[1:]), F.pow(F.col(f"{a}x") - F.col(f"{b}x"), 2))


def _cells(df: DataFrame, prefix: str, around: bool) -> DataFrame:
    for c in XYZ:
        df = df.withColumn(f"_c{c}", F.floor(F.col(f"{prefix}{c}") / F.col("_h")))
    df = df.withColumn("_cz", F.when(F.col("_flat"), F.lit(0).cast("bigint")).otherwise(F.col("_cz")))
    if around:
        three = F.array(*[F.lit(i) for i in (-1, 0, 1)])
        df = df.withColumn("_d", F.explode(three)).withColumn("_cx", F.col("_cx") + F.col("_d"))
        df = df.withColumn("_d", F.explode(three)).withColumn("_cy", F.col("_cy") + F.col("_d"))
        df = df.withColumn("_d", F.explode(F.when(F.col("_flat"), F.array(F.lit(0))).otherwise(three))).withColumn(
            "_cz", F.col("_cz") + F.col("_d")).drop("_d")
    return df


def _descend(queries: DataFrame, targets: DataFrame, size: DataFrame, keys: list[str], qid: list[str], k: int) -> DataFrame:
    """Pairs among which the k nearest targets of far queries are: down an octree of the targets, level by level.

    Each cell is known by the bounding box of its targets. A query drops the cells whose box begins beyond the nearest box
    that surely holds k targets, so it keeps a few cells a level and meets only the targets of its last cells. The depth is
    the one at which a cell is as wide as a density cell; it grows with the logarithm of the number of targets.
    """
    low = targets.groupBy(*keys).agg(*[F.min(f"t{c}").alias(f"_o{c}") for c in XYZ], F.greatest(*[F.max(f"t{c}") - F.min(f"t{c}") for c in XYZ]).alias("_w")).join(size.select(*keys, "_h0"), keys)
    depth = low.agg(F.max(F.ceil(F.log2(F.greatest(F.col("_w") / F.col("_h0"), F.lit(1.0)))))).first()[0] or 0
    depth = min(int(depth), 40) + 1
    fine = targets.join(low, keys)
    for c in XYZ:
        fine = fine.withColumn(f"_i{c}", F.least(F.floor((F.col(f"t{c}") - F.col(f"_o{c}")) / F.greatest(F.col("_w"), F.lit(1e-300)) * 2.0 ** depth), F.lit(2 ** depth - 1)).cast("bigint"))
    own = [f"_i{c}" for c in XYZ]
    boxes = fine.groupBy(*keys, *own).agg(F.count(F.lit(1)).alias("_m"), *[f(f"t{c}").alias(f"_{n}{c}") for c in XYZ for f, n in ((F.min, "l"), (F.max, "u"))])
    boxes = keep(boxes)
    front = queries.select(*keys, *qid, *[f"q{c}" for c in XYZ]).withColumns({i: F.lit(0).cast("bigint") for i in own})
    query = Window.partitionBy(*keys, *qid)
    for level in range(1, depth + 1):
        up = depth - level
        cells = boxes.select(*keys, *[F.shiftright(i, up).alias(i) for i in own], "_m", *[f"_{n}{c}" for c in XYZ for n in "lu"]).groupBy(*keys, *own).agg(
            F.sum("_m").alias("_m"), *[f(f"_{n}{c}").alias(f"_{n}{c}") for c in XYZ for f, n in ((F.min, "l"), (F.max, "u"))])
        cells = cells.withColumns({f"_p{i}": F.shiftright(i, 1) for i in own})
        front = front.withColumnsRenamed({i: f"_p{i}" for i in own}).join(cells, [*keys, *[f"_p{i}" for i in own]])
        near, far = F.lit(0.0), F.lit(0.0)
        for c in XYZ:
            near = near + F.pow(F.greatest(F.col(f"_l{c}") - F.col(f"q{c}"), F.col(f"q{c}") - F.col(f"_u{c}"), F.lit(0.0)), 2)
            far = far + F.pow(F.greatest(F.abs(F.col(f"q{c}") - F.col(f"_l{c}")), F.abs(F.col(f"q{c}") - F.col(f"_u{c}"))), 2)
        front = front.withColumn("_near", near).withColumn("_cut", F.min(F.when(F.col("_m") >= k, far)).over(query))
        front = front.filter(F.col("_cut").isNull() | (F.col("_near") <= F.col("_cut") * (1 + 1e-12) + 1e-300)).select(*keys, *qid, *[f"q{c}" for c in XYZ], *own)
        # one plan of all levels would hold the driver's memory with the depth
        front = cut_lineage(front)
    return front.join(fine.drop("_w", "_h0", *[f"_o{c}" for c in XYZ]), [*keys, *own])


def nearest_points(queries: DataFrame, targets: DataFrame, keys: list[str], qid: list[str], tid: str, k: int = 1,
                   ids: DataFrame | None = None) -> DataFrame:
    """The k nearest targets of every query point within its key: keys, qid, tid, distance, nearness (1 = nearest).

    Cell size follows the target density of each key, so a key with most of the rows is spread over its cells. Every target
    is copied into the cells around its own, a query asks the one cell that it, moved into the box of the targets, falls in,
    and the cell's targets (``CELL_TARGETS`` at most) lie in one row; so pairs are never rows. Queries that this does not
    settle go down the octree (`_descend`): those of fuller cells, near holes, with an identity that is NULL or repeats.
    ``ids`` may hold the rows whose columns among ``keys`` and ``qid`` tell whether query identities repeat.
    """
    q = queries.select(*keys, *qid, *[F.col(c).cast("double").alias(f"q{c}") for c in XYZ])
    t = targets.select(*keys, tid, *[F.col(c).cast("double").alias(f"t{c}") for c in XYZ])
    span = lambda c: F.max(f"t{c}") - F.min(f"t{c}")
    placed = F.col("tx").isNotNull() & F.col("ty").isNotNull() & F.col("tz").isNotNull()
    size = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.bool_and(placed).alias("_whole"), F.array_sort(F.array(span("x"), span("y"), span("z"))).alias("_s"),
                                span("z").alias("_sz"), *[f(f"t{c}").alias(f"_{n}{c}") for c in XYZ for f, n in ((F.min, "l"), (F.max, "u"))])
    cell = 1.5 * F.sqrt(F.get("_s", F.lit(1)) * F.get("_s", F.lit(2)) / F.col("_n"))
    cell = F.greatest(cell, F.get("_s", F.lit(2)) / F.col("_n"), F.lit(1e-9)) * math.sqrt(k)
    box = [f"_{n}{c}" for c in XYZ for n in "lu"]
    size = size.select(*keys, "_n", cell.alias("_h"), (F.col("_sz") <= cell).alias("_flat"), "_whole", *box)
    at = ["_cx", "_cy", "_cz"]

    named = [c for c in [*keys, *qid] if ids is None or c in ids.columns]
    many = (q if ids is None else ids).groupBy(*named).agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1")
    many = None if many.isEmpty() else many

    most = max(CELL_TARGETS, 64 * k)
    held = _cells(t.filter(placed).join(size.select(*keys, "_h", "_flat"), keys), "t", True)
    held = top_rows(held, [*keys, *at], [tid], most + 1).groupBy(*keys, *at).agg(F.collect_list(F.struct("tx", "ty", "tz", tid)).alias("_t"))
    held = held.filter(F.size("_t") <= most)
    inner = {f"_i{c}": F.least(F.greatest(F.col(f"q{c}"), F.col(f"_l{c}")), F.col(f"_u{c}")) for c in XYZ}
    asked = _cells(q.join(size, keys).withColumns(inner), "_i", False).drop(*inner)
    if many is not None:
        asked = asked.join(many, named, "left")
    d2 = lambda v: sum((F.pow(F.col(f"q{c}") - v[f"t{c}"], 2) for c in XYZ[1:]), F.pow(F.col("qx") - v["tx"], 2))
    near = F.transform("_t", lambda v: F.struct(d2(v).alias("_d2"), v[tid].alias(tid)))
    near = F.array(F.array_min(near)) if k == 1 else F.slice(F.sort_array(near), 1, k)
    asked = asked.join(held, [*keys, *at], "left").withColumn("near", F.when(F.size("_t") > 0, near)).drop("_t", *at)
    # A target of no asked cell is off the moved query by more than _h along one axis of the grid, and the query is off the
    # box by _o along each; targets without a place could be nearer than anything, so their keys only settle what is inside.
    off = {c: F.greatest(F.col(f"_l{c}") - F.col(f"q{c}"), F.col(f"q{c}") - F.col(f"_u{c}"), F.lit(0.0)) for c in XYZ}
    least = F.least(off["x"], off["y"], F.when(~F.col("_flat"), off["z"]))
    beyond = sum((off[c] * off[c] for c in XYZ), F.col("_h") * F.col("_h") + 2 * F.col("_h") * least)
    last = F.element_at("near", -1)["_d2"]
    sure = (F.size("near") == F.least(F.lit(k), F.col("_n"))) & F.when(F.col("_whole"), last <= beyond * (1 - 1e-9)).otherwise(F.sqrt(last) <= F.col("_h")) & (last < float("inf"))
    for c in qid:
        sure = sure & F.col(c).isNotNull()
    if many is not None:
        sure = sure & F.col("_m").isNull()
    asked = asked.withColumn("near", F.when(sure, near_out("near", tid)))
    # one row per query point, read by this pass's answer and by the descent; a lost block is simply recomputed
    open_ = F.col("near").isNull()
    seen = keep(asked.select(*keys, *qid, "near", *[F.when(open_, F.col(f"q{c}")).alias(f"q{c}") for c in XYZ]))
    done = seen.filter(~open_).select(*keys, *qid, "near")
    if not seen.filter(open_).isEmpty():
        far = _descend(seen.filter(open_).drop("near"), t, size.withColumnRenamed("_h", "_h0"), keys, qid, k).withColumn("_d2", _distance2("q", "t"))
        if k == 1:
            best = far.groupBy(*keys, *qid).agg(F.array(F.min(F.struct("_d2", tid))).alias("near"))
        else:
            best = top_rows(far, [*keys, *qid], ["_d2", tid], k).groupBy(*keys, *qid).agg(F.sort_array(F.collect_list(F.struct("_d2", tid))).alias("near"))
        best = best.withColumn("near", near_out("near", tid))
        if many is not None:
            # a repeated identity answers once for each of its rows if its cells would have done, else once
            best = best.join(many, named, "left").join(size.select(*keys, "_n", "_h"), keys)
            inside = (F.size("near") == F.least(F.lit(k), F.col("_n"))) & (F.element_at("near", -1)["distance"] <= F.col("_h"))
            best = best.withColumn("_again", F.explode(F.array_repeat(F.lit(1), F.when(inside, F.coalesce("_m", F.lit(1))).otherwise(1).cast("int"))))
        done = done.unionByName(best.select(*keys, *qid, "near"))
    return done.select(*keys, *qid, F.posexplode("near").alias("_p", "v")).select(
        *keys, *qid, F.col(f"v.{tid}").alias(tid), F.col("v.distance").alias("distance"), (F.col("_p") + 1).alias("nearness"))


def near_out(near: str, tid: str) -> Column:
    return F.transform(near, lambda v: F.struct(F.sqrt(v["_d2"]).alias("distance"), v[tid].alias(tid)))


def within_radius(queries: DataFrame, targets: DataFrame, keys: list[str], qid: list[str], tid: str) -> DataFrame:
    """Nearest target within the per-key ``radius`` column of the queries (2-D); no row where none is that near."""
    q = queries.select(*keys, *qid, F.col("radius").alias("_h"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    r = q.groupBy(*keys).agg(F.max("_h").alias("_h"))
    q = q.drop("_h").join(r, keys)
    t = targets.select(*keys, tid, F.col("x").alias("tx"), F.col("y").alias("ty")).join(r, keys).drop("qx")
    three = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    qc = (q.withColumn("_d", F.explode(three)).withColumn("_cx", F.floor(F.col("qx") / F.col("_h")) + F.col("_d"))
          .withColumn("_d", F.explode(three)).withColumn("_cy", F.floor(F.col("qy") / F.col("_h")) + F.col("_d")).drop("_d"))
    tc = t.withColumn("_cx", F.floor(F.col("tx") / F.col("_h"))).withColumn("_cy", F.floor(F.col("ty") / F.col("_h"))).drop("_h")
    d2 = F.pow(F.col("qx") - F.col("tx"), 2) + F.pow(F.col("qy") - F.col("ty"), 2)
    near = qc.join(tc, [*keys, "_cx", "_cy"]).withColumn("_d2", d2).filter(F.col("_d2") <= F.col("_h") * F.col("_h"))
    return near.groupBy(*keys, *qid).agg(F.min(F.struct("_d2", tid)).alias("b")).select(
        *keys, *qid, F.col(f"b.{tid}").alias(tid), F.sqrt("b._d2").alias("distance"))


# ------------------------------------------------------------------------------------------------ extents, scales
def extents(points: DataFrame, keys: list[str]) -> DataFrame:
    """Bounding box, midpoint centre, spans and RMS radius about the centre."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in XYZ:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"_m{c}"), F.var_pop(c).alias(f"_v{c}")]
    g = points.groupBy(*keys).agg(*aggs)
    r2 = F.lit(0.0)
    for c in XYZ:
        g = g.withColumn(f"{c}_mid", (F.col(f"{c}_min") + F.col(f"{c}_max")) / 2).withColumn(f"{c}_span", F.col(f"{c}_max") - F.col(f"{c}_min"))
        r2 = r2 + F.col(f"_v{c}") + F.pow(F.col(f"_m{c}") - F.col(f"{c}_mid"), 2)
    g = g.withColumn("radius", F.sqrt(r2))
    diag = F.sqrt(F.pow("x_span", 2) + F.pow("y_span", 2) + F.pow("z_span", 2))
    return g.withColumn("span", F.greatest(diag, F.col("radius"))).drop(*[f"_m{c}" for c in XYZ], *[f"_v{c}" for c in XYZ])


def scale_candidates(fe: DataFrame, exp: DataFrame, keys: list[str]) -> DataFrame:
    """Median ratio of the sorted spans plus the unit scales within a factor 5 of it: keys, scale_no, scale."""
    a = extents(fe, keys).select(*keys, F.array_sort(F.array("x_span", "y_span", "z_span")).alias("_a"), F.col("radius").alias("_ra"))
    e = extents(exp, keys).select(*keys, F.array_sort(F.array("x_span", "y_span", "z_span")).alias("_e"), F.col("radius").alias("_re"))
    ratios = F.array_compact(F.zip_with("_a", "_e", lambda x, y: F.when((x > 1e-30) & (y > 1e-30), y / F.when(x > 1e-30, x))))
    d = a.join(e, keys).withColumn("_r", F.array_sort(ratios))
    n = F.size("_r")
    mid = F.floor(n / 2).cast("int")
    base = F.when(n == 0, F.col("_re") / F.col("_ra")).when(n % 2 == 1, F.get("_r", mid)).otherwise((F.get("_r", mid - 1) + F.get("_r", mid)) / 2)
    d = d.withColumn("_b", base)
    near = F.array_compact(F.array(F.col("_b"), *[F.when((F.col("_b") / u).between(0.2, 5.0), F.lit(u)) for u in UNIT_SCALES]))
    scales = F.array_sort(F.array_distinct(F.transform(near, lambda v: F.round(v, 15))))
    return d.select(*keys, F.posexplode(scales).alias("scale_no", "scale"))


def camera_grid_scales(calibrations: DataFrame, exp: DataFrame, keys: list[str]) -> DataFrame:
    """Camera-grid calibration: straight and swapped scale vectors from physical width / height (in model units).

    ``calibrations``: keys, width, height, dimension_unit, model_unit."""
    box = extents(exp, keys).select(*keys, "x_span", "y_span")
    f = length_factor(F.col("dimension_unit"), "m") / length_factor(F.col("model_unit"), "m")
    d = calibrations.join(box, keys).withColumn("_w", F.col("width") * f).withColumn("_h", F.col("height") * f)
    d = d.withColumn("axes_swapped", F.explode(F.array(F.lit(False), F.lit(True))))
    sx = F.col("x_span") / F.when(F.col("axes_swapped"), F.col("_h")).otherwise(F.col("_w"))
    sy = F.col("y_span") / F.when(F.col("axes_swapped"), F.col("_w")).otherwise(F.col("_h"))
    return d.filter((F.col("x_span") > 1e-30) & (F.col("y_span") > 1e-30)).select(
        *keys, "axes_swapped", sx.alias("sx"), sy.alias("sy"), F.sqrt(sx * sy).alias("sz"))


# ------------------------------------------------------------------------------------------------ orientations
def _parity(perm: tuple[int, ...]) -> int:
    return -1 if sum(perm[i] > perm[j] for i in range(3) for j in range(i + 1, 3)) % 2 else 1


def orientation_array() -> Column:
    """The 48 signed axis permutations as an array literal of (no, perm, sign, det)."""
    rows = []
    for no, (perm, signs) in enumerate(itertools.product(itertools.permutations(range(3)), itertools.product((-1.0, 1.0), repeat=3))):
        det = _parity(perm) * int(np.prod(signs))
        rows.append(F.struct(F.lit(no).alias("no"), F.array(*[F.lit(p) for p in perm]).alias("perm"),
                             F.array(*[F.lit(s) for s in signs]).alias("sign"), F.lit(det).alias("det")))
    return F.array(*rows)


def _runs(batches, keys: list[str]):
    """The slices of equal keys in sorted Arrow batches, with whether a run begins; a run may go on in the next batch."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            code = batch.column(k).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        own = tuple(batch.column(k)[0].as_py() for k in keys)
        new[0] = last is None or any(x != y and (x == x or y == y) for x, y in zip(own, last))
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
        at = sorted({0, *np.flatnonzero(new).tolist(), batch.num_rows})
        for low, high in zip(at, at[1:]):
            yield bool(new[low]), batch.slice(low, high - low)


def _finite(*cols: str) -> Column:
    """Whether all of the columns hold finite numbers; never NULL."""
    out = F.lit(True)
    for c in cols:
        out = out & F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    return out


def _turned_points(rows: DataFrame, fec: DataFrame, ids: DataFrame, neighbours: int) -> DataFrame:
    """The map of rows (dataset_id, point_id, scale_no, _span, ex .. sz) with their orientation ``o``: a query each, whatever repeats or is missing."""
    key, qid = ["dataset_id"], ["scale_no", "orientation", "point_id"]
    scaled = F.array(F.col("ex") / F.col("sx"), F.col("ey") / F.col("sy"), F.col("ez") / F.col("sz"))
    turned = F.zip_with(scaled, "o.sign", lambda v, s: v * s)
    q = rows.withColumn("orientation", F.col("o.no"))
    for i, a in enumerate(XYZ):
        q = q.withColumn(a, F.get(turned, F.array_position("o.perm", F.lit(i)).cast("int") - 1))
    near = nearest_points(q, fec, key, qid, "node_id", neighbours, ids=ids)
    full = near.join(q.select("dataset_id", *qid, "o", "_span", "sx", "sy", "sz", "ex", "ey", "ez"), [*key, *qid]).join(
        fec.select("dataset_id", "node_id", F.array(*XYZ).alias("_n")), ["dataset_id", "node_id"])
    back = [F.get("_n", F.get("o.perm", F.lit(j))) * F.get("o.sign", F.lit(j)) * F.col(f"s{a}") - F.col(f"e{a}") for j, a in enumerate(XYZ)]
    d = F.sqrt(back[0] * back[0] + back[1] * back[1] + back[2] * back[2])
    best = full.withColumn("residual", d).groupBy(*key, *qid).agg(
        F.min(F.struct("residual", "nearness", "node_id")).alias("b"), F.first("_span").alias("_span"),
        F.first("sx").alias("sx"), F.first("sy").alias("sy"), F.first("sz").alias("sz"))
    return best.select(*key, *qid, F.col("b.node_id").alias("node_id"), F.col("b.residual").alias("residual"), "_span", "sx", "sy", "sz")


_CELL, _BOX = ["dataset_id", "_salt", "_cx", "_cy", "_cz"], ["_n", "_h", "_flat", "_ux", "_uy", "_uz", "_rows", "_whole", "_h0"]


def _all_orientations(names: list[str], neighbours: int):
    """Kernel over sorted cells, the nodes of each before the points that ask it: the residual and node of every point's images.

    A point row asks for one axis order in both signs of each axis (``_perm``) or for all six (-1). An image that nodes of
    other cells may be nearer to, or whose cell is too full, has no residual."""
    perms, signs = list(itertools.permutations(range(3))), np.array(list(itertools.product((-1.0, 1.0), repeat=3)))

    def images(v, s, e, perm, t, box):
        d2 = [[(v[:, j:j + 1] * w - t[:, perm[j]]) ** 2 for w in (-1.0, 1.0)] for j in range(3)]
        x, y, z = (perm.index(i) for i in range(3))
        for sign in signs:
            side = [int(w > 0) for w in sign]
            far = (d2[x][side[x]] + d2[y][side[y]]) + d2[z][side[z]]
            near = far.argmin(1)[:, None] if neighbours == 1 else far.argsort(1, kind="stable")[:, :neighbours]
            back = [t[near, perm[j]] * sign[j] * s[:, j:j + 1] - e[:, j:j + 1] for j in range(3)]
            residual = np.sqrt(back[0] * back[0] + back[1] * back[1] + back[2] * back[2])
            pick = residual.argmin(1)[:, None]
            node, residual = np.take_along_axis(near, pick, 1)[:, 0], np.take_along_axis(residual, pick, 1)[:, 0]
            last = np.take_along_axis(far, near[:, -1:], 1)[:, 0]
            if not box["_whole"]:
                # nodes without a place could be nearer than anything, so only what is as near as nearest_points would have it is settled
                residual = np.where((near.shape[1] == min(neighbours, box["_rows"])) & (np.sqrt(last) <= box["_h0"]), residual, np.nan)
            if box["_n"] > len(t):
                # as in nearest_points: what no asked cell holds is off the moved image by more than _h along one axis
                off = {"xyz"[perm[j]]: np.maximum(np.abs(v[:, j]) - box[f"_u{'xyz'[perm[j]]}"], 0.0) for j in range(3)}
                least = np.minimum(off["x"], off["y"]) if box["_flat"] else np.minimum(np.minimum(off["x"], off["y"]), off["z"])
                beyond = off["x"] ** 2 + off["y"] ** 2 + off["z"] ** 2 + box["_h"] ** 2 + 2 * box["_h"] * least
                residual = np.where((near.shape[1] == min(neighbours, box["_n"])) & (last <= beyond * (1 - 1e-9)), residual, np.nan)
            yield node, residual

    def answer(part, nodes, t, box):
        read = lambda *c: np.column_stack([part.column(x).to_numpy(zero_copy_only=False) for x in c])
        perm = part.column("_perm")[0].as_py()
        asked = perms if perm < 0 else [perms[perm]]
        if t is None:
            node, residual = np.zeros((part.num_rows, 8 * len(asked)), np.int64), np.full((part.num_rows, 8 * len(asked)), np.nan)
            nodes = pa.nulls(1, part.schema.field("node_id").type)
        else:
            got = [x for p in asked for x in images(read("x", "y", "z"), read("sx", "sy", "sz"), read("ex", "ey", "ez"), p, t, box)]
            node, residual = (np.column_stack([x[i] for x in got]) for i in (0, 1))
        at = pa.array(np.arange(0, residual.size + 1, residual.shape[1], dtype=np.int32))
        lists = [pa.ListArray.from_arrays(at, v) for v in (nodes.take(pa.array(node.ravel())), pa.array(residual.ravel(), from_pandas=True))]
        return pa.RecordBatch.from_arrays([*[part.column(c) for c in names[:-2]], *lists], names=names)

    def run(batches):
        cell, held, full, t, nodes, box = None, [], False, None, None, {}
        for new, part in _runs(batches, [*_CELL, "_tag", "_perm"]):
            own = tuple(part.column(c)[0].as_py() for c in _CELL)
            if own != cell:
                cell, held, full, t = own, [], False, None
            if part.column("_tag")[0].as_py() == 0:
                held, full = ([], True) if full or sum(x.num_rows for x in held) + part.num_rows > CELL_HELD else ([*held, part], False)
                continue
            if held:
                rows = pa.Table.from_batches(held).combine_chunks()
                nodes, t, held = rows["node_id"].combine_chunks(), np.column_stack([rows[c].to_numpy() for c in XYZ]), []
                box = {c: rows[c][0].as_py() for c in _BOX}
            step = max(1, 2**18 // (1 if t is None else len(t)))
            for low in range(0, part.num_rows, step):
                yield answer(part.slice(low, step), nodes, t, box)

    return run


def _mapped_in_cells(base: DataFrame, t: DataFrame, size: DataFrame, neighbours: int) -> DataFrame:
    """The images of plain points: dataset_id, point_id, scale_no, _span, ex .. sz, orientation, node_id, residual (NULL if not settled).

    Only points and nodes are shuffled, not images. Nodes and images meet by cells of their coordinates without signs (the
    nodes lie about their centre), so the eight images of an axis order ask one cell; a dataset of few nodes is one cell."""
    fold = lambda c: F.floor(F.abs(c) / F.col("_h"))
    around = lambda c: F.sequence(F.greatest(c - 1, F.lit(0)), c + 1)
    zero = F.lit(0).cast("bigint")
    nodes = t.join(size, "dataset_id")
    for c in XYZ:
        flat = F.col("_one") | F.col("_flat") if c == "z" else F.col("_one")
        nodes = nodes.withColumn(f"_c{c}", F.explode(F.when(flat, F.array(zero)).otherwise(around(fold(F.col(c))))))
    nodes = nodes.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1)))
    nodes = nodes.select(*_CELL, F.lit(0).alias("_tag"), F.lit(-1).alias("_perm"), "node_id", *XYZ, *_BOX)
    orders = F.array(*[F.struct(F.lit(i).alias("no"), *[F.lit(p.index(k)).alias(c) for k, c in enumerate(XYZ)]) for i, p in enumerate(itertools.permutations(range(3)))])
    none = F.array(F.struct(F.lit(-1).alias("no"), *[F.lit(0).alias(c) for c in XYZ]))
    points = base.join(size, "dataset_id").withColumn("_o", F.explode(F.when(F.col("_one"), none).otherwise(orders))).withColumn("_v", F.array("x", "y", "z"))
    for c in XYZ:
        moved = F.least(F.abs(F.get("_v", F.col(f"_o.{c}"))), F.col(f"_u{c}"))
        points = points.withColumn(f"_c{c}", F.when(F.col("_one") | (F.col("_flat") if c == "z" else F.lit(False)), zero).otherwise(fold(moved)))
    points = points.withColumn("_salt", F.pmod(F.xxhash64("point_id"), "_salts"))
    carried = ["point_id", "scale_no", "_span", "ex", "ey", "ez", "sx", "sy", "sz"]
    points = points.select(*_CELL, F.lit(1).alias("_tag"), F.col("_o.no").alias("_perm"), *XYZ, *carried)
    both = dealt(nodes.unionByName(points, allowMissingColumns=True), *_CELL).sortWithinPartitions(*_CELL, "_tag", "_perm", "node_id")
    own = ["dataset_id", *carried, "_perm"]
    whole = T.StructType([*[both.schema[c] for c in own], T.StructField("_nodes", T.ArrayType(both.schema["node_id"].dataType)), T.StructField("_residuals", T.ArrayType(T.DoubleType()))])
    got = both.mapInArrow(_all_orientations(whole.names, neighbours), whole)
    got = got.select(*own, F.posexplode(F.arrays_zip("_nodes", "_residuals")).alias("_i", "_r"))
    return got.select("dataset_id", *carried, (F.greatest(F.col("_perm"), F.lit(0)) * 8 + F.col("_i")).alias("orientation"), F.col("_r._nodes").alias("node_id"), F.col("_r._residuals").alias("residual"))


def score_orientations(fe: DataFrame, exp: DataFrame, scales: DataFrame, neighbours: int = 1) -> tuple[DataFrame, DataFrame]:
    """Score every signed axis permutation x scale of each dataset: (candidates, maps).

    ``fe``: dataset_id, node_id, xyz; ``exp``: dataset_id, point_id, xyz; ``scales``: dataset_id, scale_no, sx, sy, sz.
    With unequal axis scales use ``neighbours=8``: the nearest nodes in the FE metric are refined in the raw metric.
    Images of points meet the nodes in a kernel (`_mapped_in_cells`); what it cannot settle, and identities that stand for
    several places, go through `nearest_points`. A point without a place takes the first node and has no residual.
    """
    key = ["dataset_id"]
    cen = lambda d, c: extents(d, key).select("dataset_id", *[F.col(f"{a}_mid").alias(f"_m{a}") for a in XYZ], F.col("span").alias("_span"))
    fec = fe.join(cen(fe, "a").drop("_span"), key).select("dataset_id", "node_id", *[(F.col(a) - F.col(f"_m{a}")).alias(a) for a in XYZ])
    exc = exp.join(cen(exp, "e"), key).select("dataset_id", "point_id", "_span", *[(F.col(a) - F.col(f"_m{a}")).alias(f"e{a}") for a in XYZ])
    placed = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    t = fec.groupBy("dataset_id", "node_id").agg(F.collect_set(F.when(placed, F.struct(*XYZ))).alias("_at"), F.count(F.when(~placed, 1)).alias("_gaps"), F.count(F.lit(1)).alias("_rows"))
    several = (F.size("_at") > 1) | (F.col("_gaps") > 0) & (F.size("_at") > 0) | F.col("node_id").isNull()
    t = t.select("dataset_id", "node_id", F.get("_at", F.lit(0)).alias("_p"), "_gaps", "_rows", several.alias("_bad"),
                 (F.lit(1) if neighbours == 1 else F.col("_rows")).alias("_copies")).select("*", "_p.*").drop("_p")
    p = exc.filter(F.col("point_id").isNotNull()).groupBy("dataset_id", "point_id").agg(
        F.first("_span").alias("_span"), F.collect_set(F.struct("ex", "ey", "ez")).alias("_at")).select(
        "dataset_id", "point_id", "_span", F.get("_at", F.lit(0)).alias("_e"), (F.size("_at") > 1).alias("_clash")).select("*", "_e.*").drop("_e")
    s = scales.filter(F.col("scale_no").isNotNull()).groupBy("dataset_id", "scale_no").agg(F.count(F.lit(1)).alias("_m"), *[F.first(f"s{a}").alias(f"s{a}") for a in XYZ])
    span = {c: F.max(c) - F.min(c) for c in XYZ}
    size = t.groupBy(*key).agg(
        F.sum(F.when(F.col("x").isNotNull(), F.col("_copies"))).alias("_n"), F.sum("_rows").alias("_rows"), (F.sum("_gaps") == 0).alias("_whole"),
        F.bool_or(F.col("_bad") | F.col("x").isNotNull() & ~_finite(*XYZ)).alias("_bad"), F.min("node_id").alias("_first"),
        F.array_sort(F.array(*span.values())).alias("_s"), span["z"].alias("_sz"), *[F.max(F.abs(c)).alias(f"_u{c}") for c in XYZ])
    wide = lambda times, n: F.greatest(times * F.sqrt(F.get("_s", F.lit(1)) * F.get("_s", F.lit(2)) / n), F.get("_s", F.lit(2)) / n, F.lit(1e-9)) * math.sqrt(neighbours)
    # a cell's nodes are repeated for each part of the points, so parts are only made where points are many times the nodes
    load = p.groupBy(*key).agg(F.count(F.lit(1)).alias("_p")).join(s.groupBy(*key).agg(F.count(F.lit(1)).alias("_k")), key)
    size = size.join(load, key).withColumn("_h", wide(3.0, F.col("_n"))).withColumn("_h0", wide(1.5, F.col("_rows"))).withColumn("_flat", F.col("_sz") <= F.col("_h")).withColumn(
        "_one", F.col("_n") <= 2 * CELL_TARGETS).withColumn("_salts", F.ceil(F.col("_p") * F.col("_k") / (16 * F.greatest(F.col("_n"), F.lit(1)))))
    base = p.join(s, key).join(size.select(*key, "_bad", "_first", "_n"), key)
    for a in XYZ:
        base = base.withColumn(a, F.col(f"e{a}") / F.col(f"s{a}"))
    gap = F.col("_n").isNull() | F.col("ex").isNull() | F.col("ey").isNull() | F.col("ez").isNull()
    good = _finite(*XYZ, "ex", "ey", "ez", "sx", "sy", "sz")
    base = base.withColumn("_kind", F.when(F.col("_bad") | F.col("_clash") | (F.col("_m") > 1), "odd").when(gap, "gap").when(good, "plain").otherwise("odd"))
    own = ["dataset_id", "scale_no", "orientation", "point_id", "node_id", "residual", "_span", "sx", "sy", "sz"]
    plain, clean = base.filter("_kind = 'plain'").drop("_bad", "_first", "_n"), t.filter(F.col("x").isNotNull())
    if neighbours > 1:
        clean = clean.withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies")))
    clean, size = clean.select(*key, "node_id", *XYZ), size.filter(~F.col("_bad")).select(*key, "_salts", "_one", *_BOX)
    gaps = base.filter("_kind = 'gap'").withColumn("orientation", F.explode(F.sequence(F.lit(0), F.lit(47)))).withColumn("node_id", F.col("_first")).withColumn("residual", F.lit(None).cast("double"))
    maps = _mapped_in_cells(plain, clean, size, neighbours).filter(F.col("residual").isNotNull()).select(*own).unionByName(gaps.select(*own))
    pid = ["dataset_id", "point_id", "scale_no"]
    rest = [base.filter("_kind = 'odd'").select(*pid, F.sequence(F.lit(0), F.lit(47)).alias("_no"))]
    large = size.filter(~(F.col("_one") & F.col("_whole")))
    if not large.isEmpty():
        still = _mapped_in_cells(plain, clean, large, neighbours).filter(F.col("residual").isNull())
        rest.append(still.groupBy(*pid).agg(F.collect_list("orientation").alias("_no")))
    for ids in map(keep, rest):
        if not ids.isEmpty():
            asked = F.filter(orientation_array(), lambda o: F.array_contains("_no", o["no"]))
            rows = dealt(exc.join(scales, key).join(ids, pid), *key, "point_id").withColumn("o", F.explode(asked))
            maps = maps.unionByName(_turned_points(rows, fec, exc, neighbours).select(*own))
    dets = F.transform(orientation_array(), lambda o: o["det"])
    maps = maps.withColumn("det", F.get(dets, F.col("orientation")))
    tol = F.greatest(F.col("_span") * MATCH_FRACTION, F.lit(1e-12))
    cand = maps.groupBy(*key, "scale_no", "orientation").agg(
        (F.sqrt(F.avg(F.col("residual") * F.col("residual"))) / F.first("_span")).alias("rms"),
        F.avg((F.col("residual") <= tol).cast("double")).alias("matched"), F.first("det").alias("det"),
        F.first("sx").alias("sx"), F.first("sy").alias("sy"), F.first("sz").alias("sz"))
    return cand, maps


def rank_orientations(candidates: DataFrame) -> DataFrame:
    """Candidates within 1.5 x the best RMS (or its absolute window), ranked by RMS, matched share, reflection."""
    best = candidates.groupBy("dataset_id").agg(F.min("rms").alias("_best"))
    limit = F.greatest(F.col("_best") * RMS_FACTOR, F.col("_best") + RMS_WINDOW)
    kept = candidates.join(best, "dataset_id").filter(F.col("rms") <= limit).drop("_best")
    # A dataset has 48 candidates for each scale, so this window is bounded by the number of scales.
    order = Window.partitionBy("dataset_id").orderBy("rms", F.desc("matched"), F.col("det") < 0, "candidate_no")
    return kept.withColumn("rank", F.row_number().over(order))


def collapse_equivalent(candidates: DataFrame, maps: DataFrame) -> DataFrame:
    """One row per distinct registration (same point map, same scales to 9 digits) with the number left; more than one
    left is an ambiguity, which no modal quantity may resolve.

    The map of a candidate is compared by two 64-bit row hashes summed over its points, so a map is never gathered.
    """
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "point_id", "node_id").cast("decimal(38,0)"))
    sig = maps.groupBy("dataset_id", "candidate_no").agg(h(1).alias("_h1"), h(2).alias("_h2"), F.count(F.lit(1)).alias("_n"))
    c = candidates.join(sig, ["dataset_id", "candidate_no"])
    same = ["dataset_id", "_h1", "_h2", "_n", *[F.round(s, 9).alias(f"_{s}") for s in ("sx", "sy", "sz")]]
    first = c.groupBy(*same).agg(F.min_by("candidate_no", F.struct("rank", "candidate_no")).alias("candidate_no"), F.count(F.lit(1)).alias("merged"))
    n = first.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_distinct"))
    return (first.select("dataset_id", "candidate_no", "merged").join(n, "dataset_id")
            .withColumn("status", F.when(F.col("n_distinct") == 1, "UNAMBIGUOUS").otherwise("AMBIGUOUS")))


def take_confirmed(distinct: DataFrame, candidates: DataFrame, selections: DataFrame) -> DataFrame:
    """The confirmed candidate where it still exists; otherwise the ambiguity rule decides (NULL when ambiguous)."""
    valid = selections.join(candidates.select("dataset_id", F.col("candidate_no").alias("wanted")).distinct(), ["dataset_id", "wanted"], "left_semi")
    base = distinct.groupBy("dataset_id").agg(F.max("n_distinct").alias("n_distinct"), F.min("candidate_no").alias("only_one"))
    out = base.join(valid, "dataset_id", "left")
    return out.select("dataset_id", F.coalesce("wanted", F.when(F.col("n_distinct") == 1, F.col("only_one"))).alias("candidate_no"),
                      F.when(F.col("wanted").isNotNull(), "user_confirmed").when(F.col("n_distinct") == 1, "geometry")
                      .otherwise("ambiguous").alias("orientation_source"))


# ------------------------------------------------------------------------------------------------ registrations
def _r(i: int, j: int) -> Column:
    return F.get(F.get("rotation", F.lit(i)), F.lit(j))


def vectors_to_exp(df: DataFrame, cols: tuple[str, str, str], out: tuple[str, str, str]) -> DataFrame:
    """v R for three component columns; ``rotation`` is an array of rows."""
    for j in range(3):
        df = df.withColumn(out[j], sum((F.col(cols[i]) * _r(i, j) for i in (1, 2)), F.col(cols[0]) * _r(0, j)))
    return df


def points_to_exp(df: DataFrame, out: tuple[str, str, str] = ("ex", "ey", "ez")) -> DataFrame:
    """FE points in measured coordinates: (p R) * scale + translation."""
    df = vectors_to_exp(df, XYZ, ("_x", "_y", "_z"))
    for j, c in enumerate(("_x", "_y", "_z")):
        df = df.withColumn(out[j], F.col(c) * F.get("scales", F.lit(j)) + F.get("translation", F.lit(j)))
    return df.drop("_x", "_y", "_z")


def points_to_fe(df: DataFrame, out: tuple[str, str, str] = ("fx", "fy", "fz")) -> DataFrame:
    """Measured points in FE coordinates: ((p - translation) / scale) R^T."""
    for j, c in enumerate(XYZ):
        df = df.withColumn(f"_l{j}", (F.col(c) - F.get("translation", F.lit(j))) / F.get("scales", F.lit(j)))
    for i in range(3):
        df = df.withColumn(out[i], sum((F.col(f"_l{j}") * _r(i, j) for j in (1, 2)), F.col("_l0") * _r(i, 0)))
    return df.drop("_l0", "_l1", "_l2")


def determinant(rotation: str = "rotation") -> Column:
    m = lambda i, j: F.get(F.get(rotation, F.lit(i)), F.lit(j))
    return (m(0, 0) * (m(1, 1) * m(2, 2) - m(1, 2) * m(2, 1)) - m(0, 1) * (m(1, 0) * m(2, 2) - m(1, 2) * m(2, 0))
            + m(0, 2) * (m(1, 0) * m(2, 1) - m(1, 1) * m(2, 0)))


def apply_registration(registrations: DataFrame, reg_map: DataFrame, fe_nodes: DataFrame, exp_points: DataFrame) -> DataFrame:
    """Residual of each frozen point -> node pair in measured coordinates; ``problem`` names a missing side."""
    m = reg_map.join(exp_points.select("dataset_id", "point_id", *[F.col(c).alias(f"p{c}") for c in XYZ]), ["dataset_id", "point_id"], "full_outer")
    m = m.join(fe_nodes.select("dataset_id", "node_id", *XYZ), ["dataset_id", "node_id"], "left").join(registrations, "dataset_id", "left")
    m = points_to_exp(m)
    d = F.sqrt(F.pow(F.col("ex") - F.col("px"), 2) + F.pow(F.col("ey") - F.col("py"), 2) + F.pow(F.col("ez") - F.col("pz"), 2))
    problem = (F.when(F.col("node_id").isNull(), "point not in the registration").when(F.col("px").isNull(), "frozen point not measured")
               .when(F.col("x").isNull(), "FE node absent"))
    return m.withColumn("residual", d).withColumn("problem", problem)


def registration_quality(applied: DataFrame, exp_points: DataFrame) -> DataFrame:
    """Normalized RMS, matched share, largest residual, unique and duplicated nodes; refused with any problem row."""
    span = extents(exp_points, ["dataset_id"]).select("dataset_id", F.col("span").alias("_span"))
    a = applied.join(span, "dataset_id")
    tol = F.greatest(F.col("_span") * MATCH_FRACTION, F.lit(1e-12))
    g = a.groupBy("dataset_id").agg(
        (F.sqrt(F.avg(F.col("residual") * F.col("residual"))) / F.max("_span")).alias("rms"),
        F.avg((F.col("residual") <= tol).cast("double")).alias("matched"), F.max("residual").alias("max_residual"),
        F.count("node_id").alias("n_points"), F.countDistinct("node_id").alias("n_unique"), F.count("problem").alias("n_problems"))
    return g.withColumn("n_duplicates", F.col("n_points") - F.col("n_unique")).withColumn(
        "status", F.when(F.col("n_problems") > 0, "REFUSED").otherwise("APPLIED"))


def registration_equivalence(live: DataFrame, frozen: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Whether two maps send every frozen point to the same node and share the rotation.

    ``live`` / ``frozen``: dataset_id, point_id, node_id, rotation."""
    f = frozen.select("dataset_id", "point_id", F.col("node_id").alias("_node"), F.col("rotation").alias("_rot"))
    j = f.join(live, ["dataset_id", "point_id"], "full_outer")
    same_rot = F.coalesce(F.forall(F.zip_with(F.flatten("rotation"), F.flatten("_rot"), lambda a, b: F.abs(a - b) <= tolerance), lambda v: v), F.lit(False))
    g = j.groupBy("dataset_id").agg(
        F.count("_node").alias("n_frozen"), F.count("node_id").alias("n_live"),
        F.sum(F.coalesce(F.col("node_id") == F.col("_node"), F.lit(False)).cast("int")).alias("n_same"), F.bool_and(same_rot).alias("same_rotation"))
    return g.withColumn("equivalent", (F.col("n_frozen") == F.col("n_same")) & (F.col("n_live") == F.col("n_frozen")) & F.col("same_rotation"))


def surface_nodes(nodes: DataFrame, side: str = "max", tolerance: float = 1e-6) -> DataFrame:
    """Nodes of each instance within ``tolerance`` of its extreme z (an aggregate joined back, so no window per instance)."""
    level = nodes.groupBy("dataset_id", "instance").agg((F.max("z") if side == "max" else F.min("z")).alias("_level"))
    return nodes.join(level, ["dataset_id", "instance"]).filter(F.abs(F.col("z") - F.col("_level")) <= tolerance).drop("_level")


def mapping_subset(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Explicit mapping-node list per dataset: counts, duplicates, unknown ids and the verdict."""
    w = wanted.groupBy("dataset_id", "node_id").agg(F.count(F.lit(1)).alias("_k"))
    known = nodes.select("dataset_id", "node_id").distinct().withColumn("_known", F.lit(1))
    j = w.join(known, ["dataset_id", "node_id"], "left").groupBy("dataset_id").agg(
        F.sum("_k").alias("n_requested"), F.sum((F.col("_k") > 1).cast("int")).alias("n_duplicates"),
        F.sum(F.col("_known").isNull().cast("int")).alias("n_unknown"))
    verdict = (F.when(F.col("n_duplicates") > 0, "duplicate node ids").when(F.col("n_requested") < 3, "fewer than three nodes")
               .when(F.col("n_unknown") > 0, "unknown node ids").otherwise("ok"))
    return j.withColumn("verdict", verdict)


def calibrated_translation(registrations: DataFrame, surface: DataFrame, exp: DataFrame, corners: DataFrame | None = None,
                           offsets: DataFrame | None = None) -> DataFrame:
    """Translation from a known corner (its x-axis marker must point within 45 degrees of FE +X) or from panel-edge offsets.

    ``corners``: dataset_id, corner_point, marker_point, fe_x, fe_y; ``offsets``: dataset_id, off_x, off_y."""
    key = "dataset_id"
    box = surface.groupBy(key).agg(F.min("x").alias("_sx"), F.min("y").alias("_sy"), F.avg("z").alias("_sz"))
    zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    if corners is not None:
        a = exp.select(key, F.col("point_id").alias("corner_point"), *[F.col(c).alias(f"a{c}") for c in XYZ])
        b = exp.select(key, F.col("point_id").alias("marker_point"), *[F.col(c).alias(f"b{c}") for c in XYZ])
        d = corners.join(a, [key, "corner_point"], "left").join(b, [key, "marker_point"], "left").join(box, key).join(registrations.drop("translation"), key)
        d = points_to_exp(d.withColumn("x", F.col("fe_x")).withColumn("y", F.col("fe_y")).withColumn("z", F.col("_sz")).withColumn("translation", zero), ("_cx", "_cy", "_cz"))
        move = F.array(*[F.col(f"a{c}") - F.col(f"_c{c}") for c in XYZ])
        for c in XYZ:
            d = d.withColumn(c, F.col(f"b{c}") - F.col(f"a{c}"))
        d = points_to_fe(d, ("_dx", "_dy", "_dz")).withColumn("angle", F.degrees(F.atan2("_dy", "_dx")))
        status = F.when(F.col("ax").isNull() | F.col("bx").isNull(), "corner not on the grid").when(
            F.abs("angle") >= 45, "marker contradicts the documented axes").otherwise("ok")
        return d.withColumn("translation", move).select(key, "rotation", "scales", "translation", "angle", status.alias("status"))
    local = points_to_fe(exp.join(registrations.drop("translation"), key).withColumn("translation", zero))
    g = local.groupBy(key).agg(F.min("fx").alias("_fx"), F.min("fy").alias("_fy"), F.avg("fz").alias("_fz"))
    d = g.join(box, key).join(offsets, key).join(registrations.drop("translation"), key)
    d = d.withColumn("x", F.col("_sx") + F.col("off_x") - F.col("_fx")).withColumn("y", F.col("_sy") + F.col("off_y") - F.col("_fy")).withColumn(
        "z", F.col("_sz") - F.col("_fz")).withColumn("translation", zero)
    d = points_to_exp(d, ("_mx", "_my", "_mz"))
    return d.withColumn("translation", F.array(-F.col("_mx"), -F.col("_my"), -F.col("_mz"))).select(
        key, "rotation", "scales", "translation", F.lit(None).cast("double").alias("angle"), F.lit("ok").alias("status"))


def map_to_surface(registrations: DataFrame, surface: DataFrame, exp: DataFrame) -> DataFrame:
    """Nearest surface node of every measured point under a fixed registration, with the raw-metric residual."""
    q = points_to_fe(exp.join(registrations, "dataset_id")).select("dataset_id", "point_id", F.col("fx").alias("x"), F.col("fy").alias("y"), F.col("fz").alias("z"))
    near = nearest_points(q, surface, ["dataset_id"], ["point_id"], "node_id", 8)
    full = near.join(surface.select("dataset_id", "node_id", *XYZ), ["dataset_id", "node_id"]).join(registrations, "dataset_id")
    full = points_to_exp(full).join(exp.select("dataset_id", "point_id", *[F.col(c).alias(f"p{c}") for c in XYZ]), ["dataset_id", "point_id"])
    d = F.sqrt(F.pow(F.col("ex") - F.col("px"), 2) + F.pow(F.col("ey") - F.col("py"), 2) + F.pow(F.col("ez") - F.col("pz"), 2))
    return full.groupBy("dataset_id", "point_id").agg(F.min(F.struct(d.alias("residual"), F.col("nearness"), F.col("node_id"))).alias("b")).select(
        "dataset_id", "point_id", "b.node_id", "b.residual")


def perturb_points(points: DataFrame, keys: list[str], perturbations: list[tuple[str, float, float, float, float]]) -> DataFrame:
    """Every point under each named (dx, dy, scale, degrees) perturbation about the grid centroid, in the FE frame."""
    c = points.groupBy(*keys).agg(*[F.avg(a).alias(f"_m{a}") for a in XYZ])
    sets = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(dx)).alias("dx"), F.lit(float(dy)).alias("dy"), F.lit(float(s)).alias("s"),
                              F.lit(math.cos(math.radians(r))).alias("c"), F.lit(math.sin(math.radians(r))).alias("sn")) for n, dx, dy, s, r in perturbations])
    d = points.join(c, keys).withColumn("p", F.explode(sets))
    lx, ly, lz = (F.col(a) - F.col(f"_m{a}") for a in XYZ)
    k = 1 + F.col("p.s")
    return (d.withColumn("perturbation", F.col("p.name"))
            .withColumn("_x", (lx * F.col("p.c") - ly * F.col("p.sn")) / k + F.col("_mx") + F.col("p.dx"))
            .withColumn("_y", (lx * F.col("p.sn") + ly * F.col("p.c")) / k + F.col("_my") + F.col("p.dy"))
            .withColumn("_z", lz / k + F.col("_mz")).drop(*XYZ, "p", "_mx", "_my", "_mz")
            .withColumnsRenamed({"_x": "x", "_y": "y", "_z": "z"}))


# ------------------------------------------------------------------------------------------------ quads
def _named(values: dict[str, Column], then) -> Column:
    """``then(struct)`` with every value computed once; columns of columns would be written out in each other by the optimizer."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), then), F.lit(0))


def _quad_inverse() -> Column:
    """(xi, eta) of (px, py) in the element with corners (x1, y1) .. (x4, y4), in closed form.

    Eliminating eta leaves a quadratic in xi; the wanted root is the one on which the map keeps the orientation it has at the
    centre, written without cancellation. NULL where there is no real root or the centre's Jacobian is zero."""
    mix = ((1, 1, 1, 1), (-1, 1, 1, -1), (-1, -1, 1, 1), (1, -1, 1, -1))
    terms = {f"{out}{k}": 0.25 * sum((F.col(f"{c}{i + 1}") * w for i, w in enumerate(ws)), F.lit(0.0))
             for out, c in (("a", "x"), ("b", "y")) for k, ws in enumerate(mix)}

    def eta(m, z):
        p, q = m["a2"] + m["a3"] * z["xi"], m["b2"] + m["b3"] * z["xi"]
        return F.struct(z["xi"].alias("xi"), F.when(F.abs(p) >= F.abs(q), F.try_divide(z["x"] - m["a1"] * z["xi"], p)).otherwise(
            F.try_divide(z["y"] - m["b1"] * z["xi"], q)).alias("eta"))

    def root(m, k):
        # a point on the fold of the map may fall below zero by rounding
        r = -F.signum(k["j"]) * F.when(k["d"] >= 0, F.sqrt(k["d"])).when(k["d"] >= -1e-12 * k["B"] * k["B"], 0.0)
        return _named({"r": r}, lambda n: _named({"x": k["x"], "y": k["y"], "xi": F.when(k["j"] != 0, F.when(
            k["B"] * n["r"] >= 0, F.try_divide(-2 * k["C"], k["B"] + n["r"])).otherwise(F.try_divide(n["r"] - k["B"], 2 * k["A"])))}, lambda z: eta(m, z)))

    def quadratic(m):
        j, x, y = m["a1"] * m["b2"] - m["a2"] * m["b1"], F.col("px") - m["a0"], F.col("py") - m["b0"]
        return _named({"x": x, "y": y, "j": j}, lambda o: _named({
            "x": o["x"], "y": o["y"], "j": o["j"], "A": m["a3"] * m["b1"] - m["a1"] * m["b3"],
            "B": o["x"] * m["b3"] - o["y"] * m["a3"] - o["j"], "C": o["x"] * m["b2"] - o["y"] * m["a2"]}, lambda q: _named({
                **{n: q[n] for n in "xyjABC"}, "d": q["B"] * q["B"] - 4 * q["A"] * q["C"]}, lambda k: root(m, k))))

    return _named(terms, quadratic)


def sample_quads(points: DataFrame, quads: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """Bilinear value at each point from the first four-node element that holds it; points outside are marked.

    ``quads``: dataset_id, element_id, n1..n4; ``nodes``: dataset_id, node_id, x, y, value column. Every element lies in the
    grid of its own size (cells of the next power of two, so it touches four at most) and a point asks each size that its
    dataset has: one large element costs one more candidate a point, not coarser cells for all. Elements with a missing node,
    a NULL coordinate or no extent hold nothing; points with a NULL coordinate are refused."""
    q = quads
    for i in (1, 2, 3, 4):
        q = q.join(nodes.select("dataset_id", F.col("node_id").alias(f"n{i}"), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"),
                                F.col(value).alias(f"v{i}")), ["dataset_id", f"n{i}"])
    corner = lambda c: [f"{c}{i}" for i in (1, 2, 3, 4)]
    for c in [*corner("x"), *corner("y")]:
        q = q.filter(F.col(c).isNotNull() & ~F.isnan(c))
    q = q.withColumns({f"_{c}{n}": f(*corner(c)) for c in "xy" for n, f in (("lo", F.least), ("hi", F.greatest))})
    q = q.withColumn("_e", F.greatest(F.col("_xhi") - F.col("_xlo"), F.col("_yhi") - F.col("_ylo"))).filter("_e > 0")
    q = q.withColumn("_tol", F.col("_e") * 1e-9).withColumn("_lev", F.ceil(F.log2(F.col("_e") * (1 + 4e-9))).cast("int"))
    cell = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("_lev")))
    span = lambda c: F.sequence(cell(F.col(f"_{c}lo") - F.col("_tol")), cell(F.col(f"_{c}hi") + F.col("_tol")))
    q = q.withColumn("_cx", F.explode(span("x"))).withColumn("_cy", F.explode(span("y")))
    sizes = q.groupBy("dataset_id").agg(F.collect_set("_lev").alias("_levs"))
    p = points.select("dataset_id", "point_id", F.col("x").alias("px"), F.col("y").alias("py")).filter(
        F.col("px").isNotNull() & F.col("py").isNotNull()).join(sizes, "dataset_id").withColumn("_lev", F.explode("_levs")).drop("_levs")
    p = p.withColumn("_cx", cell(F.col("px"))).withColumn("_cy", cell(F.col("py")))
    c = p.join(q, ["dataset_id", "_lev", "_cx", "_cy"])
    for a in "xy":
        c = c.filter(F.col(f"p{a}").between(F.col(f"_{a}lo") - F.col("_tol"), F.col(f"_{a}hi") + F.col("_tol")))
    # a generator keeps the filter from repeating the inverse
    c = c.withColumn("_s", F.explode(F.array(_quad_inverse())))
    xi, eta = F.col("_s.xi"), F.col("_s.eta")
    inside = (F.abs(xi) <= 1 + 1e-9) & (F.abs(eta) <= 1 + 1e-9)
    val = 0.25 * ((1 - xi) * (1 - eta) * F.col("v1") + (1 + xi) * (1 - eta) * F.col("v2") + (1 + xi) * (1 + eta) * F.col("v3") + (1 - xi) * (1 + eta) * F.col("v4"))
    hit = c.filter(inside).groupBy("dataset_id", "point_id").agg(F.min(F.struct("element_id", val.alias("value"))).alias("b"))
    return points.select("dataset_id", "point_id").join(hit, ["dataset_id", "point_id"], "left").select(
        "dataset_id", "point_id", "b.element_id", "b.value", F.col("b").isNull().alias("refused"))


# ------------------------------------------------------------------------------------------------ symmetry, grids
def normalised_plane(points: DataFrame, keys: list[str], mirror_tolerance: float = 0.02, near_square: float = 0.05) -> DataFrame:
    """In-plane coordinates scaled to [-1, 1] per key, with the mirror tolerance and whether the plan is near square."""
    g = points.groupBy(*keys).agg(*[f(c).alias(f"_{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    hx, hy = (F.col("_hix") - F.col("_lox")) / 2, (F.col("_hiy") - F.col("_loy")) / 2
    d = points.join(g, keys)
    small, big = F.least(hx, hy), F.greatest(hx, hy)
    return (d.filter((hx > 0) & (hy > 0)).withColumn("u", (F.col("x") - (F.col("_lox") + F.col("_hix")) / 2) / hx)
            .withColumn("v", (F.col("y") - (F.col("_loy") + F.col("_hiy")) / 2) / hy)
            .withColumn("tolerance", F.lit(mirror_tolerance * 2.0) * small / big).withColumn("near_square", F.abs(hx - hy) / big <= near_square)
            .drop("_lox", "_hix", "_loy", "_hiy"))


def mirror_nodes(plane: DataFrame, keys: list[str]) -> DataFrame:
    """Mirror partner of each node under the four reflections (self-join through cells of the tolerance)."""
    flips = F.array(*[F.struct(F.lit(n).alias("name"), F.col(a).alias("x"), F.col(b).alias("y")) for n, a, b in (
        ("x", "_nu", "v"), ("y", "u", "_nv"), ("diagonal", "v", "u"), ("antidiagonal", "_nv", "_nu"))])
    q = plane.withColumn("_nu", -F.col("u")).withColumn("_nv", -F.col("v")).withColumn("f", F.explode(flips)).select(
        *keys, "node_id", F.col("f.name").alias("reflection"), F.col("f.x").alias("x"), F.col("f.y").alias("y"), F.col("tolerance").alias("radius"))
    t = plane.select(*keys, F.col("node_id").alias("mirror_id"), F.col("u").alias("x"), F.col("v").alias("y"))
    hit = within_radius(q, t, keys, ["reflection", "node_id"], "mirror_id")
    return q.select(*keys, "reflection", "node_id").join(hit, [*keys, "reflection", "node_id"], "left")


def mirror_coverage(mirrors: DataFrame, keys: list[str]) -> DataFrame:
    return mirrors.groupBy(*keys, "reflection").agg(F.avg(F.col("mirror_id").isNotNull().cast("double")).alias("coverage"))


def parity_classes(plane: DataFrame, keys: list[str], minimum_coverage: float = 0.95, threshold: float = 0.80) -> DataFrame:
    """Parity score per reflection and its class; refused below the coverage gate; diagonals only when near square."""
    m = mirror_nodes(plane, keys).join(plane.select(*keys, "node_id", "w", "near_square"), [*keys, "node_id"])
    other = plane.select(*keys, F.col("node_id").alias("mirror_id"), F.col("w").alias("_w2"))
    m = m.join(other, [*keys, "mirror_id"], "left")
    hit = F.col("mirror_id").isNotNull()
    g = m.groupBy(*keys, "reflection").agg(
        F.avg(hit.cast("double")).alias("coverage"), F.sum(F.when(hit, F.col("w") * F.col("_w2"))).alias("_num"),
        F.sum(F.when(hit, F.col("w") * F.col("w"))).alias("_den"), F.bool_or("near_square").alias("_sq"))
    ok = (F.col("coverage") >= minimum_coverage) & (F.col("_den") > 0) & (F.col("_sq") | F.col("reflection").isin("x", "y"))
    g = g.withColumn("parity", F.when(ok, F.col("_num") / F.when(F.col("_den") > 0, F.col("_den"))))
    cls = F.when(F.col("parity") >= threshold, "E").when(F.col("parity") <= -threshold, "O").when(F.col("parity").isNotNull(), "M")
    return g.withColumn("parity_class", cls).drop("_num", "_den", "_sq")


def classify_shapes(points: DataFrame, keys: list[str], policy: ShapeFamilyPolicy = ShapeFamilyPolicy()) -> DataFrame:
    """Parity classes of every surface shape under the policy; each row carries the policy's hash.

    ``points``: keys, node_id, x, y, w. Shapes without extent along x or y give no rows."""
    plane = normalised_plane(points, keys, policy.mirror_tolerance, policy.near_square_tolerance)
    return stamp(parity_classes(plane, keys, policy.minimum_mirror_coverage, policy.parity_threshold), policy)


def shape_families(points: DataFrame, keys: list[str], policy: ShapeFamilyPolicy = ShapeFamilyPolicy()) -> DataFrame:
    """``keys, parity_x, parity_y, nodal_x, nodal_y, family, torsion, policy_hash``: the family of every classified shape.

    A family is named by its parities and nodal-line counts, never by a mode number; a shape whose parity along x or y was
    refused has a NULL family. ``torsion`` marks shapes that are odd along both."""
    own = [*keys, "policy_hash"]
    pick = lambda r: F.max(F.when(F.col("reflection") == r, F.col("parity_class"))).alias(f"parity_{r}")
    c = classify_shapes(points, keys, policy).groupBy(*own).agg(pick("x"), pick("y"))
    plane = normalised_plane(points, keys, policy.mirror_tolerance, policy.near_square_tolerance)
    c = c.join(nodal_lines(plane, keys, policy.nodal_grid_points, policy.nodal_amplitude_floor), keys)
    name = F.concat(F.lit("Px:"), "parity_x", F.lit("|Py:"), "parity_y", F.lit("|nx:"), F.col("nodal_x").cast("string"), F.lit("|ny:"), F.col("nodal_y").cast("string"))
    return c.withColumn("family", name).withColumn("torsion", F.coalesce((F.col("parity_x") == "O") & (F.col("parity_y") == "O"), F.lit(False)))


def _nearest_of(u: np.ndarray, v: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """The row nearest to each point of the grid axis x axis, of equally near ones the first."""
    n, step = len(axis), max(1, 2**20 // len(axis) ** 2)
    best, at = np.full((n, n), np.inf), np.zeros((n, n), np.int64)
    for low in range(0, len(u), step):
        d2 = ((axis[:, None] - u[low:low + step]) ** 2)[:, None, :] + ((axis[:, None] - v[low:low + step]) ** 2)[None, :, :]
        i = np.where(np.isnan(d2), np.inf, d2).argmin(2) if np.isnan(d2.sum()) else d2.argmin(2)
        d = np.take_along_axis(d2, i[:, :, None], 2)[:, :, 0]
        at, best = np.where(d < best, i + low, at), np.fmin(d, best)
    return at


def _grid_nodes(batches, groups: list[str], axis: np.ndarray):
    """The rows of each run of ``groups`` as a table; of a run longer than ``GRID_ROWS`` those nearest to some grid point, so it is never held whole."""
    def cut(held):
        rows = pa.Table.from_batches(held).combine_chunks()
        return rows.take(np.unique(_nearest_of(rows["u"].to_numpy(), rows["v"].to_numpy(), axis))).to_batches()

    held: list[pa.RecordBatch] = []
    for new, part in _runs(batches, groups):
        if new and held:
            yield pa.Table.from_batches(held)
            held = []
        held.append(part)
        if sum(x.num_rows for x in held) > max(GRID_ROWS, 2 * len(axis) ** 2):
            held = cut(held)
    if held:
        yield pa.Table.from_batches(held)


def _sign_changes(low: np.ndarray, high: np.ndarray, inner: np.ndarray, named: np.ndarray) -> int | None:
    """The median of the sign changes along the rows of a grid, leaving out its first and last row and points without a sign (NaN)."""
    keep_ = np.arange(1, len(low) - 1)[named[1:-1].any(1)]
    low, high, inner = low[keep_], high[keep_], inner[keep_]
    signed = ~np.isnan(low)
    before = np.maximum.accumulate(np.where(signed, np.arange(low.shape[1]), -1), axis=1)[:, :-1]
    other = (before >= 0) & signed[:, 1:] & (np.take_along_axis(high, np.maximum(before, 0), 1) != low[:, 1:])
    return math.floor(np.median(other.sum(1) + np.where(signed, inner, 0).sum(1))) if len(keep_) else None


def nodal_lines(plane: DataFrame, keys: list[str], n: int = 41, floor: float = 0.05) -> DataFrame:
    """Nodal-line counts along x and y: nearest-node resampling on an n x n grid, sign changes per inner row / column.

    Grid points are not rows: a kernel holds the grid of one key and passes over the key's nodes, which come sorted by their
    id. Keys with many nodes are first cut, in parts, to the nodes that are nearest to some grid point. A node id that repeats
    is nearest at any of its places and has all of its signs; a NULL id leaves its grid points out."""
    axis = np.arange(n) * (2.0 / (n - 1)) - 1.0
    for k in keys:
        plane = plane.filter(F.col(k).isNotNull())
    top = plane.groupBy(*keys).agg((F.max(F.abs("w")) * floor).alias("_floor"), F.ceil(F.count(F.lit(1)) / GRID_PART).alias("_parts"))
    sign = F.when(F.abs("w") > F.col("_floor"), F.signum("w"))
    code = F.when(F.isnan(sign), 2.0).otherwise(sign)
    place = F.when(F.col("u").isNotNull() & F.col("v").isNotNull(), F.struct(F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v")))
    t = plane.join(top, keys).groupBy(*keys, "_parts", "node_id").agg(F.collect_set(place).alias("_at"), F.collect_set(code).alias("_s"))
    named = F.col("node_id").isNotNull()
    t = t.select(*keys, F.pmod(F.xxhash64("node_id"), "_parts").alias("_part"), "node_id", F.explode("_at").alias("_p"), named.alias("_named"),
                 F.when(named, F.array_min("_s")).alias("_lo"), F.when(named, F.array_max("_s")).alias("_hi"), (F.size("_s") - 1.0).alias("_inner"))
    t = t.select(*keys, "_part", "node_id", "_p.u", "_p.v", "_named", "_lo", "_hi", "_inner")
    parts, whole = [*keys, "_part"], T.StructType([*[plane.schema[k] for k in keys], T.StructField("nodal_x", T.LongType()), T.StructField("nodal_y", T.LongType())])

    def cut(batches):
        out, rows = [], 0
        for part in _grid_nodes(batches, parts, axis):
            out, rows = [*out, part], rows + part.num_rows
            if rows > 8192:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
                out, rows = [], 0
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    def count(batches):
        for rows in _grid_nodes(batches, keys, axis):
            rows = rows.combine_chunks()
            column = lambda c: rows[c].to_numpy()
            at = _nearest_of(column("u"), column("v"), axis)
            grids = [column(c).astype(float)[at] for c in ("_lo", "_hi", "_inner")] + [column("_named")[at]]
            # the grid is (x, y), so its transpose has a line of constant y in a row, along x
            x, y = _sign_changes(*[g.T for g in grids]), _sign_changes(*grids)
            if x is not None and y is not None:
                yield pa.RecordBatch.from_arrays([*[rows[k].combine_chunks()[:1] for k in keys], pa.array([x], pa.int64()), pa.array([y], pa.int64())], names=whole.names)

    t = t.repartition(*parts).sortWithinPartitions(*parts, "node_id").mapInArrow(cut, t.schema)
    return t.repartition(*keys).sortWithinPartitions(*keys, "node_id").mapInArrow(count, whole)


def grid_pitch(points: DataFrame, keys: list[str], pid: str) -> DataFrame:
    """Median nearest-neighbour distance and direction (mod 90 degrees) of a planar scan grid."""
    flat = points.select(*keys, pid, "x", "y", F.lit(0.0).alias("z"))
    near = nearest_points(flat, flat.withColumnRenamed(pid, "_other"), keys, [pid], "_other", 2).filter(F.col(pid) != F.col("_other"))
    near = top_rows(near, [*keys, pid], ["distance", "_other"])
    j = near.join(flat, [*keys, pid]).join(flat.select(*keys, F.col(pid).alias("_other"), F.col("x").alias("_x"), F.col("y").alias("_y")), [*keys, "_other"])
    deg = F.degrees(F.atan2(F.col("_y") - F.col("y"), F.col("_x") - F.col("x")))
    return j.withColumn("_a", F.pmod(deg, F.lit(90.0))).groupBy(*keys).agg(
        F.percentile("distance", F.lit(0.5)).alias("pitch"), F.percentile("_a", F.lit(0.5)).alias("angle_deg"))


def grid_cells(points: DataFrame, keys: list[str], pid: str) -> DataFrame:
    """Integer cell (i, j) of each point along its grid's own axes, centred on the grid, plus a regularity flag."""
    pitch = grid_pitch(points, keys, pid)
    mean = points.groupBy(*keys).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    d = points.join(pitch, keys).join(mean, keys)
    c, s = F.cos(F.radians("angle_deg")), F.sin(F.radians("angle_deg"))
    dx, dy = F.col("x") - F.col("_mx"), F.col("y") - F.col("_my")
    d = keep(d.select(*keys, pid, "pitch", (dx * c + dy * s).alias("_u"), (dy * c - dx * s).alias("_v")))
    low = d.groupBy(*keys).agg(F.min("_u").alias("_u0"), F.min("_v").alias("_v0"))
    d = d.join(low, keys).withColumn("i", F.rint((F.col("_u") - F.col("_u0")) / F.col("pitch"))).withColumn("j", F.rint((F.col("_v") - F.col("_v0")) / F.col("pitch")))
    box = d.groupBy(*keys).agg(F.max("i").alias("_i9"), F.max("j").alias("_j9"), F.count(F.lit(1)).alias("_n"), F.countDistinct("i", "j").alias("_cells"))
    return d.join(box, keys).select(*keys, pid, (F.col("i") - F.col("_i9") / 2).alias("ci"), (F.col("j") - F.col("_j9") / 2).alias("cj"),
                                    (F.col("_n") == F.col("_cells")).alias("regular"))


def grid_symmetry(reference: DataFrame, current: DataFrame, keys: list[str], pid: str) -> DataFrame:
    """Which of the eight square symmetries maps one id layout onto the other for all ids."""
    r = grid_cells(reference, keys, pid)
    c = grid_cells(current, keys, pid).select(*keys, pid, F.col("ci").alias("di"), F.col("cj").alias("dj"), F.col("regular").alias("regular2"))
    both = keep(r.join(c, [*keys, pid], "full_outer"))
    sets = both.groupBy(*keys).agg(F.sum((F.col("ci").isNull() | F.col("di").isNull()).cast("int")).alias("n_unmatched"), F.count(F.lit(1)).alias("n_points"),
                                   F.coalesce(F.bool_and(F.col("regular") & F.col("regular2")), F.lit(False)).alias("regular"))
    table = F.array(*[F.struct(F.lit(n).alias("name"), *[F.lit(m[i][j]).alias(f"m{i}{j}") for i in (0, 1) for j in (0, 1)]) for n, m in SQUARE_SYMMETRIES.items()])
    t = both.withColumn("m", F.explode(table))
    hit = (F.abs(F.col("ci") * F.col("m.m00") + F.col("cj") * F.col("m.m01") - F.col("di")) <= 1e-5) & (
        F.abs(F.col("ci") * F.col("m.m10") + F.col("cj") * F.col("m.m11") - F.col("dj")) <= 1e-5)
    per = t.groupBy(*keys, "m").agg(F.sum(F.coalesce(hit, F.lit(False)).cast("int")).alias("k")).join(sets, keys)
    full = F.col("k") == F.col("n_points")
    g = per.groupBy(*keys).agg(F.max("k").alias("ids_preserved"), F.sum(full.cast("int")).alias("_full"), F.max(F.when(full, F.col("m.name"))).alias("symmetry"),
                               F.max(F.when(full, F.col("m.m00") * F.col("m.m11") - F.col("m.m01") * F.col("m.m10"))).alias("_det"),
                               F.max("n_points").alias("n_points"), F.max("n_unmatched").alias("n_unmatched"), F.bool_and("regular").alias("regular"))
    one = (F.col("_full") == 1) & (F.col("n_unmatched") == 0) & F.col("regular")
    return (g.withColumn("symmetry", F.when(one, F.col("symmetry"))).withColumn("proper", F.when(one, F.col("_det") > 0))
            .withColumn("status", F.when(one & (F.col("_det") > 0), "MAPPING_DERIVED").otherwise("MAPPING_REFUSED")).drop("_full", "_det"))


def evidence_map(points: DataFrame, placements: DataFrame) -> DataFrame:
    """Scan points to FE plane coordinates from recorded evidence: grid axes, window offsets and signed axes.

    ``placements``: dataset_id, centre_x/y, u_x/y, v_x/y, mm_per_unit, su_min, sv_min, off_u, off_v, plan_x/y, scan_to_phi
    (rows), phi_to_fe (rows), origin (array)."""
    d = points.join(placements, "dataset_id")
    dx, dy = F.col("x") - F.col("centre_x"), F.col("y") - F.col("centre_y")
    su = (dx * F.col("u_x") + dy * F.col("u_y")) * F.col("mm_per_unit") - F.col("su_min") + F.col("off_u")
    sv = (dx * F.col("v_x") + dy * F.col("v_y")) * F.col("mm_per_unit") - F.col("sv_min") + F.col("off_v")
    m = lambda name, i, j: F.get(F.get(name, F.lit(i)), F.lit(j))
    plan = (F.col("plan_x"), F.col("plan_y"))
    phi = []
    for axis in range(3):
        start = F.lit(0.0)
        if axis < 2:
            # the edge a direction starts from lies at 0 for a positive axis and at the plan size for a negative one
            for col in (0, 1):
                along = F.abs(m("scan_to_phi", 0, col)) > 0.5
                mine = along if axis == 0 else ~along
                start = F.when(mine, F.when(m("scan_to_phi", axis, col) > 0, 0.0).otherwise(plan[axis])).otherwise(start)
        phi.append(start + su * m("scan_to_phi", axis, 0) + sv * m("scan_to_phi", axis, 1) - F.get("origin", F.lit(axis)))
    for i, name in enumerate(("fe_x", "fe_y")):
        d = d.withColumn(name, phi[0] * m("phi_to_fe", i, 0) + phi[1] * m("phi_to_fe", i, 1) + phi[2] * m("phi_to_fe", i, 2))
    return d

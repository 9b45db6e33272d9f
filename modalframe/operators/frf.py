"""Frequency-response operators: channels, indicators, peaks, close-mode bands.

Channels are reduced to one indicator value per (dataset, reference, line) first. What stays ordered afterwards is one
measured frequency axis, whose length is fixed by the acquisition and does not grow with channels or rows.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modalframe.functions.cplx import abs2, clip
from modalframe.functions.reasons import reason_array
from modalframe.operators import axis
from modalframe.operators.ordered import islands, log_bin, top_rows, with_order
from modalframe.session import cut_lineage, keep

AXIS = ["dataset_id", "ref_node", "ref_dir"]
EIGENPAIRS = T.ArrayType(T.StructType([T.StructField("sigma", T.DoubleType()), T.StructField("vr", T.ArrayType(T.DoubleType())),
                                       T.StructField("vi", T.ArrayType(T.DoubleType()))]))
CHANNEL = ["dataset_id", "rsp_node", "rsp_dir", "ref_node", "ref_dir"]


# ---------------------------------------------------------------------------------------------------- channels
def channels(lines: DataFrame) -> DataFrame:
    """Fold lines to one row per channel with x / re / im arrays in line order."""
    item = F.struct("line", "f_hz", "re", "im")
    packed = lines.groupBy(*CHANNEL).agg(F.sort_array(F.collect_list(item)).alias("p"))
    return packed.select(*CHANNEL, F.col("p.f_hz").alias("x"), F.col("p.re").alias("re"), F.col("p.im").alias("im"))


def explode_channels(chans: DataFrame) -> DataFrame:
    """The inverse of ``channels``: one row per line (line = position on the axis)."""
    z = chans.select(*CHANNEL, F.posexplode(F.arrays_zip("x", "re", "im")).alias("line", "v"))
    return z.select(*CHANNEL, "line", F.col("v.x").alias("f_hz"), F.col("v.re").alias("re"), F.col("v.im").alias("im"))


def median_of(array: Column) -> Column:
    s = F.array_sort(array)
    n = F.size(array)
    mid = F.floor(n / 2).cast("int")
    return F.when(n == 0, None).when(n % 2 == 1, F.get(s, mid)).otherwise((F.get(s, mid - 1) + F.get(s, mid)) / 2)


def axis_signature(chans: DataFrame) -> DataFrame:
    """Line count, start, end and median step of each channel axis; NULL below three lines or with non-finite values."""
    x = F.col("x")
    steps = F.zip_with(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))),
                       lambda a, b: a - b)
    ok = (F.size(x) >= 3) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (chans.withColumn("n_lines", F.when(ok, F.size(x))).withColumn("x_first", F.when(ok, F.round(F.get(x, F.lit(0)), 10)))
            .withColumn("x_last", F.when(ok, F.round(F.get(x, F.size(x) - 1), 10)))
            .withColumn("x_step", F.when(ok, F.round(median_of(steps), 10))))


def quantity_priority(label: Column) -> Column:
    """Displacement over velocity over acceleration over anything else, by the channel label."""
    low = F.lower(label)
    return (F.when(low.contains("displacement"), 3).when(low.contains("velocity"), 2)
            .when(low.contains("acceleration") | low.contains("accelerance"), 1).otherwise(0))


SIGNATURE = ["n_lines", "x_first", "x_last", "x_step"]


def winning_group(chans: DataFrame) -> DataFrame:
    """Per dataset the FRF group (axis, reference, quantity, id2) with the best quantity, most DOFs, most channels."""
    c = axis_signature(chans).filter(F.col("n_lines").isNotNull()).withColumn("priority", quantity_priority(F.col("label")))
    g = c.groupBy("dataset_id", *SIGNATURE, "ref_node", "ref_dir", "priority", "label").agg(
        F.countDistinct("rsp_node", "rsp_dir").alias("n_dofs"), F.count(F.lit(1)).alias("n_channels"))
    return top_rows(g, ["dataset_id"], [F.desc("priority"), F.desc("n_dofs"), F.desc("n_channels"), "ref_node", "ref_dir", "label",
                                        *SIGNATURE])


def winning_multi_reference_group(chans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The (axis, quantity) group with the most references per dataset, and the references it leaves out with a reason."""
    c = axis_signature(chans).filter(F.col("n_lines").isNotNull()).withColumn("priority", quantity_priority(F.col("label")))
    per_ref = c.groupBy("dataset_id", *SIGNATURE, "priority", "ref_node", "ref_dir").agg(
        F.countDistinct("rsp_node", "rsp_dir").alias("n"))
    g = per_ref.groupBy("dataset_id", *SIGNATURE, "priority").agg(F.count(F.lit(1)).alias("n_refs"), F.sum("n").alias("n_channels"))
    win = top_rows(g, ["dataset_id"], [F.desc("priority"), F.desc("n_refs"), F.desc("n_channels"), *SIGNATURE])
    chosen = per_ref.join(win.select("dataset_id", *SIGNATURE, "priority"), ["dataset_id", *SIGNATURE, "priority"], "left_semi")
    others = per_ref.join(chosen, ["dataset_id", "ref_node", "ref_dir"], "left_anti")
    w = win.select("dataset_id", *[F.col(s).alias(f"w_{s}") for s in SIGNATURE])
    same_axis = F.lit(True)
    for s in SIGNATURE:
        same_axis = same_axis & (F.col(s) == F.col(f"w_{s}"))
    dropped = (others.join(w, "dataset_id").withColumn(
        "reason", F.when(same_axis, "incompatible physical quantity").otherwise("incompatible frequency axis"))
        .groupBy("dataset_id", "ref_node", "ref_dir").agg(F.min("reason").alias("reason")))
    return win, dropped


def resolve_duplicates(chans: DataFrame, rtol: float = 1e-6, atol: float = 1e-9) -> DataFrame:
    """One row per channel key with its status: single, equivalent (kept once) or conflicting (dropped).

    Every copy is compared with the first record of its key through a join, so copies are never gathered in one place.
    """
    first = chans.groupBy(*CHANNEL).agg(F.min_by(F.struct("re", "im"), F.col("record_index")).alias("first"),
                                        F.count(F.lit(1)).alias("n_copies"))
    close = (F.size("re") == F.size("first.re")) & F.forall(
        F.arrays_zip(F.col("re").alias("r"), F.col("im").alias("i"), F.col("first.re").alias("fr"), F.col("first.im").alias("fi")),
        lambda v: F.hypot(v["r"] - v["fr"], v["i"] - v["fi"]) <= F.lit(atol) + F.lit(rtol) * F.hypot(v["r"], v["i"]))
    per = (chans.join(first, CHANNEL).withColumn("_same", close).groupBy(*CHANNEL)
           .agg(F.max("n_copies").alias("n_copies"), F.bool_and("_same").alias("same")))
    status = F.when(F.col("n_copies") == 1, "single").when(F.col("same"), "equivalent").otherwise("conflicting")
    return per.withColumn("status", status).withColumn("kept", F.col("status") != "conflicting")


def attach_coherence(frf: DataFrame, coh: DataFrame) -> DataFrame:
    """Join coherence channels on reference, response and the same axis (sample by sample within 1e-8 / 1e-10)."""
    c = coh.select(*CHANNEL, F.col("x").alias("cx"), F.transform("coh", lambda v: clip(v)).alias("coh"))
    same = (F.size("x") == F.size("cx")) & (F.size("x") == F.size("coh")) & F.forall(
        F.zip_with("x", "cx", lambda a, b: F.abs(b - a) <= F.lit(1e-10) + F.lit(1e-8) * F.abs(a)), lambda v: v)
    out = frf.join(c, CHANNEL, "left")
    return out.withColumn("coh", F.when(same, F.col("coh"))).drop("cx")


def common_responses(lines: DataFrame) -> DataFrame:
    """Response DOFs with the references that see them and whether all references of the dataset do."""
    seen = lines.groupBy("dataset_id", "rsp_node", "rsp_dir").agg(
        F.countDistinct("ref_node", "ref_dir").alias("n_seen"),
        F.sort_array(F.collect_set(F.concat_ws(":", "ref_node", "ref_dir"))).alias("present"))
    refs = lines.groupBy("dataset_id").agg(F.countDistinct("ref_node", "ref_dir").alias("n_refs"))
    return seen.join(refs, "dataset_id").withColumn("common", F.col("n_seen") == F.col("n_refs"))


def response_coverage(responses: DataFrame) -> DataFrame:
    return responses.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_all"), F.sum(F.col("common").cast("int")).alias("n_common")).withColumn(
        "coverage", F.col("n_common") / F.col("n_all"))


# ---------------------------------------------------------------------------------------------------- indicators
def indicator(lines: DataFrame, coherence: DataFrame | None = None) -> DataFrame:
    """L2 norm over channels per line, with the mean coherence (NULL where none was measured)."""
    out = lines.groupBy(*AXIS, "line", "f_hz").agg(F.sqrt(F.sum(abs2(F.col("re"), F.col("im")))).alias("indicator"),
                                                   F.count(F.lit(1)).alias("n_channels"))
    if coherence is None:
        return out.withColumn("coherence", F.lit(None).cast("double"))
    mean = coherence.groupBy(*AXIS, "line").agg(F.avg("coh").alias("coherence"))
    return out.join(mean, [*AXIS, "line"], "left")


def axis_steps(axis: DataFrame, keys: list[str]) -> DataFrame:
    """Median step and non-uniformity of a frequency axis. Lines are distinct per key, so the ordered set is one axis."""
    per_line = axis.select(*keys, "line", "f_hz").distinct()
    # neighbours in line order, cut into blocks of 256 lines
    steps = with_order(per_line, keys, F.floor(F.col("line") / 256), ["line"], previous={"_prev": "f_hz"})
    steps = steps.withColumn("step", F.col("f_hz") - F.col("_prev"))
    return steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_lines"), F.min("f_hz").alias("band_lo"), F.max("f_hz").alias("band_hi"),
        F.percentile("step", F.lit(0.5)).alias("resolution"),
        ((F.max("step") - F.min("step")) / F.percentile("step", F.lit(0.5))).alias("nonuniformity"))


def frf_summary(lines: DataFrame, coherence: DataFrame) -> DataFrame:
    """Channel and node counts, band and step, coherence channels and status of each measured axis."""
    g = lines.groupBy(*AXIS).agg(F.countDistinct("rsp_node", "rsp_dir").alias("n_channels"), F.countDistinct("rsp_node").alias("n_nodes"))
    c = coherence.groupBy(*AXIS).agg(F.countDistinct("rsp_node", "rsp_dir").alias("n_coherence"))
    return (g.join(axis_steps(lines, AXIS), AXIS).join(c, AXIS, "left").withColumn("n_coherence", F.coalesce("n_coherence", F.lit(0)))
            .withColumn("coherence_status", F.when(F.col("n_coherence") > 0, "computed").otherwise("unavailable")))


def reference_gram(lines: DataFrame) -> DataFrame:
    """Per line the Hermitian reference Gram entries g_ij = sum over common responses of conj(h_i) h_j (i <= j)."""
    common = common_responses(lines).filter("common").select("dataset_id", "rsp_node", "rsp_dir")
    h = lines.join(common, ["dataset_id", "rsp_node", "rsp_dir"], "left_semi")
    left = h.select("dataset_id", "line", "f_hz", "rsp_node", "rsp_dir", F.struct("ref_node", "ref_dir").alias("i"),
                    F.col("re").alias("ar"), F.col("im").alias("ai"))
    right = h.select("dataset_id", "line", "rsp_node", "rsp_dir", F.struct("ref_node", "ref_dir").alias("j"),
                     F.col("re").alias("br"), F.col("im").alias("bi"))
    pair = left.join(right, ["dataset_id", "line", "rsp_node", "rsp_dir"]).filter(F.col("i") <= F.col("j"))
    return pair.groupBy("dataset_id", "line", "f_hz", "i", "j").agg(
        F.sum(F.col("ar") * F.col("br") + F.col("ai") * F.col("bi")).alias("gr"),
        F.sum(F.col("ar") * F.col("bi") - F.col("ai") * F.col("br")).alias("gi"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _gram_singular_values(i: pd.Series, j: pd.Series, gr: pd.Series, gi: pd.Series) -> pd.Series:
    """Singular values (descending) from the upper-triangle Gram entries of each line; lines with equally many references
    are solved in one call."""
    out = pd.Series([None] * len(i), index=i.index, dtype=object)
    width = np.array([int(max(b)) + 1 if b is not None else 0 for b in j])
    for k in np.unique(width[width > 0]):
        at = np.flatnonzero(width == k)
        m = np.zeros((len(at), k, k), complex)
        for n, r in enumerate(at):
            a, b = np.asarray(i.iat[r]), np.asarray(j.iat[r])
            m[n, a, b] = np.asarray(gr.iat[r]) + 1j * np.asarray(gi.iat[r])
            m[n, b, a] = np.conj(m[n, a, b])
        values = np.sqrt(np.clip(np.linalg.eigvalsh(m)[:, ::-1], 0.0, None))
        for n, r in enumerate(at):
            out.iat[r] = values[n]
    return out


def cmif(lines: DataFrame) -> DataFrame:
    """Singular values of the response x reference matrix of each line: ``sv`` (all, descending), sv1, sv2 and n_refs.

    Every line is treated by its own number of references: one or two are finished in closed form, the small Gram of a line
    with more goes to a batched kernel.
    """
    g = reference_gram(lines).groupBy("dataset_id", "line", "f_hz").agg(F.array_sort(F.collect_list(F.struct("i", "j", "gr", "gi"))).alias("g"))
    diag = F.filter("g", lambda e: e["i"] == e["j"])
    g = g.withColumn("d", diag).withColumn("n_refs", F.size("d"))
    place = lambda c: (F.array_position(F.col("d.i"), c).cast("int") - 1)
    many = F.transform("g", lambda e: F.struct(place(e["i"]).alias("ki"), place(e["j"]).alias("kj"), e["gr"].alias("gr"), e["gi"].alias("gi")))
    wide = g.filter("n_refs > 2").withColumn("m", many).withColumn("sv", _gram_singular_values("m.ki", "m.kj", "m.gr", "m.gi"))
    p, q = F.get("d", F.lit(0))["gr"], F.get("d", F.lit(1))["gr"]
    cross = F.filter("g", lambda e: e["i"] != e["j"])
    off = lambda part: F.coalesce(F.get(cross, F.lit(0))[part], F.lit(0.0))
    mean, half = (p + q) / 2, (p - q) / 2
    root = F.sqrt(half * half + abs2(off("gr"), off("gi")))
    two = F.array(F.sqrt(mean + root), F.sqrt(F.greatest(mean - root, F.lit(0.0))))
    few = g.filter("n_refs <= 2").withColumn("sv", F.when(F.col("n_refs") == 1, F.array(F.sqrt(p))).otherwise(two))
    columns = ["dataset_id", "line", "f_hz", "n_refs", "sv"]
    return few.select(*columns).unionByName(wide.select(*columns)).select("dataset_id", "line", "f_hz", "n_refs", "sv", F.get("sv", F.lit(0)).alias("sv1"), F.get("sv", F.lit(1)).alias("sv2"))


# ---------------------------------------------------------------------------------------------------- peaks
def positions(ind: DataFrame) -> DataFrame:
    """Number the lines of each axis from 0 (``pos``) and add their count (``n_lines``)."""
    count = ind.groupBy(*AXIS).agg(F.count(F.lit(1)).alias("n_lines"))
    d = with_order(ind.join(count, AXIS), AXIS, F.floor(F.col("line") / 4096), ["line"], rank="pos")
    return d.withColumn("pos", F.col("pos").cast("bigint") - 1)


def smooth_indicator(ind: DataFrame) -> DataFrame:
    """Quadratic least-squares smoothing of log10(indicator) along each axis (window max(5, 0.4 % of lines), odd).

    Interior lines use the centred window; edge lines evaluate the polynomial of the first / last window off-centre. Axes may have
    any length: they are smoothed in blocks.
    """
    d = positions(ind).join(ind.groupBy(*AXIS).agg(F.max("indicator").alias("_top")), AXIS)
    floor = F.greatest(F.col("_top"), F.lit(1e-30)) * F.lit(1e-14)
    d = d.withColumn("log_ind", F.log10(F.greatest(F.col("indicator"), floor))).drop("_top")
    n = F.col("n_lines")
    want = F.greatest(F.lit(5), F.round(n * F.lit(0.004)).cast("bigint"))
    want = F.when(want % 2 == 0, want + 1).otherwise(want)
    most = F.when((n - 1) % 2 == 1, n - 1).otherwise(n - 2)
    return axis.smooth(d, AXIS, "log_ind", F.floor((F.least(want, most) - 1) / 2), "smoothed")


def thin(pos: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Which peaks stay when, from the highest down (the later of equal ones first), each takes out its neighbours closer than ``distance``."""
    alive, done = np.ones(len(pos), bool), np.zeros(len(pos), bool)
    for k in np.argsort(height, kind="stable")[::-1]:
        if alive[k]:
            done[k] = True
            alive[np.searchsorted(pos, pos[k] - distance, "right") : np.searchsorted(pos, pos[k] + distance, "left")] = False
    return done


def _thinned(table: pa.Table) -> pa.Table:
    table = table.sort_by("pos")
    pos, height = table.column("pos").to_numpy(), table.column("smoothed").to_numpy()
    return table.filter(pa.array(thin(pos, height, int(table.column("_distance")[0].as_py())))).drop_columns(["_cluster"])


def find_peaks(smoothed: DataFrame) -> DataFrame:
    """Peaks of each axis in the positive band, with their ``prominence``.

    Local maxima (the middle of a level stretch) are thinned by a distance of 0.25 % of the lines, highest first, and cut by
    prominence (2 % of the range, 0.01 at least). Thinning runs in clusters of maxima that are close to each other; prominence comes
    from the nearest higher line on each side, found by block minima. The smoothed lines are checkpointed, as each step reads them.
    """
    smoothed = cut_lineage(smoothed)
    n = F.col("n_lines")
    at = F.floor(F.col("pos") / axis.BLOCK)
    line = smoothed.select(*AXIS, "pos", "smoothed", "n_lines")
    steps = with_order(line, AXIS, at, ["pos"], previous={"_prior": "smoothed"}).filter("_prior IS NULL OR smoothed <> _prior")
    steps = with_order(steps, AXIS, at, ["pos"], following={"_next": "pos", "_after": "smoothed"})
    tops = steps.filter("smoothed > _prior AND smoothed > _after").withColumn("pos", F.floor((F.col("pos") + F.col("_next") - 1) / 2)).select(*AXIS, "pos", "smoothed", "n_lines")
    tops = tops.withColumn("_distance", F.greatest(F.lit(2), F.round(n * 0.0025)).cast("bigint"))
    starts = F.col("_p").isNull() | (F.col("pos") - F.col("_p") >= F.col("_distance"))
    clusters = islands(tops, AXIS, at, ["pos"], starts, "_cluster", {"_p": "pos"}).select(*AXIS, "_cluster", "pos", "smoothed", "_distance")
    peaks = clusters.groupBy(*AXIS, "_cluster").applyInArrow(_thinned, clusters.drop("_cluster").schema)
    depth = line.withColumn("depth", -F.col("smoothed"))
    peaks = cut_lineage(peaks)
    found = axis.nearest_below(depth, peaks.withColumn("level", -F.col("smoothed")), AXIS, "depth")
    span = smoothed.groupBy(*AXIS).agg((F.max("smoothed") - F.min("smoothed")).alias("_range"))
    # Tops of the negated values: the lowest points between a peak and the next higher line on either side.
    foot = lambda c: F.coalesce(-F.col(c), F.col("smoothed"))
    out = smoothed.join(found, [*AXIS, "pos"]).join(span, AXIS).withColumn("prominence", F.col("smoothed") - F.greatest(foot("left_top"), foot("right_top")))
    return out.filter((F.col("prominence") >= F.greatest(F.lit(0.01), 0.02 * F.col("_range"))) & (F.col("f_hz") > 0)).drop("left", "right", "left_top", "right_top", "_range")


def rank_peaks(peaks: DataFrame, keep: int = 40) -> DataFrame:
    """Score = prominence + 0.25 coherence + 0.15 normalised amplitude; the best ``keep`` of each axis, numbered by line.

    ``n_dropped`` counts the peaks of the axis beyond them.
    """
    rng = peaks.groupBy(*AXIS).agg(F.min("smoothed").alias("_lo"), F.max("smoothed").alias("_hi"), F.greatest(F.count(F.lit(1)) - keep, F.lit(0)).alias("n_dropped"))
    amp = (F.col("smoothed") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-12))
    coh = clip(F.coalesce("coherence", F.lit(0.0)))
    scored = peaks.join(rng, AXIS).withColumn("score", F.col("prominence") + 0.25 * coh + 0.15 * amp).drop("_lo", "_hi")
    best = top_rows(scored, AXIS, [F.desc("score"), F.desc("line")], keep)
    return best.withColumn("peak_no", F.row_number().over(Window.partitionBy(*AXIS).orderBy("line")))


def half_power_damping(peaks: DataFrame, ind: DataFrame) -> DataFrame:
    """Damping from the first crossing of peak / sqrt(2) on each side; NULL at the axis ends or from 0.5 upwards.

    Crossings are found by block minima: a peak looks at three blocks of its axis at most, however far they are.
    """
    lines = cut_lineage(positions(ind).select(*AXIS, "pos", "n_lines", "line", "f_hz", "indicator"))
    p = lines.join(peaks.select(*AXIS, "line").distinct(), [*AXIS, "line"]).withColumn("level", F.col("indicator") / F.sqrt(F.lit(2.0)))
    found = axis.nearest_below(lines, p, AXIS, "indicator", inclusive=True).select(*AXIS, "pos", "left", "right")
    p = p.join(found, [*AXIS, "pos"])
    ends = F.array(*[F.struct(F.lit(k).alias("k"), c.alias("at")) for k, c in (("l0", F.col("left")), ("l1", F.col("left") + 1), ("r0", F.col("right") - 1), ("r1", F.col("right")))])
    wanted = p.select(*AXIS, F.col("pos").alias("peak_pos"), F.explode(ends).alias("e")).select(*AXIS, "peak_pos", "e.k", F.col("e.at").alias("pos"))
    point = lambda k: F.max(F.when(F.col("k") == k, F.struct("f_hz", "indicator"))).alias(k)
    points = wanted.join(lines.select(*AXIS, "pos", "f_hz", "indicator"), [*AXIS, "pos"]).groupBy(*AXIS, "peak_pos").agg(*map(point, ("l0", "l1", "r0", "r1"))).withColumnRenamed("peak_pos", "pos")

    def at(a: str, b: str) -> Column:
        rise = F.col(f"{b}.indicator") - F.col(f"{a}.indicator")
        return F.when(F.abs(rise) <= 1e-30, F.col(f"{b}.f_hz")).otherwise(
            F.col(f"{a}.f_hz") + (F.col("level") - F.col(f"{a}.indicator")) * (F.col(f"{b}.f_hz") - F.col(f"{a}.f_hz"))
            / F.when(F.abs(rise) > 1e-30, rise))

    zeta = (at("r0", "r1") - at("l0", "l1")) / (2 * F.col("f_hz"))
    open_end = F.col("left").isNull() | F.col("right").isNull() | (F.col("left") == 0) | (F.col("right") == F.col("n_lines") - 1)
    good = ~open_end & (F.col("indicator") > 0) & (F.col("f_hz") > 0) & (zeta > 0) & (zeta < 0.5)
    return p.join(points, [*AXIS, "pos"], "left").select(*AXIS, F.col("line").alias("peak_line"), F.col("f_hz").alias("peak_hz"), F.when(good, zeta).alias("damping"))


def peak_shapes(peaks: DataFrame, lines: DataFrame) -> DataFrame:
    """Channel values at the peak lines; the sign of the direction turns into the sign of the component."""
    sign = F.when(F.col("rsp_dir") < 0, -1.0).otherwise(1.0)
    return (lines.filter(F.abs("rsp_dir").between(1, 3)).join(peaks.select(*AXIS, "line"), [*AXIS, "line"])
            .select(*AXIS, "line", "f_hz", F.col("rsp_node").alias("node_id"), F.abs("rsp_dir").alias("dof"),
                    (sign * F.col("re")).alias("re"), (sign * F.col("im")).alias("im")))


def renumber(modes: DataFrame, keys: list[str]) -> DataFrame:
    """New 1-based numbers by frequency; the old number is kept as ``original_no``."""
    out = with_order(modes, keys, log_bin(F.col("frequency_hz")), ["frequency_hz", "mode_no"], rank="new_no")
    return out.withColumnRenamed("mode_no", "original_no").withColumnRenamed("new_no", "mode_no")


def close_groups(modes: DataFrame, keys: list[str], absolute: float = 3.0, relative: float = 0.03,
                 singletons: bool = False) -> DataFrame:
    """Gaps-and-islands on frequency: neighbours within max(absolute, relative x mean) share a group."""
    gap = F.col("frequency_hz") - F.col("_prev")
    limit = F.greatest(F.lit(absolute), F.lit(relative) * 0.5 * (F.col("frequency_hz") + F.col("_prev")))
    starts = F.col("_prev").isNull() | (gap > limit)
    out = islands(modes, keys, log_bin(F.col("frequency_hz")), ["frequency_hz", "mode_no"], starts, "group_no", {"_prev": "frequency_hz"})
    out = out.drop("_prev")
    size = out.groupBy(*keys, "group_no").agg(F.count(F.lit(1)).alias("group_size"), F.min("frequency_hz").alias("group_lo"),
                                              F.max("frequency_hz").alias("group_hi"), F.avg("frequency_hz").alias("group_mid"))
    out = out.join(size, [*keys, "group_no"])
    return out if singletons else out.filter(F.col("group_size") > 1)


def interval_association(bands: DataFrame, peaks: DataFrame, keys: list[str], floor_hz: float, relative: float,
                         use_span: bool = False) -> DataFrame:
    """Range join of bands [lo_hz, hi_hz] widened by max(floor, relative x centre[, span]) with peaks (peak_hz).

    Both sides carry logarithmic bins; a band is copied only into the few bins it touches.
    """
    width = 0.1
    mid = F.coalesce(F.col("mid_hz"), (F.col("lo_hz") + F.col("hi_hz")) / 2) if "mid_hz" in bands.columns else (
        F.col("lo_hz") + F.col("hi_hz")) / 2
    terms = [F.lit(float(floor_hz)), F.lit(float(relative)) * mid] + ([F.col("hi_hz") - F.col("lo_hz")] if use_span else [])
    b = bands.withColumn("window_hz", F.greatest(*terms))
    b = b.withColumn("_lo", F.col("lo_hz") - F.col("window_hz")).withColumn("_hi", F.col("hi_hz") + F.col("window_hz"))
    b = b.withColumn("_bin", F.explode(F.sequence(log_bin(F.greatest("_lo", F.lit(0.01)), width), log_bin(F.greatest("_hi", F.lit(0.01)), width))))
    p = peaks.withColumn("_bin", log_bin(F.greatest("peak_hz", F.lit(0.01)), width))
    return b.join(p, [*keys, "_bin"]).filter(F.col("peak_hz").between(F.col("_lo"), F.col("_hi"))).drop("_bin", "_lo", "_hi")


# ---------------------------------------------------------------------------------------------------- close-mode bands
def band_lines(bands: DataFrame, lines: DataFrame, coherence: DataFrame | None = None) -> DataFrame:
    """Detrended, coherence-weighted, root-norm scaled band snapshots of every channel.

    ``bands``: dataset_id, band_id, lo_hz, hi_hz. The straight line between a channel's first and last band value is
    removed; a line's column is divided by the square root of its norm over responses.
    """
    rows = lines.join(bands.select("dataset_id", "band_id", "lo_hz", "hi_hz"), "dataset_id").filter(
        F.col("f_hz").between(F.col("lo_hz"), F.col("hi_hz")))
    chan = ["dataset_id", "band_id", "rsp_node", "rsp_dir", "ref_node", "ref_dir"]
    ends = rows.groupBy(*chan).agg(
        F.min_by(F.struct("line", "re", "im"), "line").alias("a"), F.max_by(F.struct("line", "re", "im"), "line").alias("b"))
    rows = rows.join(ends, chan)
    t = (F.col("line") - F.col("a.line")) / F.when(F.col("b.line") > F.col("a.line"), F.col("b.line") - F.col("a.line"))
    t = F.coalesce(t, F.lit(0.0))
    rows = rows.withColumn("_re", F.col("re") - (F.col("a.re") * (1 - t) + F.col("b.re") * t)).withColumn(
        "_im", F.col("im") - (F.col("a.im") * (1 - t) + F.col("b.im") * t))
    if coherence is not None:
        rows = rows.join(coherence.groupBy("dataset_id", "line").agg(F.avg("coh").alias("_coh")), ["dataset_id", "line"], "left")
        wgt = F.sqrt(F.least(F.greatest(F.coalesce("_coh", F.lit(1.0)), F.lit(0.05)), F.lit(1.0)))
        rows = rows.withColumn("_re", F.col("_re") * wgt).withColumn("_im", F.col("_im") * wgt)
    col = ["dataset_id", "band_id", "ref_node", "ref_dir", "line"]
    norm = rows.groupBy(*col).agg(F.sqrt(F.sum(abs2(F.col("_re"), F.col("_im")))).alias("_norm"))
    top = norm.groupBy("dataset_id", "band_id").agg(F.greatest(F.max("_norm") * 1e-12, F.lit(1e-30)).alias("_floor"))
    rows = rows.join(norm.join(top, ["dataset_id", "band_id"]), col)
    scale = F.sqrt(F.greatest("_norm", "_floor"))
    return rows.select(*chan, "line", "f_hz", (F.col("_re") / scale).alias("re"), (F.col("_im") / scale).alias("im"))


@F.pandas_udf(EIGENPAIRS)
def _band_modes(size: pd.Series, i: pd.Series, j: pd.Series, gr: pd.Series, gi: pd.Series, wanted: pd.Series) -> pd.Series:
    """Leading eigenpairs of each band's snapshot Gram (columns x columns)."""
    out = []
    for k, a, b, re, im, n in zip(size, i, j, gr, gi, wanted):
        m = np.zeros((k, k), complex)
        m[a, b] = np.asarray(re) + 1j * np.asarray(im)
        m[b, a] = np.conj(m[a, b])
        val, vec = np.linalg.eigh(m)
        order = np.argsort(val)[::-1][:n]
        out.append([{"sigma": float(np.sqrt(max(val[o], 0.0))), "vr": vec[:, o].real, "vi": vec[:, o].imag} for o in order])
    return pd.Series(out)


def band_components(snapshots: DataFrame, wanted: DataFrame, min_ratio: float = 0.015) -> tuple[DataFrame, DataFrame]:
    """Leading spatial components of each band and their response vectors.

    The Gram over snapshot columns (reference x line) is summed in Spark over responses, so only a columns x columns
    matrix per band, bounded by the band width, reaches the small eigenproblem. Returns (components, shapes).
    """
    key = ["dataset_id", "band_id"]
    snapshots = keep(snapshots)
    cols = snapshots.select(*key, "ref_node", "ref_dir", "line", "f_hz").distinct()
    cols = cols.withColumn("c", F.row_number().over(Window.partitionBy(*key).orderBy("ref_node", "ref_dir", "line")) - 1)
    s = snapshots.join(cols.drop("f_hz"), [*key, "ref_node", "ref_dir", "line"])
    vec = s.groupBy(*key, "rsp_node", "rsp_dir").agg(F.sort_array(F.collect_list(F.struct("c", "re", "im"))).alias("v"))
    pair = vec.select(*key, "v", F.explode("v").alias("p")).select(
        *key, "p", F.explode(F.filter("v", lambda q: q["c"] >= F.col("p.c"))).alias("q"))
    gram = pair.groupBy(*key, F.col("p.c").alias("i"), F.col("q.c").alias("j")).agg(
        F.sum(F.col("p.re") * F.col("q.re") + F.col("p.im") * F.col("q.im")).alias("gr"),
        F.sum(F.col("p.re") * F.col("q.im") - F.col("p.im") * F.col("q.re")).alias("gi"))
    size = cols.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("k"),
                                  F.sort_array(F.collect_list(F.struct("c", "f_hz", "line"))).alias("axis"))
    g = gram.groupBy(*key).agg(F.collect_list(F.struct("i", "j", "gr", "gi")).alias("g")).join(size, key).join(wanted, key)
    modes = g.select(*key, "axis", F.posexplode(_band_modes("k", "g.i", "g.j", "g.gr", "g.gi", F.col("wanted").cast("int"))).alias("comp", "m"))
    lead = modes.filter("comp = 0").select(*key, F.col("m.sigma").alias("sigma0"))
    modes = modes.join(lead, key).withColumn("ratio", F.col("m.sigma") / F.when(F.col("sigma0") > 1e-30, F.col("sigma0")))
    modes = modes.filter((F.col("comp") == 0) | (F.col("ratio") >= min_ratio)).filter(F.col("ratio").isNotNull())
    energy = modes.select(*key, "comp", "ratio", F.col("m.sigma").alias("sigma"), F.explode(F.arrays_zip(
        F.col("axis.f_hz").alias("f"), F.col("axis.line").alias("l"), F.col("m.vr").alias("vr"), F.col("m.vi").alias("vi"))).alias("e"))
    per_line = energy.groupBy(*key, "comp", "ratio", "sigma", F.col("e.l").alias("line"), F.col("e.f").alias("f_hz")).agg(
        F.sum(F.pow("sigma", 2) * abs2(F.col("e.vr"), F.col("e.vi"))).alias("energy"))
    comps = per_line.groupBy(*key, "comp", "ratio", "sigma").agg(
        F.max_by("f_hz", F.struct(F.round("energy", 12), -F.col("line"))).alias("peak_hz"),
        (F.sum(F.col("f_hz") * F.col("energy")) / F.sum("energy")).alias("centroid_hz"))
    comps = comps.withColumn("frequency_hz", 0.7 * F.col("peak_hz") + 0.3 * F.col("centroid_hz"))
    proj = vec.join(modes.select(*key, "comp", "m"), key)
    # u = S v / sigma with v the eigenvector of S^H S
    pick = lambda q, part: F.get(F.col(f"m.{part}"), q["c"])
    ur = F.aggregate("v", F.lit(0.0), lambda acc, q: acc + q["re"] * pick(q, "vr") - q["im"] * pick(q, "vi"))
    ui = F.aggregate("v", F.lit(0.0), lambda acc, q: acc + q["re"] * pick(q, "vi") + q["im"] * pick(q, "vr"))
    sign = F.when(F.col("rsp_dir") < 0, -1.0).otherwise(1.0)
    sig = F.when(F.col("m.sigma") > 1e-30, F.col("m.sigma"))
    shapes = proj.select(*key, "comp", F.col("rsp_node").alias("node_id"), F.abs("rsp_dir").alias("dof"),
                         (sign * ur / sig).alias("re"), (sign * ui / sig).alias("im"))
    return comps, shapes


def pick_components(components: DataFrame, keys: list[str]) -> DataFrame:
    """The components least like an existing mode (then the strongest), up to each row's ``missing`` count."""
    w = Window.partitionBy(*keys).orderBy("max_mac", F.desc("ratio"), "comp")
    return components.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= F.col("missing"))


def peak_confidence(modes: DataFrame) -> DataFrame:
    """Source and confidence labels; only a computed coherence may raise a peak-derived mode."""
    fitted = F.col("dataset_type").isin(55, 2414)
    coh = F.when(F.col("coherence_status") == "computed", F.col("coherence"))
    label = (F.when(fitted, "High").when(F.col("dataset_type") != 58, "Imported")
             .when(coh.isNull() & (F.col("coherence_status") == "parse_error"), "Peak-derived (coherence parse error)")
             .when(coh.isNull(), "Peak-derived (coherence unavailable)").when(coh >= 0.90, "High peak confidence")
             .when(coh >= 0.70, "Medium peak confidence").otherwise("Peak-derived"))
    score = F.when(F.col("dataset_type") == 58, clip(F.coalesce(coh, F.lit(0.0)))).otherwise(1.0)
    source = F.when(fitted, "Curve-fitted modal set").when(F.col("dataset_type") == 58, "FRF resonance peak").otherwise("Imported modal vector")
    return modes.withColumn("source_label", source).withColumn("confidence_label", label).withColumn("confidence_score", score)


def validate_close_modes(cands: DataFrame) -> DataFrame:
    """Accept or reject close-mode candidates. Needs nearby, wanted, max_mac, references, second_ratio."""
    ratio = F.coalesce("second_ratio", F.lit(0.0))
    reasons = reason_array(
        (F.col("nearby") >= F.greatest(F.col("wanted"), F.lit(1)), "enough independent peaks"),
        (F.col("max_mac") >= 0.90, "duplicate spatial shape"), (F.col("references") < 2, "single reference"),
        ((F.col("references") >= 2) & (ratio < 0.05), "insufficient independent rank"))
    score = F.when(F.col("references") > 1, 1.0).otherwise(0.2) * clip(ratio / 0.20) * clip((1 - F.col("max_mac")) / 0.50)
    out = cands.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0).withColumn("confidence_score", score)
    return out.withColumn("confidence_label", F.when(F.col("confidence_score") >= 0.75, "High").when(
        F.col("confidence_score") >= 0.45, "Medium").otherwise("Low"))


# ---------------------------------------------------------------------------------------------------- quality checks
def completeness(lines: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected vs present response channels, dead channels and point count per dataset.

    ``expected``: dataset_id, rsp_node, rsp_dir."""
    chan = lines.groupBy("dataset_id", "rsp_node", "rsp_dir").agg((F.max(abs2(F.col("re"), F.col("im"))) == 0).alias("dead"))
    both = expected.withColumn("wanted", F.lit(True)).join(
        chan.withColumn("present", F.lit(True)), ["dataset_id", "rsp_node", "rsp_dir"], "full_outer")
    has, want = F.coalesce("present", F.lit(False)), F.coalesce("wanted", F.lit(False))
    n = lambda c: F.sum(c.cast("int"))
    out = both.groupBy("dataset_id").agg(
        n(has).alias("n_channels"), n(want & ~has).alias("n_missing"), n(has & ~want).alias("n_extra"),
        n(has & F.coalesce("dead", F.lit(False))).alias("n_dead"),
        F.countDistinct(F.when(has, F.col("rsp_node"))).alias("n_points"), F.countDistinct(F.when(want, F.col("rsp_node"))).alias("n_points_expected"))
    bad = (F.col("n_missing") > 0) | (F.col("n_dead") > 0) | (F.col("n_points") != F.col("n_points_expected"))
    return out.withColumn("status", F.when(bad, "WARNING").otherwise("PASS"))


def resolution_check(modes: DataFrame, axes: DataFrame, keys: list[str]) -> DataFrame:
    """Bandwidth against line spacing and the gap to the next mode (in number order) for every measured mode.

    ``modes``: keys, dataset_id, mode_no, frequency_hz, damping_ratio; ``axes``: dataset_id, resolution."""
    nxt = with_order(modes, keys, F.floor(F.col("mode_no") / 256), ["mode_no"],
                     following={"next_hz": "frequency_hz", "next_damping": "damping_ratio", "next_no": "mode_no"})
    m = nxt.join(axes.select("dataset_id", "resolution"), "dataset_id", "left")
    bw = 2 * F.col("damping_ratio") * F.col("frequency_hz")
    nbw = 2 * F.col("next_damping") * F.col("next_hz")
    gap = F.col("next_hz") - F.col("frequency_hz")
    rel = gap / (0.5 * (F.col("next_hz") + F.col("frequency_hz")))
    return (m.withColumn("bandwidth", bw).withColumn("bandwidth_lines", bw / F.col("resolution"))
            .withColumn("unresolved", bw < 3 * F.col("resolution")).withColumn("gap_hz", gap).withColumn("relative_gap", rel)
            .withColumn("gap_lines", gap / F.col("resolution"))
            .withColumn("overlap", F.when(gap > 0, 0.5 * (bw + nbw) / F.when(gap > 0, gap))).withColumn("close", rel < 0.03)
            .withColumn("damping_available", F.col("damping_ratio").isNotNull()))

"""Queries of the frequency axis: FRF channels, indicators, peaks, close modes and resolution checks."""
from __future__ import annotations

from pyspark.sql import functions as F

from modalframe.operators import frf, mac, pairing
from modalframe.operators.ordered import with_order
from modalframe.plans.correlation import DUP_SQL
from modalframe.plans.registry import query

LABEL = """CASE (dataset_id + ref_node) % 4 WHEN 0 THEN 'Voltage' WHEN 1 THEN 'Displacement' WHEN 2 THEN 'Velocity' ELSE 'Accelerance' END"""


def labelled_channels(t):
    c = frf.channels(t.frf)
    return c.withColumn("label", F.expr(LABEL))


# Axis --------------------------------------------------------------------------------------------------------------
SIG_SQL = f"""ch AS (SELECT dataset_id, rsp_node, rsp_dir, ref_node, ref_dir, any_value({LABEL}) AS label, count(*) AS n_lines, min(f_hz) AS x_first, max(f_hz) AS x_last
 FROM fx_frf GROUP BY 1, 2, 3, 4, 5),
 st AS (SELECT dataset_id, rsp_node, rsp_dir, ref_node, ref_dir, median(d) AS x_step FROM (SELECT *, f_hz - lag(f_hz) OVER
 (PARTITION BY dataset_id, rsp_node, rsp_dir, ref_node, ref_dir ORDER BY line) AS d FROM fx_frf) GROUP BY 1, 2, 3, 4, 5),
 sig AS (SELECT ch.*, x_step, CASE label WHEN 'Displacement' THEN 3 WHEN 'Velocity' THEN 2 WHEN 'Accelerance' THEN 1 ELSE 0 END AS priority
 FROM ch JOIN st USING (dataset_id, rsp_node, rsp_dir, ref_node, ref_dir) WHERE n_lines >= 3)"""


@query("w06_axis_signature", "dataset_id:i rsp_node:i ref_node:i n_lines:i x_first:6 x_last:6 x_step:6", f"WITH {SIG_SQL} SELECT * FROM sig")
def w06(t):
    return frf.axis_signature(frf.channels(t.frf)).filter("n_lines is not null")


@query("k02_winning_frf_group", "dataset_id:i ref_node:i ref_dir:i priority:i label n_lines:i n_dofs:i n_channels:i",
       f"""WITH {SIG_SQL}, g AS (SELECT dataset_id, n_lines, x_first, x_last, x_step, ref_node, ref_dir, priority, label,
 count(*) AS n_dofs, count(*) AS n_channels FROM sig GROUP BY ALL)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY priority DESC, n_dofs DESC, n_channels DESC, ref_node, ref_dir,
 label, n_lines, x_first, x_last, x_step) AS k FROM g) WHERE k = 1""")
def k02(t):
    return frf.winning_group(labelled_channels(t))


K3_SQL = f"""WITH {SIG_SQL}, pr AS (SELECT dataset_id, n_lines, x_first, x_last, x_step, priority, ref_node, ref_dir, count(*) AS n FROM sig GROUP BY ALL),
 g AS (SELECT dataset_id, n_lines, x_first, x_last, x_step, priority, count(*) AS n_refs, sum(n) AS n_channels FROM pr GROUP BY ALL),
 win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY priority DESC, n_refs DESC, n_channels DESC,
 n_lines, x_first, x_last, x_step) AS k FROM g) WHERE k = 1)"""


@query("k03_multi_reference_group", "dataset_id:i priority:i n_lines:i n_refs:i n_channels:i", K3_SQL + " SELECT * FROM win")
def k03(t):
    return frf.winning_multi_reference_group(labelled_channels(t))[0]


@query("k03_dropped_references", "dataset_id:i ref_node:i ref_dir:i reason",
       K3_SQL + """ SELECT p.dataset_id, p.ref_node, p.ref_dir, min(CASE WHEN p.n_lines = w.n_lines AND p.x_first = w.x_first AND p.x_last = w.x_last
 AND p.x_step = w.x_step THEN 'incompatible physical quantity' ELSE 'incompatible frequency axis' END) AS reason
 FROM pr p JOIN win w USING (dataset_id) WHERE NOT EXISTS (SELECT 1 FROM pr c WHERE c.dataset_id = p.dataset_id AND c.ref_node = p.ref_node
 AND c.ref_dir = p.ref_dir AND c.n_lines = w.n_lines AND c.x_first = w.x_first AND c.x_last = w.x_last AND c.x_step = w.x_step
 AND c.priority = w.priority) GROUP BY 1, 2, 3""")
def k03_dropped(t):
    return frf.winning_multi_reference_group(labelled_channels(t))[1]


@query("j12_coherence_channels", "dataset_id:i rsp_node:i ref_node:i line:i coh:6",
       """SELECT f.dataset_id, f.rsp_node, f.ref_node, f.line, c.coh FROM fx_frf f LEFT JOIN fx_coh c USING (dataset_id, rsp_node, rsp_dir, ref_node, ref_dir, line)""")
def j12(t):
    c = t.coh.groupBy(*frf.CHANNEL).agg(F.sort_array(F.collect_list(F.struct("line", "coh"))).alias("p"))
    c = c.select(*frf.CHANNEL, F.transform("p.line", lambda v: 5 + 2 * v.cast("double")).alias("x"), F.col("p.coh").alias("coh"))
    out = frf.attach_coherence(frf.channels(t.frf), c)
    return out.select(*frf.CHANNEL, F.explode(F.arrays_zip("x", F.coalesce("coh", F.array_repeat(F.lit(None).cast("double"), F.size("x"))).alias("coh"))).alias("v")).select(
        *frf.CHANNEL, ((F.col("v.x") - 5) / 2).alias("line"), F.col("v.coh").alias("coh"))


@query("a64_duplicate_channels", "dataset_id:i rsp_node:i ref_node:i n_copies:i status kept",
       """SELECT dataset_id, rsp_node, ref_node, CASE WHEN rsp_node IN (1, 2) THEN 2 ELSE 1 END AS n_copies,
 CASE WHEN rsp_node = 1 THEN 'equivalent' WHEN rsp_node = 2 THEN 'conflicting' ELSE 'single' END AS status, rsp_node <> 2 AS kept
 FROM fx_frf GROUP BY 1, 2, 3""")
def a64(t):
    c = frf.channels(t.frf).withColumn("record_index", F.lit(1))
    copy = c.filter("rsp_node in (1, 2)").withColumn("record_index", F.lit(2)).withColumn(
        "re", F.when(F.col("rsp_node") == 2, F.transform("re", lambda v: v * 1.01 + 1.0)).otherwise(F.col("re")))
    return frf.resolve_duplicates(c.unionByName(copy))


# Responses ---------------------------------------------------------------------------------------------------------
RESP_IN = "SELECT * FROM fx_frf WHERE NOT (rsp_node = 3 AND ref_node = 2 AND dataset_id % 2 = 0)"
RESP_SQL = f"""f AS ({RESP_IN}), refs AS (SELECT dataset_id, count(DISTINCT ref_node) AS n_refs FROM f GROUP BY 1),
 resp AS (SELECT dataset_id, rsp_node, rsp_dir, count(DISTINCT ref_node) AS n_seen, string_agg(DISTINCT CONCAT(ref_node, ':', ref_dir), ';' ORDER BY CONCAT(ref_node, ':', ref_dir)) AS present
 FROM f GROUP BY 1, 2, 3)"""


@query("u02_common_responses", "dataset_id:i n_all:i n_common:i coverage:6",
       f"WITH {RESP_SQL} SELECT dataset_id, count(*) AS n_all, sum(CASE WHEN n_seen = n_refs THEN 1 ELSE 0 END) AS n_common, "
       "sum(CASE WHEN n_seen = n_refs THEN 1 ELSE 0 END) / count(*) AS coverage FROM resp JOIN refs USING (dataset_id) GROUP BY 1")
def u02(t):
    return frf.response_coverage(frf.common_responses(t.sql(RESP_IN)))


@query("u03_responses_not_common", "dataset_id:i rsp_node:i rsp_dir:i present",
       f"WITH {RESP_SQL} SELECT dataset_id, rsp_node, rsp_dir, present FROM resp JOIN refs USING (dataset_id) WHERE n_seen < n_refs")
def u03(t):
    return frf.common_responses(t.sql(RESP_IN)).filter("not common").withColumn("present", F.concat_ws(";", "present"))


@query("a22_frf_indicator", "dataset_id:i ref_node:i line:i f_hz:6 indicator:4 n_channels:i coherence:6",
       """SELECT * FROM (SELECT dataset_id, ref_node, line, f_hz, sqrt(sum(re * re + im * im)) AS indicator, count(*) AS n_channels FROM fx_frf GROUP BY 1, 2, 3, 4)
 LEFT JOIN (SELECT dataset_id, ref_node, line, avg(coh) AS coherence FROM fx_coh GROUP BY 1, 2, 3) USING (dataset_id, ref_node, line)""")
def a22(t):
    return frf.indicator(t.frf, t.coh)


AXIS_SQL = """(SELECT {k}, count(*) AS n_lines, min(f_hz) AS band_lo, max(f_hz) AS band_hi, median(d) AS resolution, (max(d) - min(d)) / median(d) AS nonuniformity
 FROM (SELECT *, f_hz - lag(f_hz) OVER (PARTITION BY {k} ORDER BY line) AS d FROM (SELECT DISTINCT {k}, line, f_hz FROM fx_frf)) GROUP BY {k})"""


@query("a22_frf_summary", "dataset_id:i ref_node:i n_channels:i n_nodes:i n_lines:i band_lo:6 band_hi:6 resolution:6 n_coherence:i coherence_status",
       f"""SELECT g.*, a.n_lines, band_lo, band_hi, resolution, coalesce(n_coherence, 0) AS n_coherence,
 CASE WHEN n_coherence > 0 THEN 'computed' ELSE 'unavailable' END AS coherence_status
 FROM (SELECT dataset_id, ref_node, count(DISTINCT rsp_node) AS n_channels, count(DISTINCT rsp_node) AS n_nodes FROM fx_frf GROUP BY 1, 2) g
 JOIN {AXIS_SQL.format(k='dataset_id, ref_node')} a USING (dataset_id, ref_node)
 LEFT JOIN (SELECT dataset_id, ref_node, count(DISTINCT rsp_node) AS n_coherence FROM fx_coh GROUP BY 1, 2) c USING (dataset_id, ref_node)""")
def a22_summary(t):
    return frf.frf_summary(t.frf, t.coh)


@query("a23_cmif_singular_values", "dataset_id:i line:i f_hz:6 n_refs:i sv1:4 sv2:4",
       f"""WITH keep AS (SELECT dataset_id, rsp_node FROM fx_frf GROUP BY 1, 2 HAVING count(DISTINCT ref_node) = 2),
 h AS (SELECT f.* FROM fx_frf f JOIN keep USING (dataset_id, rsp_node)),
 d AS (SELECT dataset_id, line, f_hz, sum(CASE WHEN ref_node = 1 THEN re * re + im * im END) AS p, sum(CASE WHEN ref_node = 2 THEN re * re + im * im END) AS q FROM h GROUP BY 1, 2, 3),
 x AS (SELECT a.dataset_id, a.line, sum(a.re * b.re + a.im * b.im) AS xr, sum(a.re * b.im - a.im * b.re) AS xi FROM h a JOIN h b USING (dataset_id, line, rsp_node)
 WHERE a.ref_node = 1 AND b.ref_node = 2 GROUP BY 1, 2),
 z AS (SELECT d.*, coalesce(xr, 0e0) AS xr, coalesce(xi, 0e0) AS xi FROM d LEFT JOIN x USING (dataset_id, line))
 SELECT dataset_id, line, f_hz, CASE WHEN p IS NULL OR q IS NULL THEN 1 ELSE 2 END AS n_refs,
 CASE WHEN p IS NULL OR q IS NULL THEN sqrt(coalesce(p, q)) ELSE sqrt((p + q) / 2 + sqrt(pow((p - q) / 2, 2) + xr * xr + xi * xi)) END AS sv1,
 CASE WHEN p IS NULL OR q IS NULL THEN NULL ELSE sqrt(greatest((p + q) / 2 - sqrt(pow((p - q) / 2, 2) + xr * xr + xi * xi), 0e0)) END AS sv2 FROM z""")
def a23(t):
    return frf.cmif(t.frf)


EXPECTED = """SELECT dataset_id, CAST(n AS INT) AS rsp_node, CAST(CASE WHEN n = 4 THEN -2 ELSE n % 3 + 1 END AS INT) AS rsp_dir
 FROM (SELECT DISTINCT dataset_id FROM fx_frf) CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 7)"""


@query("a25_frf_completeness", "dataset_id:i n_channels:i n_missing:i n_extra:i n_dead:i n_points:i status",
       f"""WITH e AS ({EXPECTED}), c AS (SELECT dataset_id, rsp_node, rsp_dir, max(CASE WHEN dataset_id % 3 = 1 AND rsp_node = 2 THEN 0e0 ELSE re * re + im * im END) = 0 AS dead
 FROM fx_frf GROUP BY 1, 2, 3), b AS (SELECT dataset_id, rsp_node, rsp_dir, c.dead, c.dead IS NOT NULL AS has, e.n IS NOT NULL AS want
 FROM (SELECT *, 1 AS n FROM e) e FULL JOIN c USING (dataset_id, rsp_node, rsp_dir))
 SELECT dataset_id, sum(CASE WHEN has THEN 1 ELSE 0 END) AS n_channels, sum(CASE WHEN want AND NOT has THEN 1 ELSE 0 END) AS n_missing,
 sum(CASE WHEN has AND NOT want THEN 1 ELSE 0 END) AS n_extra, sum(CASE WHEN dead THEN 1 ELSE 0 END) AS n_dead,
 count(DISTINCT CASE WHEN has THEN rsp_node END) AS n_points,
 CASE WHEN sum(CASE WHEN want AND NOT has THEN 1 ELSE 0 END) > 0 OR sum(CASE WHEN dead THEN 1 ELSE 0 END) > 0
 OR count(DISTINCT CASE WHEN has THEN rsp_node END) <> count(DISTINCT CASE WHEN want THEN rsp_node END) THEN 'WARNING' ELSE 'PASS' END AS status FROM b GROUP BY 1""")
def a25(t):
    dead = (F.col("dataset_id") % 3 == 1) & (F.col("rsp_node") == 2)
    lines = t.frf.withColumn("re", F.when(dead, 0.0).otherwise(F.col("re"))).withColumn("im", F.when(dead, 0.0).otherwise(F.col("im")))
    return frf.completeness(lines, t.sql(EXPECTED))


# Modes on an axis --------------------------------------------------------------------------------------------------
@query("a26_coherence_at_resonance", "cmp_id:i mode_no:i dataset_id:i coherence:6 flagged",
       """WITH ax AS (SELECT dataset_id, line, f_hz, avg(coh) AS coh FROM fx_coh JOIN (SELECT DISTINCT dataset_id, line, f_hz FROM fx_frf) USING (dataset_id, line) GROUP BY 1, 2, 3),
 m AS (SELECT cmp_id, mode_no, specimen_id % 5 AS dataset_id, frequency_hz FROM fx_modes WHERE role = 'EXP'),
 b AS (SELECT dataset_id, min(f_hz) AS lo, max(f_hz) AS hi FROM ax GROUP BY 1)
 SELECT cmp_id, mode_no, dataset_id, CASE WHEN frequency_hz BETWEEN lo AND hi THEN coh END AS coherence,
 coalesce(CASE WHEN frequency_hz BETWEEN lo AND hi THEN coh END < 0.9, false) AS flagged
 FROM (SELECT m.*, coh, row_number() OVER (PARTITION BY cmp_id, mode_no ORDER BY abs(f_hz - frequency_hz), line) AS k FROM m JOIN ax USING (dataset_id)) JOIN b USING (dataset_id) WHERE k = 1""")
def a26(t):
    axis = t.coh.groupBy("dataset_id", "line").agg(F.avg("coh").alias("coh")).join(
        t.frf.select("dataset_id", "line", "f_hz").distinct(), ["dataset_id", "line"])
    modes = t.modes.filter("role = 'EXP'").withColumn("dataset_id", F.col("specimen_id") % 5)
    return frf_coherence_at_modes(modes, axis)


def frf_coherence_at_modes(modes, axis):
    """Coherence at the line nearest to each mode (NULL outside the measured band or without an axis) and the < 0.9 flag."""
    merged = axis.select(F.col("dataset_id").alias("cmp_id"), F.lit("FE").alias("role"), F.col("line").cast("bigint").alias("mode_no"),
                         F.col("f_hz").alias("frequency_hz")).unionByName(
        modes.select(F.col("dataset_id").alias("cmp_id"), F.lit("EXP").alias("role"),
                     F.xxhash64("cmp_id", "mode_no").alias("mode_no"), "frequency_hz"))
    near = pairing.nearest_frequencies(merged, 1).select(F.col("cmp_id").alias("dataset_id"), F.col("exp_mode").alias("_key"), F.col("fe_mode").alias("line"))
    band = axis.groupBy("dataset_id").agg(F.min("f_hz").alias("_lo"), F.max("f_hz").alias("_hi"))
    out = (modes.withColumn("_key", F.xxhash64("cmp_id", "mode_no")).join(near, ["dataset_id", "_key"], "left")
           .join(axis.select("dataset_id", "line", "coh"), ["dataset_id", "line"], "left").join(band, "dataset_id", "left"))
    inside = F.col("frequency_hz").between(F.col("_lo"), F.col("_hi"))
    return out.withColumn("coherence", F.when(inside, F.col("coh"))).withColumn("flagged", F.coalesce(F.col("coherence") < 0.9, F.lit(False)))


RES_SQL = f"""SELECT m.*, gap AS gap_hz, gap / mid AS relative_gap, gap / resolution AS gap_lines, 2e0 * damping_ratio * frequency_hz AS bandwidth,
 2e0 * damping_ratio * frequency_hz / resolution AS bandwidth_lines, 2e0 * damping_ratio * frequency_hz < 3e0 * resolution AS unresolved,
 CASE WHEN gap > 0 THEN (damping_ratio * frequency_hz + nz * nf) / gap END AS overlap, gap / mid < 0.03 AS close, damping_ratio IS NOT NULL AS damping_available
 FROM (SELECT *, nf - frequency_hz AS gap, (nf + frequency_hz) / 2 AS mid FROM (SELECT cmp_id, mode_no, specimen_id % 5 AS dataset_id, frequency_hz, damping_ratio,
 lead(frequency_hz) OVER (PARTITION BY cmp_id ORDER BY mode_no) AS nf, lead(damping_ratio) OVER (PARTITION BY cmp_id ORDER BY mode_no) AS nz,
 lead(mode_no) OVER (PARTITION BY cmp_id ORDER BY mode_no) AS next_no FROM fx_modes WHERE role = 'EXP')) m
 LEFT JOIN {AXIS_SQL.format(k='dataset_id')} a USING (dataset_id)"""


def resolved(t):
    modes = t.modes.filter("role = 'EXP'").withColumn("dataset_id", F.col("specimen_id") % 5)
    return frf.resolution_check(modes, frf.axis_steps(t.frf, ["dataset_id"]), ["cmp_id"])


@query("a27_resolution_check", "cmp_id:i mode_no:i bandwidth:6 bandwidth_lines:6 unresolved overlap:4 close damping_available", RES_SQL)
def a27(t):
    return resolved(t)


@query("a27_axis_steps", "dataset_id:i n_lines:i resolution:6 nonuniformity:6", f"SELECT * FROM {AXIS_SQL.format(k='dataset_id')}")
def a27_axis(t):
    return frf.axis_steps(t.frf, ["dataset_id"])


@query("w02_adjacent_gaps", "cmp_id:i mode_no:i next_no:i gap_hz:6 relative_gap:6 gap_lines:6", RES_SQL)
def w02(t):
    return resolved(t)


W3_SQL = """SELECT cmp_id, role, mode_no, dense_rank() OVER (PARTITION BY cmp_id, role ORDER BY g) AS group_no, frequency_hz, count(*) OVER (PARTITION BY cmp_id, role, g) AS group_size,
 min(frequency_hz) OVER (PARTITION BY cmp_id, role, g) AS group_lo, max(frequency_hz) OVER (PARTITION BY cmp_id, role, g) AS group_hi FROM (
 SELECT *, sum(CASE WHEN p IS NULL OR frequency_hz - p > greatest({a}, {r} * 0.5e0 * (frequency_hz + p)) THEN 1 ELSE 0 END)
 OVER (PARTITION BY cmp_id, role ORDER BY frequency_hz, mode_no) AS g FROM (
 SELECT *, lag(frequency_hz) OVER (PARTITION BY cmp_id, role ORDER BY frequency_hz, mode_no) AS p FROM fx_modes))"""


@query("w03_close_groups", "cmp_id:i role mode_no:i group_no:i group_size:i group_lo:6 group_hi:6",
       "SELECT * FROM (" + W3_SQL.format(a="3e0", r="0.03e0") + ") WHERE group_size > 1")
def w03(t):
    return frf.close_groups(t.modes, ["cmp_id", "role"])


@query("w03_peak_groups", "cmp_id:i role mode_no:i group_no:i group_size:i", W3_SQL.format(a="3.5e0", r="0.035e0"))
def w03_peaks(t):
    return frf.close_groups(t.modes, ["cmp_id", "role"], 3.5, 0.035, singletons=True)


@query("w12_renumbered_modes", "cmp_id:i original_no:i mode_no:i",
       "SELECT cmp_id, mode_no AS original_no, row_number() OVER (PARTITION BY cmp_id ORDER BY frequency_hz, mode_no) AS mode_no FROM fx_modes WHERE role = 'EXP'")
def w12(t):
    return frf.renumber(t.modes.filter("role = 'EXP'"), ["cmp_id"])


BANDS_SQL = """bands AS (SELECT cmp_id, min(frequency_hz) AS lo, max(frequency_hz) AS hi, avg(frequency_hz) AS mid, count(*) AS n, g FROM (
 SELECT *, sum(CASE WHEN p IS NULL OR frequency_hz - p > greatest(3.5e0, 0.035e0 * 0.5e0 * (frequency_hz + p)) THEN 1 ELSE 0 END)
 OVER (PARTITION BY cmp_id ORDER BY frequency_hz, mode_no) AS g FROM (SELECT *, lag(frequency_hz) OVER (PARTITION BY cmp_id ORDER BY frequency_hz, mode_no) AS p
 FROM fx_modes WHERE role = 'EXP')) GROUP BY cmp_id, g)"""


def mode_bands(t):
    g = frf.close_groups(t.modes.filter("role = 'EXP'"), ["cmp_id"], 3.5, 0.035, singletons=True)
    return g.groupBy("cmp_id", "group_no").agg(F.min("group_lo").alias("lo_hz"), F.max("group_hi").alias("hi_hz"),
                                               F.avg("frequency_hz").alias("mid_hz"), F.count(F.lit(1)).alias("n"))


@query("j11_interval_association", "cmp_id:i band:i fe_mode:i window_hz:6",
       f"""WITH {BANDS_SQL} SELECT b.cmp_id, b.g AS band, f.mode_no AS fe_mode, greatest(3e0, 0.04e0 * mid, hi - lo) AS window_hz FROM bands b JOIN fx_modes f
 ON f.cmp_id = b.cmp_id AND f.role = 'FE' AND f.frequency_hz BETWEEN lo - greatest(3e0, 0.04e0 * mid, hi - lo) AND hi + greatest(3e0, 0.04e0 * mid, hi - lo)""")
def j11(t):
    peaks = t.modes.filter("role = 'FE'").select("cmp_id", F.col("mode_no").alias("fe_mode"), F.col("frequency_hz").alias("peak_hz"))
    return frf.interval_association(mode_bands(t), peaks, ["cmp_id"], 3.0, 0.04, True).withColumnRenamed("group_no", "band")


# Peaks -------------------------------------------------------------------------------------------------------------
def smoothed(t):
    return frf.smooth_indicator(frf.indicator(t.frf, t.coh))


SMOOTH_SQL = """i AS (SELECT dataset_id, ref_node, line, f_hz, sqrt(sum(re * re + im * im)) AS v FROM fx_frf GROUP BY 1, 2, 3, 4),
 y AS (SELECT dataset_id, ref_node, line, f_hz, log10(greatest(v, 1e-14 * max(v) OVER w)) AS y, row_number() OVER (PARTITION BY dataset_id, ref_node ORDER BY line) - 1 AS pos,
 count(*) OVER w AS n FROM i WINDOW w AS (PARTITION BY dataset_id, ref_node)),
 h AS (SELECT a.*, greatest(2, least(a.pos, a.n - 3)) AS c FROM y a WHERE n >= 6),
 s AS (SELECT h.dataset_id, h.ref_node, h.line, h.f_hz, h.pos, sum(b.y * (0.2e0 + (h.pos - c) * (b.pos - c) / 10e0 + (pow(h.pos - c, 2) - 2e0) * (pow(b.pos - c, 2) - 2e0) / 14e0)) AS smoothed
 FROM h JOIN y b ON h.dataset_id = b.dataset_id AND h.ref_node = b.ref_node AND abs(b.pos - c) <= 2 GROUP BY 1, 2, 3, 4, 5
 UNION ALL SELECT dataset_id, ref_node, line, f_hz, pos, y FROM y WHERE n < 6)"""
# Neighbouring maxima are two lines apart at least, so thinning (a distance of 2 below 1000 lines) takes out none.
PEAK_SQL = f"""{SMOOTH_SQL},
 x AS (SELECT * FROM (SELECT *, lag(smoothed) OVER w AS a, lead(smoothed) OVER w AS b FROM s WINDOW w AS (PARTITION BY dataset_id, ref_node ORDER BY pos)) WHERE smoothed > a AND smoothed > b),
 e AS (SELECT x.dataset_id, x.ref_node, x.pos, coalesce(max(CASE WHEN s.pos < x.pos AND s.smoothed > x.smoothed THEN s.pos END), -1) AS l,
 coalesce(min(CASE WHEN s.pos > x.pos AND s.smoothed > x.smoothed THEN s.pos END), 1000000000) AS r FROM x JOIN s USING (dataset_id, ref_node) GROUP BY 1, 2, 3),
 m AS (SELECT e.dataset_id, e.ref_node, e.pos, min(CASE WHEN s.pos <= e.pos THEN s.smoothed END) AS ml, min(CASE WHEN s.pos >= e.pos THEN s.smoothed END) AS mr
 FROM e JOIN s USING (dataset_id, ref_node) WHERE s.pos > e.l AND s.pos < e.r GROUP BY 1, 2, 3),
 g AS (SELECT dataset_id, ref_node, max(smoothed) - min(smoothed) AS span FROM s GROUP BY 1, 2),
 p AS (SELECT x.*, x.smoothed - greatest(ml, mr) AS prominence FROM x JOIN m USING (dataset_id, ref_node, pos) JOIN g USING (dataset_id, ref_node)
 WHERE x.smoothed - greatest(ml, mr) >= greatest(0.01e0, 0.02e0 * span) AND f_hz > 0)"""


@query("w07_smoothed_indicator", "dataset_id:i ref_node:i line:i smoothed:6", f"WITH {SMOOTH_SQL} SELECT dataset_id, ref_node, line, smoothed FROM s")
def w07(t):
    return smoothed(t)


@query("w08_indicator_peaks", "dataset_id:i ref_node:i line:i f_hz:6 prominence:6", f"WITH {PEAK_SQL} SELECT dataset_id, ref_node, line, f_hz, prominence FROM p")
def w08(t):
    return frf.find_peaks(smoothed(t))


@query("w09_ranked_peaks", "dataset_id:i ref_node:i line:i score:5 peak_no:i n_dropped:i",
       f"""WITH {PEAK_SQL},
 q AS (SELECT p.*, count(*) OVER w AS n, prominence + 0.25e0 * least(coalesce(c.coh, 0e0), 1e0) + 0.15e0 * (smoothed - min(smoothed) OVER w) / greatest(max(smoothed) OVER w - min(smoothed) OVER w, 1e-12) AS score
 FROM p LEFT JOIN (SELECT dataset_id, ref_node, line, avg(coh) AS coh FROM fx_coh GROUP BY 1, 2, 3) c USING (dataset_id, ref_node, line) WINDOW w AS (PARTITION BY dataset_id, ref_node)),
 k AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, ref_node ORDER BY score DESC, line DESC) AS k FROM q)
 SELECT dataset_id, ref_node, line, score, row_number() OVER (PARTITION BY dataset_id, ref_node ORDER BY line) AS peak_no, greatest(n - 40, 0) AS n_dropped FROM k WHERE k <= 40""")
def w09(t):
    return frf.rank_peaks(frf.find_peaks(smoothed(t)), keep=40)


@query("w10_half_power_damping", "dataset_id:i ref_node:i peak_line:i damping:6",
       """WITH i AS (SELECT dataset_id, ref_node, line, f_hz, sqrt(sum(re * re + im * im)) AS y FROM fx_frf GROUP BY 1, 2, 3, 4),
 w AS (SELECT *, lag(y) OVER z AS a, lead(y) OVER z AS b, min(line) OVER (PARTITION BY dataset_id, ref_node) AS first_, max(line) OVER (PARTITION BY dataset_id, ref_node) AS last_,
 lead(f_hz) OVER z AS fn, lag(f_hz) OVER z AS fp FROM i WINDOW z AS (PARTITION BY dataset_id, ref_node ORDER BY line)),
 p AS (SELECT * FROM w WHERE y > a AND y > b),
 l AS (SELECT p.dataset_id, p.ref_node, p.line, max(w.line) AS ll FROM p JOIN w ON w.dataset_id = p.dataset_id AND w.ref_node = p.ref_node AND w.line < p.line AND w.y <= p.y / sqrt(2e0) GROUP BY 1, 2, 3),
 r AS (SELECT p.dataset_id, p.ref_node, p.line, min(w.line) AS rl FROM p JOIN w ON w.dataset_id = p.dataset_id AND w.ref_node = p.ref_node AND w.line > p.line AND w.y <= p.y / sqrt(2e0) GROUP BY 1, 2, 3),
 z AS (SELECT p.dataset_id, p.ref_node, p.line AS peak_line, CASE WHEN ll IS NULL OR rl IS NULL OR ll = p.first_ OR rl = p.last_ THEN NULL ELSE
 ((rw.fp + (p.y / sqrt(2e0) - rw.a) * (rw.f_hz - rw.fp) / (rw.y - rw.a)) - (lw.f_hz + (p.y / sqrt(2e0) - lw.y) * (lw.fn - lw.f_hz) / (lw.b - lw.y))) / (2e0 * p.f_hz) END AS d
 FROM p LEFT JOIN l USING (dataset_id, ref_node, line) LEFT JOIN r USING (dataset_id, ref_node, line)
 LEFT JOIN w lw ON lw.dataset_id = p.dataset_id AND lw.ref_node = p.ref_node AND lw.line = ll LEFT JOIN w rw ON rw.dataset_id = p.dataset_id AND rw.ref_node = p.ref_node AND rw.line = rl)
 SELECT dataset_id, ref_node, peak_line, CASE WHEN d > 0 AND d < 0.5 THEN d END AS damping FROM z""")
def w10(t):
    i = frf.indicator(t.frf)
    n = with_order(i, frf.AXIS, F.floor(F.col("line") / 4096), ["line"], previous={"a": "indicator"}, following={"b": "indicator"})
    return frf.half_power_damping(n.filter("indicator > a and indicator > b"), i)


@query("w18_peak_shapes", "dataset_id:i ref_node:i line:i node_id:i dof:i re:4 im:4",
       """WITH i AS (SELECT dataset_id, ref_node, line, sqrt(sum(re * re + im * im)) AS y FROM fx_frf GROUP BY 1, 2, 3),
 p AS (SELECT * FROM (SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS b FROM i WINDOW w AS (PARTITION BY dataset_id, ref_node ORDER BY line)) WHERE y > a AND y > b)
 SELECT f.dataset_id, f.ref_node, f.line, rsp_node AS node_id, abs(rsp_dir) AS dof, sign(rsp_dir) * re AS re, sign(rsp_dir) * im AS im FROM fx_frf f JOIN p USING (dataset_id, ref_node, line)""")
def w18(t):
    i = frf.indicator(t.frf)
    n = with_order(i, frf.AXIS, F.floor(F.col("line") / 4096), ["line"], previous={"a": "indicator"}, following={"b": "indicator"})
    return frf.peak_shapes(n.filter("indicator > a and indicator > b"), t.frf)


# Close-mode bands ----------------------------------------------------------------------------------------------------
FRF_BANDS = """SELECT dataset_id, b AS band_id, 20e0 + 30e0 * b AS lo_hz, 55e0 + 30e0 * b AS hi_hz FROM (SELECT DISTINCT dataset_id FROM fx_frf)
 CROSS JOIN (SELECT 0 AS b UNION ALL SELECT 1 UNION ALL SELECT 2)"""


@query("w13_band_snapshots", "dataset_id:i band_id:i rsp_node:i ref_node:i line:i re:6 im:6",
       f"""WITH bands AS ({FRF_BANDS}), r AS (SELECT f.*, band_id, first_value(f.re) OVER w AS r0, first_value(f.im) OVER w AS i0, last_value(f.re) OVER w AS r1, last_value(f.im) OVER w AS i1,
 coalesce((f.line - min(f.line) OVER w) / nullif(max(f.line) OVER w - min(f.line) OVER w, 0), 0e0) AS t
 FROM fx_frf f JOIN bands b ON f.dataset_id = b.dataset_id AND f.f_hz BETWEEN lo_hz AND hi_hz
 WINDOW w AS (PARTITION BY f.dataset_id, band_id, rsp_node, ref_node ORDER BY f.line ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 c AS (SELECT dataset_id, line, least(greatest(avg(coh), 0.05e0), 1e0) AS coh FROM fx_coh GROUP BY 1, 2),
 d AS (SELECT r.dataset_id, band_id, rsp_node, ref_node, r.line, (re - (r0 * (1e0 - t) + r1 * t)) * sqrt(coalesce(coh, 1e0)) AS re, (im - (i0 * (1e0 - t) + i1 * t)) * sqrt(coalesce(coh, 1e0)) AS im
 FROM r LEFT JOIN c USING (dataset_id, line)),
 n AS (SELECT *, sqrt(sum(re * re + im * im) OVER (PARTITION BY dataset_id, band_id, ref_node, line)) AS norm FROM d)
 SELECT dataset_id, band_id, rsp_node, ref_node, line, re / s AS re, im / s AS im FROM (SELECT *, sqrt(greatest(norm, greatest(1e-12 * max(norm) OVER (PARTITION BY dataset_id, band_id), 1e-30))) AS s FROM n)""")
def w13(t):
    return frf.band_lines(t.sql(FRF_BANDS), t.frf, t.coh)


def components(t):
    bands = t.sql(FRF_BANDS)
    snaps = frf.band_lines(bands, t.frf, t.coh)
    return frf.band_components(snaps, bands.select("dataset_id", "band_id", F.lit(3).alias("wanted")))


@query("a24_band_components", "dataset_id:i band_id:i comp:i ratio:6 frequency_hz:4")
def a24(t):
    return components(t)[0]


@query("a24_component_shapes", "dataset_id:i band_id:i comp:i node_id:i dof:i magnitude:6")
def a24_shapes(t):
    return components(t)[1].withColumn("magnitude", F.hypot("re", "im"))


K4_SQL = f"SELECT *, candidate % 5 / 10e0 AS ratio, cmp_id % 3 AS missing FROM ({DUP_SQL})"


def dup(t):
    exp = t.modes.filter("role = 'EXP'")
    cand = exp.filter("mode_no % 4 = 3").select("cmp_id", F.col("mode_no").alias("candidate"), F.col("frequency_hz").alias("lo_hz"), F.col("frequency_hz").alias("hi_hz"))
    base = exp.filter("mode_no % 4 <> 3").select("cmp_id", F.col("mode_no").alias("existing"), F.col("frequency_hz").alias("peak_hz"))
    near = frf.interval_association(cand, base, ["cmp_id"], 3.0, 0.04)
    return near, mac.duplicate_mac(t.shapes, near.select("cmp_id", "candidate", "existing"))


@query("k04_extra_components", "cmp_id:i comp:i pick:i max_mac:6",
       f"SELECT cmp_id, candidate AS comp, max_mac, pick FROM (SELECT *, row_number() OVER (PARTITION BY cmp_id ORDER BY max_mac, ratio DESC, candidate) AS pick FROM ({K4_SQL})) WHERE pick <= missing")
def k04(t):
    c = dup(t)[1].withColumnRenamed("candidate", "comp").withColumn("ratio", F.col("comp") % 5 / 10).withColumn("missing", F.col("cmp_id") % 3)
    return frf.pick_components(c, ["cmp_id"])


@query("p21_peak_confidence", "cmp_id:i mode_no:i source_label confidence_label confidence_score:6",
       """SELECT cmp_id, mode_no, CASE WHEN dt IN (55, 2414) THEN 'Curve-fitted modal set' WHEN dt = 58 THEN 'FRF resonance peak' ELSE 'Imported modal vector' END AS source_label,
 CASE WHEN dt IN (55, 2414) THEN 'High' WHEN dt <> 58 THEN 'Imported' WHEN st = 'parse_error' THEN 'Peak-derived (coherence parse error)' WHEN st = 'unavailable' THEN 'Peak-derived (coherence unavailable)'
 WHEN coh >= 0.9 THEN 'High peak confidence' WHEN coh >= 0.7 THEN 'Medium peak confidence' ELSE 'Peak-derived' END AS confidence_label,
 CASE WHEN dt = 58 THEN CASE WHEN st = 'computed' THEN coh ELSE 0e0 END ELSE 1e0 END AS confidence_score
 FROM (SELECT *, CASE mode_no % 5 WHEN 0 THEN 55 WHEN 1 THEN 2414 WHEN 2 THEN 99 ELSE 58 END AS dt, CASE mode_no % 7 WHEN 0 THEN 'parse_error' WHEN 1 THEN 'unavailable' ELSE 'computed' END AS st,
 0.6e0 + 0.01e0 * (mode_no % 41) AS coh FROM fx_modes WHERE role = 'EXP')""")
def p21(t):
    m = t.modes.filter("role = 'EXP'").withColumn("dataset_type", F.expr("CASE mode_no % 5 WHEN 0 THEN 55 WHEN 1 THEN 2414 WHEN 2 THEN 99 ELSE 58 END"))
    m = m.withColumn("coherence_status", F.expr("CASE mode_no % 7 WHEN 0 THEN 'parse_error' WHEN 1 THEN 'unavailable' ELSE 'computed' END"))
    return frf.peak_confidence(m.withColumn("coherence", F.expr("0.6D + 0.01D * (mode_no % 41)")))


P22_SQL = f"""WITH d AS ({DUP_SQL}), nb AS (SELECT a.cmp_id, a.mode_no AS candidate, count(*) AS nearby FROM fx_modes a JOIN fx_modes b ON a.cmp_id = b.cmp_id AND a.role = 'EXP' AND b.role = 'EXP'
 AND a.mode_no % 4 = 3 AND b.mode_no % 4 <> 3 AND abs(a.frequency_hz - b.frequency_hz) <= greatest(3e0, 0.04e0 * a.frequency_hz) GROUP BY 1, 2),
 x AS (SELECT *, 1 + candidate % 2 AS wanted, 1 + cmp_id % 2 AS refs, candidate % 9 / 40e0 AS r FROM d JOIN nb USING (cmp_id, candidate)),
 y AS (SELECT *, concat_ws(';', CASE WHEN nearby >= wanted THEN 'enough independent peaks' END, CASE WHEN max_mac >= 0.9 THEN 'duplicate spatial shape' END,
 CASE WHEN refs < 2 THEN 'single reference' END, CASE WHEN refs >= 2 AND r < 0.05 THEN 'insufficient independent rank' END) AS reasons,
 CASE WHEN refs > 1 THEN 1e0 ELSE 0.2e0 END * least(r / 0.2e0, 1e0) * least(greatest((1e0 - max_mac) / 0.5e0, 0e0), 1e0) AS confidence_score FROM x)
 SELECT *, reasons = '' AS accepted, CASE WHEN confidence_score >= 0.75 THEN 'High' WHEN confidence_score >= 0.45 THEN 'Medium' ELSE 'Low' END AS confidence_label FROM y"""


def validated(t):
    near, best = dup(t)
    c = best.join(near.groupBy("cmp_id", "candidate").agg(F.count(F.lit(1)).alias("nearby")), ["cmp_id", "candidate"])
    c = (c.withColumn("wanted", 1 + F.col("candidate") % 2).withColumn("references", 1 + F.col("cmp_id") % 2)
         .withColumn("second_ratio", F.col("candidate") % 9 / 40))
    return frf.validate_close_modes(c).withColumn("reasons", F.concat_ws(";", "reasons"))


@query("p22_close_mode_validation", "cmp_id:i candidate:i reasons accepted confidence_score:6 confidence_label", P22_SQL)
def p22(t):
    return validated(t)


@query("u01_peak_and_candidate_union", "cmp_id:i original_no:i mode_no:i source",
       f"""SELECT cmp_id, m AS original_no, row_number() OVER (PARTITION BY cmp_id ORDER BY hz, m) AS mode_no, source FROM (
 SELECT cmp_id, mode_no AS m, frequency_hz AS hz, 'peak' AS source FROM fx_modes WHERE role = 'EXP' AND mode_no % 4 <> 3
 UNION ALL SELECT c.cmp_id, candidate, frequency_hz, 'component' FROM ({P22_SQL}) c JOIN fx_modes m ON m.cmp_id = c.cmp_id AND m.mode_no = candidate AND m.role = 'EXP' WHERE confidence_score >= 0.1)""")
def u01(t):
    exp = t.modes.filter("role = 'EXP'")
    good = validated(t).filter("confidence_score >= 0.1").select("cmp_id", F.col("candidate").alias("mode_no"), "confidence_score")
    extra = exp.select("cmp_id", "mode_no", "frequency_hz").join(good, ["cmp_id", "mode_no"]).withColumn("source", F.lit("component"))
    base = exp.filter("mode_no % 4 <> 3").select("cmp_id", "mode_no", "frequency_hz").withColumn("source", F.lit("peak"))
    return frf.renumber(base.unionByName(extra, allowMissingColumns=True), ["cmp_id"])

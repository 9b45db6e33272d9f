"""Queries of record tables, identities, logs, links and file sources."""
from __future__ import annotations

from pyspark.sql import functions as F

from modalframe.operators import mac, pairing
from modalframe.operators import records as rc
from modalframe.operators import sensitivity as se
from modalframe.plans.correlation import CAND_SQL, STATUS_SQL
from modalframe.plans.evidence import gated
from modalframe.plans.registry import query
from modalframe.plans.sensitivity import CENTRAL_SQL
from modalframe.session import scratch_path
from modalframe.sources import files

# Record classification -----------------------------------------------------------------------------------------------
CLASS_SQL = """lb AS (SELECT *, ds_type = 55 AND regexp_matches(id1, '(?i)\\s+residuals?\\s+(below|above)\\b') AS marked FROM fx_records),
 cl AS (SELECT *, CASE WHEN analysis_type IN (2, 3, 7) THEN CASE WHEN marked THEN 'ambiguous' ELSE 'physical' END WHEN analysis_type IN (1, 4, 5, 6) OR (ds_type = 2414 AND analysis_type = 9) THEN CASE WHEN marked THEN 'residual' ELSE 'non_modal' END ELSE 'ambiguous' END AS classification,
 CASE WHEN coalesce(analysis_type IN (2, 3, 7), false) THEN id1 WHEN marked THEN regexp_replace(id1, '(?i)\\s+residuals?\\s+(below|above).*$', '') ELSE id1 END AS processing_name FROM lb),
 fm AS (SELECT *, CASE WHEN ds_type = 55 THEN CASE WHEN freq > 1e-30 THEN freq ELSE abs(eig_im) / (2e0 * pi()) END ELSE freq END AS frequency_hz, coalesce(mode_n, record_index + 1) AS mode_no FROM fx_records),
 ms AS (SELECT cl.dataset_id, lower(processing_name) AS set_identity, arg_min(processing_name, cl.record_index) AS display_name, count(*) FILTER (classification IN ('physical', 'ambiguous') AND frequency_hz > 0) AS n_modes, count(*) FILTER (classification = 'residual') AS n_residual,
 count(*) FILTER (classification = 'non_modal') AS n_non_modal, count(*) FILTER (classification = 'ambiguous' AND frequency_hz > 0) AS n_ambiguous, count(*) FILTER (classification IN ('physical', 'ambiguous') AND NOT frequency_hz > 0) AS n_rejected
 FROM cl JOIN fm ON fm.record_index = cl.record_index WHERE cl.ds_type = 55 GROUP BY 1, 2 HAVING n_modes > 0),
 mk AS (SELECT *, trim(regexp_replace(set_identity, '[^a-z0-9]+', '-', 'g'), '-') AS set_key FROM ms)"""


@query("p07_record_classification", "record_index:i classification included processing_name", f"WITH {CLASS_SQL} SELECT *, classification NOT IN ('residual', 'non_modal') AS included FROM cl")
def p07(t):
    return rc.classify_records(t.records)


@query("s06_fitted_modes", "record_index:i mode_no:i frequency_hz:6 rejected", f"WITH {CLASS_SQL} SELECT *, NOT frequency_hz > 0 AS rejected FROM fm")
def s06(t):
    return rc.fitted_modes(t.records)


@query("a63_modal_sets", "dataset_id:i set_key display_name n_modes:i n_residual:i n_non_modal:i n_ambiguous:i n_rejected:i", f"WITH {CLASS_SQL} SELECT * FROM mk")
def a63(t):
    return rc.modal_sets(rc.classify_records(t.records), rc.fitted_modes(t.records))


REQ = "SELECT c_custkey AS dataset_id, CASE c_custkey % 4 WHEN 0 THEN 'PROC 1' WHEN 1 THEN 'proc-2' WHEN 2 THEN 'Proc 9' END AS requested FROM customer"


@query("p08_selected_set", "dataset_id:i set_key policy",
       f"""WITH {CLASS_SQL}, rq AS ({REQ}), n AS (SELECT dataset_id, count(*) AS n_sets, min(set_key) AS only_key FROM mk GROUP BY 1), h AS (SELECT mk.dataset_id, min(set_key) AS hit FROM mk JOIN rq USING (dataset_id) WHERE lower(requested) IN (lower(set_key), lower(display_name), set_identity) GROUP BY 1),
 p AS (SELECT n.*, hit, CASE WHEN requested IS NOT NULL THEN CASE WHEN hit IS NULL THEN 'refused: not found' ELSE 'explicit' END WHEN n_sets > 1 THEN 'refused: several sets' ELSE 'implicit_single_set' END AS policy FROM n LEFT JOIN rq USING (dataset_id) LEFT JOIN h USING (dataset_id))
 SELECT *, CASE policy WHEN 'explicit' THEN hit WHEN 'implicit_single_set' THEN only_key END AS set_key FROM p""")
def p08(t):
    return rc.select_set(rc.modal_sets(rc.classify_records(t.records), rc.fitted_modes(t.records)), t.sql(REQ))


TYPED = """SELECT *, CASE mode_no % 6 WHEN 0 THEN 55 WHEN 1 THEN 2414 WHEN 2 THEN 58 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 99 END AS dataset_type, CASE mode_no % 6 WHEN 3 THEN 'curve-fitted import' WHEN 4 THEN 'FRF peak list' END AS mode_source FROM fx_modes WHERE role = 'EXP'"""


@query("p12_record_class", "cmp_id:i mode_no:i record_class",
       f"""SELECT *, CASE WHEN dataset_type = 58 OR coalesce(mode_source, '') LIKE '%FRF peak%' THEN 'FRF_PEAK_RESPONSE_SNAPSHOT' WHEN dataset_type IN (55, 2414) OR coalesce(mode_source, '') LIKE '%curve-fitted%' THEN 'FITTED_EXPERIMENTAL_MODE' ELSE 'UNCLASSIFIED_EXPERIMENTAL_RECORD' END AS record_class FROM ({TYPED})""")
def p12(t):
    return rc.record_class(t.sql(TYPED))


SPARSE = "SELECT cmp_id, role, mode_no, node_id, dof, CASE WHEN dof = 2 OR (mode_no % 7 = 0 AND node_id > 1) OR (mode_no % 5 = 1 AND dof = 1) THEN 0e0 ELSE re END AS re, CASE WHEN dof = 2 OR (mode_no % 7 = 0 AND node_id > 1) OR (mode_no % 5 = 1 AND dof = 1) THEN 0e0 ELSE im END AS im FROM fx_shapes"
AXES_SQL = f"""sh AS ({SPARSE}), nd AS (SELECT cmp_id, role, mode_no, node_id, bool_or(dof = 1 AND re * re + im * im > 0) AS a1, bool_or(dof = 2 AND re * re + im * im > 0) AS a2, bool_or(dof = 3 AND re * re + im * im > 0) AS a3 FROM sh GROUP BY 1, 2, 3, 4),
 av AS (SELECT cmp_id, role, mode_no, sum(CASE WHEN a1 OR a2 OR a3 THEN 1 ELSE 0 END) AS n_points, CASE WHEN bool_or(a1) THEN 'x' ELSE '' END || CASE WHEN bool_or(a2) THEN 'y' ELSE '' END || CASE WHEN bool_or(a3) THEN 'z' ELSE '' END AS axes,
 sum(CASE WHEN a1 OR a2 OR a3 THEN 1 ELSE 0 END) >= 3 AS spatial_available FROM nd GROUP BY 1, 2, 3)"""


@query("p13_spatial_availability", "cmp_id:i role mode_no:i n_points:i axes spatial_available", f"WITH {AXES_SQL} SELECT * FROM av")
def p13(t):
    return rc.spatial_availability(t.sql(SPARSE))


@query("p11_mode_eligibility", "cmp_id:i mode_no:i check_status eligible",
       "SELECT cmp_id, mode_no, CASE WHEN specimen_id % 3 = 0 THEN 'NOT_AVAILABLE' ELSE 'PASS' END AS check_status, specimen_id % 3 = 0 OR frequency_hz >= 40e0 + 10e0 * specimen_id AS eligible FROM fx_modes WHERE role = 'EXP'")
def p11(t):
    lim = t.modes.select("specimen_id").distinct().filter("specimen_id % 3 <> 0").withColumn("suspension_max_hz", 40.0 + 10.0 * F.col("specimen_id"))
    return rc.mode_eligibility(t.modes.filter("role = 'EXP'"), lim)


@query("p28_coordinate_system_warnings", "dataset_id:i n_non_default:i has_2420",
       """SELECT dataset_id, sum(CASE WHEN node_id % 100 = 0 AND dataset_id % 3 = 0 THEN 0 ELSE CASE WHEN node_id % 4 NOT IN (0, 1) THEN 1 ELSE 0 END + CASE WHEN node_id % 7 NOT IN (0, 1) THEN 1 ELSE 0 END END) AS n_non_default, bool_or(node_id % 100 = 0 AND dataset_id % 3 = 0) AS has_2420 FROM fx_fe_points GROUP BY 1""")
def p28(t):
    return rc.local_coordinate_warnings(geometry_records(t))


def geometry_records(t):
    """One geometry record per (dataset, instance, row of ten nodes); every third dataset has a coordinate-system record."""
    p = t.fe_points.withColumn("cs", (F.col("node_id") % 100 == 0) & (F.col("dataset_id") % 3 == 0))
    item = F.struct("node_id", "x", "y", "z", (F.col("node_id") % 4).cast("int").alias("a"), (F.col("node_id") % 7).cast("int").alias("b"))
    g = p.groupBy("dataset_id", "cs", F.floor(F.col("node_id") / 10).alias("record_index")).agg(F.sort_array(F.collect_list(item)).alias("n"))
    return g.select("dataset_id", "record_index", F.when(F.col("cs"), 2420).when(F.col("record_index") % 2 == 0, 15).otherwise(2411).alias("ds_type"), F.col("n.node_id").alias("node_nums"),
                    F.col("n.x").alias("x"), F.col("n.y").alias("y"), F.col("n.z").alias("z"), F.col("n.a").alias("def_cs"), F.col("n.b").alias("disp_cs"))


@query("s05_record_geometry", "dataset_id:i node_id:i x:6 y:6 z:6",
       "SELECT dataset_id, node_id, x + CASE WHEN floor(node_id / 10) % 3 = 0 THEN 1e0 ELSE 0e0 END AS x, y, z FROM fx_fe_points WHERE NOT (node_id % 100 = 0 AND dataset_id % 3 = 0)")
def s05(t):
    r = geometry_records(t)
    later = r.filter("record_index % 3 = 0").withColumn("record_index", F.col("record_index") + 1000000).withColumn("x", F.transform("x", lambda v: v + 1.0))
    return rc.latest_geometry(r.unionByName(later))


@query("s06_fitted_shapes", "dataset_id:i mode_no:i node_id:i dof:i re:6 im:6 measured",
       """SELECT cmp_id AS dataset_id, mode_no, node_id, dof, CASE WHEN dof = 2 AND mode_no % 3 = 0 OR dof = 1 AND mode_no % 4 = 1 THEN 0e0 ELSE re END AS re, CASE WHEN dof = 2 AND mode_no % 3 = 0 OR dof = 1 AND mode_no % 4 = 1 THEN 0e0 ELSE im END AS im,
 NOT (dof = 2 AND mode_no % 3 = 0 OR dof = 1 AND mode_no % 4 = 1) AS measured FROM fx_shapes WHERE role = 'EXP'""")
def s06_shapes(t):
    s = t.shapes.filter("role = 'EXP'").withColumn("zero", F.expr("dof = 1 AND mode_no % 4 = 1"))
    per = lambda d, c: F.transform(F.sort_array(F.collect_list(F.when(F.col("dof") == d, F.struct("node_id", F.when(F.col("zero"), 0.0).otherwise(F.col(c)).alias("v"))))), lambda x: x["v"])
    g = s.groupBy(F.col("cmp_id").alias("dataset_id"), "mode_no").agg(F.sort_array(F.collect_set("node_id")).alias("node_nums"), *[per(d, c).alias(f"{c[0]}{d}") for d in (1, 2, 3) for c in ("re", "im")])
    for c in ("r2", "i2"):
        g = g.withColumn(c, F.when(F.col("mode_no") % 3 != 0, F.col(c)))
    return rc.record_shapes(g)


# Frequency reconciliation --------------------------------------------------------------------------------------------
TRUE_HZ = "CAST(floor(p_partkey / 20) AS BIGINT) AS package_id, p_partkey % 20 + 1 AS mode_no, 30e0 + 1.5e0 * (p_partkey % 20) + 0.0007e0 * (p_partkey % 13) AS hz"
FRAMES = f"""SELECT package_id, mode_no, CASE WHEN mode_no % 9 = 4 THEN CAST(round(hz + 0.3e0, 2) AS VARCHAR(20)) WHEN package_id % 11 = 3 AND mode_no = 1 THEN CAST(CAST(mode_no AS DOUBLE) AS VARCHAR(20)) ELSE CAST(round(hz, 2) AS VARCHAR(20)) END AS frame_text,
 CASE WHEN mode_no % 5 = 0 THEN CONCAT('Mode ', mode_no) WHEN mode_no % 9 = 4 AND package_id % 2 = 0 THEN CONCAT('Mode ', mode_no, ': Value = 1.0 Freq = ', CAST(round(hz + 0.3e0, 2) AS VARCHAR(20)), ' (cycles/time)') ELSE CONCAT('Mode ', mode_no, ': Value = 1.0 Freq = ', CAST(round(hz, 2) AS VARCHAR(20)), ' (cycles/time)') END AS description FROM (SELECT {TRUE_HZ} FROM part) b"""
EIGF = f"""SELECT package_id, mode_no, hz AS value FROM (SELECT {TRUE_HZ} FROM part) b WHERE package_id % 10 <> 0 AND NOT (package_id % 10 = 1 AND mode_no = 7)
 UNION ALL SELECT package_id, 100 AS mode_no, hz + 0.0021e0 AS value FROM (SELECT {TRUE_HZ} FROM part) b WHERE package_id % 10 = 2 AND mode_no = 3 UNION ALL SELECT package_id, mode_no, hz AS value FROM (SELECT {TRUE_HZ} FROM part) b WHERE package_id % 10 = 4 AND mode_no = 5"""
EIGV = f"""SELECT package_id, mode_no, pow(2e0 * 3.141592653589793e0 * hz, 2) * CASE WHEN mode_no = 6 THEN 1.001e0 ELSE 1e0 END AS value FROM (SELECT {TRUE_HZ} FROM part) b WHERE package_id % 10 IN (5, 6, 7) AND NOT (package_id % 10 = 7 AND mode_no = 2)"""
PREC = "greatest(0.5e0 * pow(10e0, -length(split_part({c}, '.', 2))), abs(CAST({c} AS DOUBLE)) * pow(2e0, -23))"
RECON_SQL = f"""fr AS ({FRAMES}), ef AS ({EIGF}), evl AS ({EIGV}), f1 AS (SELECT package_id, mode_no, min(value) AS f, count(*) AS nf FROM ef GROUP BY 1, 2), v1 AS (SELECT package_id, mode_no, min(value) AS v FROM evl GROUP BY 1, 2),
 hs AS (SELECT coalesce(f1.package_id, v1.package_id) AS package_id, count(f) AS kf, count(v) AS kv, max(nf) AS df, count(*) FILTER (f IS NULL OR v IS NULL) AS odd FROM f1 FULL JOIN v1 ON f1.package_id = v1.package_id AND f1.mode_no = v1.mode_no GROUP BY 1),
 d AS (SELECT fr.*, CAST(frame_text AS DOUBLE) AS fh, {PREC.format(c='frame_text')} AS tol, f, v, kf, kv, df, odd, EXISTS (SELECT 1 FROM f1 o WHERE o.package_id = fr.package_id AND o.mode_no <> fr.mode_no AND abs(o.f - CAST(fr.frame_text AS DOUBLE)) <= {PREC.format(c='fr.frame_text')}) AS twin
 FROM fr LEFT JOIN f1 ON f1.package_id = fr.package_id AND f1.mode_no = fr.mode_no LEFT JOIN v1 ON v1.package_id = fr.package_id AND v1.mode_no = fr.mode_no LEFT JOIN hs ON hs.package_id = fr.package_id),
 r AS (SELECT *, CASE WHEN coalesce(kf, 0) = 0 THEN 'history missing' WHEN df > 1 THEN 'frequency history has a mode twice' WHEN kv > 0 AND odd > 0 THEN 'histories cover unequal modes' WHEN f IS NULL THEN 'mode absent from history'
 WHEN NOT (fh > 0 AND abs(f - fh) <= tol) THEN 'history disagrees with frame' WHEN twin THEN 'frame fits a second mode' WHEN v IS NOT NULL AND NOT abs(sqrt(v) / (2e0 * pi()) - f) <= 4e0 * pow(2e0, -24) * f THEN 'eigenvalue disagrees with frequency' END AS reason FROM d)"""


@query("j13_reconciled_frequencies", "package_id:i mode_no:i frequency_hz:6 source reason", f"WITH {RECON_SQL} SELECT *, CASE WHEN reason IS NULL THEN f ELSE fh END AS frequency_hz, CASE WHEN reason IS NULL THEN 'history' ELSE 'frame' END AS source FROM r")
def j13(t):
    return rc.reconcile_frequencies(t.sql(FRAMES), t.sql(EIGF), t.sql(EIGV))


@query("j14_contradicting_frequencies", "package_id:i mode_no:i rejected reason",
       f"""WITH {RECON_SQL}, rl AS (SELECT f1.package_id, f1.mode_no, f1.f AS e FROM f1 LEFT JOIN v1 ON v1.package_id = f1.package_id AND v1.mode_no = f1.mode_no WHERE f1.package_id NOT IN (SELECT package_id FROM v1) OR (v IS NOT NULL AND abs(sqrt(v) / (2e0 * pi()) - f) <= 4e0 * pow(2e0, -24) * greatest(f, sqrt(v) / (2e0 * pi())) + 1e-12)),
 x AS (SELECT fr.*, CAST(frame_text AS DOUBLE) AS m, nullif(regexp_extract(description, 'Freq = ([0-9.]+)', 1), '') AS dt, e FROM fr LEFT JOIN rl ON rl.package_id = fr.package_id AND rl.mode_no = fr.mode_no),
 y AS (SELECT *, coalesce(CAST(dt AS DOUBLE), m) AS fv, {PREC.format(c='frame_text')} AS mt, CASE WHEN dt IS NULL THEN {PREC.format(c='frame_text')} ELSE {PREC.format(c='dt')} END AS ft FROM x),
 z AS (SELECT *, dt IS NOT NULL AND abs(m - CAST(dt AS DOUBLE)) > greatest(ft, mt) AS r1, e IS NOT NULL AND abs(fv - e) > ft + abs(e) * pow(2e0, -23) AS r2 FROM y)
 SELECT package_id, mode_no, r1 OR r2 AS rejected, concat_ws(';', CASE WHEN r1 THEN 'manifest contradicts its description' END, CASE WHEN r2 THEN CASE WHEN dt IS NULL THEN 'manifest' ELSE 'description' END || ' contradicts EIGFREQ' END, CASE WHEN (r1 OR r2) AND m = mode_no THEN 'value equals the mode number' END) AS reason FROM z""")
def j14(t):
    one = t.sql(EIGF).groupBy("package_id", "mode_no").agg(F.min("value").alias("value"))
    return rc.contradictions(t.sql(FRAMES), rc.reliable_history(one, t.sql(EIGV)))


LEFT_HZ = f"SELECT package_id, mode_no, hz AS left_hz FROM (SELECT {TRUE_HZ} FROM part) b WHERE mode_no % 19 <> 1"
RIGHT_HZ = f"SELECT package_id, mode_no, floor(hz * 1000e0 + 0.5e0) / 1000e0 + CASE WHEN mode_no % 8 = 3 THEN 0.01e0 ELSE 0e0 END AS right_hz FROM (SELECT {TRUE_HZ} FROM part) b WHERE mode_no % 17 <> 2"


@query("j15_printed_agreement", "package_id:i mode_no:i equal abs_diff:6",
       f"""WITH l AS ({LEFT_HZ}), r AS ({RIGHT_HZ}) SELECT coalesce(l.package_id, r.package_id) AS package_id, coalesce(l.mode_no, r.mode_no) AS mode_no, coalesce(round_even(left_hz * 1000e0, 0) = round_even(right_hz * 1000e0, 0), false) AS equal, abs(left_hz - right_hz) AS abs_diff FROM l FULL JOIN r ON l.package_id = r.package_id AND l.mode_no = r.mode_no""")
def j15(t):
    return rc.same_printed(t.sql(LEFT_HZ), t.sql(RIGHT_HZ), ["package_id", "mode_no"])


# Logs and links ------------------------------------------------------------------------------------------------------
@query("w14_active_state", "series_key:i n_entries:i seq:i state",
       "SELECT series_key, n_entries, seq, CASE WHEN action <> 'WITHDRAWN' THEN action END AS state FROM (SELECT *, count(*) OVER (PARTITION BY series_key) AS n_entries, row_number() OVER (PARTITION BY series_key ORDER BY recorded_at DESC, seq DESC) AS k FROM fx_log) WHERE k = 1")
def w14(t):
    return rc.active_state(t.log)


@query("w16_first_evaluations", "series_key:i candidate_hash seq:i outcome n_replayed:i",
       "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY series_key, candidate_hash) - 1 AS n_replayed, row_number() OVER (PARTITION BY series_key, candidate_hash ORDER BY seq) AS k FROM fx_log) WHERE k = 1")
def w16(t):
    return rc.first_evaluations(t.log)


@query("a66_run_counts", "series_key:i n_evaluations:i n_reused:i n_solves:i n_failed:i",
       "SELECT series_key, count(*) AS n_evaluations, count(*) FILTER (outcome = 'REUSED') AS n_reused, count(*) FILTER (outcome <> 'REUSED') AS n_solves, count(*) FILTER (outcome = 'FAILED') AS n_failed FROM fx_log GROUP BY 1")
def a66(t):
    return rc.run_counts(t.log)


RUNS = """SELECT test_run_id, CASE WHEN test_run_id % 50 = 20 THEN test_run_id + 1 WHEN test_run_id % 50 = 21 THEN test_run_id - 1 WHEN test_run_id % 97 = 5 THEN 99999999 ELSE remount_of END AS remount_of, CASE WHEN test_run_id % 31 = 2 THEN NULL ELSE specimen_id END AS specimen_id,
 CASE WHEN test_run_id % 41 = 3 THEN 'd2' ELSE 'd1' END AS design_id, CASE WHEN test_run_id % 23 = 6 THEN NULL WHEN test_run_id % 5 = 0 THEN 'B' ELSE 'A' END AS protocol, grid_id % 2 AS grid_id FROM fx_runs"""
# Some runs are recorded twice.
TWICE = f"""{RUNS} UNION ALL
 SELECT test_run_id, remount_of, specimen_id, 'd1' AS design_id, 'A' AS protocol, grid_id % 2 AS grid_id FROM fx_runs WHERE test_run_id % 61 = 7"""


@query("j24_remount_eligibility", "test_run_id:i remount_of:i eligibility",
       f"""WITH r AS (SELECT DISTINCT * FROM ({RUNS})) SELECT a.test_run_id, a.remount_of, CASE WHEN a.specimen_id IS NULL OR b.specimen_id IS NULL THEN 'INSUFFICIENTLY_DOCUMENTED' WHEN a.specimen_id <> b.specimen_id OR a.design_id <> b.design_id THEN 'NOT_ELIGIBLE'
 WHEN a.protocol IS NULL OR b.protocol IS NULL THEN 'INSUFFICIENTLY_DOCUMENTED' WHEN a.protocol <> b.protocol THEN 'NOT_ELIGIBLE' WHEN a.grid_id <> b.grid_id THEN 'FREQUENCY_ONLY' ELSE 'FREQUENCY_AND_SHAPE' END AS eligibility FROM r a JOIN r b ON a.remount_of = b.test_run_id""")
def j24(t):
    return rc.classify_repeats(t.sql(RUNS).distinct())


@query("j25_link_problems", "test_run_id:i problem",
       f"""WITH RECURSIVE r AS ({TWICE}), o AS (SELECT test_run_id, any_value(remount_of) AS remount_of, any_value(specimen_id) AS specimen_id FROM r WHERE test_run_id % 61 <> 7 GROUP BY 1 UNION ALL SELECT test_run_id, remount_of, specimen_id FROM fx_runs WHERE test_run_id % 61 = 7),
 k AS (SELECT o.test_run_id, o.remount_of, o.specimen_id, b.specimen_id AS ts FROM o JOIN o b ON b.test_run_id = o.remount_of), w AS (SELECT test_run_id, remount_of AS t FROM k UNION SELECT w.test_run_id, k.remount_of FROM w JOIN k ON k.test_run_id = w.t)
 SELECT test_run_id, 'duplicate run' AS problem FROM r GROUP BY 1 HAVING count(*) > 1 UNION SELECT test_run_id, 'unknown target' FROM o WHERE remount_of IS NOT NULL AND remount_of NOT IN (SELECT test_run_id FROM o)
 UNION SELECT test_run_id, 'different specimen' FROM k WHERE NOT coalesce(specimen_id = ts, false) UNION SELECT test_run_id, 'cycle' FROM w WHERE t IN (SELECT test_run_id FROM w w2 WHERE w2.test_run_id = w2.t)
 UNION SELECT test_run_id, 'contradictory identity' FROM r WHERE specimen_id IN (SELECT specimen_id FROM r WHERE specimen_id IS NOT NULL GROUP BY 1 HAVING min(design_id) <> max(design_id))""")
def j25(t):
    r = t.sql(TWICE)
    # the duplicated runs carry equal links here, so which copy is followed does not matter
    fixed = t.runs.filter("test_run_id % 61 = 7").select("test_run_id", F.col("remount_of").alias("_r"), F.col("specimen_id").alias("_s"))
    r = r.join(fixed, "test_run_id", "left").withColumn("remount_of", F.when(F.col("_s").isNotNull(), F.col("_r")).otherwise(F.col("remount_of"))).withColumn("specimen_id", F.coalesce("_s", "specimen_id"))
    return rc.link_problems(r.drop("_r", "_s"))


JOBS = """SELECT s_suppkey AS specimen_id, k AS perturbation_id, CONCAT(s_suppkey, CASE WHEN s_suppkey % 9 = 2 AND k = 'E+' THEN '-old' ELSE '' END, '-', k) AS job FROM supplier CROSS JOIN (SELECT 'E+' AS k UNION ALL SELECT 'E-' AS k UNION ALL SELECT 'G+' AS k) ks WHERE NOT (s_suppkey % 5 = 1 AND k = 'E-')"""


@query("j26_job_completeness", "specimen_id:i perturbation_id planned_job status",
       """SELECT s_suppkey AS specimen_id, k AS perturbation_id, s_suppkey || '-' || k AS planned_job, CASE WHEN k = 'G-' OR (s_suppkey % 5 = 1 AND k = 'E-') THEN 'MISSING' WHEN s_suppkey % 9 = 2 AND k = 'E+' THEN 'WRONG_JOB' ELSE 'COMPLETE' END AS status FROM supplier, (SELECT unnest(['E+', 'E-', 'G+', 'G-']) AS k)""")
def j26(t):
    return rc.job_completeness(t.supplier.select(F.col("s_suppkey").alias("specimen_id")), [(k, f"-{k}") for k in ("E+", "E-", "G+", "G-")], t.sql(JOBS))


INV = "SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS package_id, CASE WHEN p_partkey % 20 = 0 THEN 'geometry' ELSE 'mode' END AS role, CONCAT('f', p_partkey % 20) AS path, CAST(p_size AS BIGINT) AS size, sha2(p_name, 256) AS sha256 FROM part"


@query("j21_file_identity", "package_id:i role path state",
       """WITH a AS (SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS package_id, CASE WHEN p_partkey % 20 = 0 THEN 'geometry' ELSE 'mode' END AS role, 'f' || p_partkey % 20 AS path, p_partkey AS k FROM part)
 SELECT package_id, role, path, CASE WHEN k % 13 = 1 THEN 'missing' WHEN k % 13 = 2 THEN 'new' WHEN k % 13 IN (3, 4) THEN 'changed' ELSE 'equal' END AS state FROM a""")
def j21(t):
    i = t.sql(INV.replace(" FROM part", ", p_partkey AS k FROM part"))
    now = i.filter("k % 13 <> 1").withColumn("sha256", F.when(F.col("k") % 13 == 3, F.sha2("sha256", 256)).otherwise(F.col("sha256"))).withColumn("size", F.when(F.col("k") % 13 == 4, F.col("size") + 1).otherwise(F.col("size")))
    return rc.compare_inventories(i.filter("k % 13 <> 2").drop("k"), now.drop("k"))


@query("a56_geometry_identity", "dataset_id:i n_nodes:i n_duplicates:i geometry_hash")
def a56(t):
    return rc.geometry_identity(t.fe_points)


@query("a65_package_row_counts", "package_id:i n_geometry:i problems",
       """WITH g AS (SELECT dataset_id AS package_id, count(*) AS n FROM fx_fe_points GROUP BY 1) SELECT package_id, n AS n_geometry, concat_ws(';', CASE WHEN package_id % 6 = 1 THEN 'geometry count differs' END, CASE WHEN package_id % 5 = 2 THEN 'a mode file misses nodes' END, CASE WHEN package_id % 4 = 3 THEN 'instances differ' END) AS problems FROM g""")
def a65(t):
    g = t.fe_points.withColumnRenamed("dataset_id", "package_id")
    man = g.groupBy("package_id").agg(F.count(F.lit(1)).alias("n")).select("package_id", F.when(F.col("package_id") % 6 == 1, F.col("n") + 1).otherwise(F.col("n")).alias("geometry_node_count"))
    rows = g.select("package_id", "node_id", F.explode(F.array(F.lit(7), F.lit(8))).alias("mode_no")).filter("not (package_id % 5 = 2 and mode_no = 8 and node_id % 100 = 3)")
    deck = g.select("package_id", F.lower("instance").alias("instance")).distinct().filter("not (package_id % 4 = 3 and instance = 'i1')")
    return rc.package_row_counts(man, g, rows, deck)


# Reviews and applicability -------------------------------------------------------------------------------------------
REVIEWS = "SELECT cmp_id, fe_mode, CASE fe_mode % 8 WHEN 0 THEN 'Accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'unresolved' WHEN 3 THEN 'whatever' ELSE 'automatic' END AS decision, CASE WHEN fe_mode % 16 = 0 THEN exp_mode + 1 END AS manual_exp FROM fx_pairs WHERE fe_mode % 8 < 5"


@query("j20_manual_overrides", "cmp_id:i fe_mode:i exp_mode:i decision final_exp:i replaced mac:6",
       f"""WITH au AS (SELECT cmp_id, fe_mode, CASE WHEN fe_mode % 32 <> 16 THEN exp_mode END AS exp_mode FROM fx_pairs), rv AS ({REVIEWS}), j AS (SELECT coalesce(au.cmp_id, rv.cmp_id) AS cmp_id, coalesce(au.fe_mode, rv.fe_mode) AS fe_mode, exp_mode, CASE WHEN lower(decision) IN ('accepted', 'rejected', 'unresolved') THEN lower(decision) ELSE 'automatic' END AS decision, manual_exp
 FROM au FULL JOIN rv ON au.cmp_id = rv.cmp_id AND au.fe_mode = rv.fe_mode), k AS (SELECT *, CASE decision WHEN 'accepted' THEN coalesce(manual_exp, exp_mode) WHEN 'automatic' THEN exp_mode END AS final_exp FROM j),
 m AS (SELECT k.cmp_id, k.fe_mode, k.final_exp, (pow(sum(a.re * b.re + a.im * b.im), 2) + pow(sum(a.re * b.im - a.im * b.re), 2)) / (sum(a.re * a.re + a.im * a.im) * sum(b.re * b.re + b.im * b.im)) AS mac FROM k
 JOIN fx_shapes a ON a.cmp_id = k.cmp_id AND a.role = 'FE' AND a.mode_no = k.fe_mode JOIN fx_shapes b ON b.cmp_id = k.cmp_id AND b.role = 'EXP' AND b.measured AND b.mode_no = final_exp AND a.node_id = b.node_id AND a.dof = b.dof GROUP BY 1, 2, 3)
 SELECT k.cmp_id, k.fe_mode, exp_mode, decision, k.final_exp, coalesce(k.final_exp <> exp_mode, k.final_exp IS NOT NULL) AS replaced, mac FROM k LEFT JOIN m ON m.cmp_id = k.cmp_id AND m.fe_mode = k.fe_mode""")
def j20(t):
    auto = t.pairs.select("cmp_id", "fe_mode", F.when(F.col("fe_mode") % 32 != 16, F.col("exp_mode")).alias("exp_mode"))
    r = rc.apply_reviews(auto, t.sql(REVIEWS))
    chosen = r.filter("final_exp is not null").select("cmp_id", "fe_mode", F.col("final_exp").alias("exp_mode"))
    m = mac.masked_mac(chosen, t.shapes).select("cmp_id", "fe_mode", "mac")
    return r.join(m, ["cmp_id", "fe_mode"], "left")


ARCHIVED = """SELECT cmp_id, fe_mode AS row_id, fe_mode, CASE WHEN fe_mode % 14 = 3 THEN exp_mode + 1 ELSE exp_mode END AS exp_mode, fe_hz * CASE WHEN fe_mode % 10 = 7 THEN 1.01e0 ELSE 1e0 END AS fe_hz, exp_hz, CASE WHEN fe_mode % 12 = 5 THEN 'branch not resolved' END AS branch_problem, 0.01e0 * (fe_mode % 40) AS s FROM fx_pairs"""


@query("j32_archive_applicability", "cmp_id:i row_id:i applicable reason s:6",
       f"""WITH ar AS ({ARCHIVED}), ct AS (SELECT *, CASE WHEN mac < 0.8 THEN 'LOW_MAC' ELSE 'MAC_SUPPORTED' END AS category FROM fx_pairs),
 x AS (SELECT ar.*, f.frequency_hz AS lf, e.frequency_hz AS le, category FROM ar LEFT JOIN fx_modes f ON f.cmp_id = ar.cmp_id AND f.role = 'FE' AND f.mode_no = ar.fe_mode LEFT JOIN fx_modes e ON e.cmp_id = ar.cmp_id AND e.role = 'EXP' AND e.mode_no = ar.exp_mode LEFT JOIN ct ON ct.cmp_id = ar.cmp_id AND ct.fe_mode = ar.fe_mode AND ct.exp_mode = ar.exp_mode),
 y AS (SELECT *, CASE WHEN branch_problem IS NOT NULL THEN branch_problem WHEN NOT coalesce(abs(lf - fe_hz) <= 1e-6 * greatest(lf, fe_hz), false) THEN 'FE mode missing or different' WHEN NOT coalesce(abs(le - exp_hz) <= 1e-6 * greatest(le, exp_hz), false) THEN 'measured mode missing or different'
 WHEN category IS NULL THEN 'not paired in the comparison' WHEN category <> 'MAC_SUPPORTED' THEN 'pair is ' || category END AS reason FROM x) SELECT cmp_id, row_id, reason IS NULL AS applicable, reason, CASE WHEN reason IS NULL THEN s END AS s FROM y""")
def j32(t):
    cat = t.pairs.withColumn("category", F.when(F.col("mac") < 0.8, "LOW_MAC").otherwise("MAC_SUPPORTED"))
    return rc.applicability(t.sql(ARCHIVED), t.modes, cat)


@query("j35_contract_failures", "dataset_id:i check_name actual expected",
       """WITH a AS (SELECT cmp_id AS dataset_id, count(*) AS n_modes FROM fx_modes WHERE role = 'EXP' GROUP BY 1), m AS (SELECT cmp_id AS dataset_id, count(DISTINCT node_id) AS n_points, count(DISTINCT CASE WHEN measured THEN dof END) AS n_dofs FROM fx_shapes WHERE role = 'EXP' GROUP BY 1),
 x AS (SELECT a.*, n_points, n_dofs FROM a JOIN m USING (dataset_id))
 SELECT dataset_id, 'n_modes' AS check_name, CAST(n_modes AS VARCHAR) AS actual, CAST(n_modes + 1 AS VARCHAR) AS expected FROM x WHERE dataset_id % 4 = 1 UNION ALL SELECT dataset_id, 'n_points', CAST(n_points AS VARCHAR), '11' FROM x WHERE dataset_id % 5 = 2 UNION ALL SELECT dataset_id, 'n_dofs', CAST(n_dofs AS VARCHAR), '1' FROM x WHERE dataset_id % 6 = 3""")
def j35(t):
    a = t.modes.filter("role = 'EXP'").groupBy(F.col("cmp_id").alias("dataset_id")).agg(F.count(F.lit(1)).alias("n_modes"))
    m = t.shapes.filter("role = 'EXP'").groupBy(F.col("cmp_id").alias("dataset_id")).agg(F.countDistinct("node_id").alias("n_points"), F.countDistinct(F.when(F.col("measured"), F.col("dof"))).alias("n_dofs"))
    actual = a.join(m, "dataset_id")
    d = F.col("dataset_id")
    pinned = actual.select("dataset_id", F.when(d % 4 == 1, F.col("n_modes") + 1).otherwise(F.col("n_modes")).alias("n_modes"), F.when(d % 5 == 2, 11).otherwise(F.col("n_points")).alias("n_points"), F.when(d % 6 == 3, 1).otherwise(F.col("n_dofs")).alias("n_dofs"))
    return rc.contract_failures(actual, pinned, ["n_modes", "n_points", "n_dofs"])


# File sources: the tables are written by Spark first, then read back by the scan under test ---------------------------
def manifests(t):
    """Package manifests (one JSON document per line) written below the scratch folder."""
    f = t.sql(FRAMES)
    item = F.struct(F.col("mode_no").alias("mode"), F.col("frame_text").cast("double").alias("frequency_hz"), F.col("mode_no").alias("frame_index"), "description",
                    F.concat(F.lit("mode_"), "mode_no", F.lit(".csv")).alias("file"), F.lit(10).cast("bigint").alias("node_count"))
    m = f.groupBy("package_id").agg(F.sort_array(F.collect_list(item)).alias("modes"))
    h = t.sql(EIGF).groupBy("package_id").agg(F.array(F.struct(F.lit("EIGFREQ").alias("name"), F.lit("Assembly").alias("region"), F.lit("frequency").alias("description"), F.sort_array(F.collect_list(F.array(F.col("mode_no").cast("double"), "value"))).alias("data"))).alias("history"))
    m = m.join(h, "package_id", "left").select("package_id", F.when(F.col("package_id") % 4 == 0, 1).otherwise(2).alias("format_version"), F.when(~(F.col("package_id") % 6).isin(0, 3), "geometry.csv").alias("geometry_file"), F.lit(10).alias("geometry_node_count"), F.lit("Step-1").alias("step_name"), "modes", "history")
    path = scratch_path(t.spark, "manifests")
    m.write.mode("error").json(path)
    return path


@query("s01_package_manifests", "package_id:i format_version:i refused mode_no:i frequency_hz:6 file",
       f"WITH fr AS ({FRAMES}) SELECT package_id, CASE WHEN package_id % 4 = 0 THEN 1 ELSE 2 END AS format_version, package_id % 4 <> 0 AND package_id % 6 IN (0, 3) AS refused, mode_no, CAST(frame_text AS DOUBLE) AS frequency_hz, 'mode_' || mode_no || '.csv' AS file FROM fr")
def s01(t):
    return files.read_manifests(t.spark, manifests(t), one_per_file=False)


@query("s04_history_rows", "package_id:i region name x:i value:6", f"SELECT package_id, 'Assembly' AS region, 'EIGFREQ' AS name, mode_no AS x, value FROM ({EIGF})")
def s04(t):
    return files.read_history(t.spark, manifests(t), one_per_file=False)


def geometry_path(t):
    path = scratch_path(t.spark, "geometry")
    t.fe_points.select("dataset_id", "instance", F.col("node_id").alias("node_label"), "x", "y", "z").repartition("dataset_id").write.partitionBy("dataset_id").options(**files.BY_TASKS).option("header", True).csv(path)
    return path


@query("s02_geometry_files", "dataset_id:i instance node_id:i x:6 y:6 z:6", "SELECT dataset_id, instance, node_id, x, y, z FROM fx_fe_points")
def s02(t):
    return files.read_geometry(t.spark, geometry_path(t))


MODE_ROWS = "SELECT dataset_id, node_id, instance, m AS mode_no, sin(0.1e0 * x * m) AS u1, 0.5e0 * y AS u2, cos(0.1e0 * y) * m AS u3, 0.25e0 * z AS v1 FROM fx_fe_points CROSS JOIN (SELECT 7 AS m UNION ALL SELECT 8 AS m) ms"


@query("s03_mode_files", "dataset_id:i mode_no:i node_id dof:i re:6 im:6 x:6 y:6 z:6",
       f"""SELECT r.dataset_id, mode_no, r.instance || ':' || r.node_id AS node_id, d AS dof, CASE d WHEN 1 THEN u1 WHEN 2 THEN u2 ELSE u3 END AS re, CASE d WHEN 1 THEN v1 ELSE 0e0 END AS im, CASE WHEN r.node_id % 50 = 3 THEN 0e0 ELSE p.x END AS x, CASE WHEN r.node_id % 50 = 3 THEN 0e0 ELSE p.y END AS y, CASE WHEN r.node_id % 50 = 3 THEN 0e0 ELSE p.z END AS z
 FROM ({MODE_ROWS}) r JOIN fx_fe_points p ON p.node_id = r.node_id, (SELECT unnest([1, 2, 3]) AS d)""")
def s03(t):
    path = scratch_path(t.spark, "modes")
    r = t.sql(MODE_ROWS).select("dataset_id", "mode_no", "instance", F.col("node_id").alias("node_label"), F.col("u1").alias("u1_real"), F.col("u2").alias("u2_real"), F.col("u3").alias("u3_real"),
                                F.col("v1").alias("u1_imag"), F.lit(0.0).alias("u2_imag"), F.lit(0.0).alias("u3_imag"))
    r.repartition("dataset_id", "mode_no").write.partitionBy("dataset_id", "mode_no").options(**files.BY_TASKS).option("header", True).csv(path)
    geo = files.read_geometry(t.spark, geometry_path(t)).filter("node_id % 50 <> 3")
    return files.read_mode_files(t.spark, path, geo)


@query("s07_log_eigenvalues", "package_id:i step:i mode_no:i eigenvalue:4 frequency_hz:4",
       f"""SELECT package_id, s AS step, mode_no, round(pow(2e0 * pi() * hz, 2) * s, 4) AS eigenvalue, round(hz * s, 4) AS frequency_hz FROM (SELECT {TRUE_HZ} FROM part), (SELECT unnest([1, 2]) AS s)""")
def s07(t):
    line = F.format_string("%8d%s %16.4f %12.4f %12.4f %10.4f", "mode_no", F.when(F.col("mode_no") == 1, "*").otherwise(""), F.col("ev"), F.col("hz") * 6.2831853, F.col("hz"), F.lit(0.0))
    b = t.sql(f"SELECT {TRUE_HZ} FROM part").withColumn("step", F.explode(F.array(F.lit(1), F.lit(2))))
    b = b.withColumn("ev", F.pow(2 * 3.141592653589793 * F.col("hz"), 2) * F.col("step")).withColumn("hz", F.col("hz") * F.col("step")).withColumn("line", line)
    sec = b.groupBy("package_id", "step").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("mode_no", "line"))), lambda v: v["line"])).alias("rows"))
    sec = sec.withColumn("text", F.concat(F.lit("\n      S T E P       "), F.col("step"), F.lit("     C A L C U L A T I O N   O F   E I G E N V A L U E S\n\n   E I G E N V A L U E    O U T P U T\n\n MODE NO      EIGENVALUE\n\n"), F.col("rows"),
                                          F.lit("\n\n   EIGENVALUES MARKED BY * ARE SHIFTED\n   P A R T I C I P A T I O N\n       1   1.0  2.0  3.0  4.0\n")))
    doc = sec.groupBy("package_id").agg(F.concat_ws("\n", F.lit("HEADER"), F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("step", "text"))), lambda v: v["text"]))).alias("value"))
    path = scratch_path(t.spark, "logs")
    files.write_texts(doc.withColumn("name", F.concat(F.lit("package_id="), F.coalesce(F.col("package_id").cast("string"), F.lit("")))), path)
    out = files.read_eigenvalue_tables(t.spark, path)
    return out.withColumn("package_id", F.regexp_extract("file", r"package_id=(\d+)", 1))


DECKS = """SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS deck_id, 50000 + max(p_size) AS e1, max(p_retailprice) AS e2, 0.5e0 + 0.01e0 * min(p_size) AS h FROM part GROUP BY 1"""


@query("s08_deck_materials", "deck_id:i name value:6",
       f"""WITH d AS ({DECKS}) SELECT deck_id, name, value FROM d, LATERAL (SELECT unnest(['E1', 'E2', 'E3', 'nu12', 'nu13', 'nu23', 'G12', 'G13', 'G23', 'rho', 'h']) AS name, unnest([e1, e2, 9000e0, 0.05e0, 0.3e0, 0.31e0, 4500e0, 3000e0, 2800e0, 1.5e-9, h]) AS value)""")
def s08(t):
    d = t.sql(DECKS)
    text = F.concat_ws("\n", F.lit("*Heading"), F.lit("*Material, name=carbon"), F.lit("*Density"), F.lit(" 1.5e-09,"), F.lit("*Elastic, type=ENGINEERING CONSTANTS"),
                       F.concat_ws(", ", F.col("e1").cast("string"), F.col("e2").cast("string"), F.lit("9000., 0.05, 0.3, 0.31, 4500., 3000.")), F.lit(" 2800.,"),
                       F.lit("*Shell Section, elset=plate, material=carbon"), F.concat(F.format_string("%.2f", "h"), F.lit(", 5")), F.lit("*Step"))
    path = scratch_path(t.spark, "decks")
    files.write_texts(d.select(F.concat(F.lit("deck_id="), F.coalesce(F.col("deck_id").cast("string"), F.lit(""))).alias("name"), text.alias("value")), path)
    return files.read_material_decks(t.spark, path).withColumn("deck_id", F.regexp_extract("file", r"deck_id=(\d+)", 1))


MTX = "SELECT matrix_id, i + 1 AS i, j + 1 AS j, value FROM fx_matrix WHERE i >= j"


def matrix_path(t):
    m = t.sql(MTX)
    text = F.concat_ws(", ", F.floor((F.col("i") + 2) / 3), (F.col("i") - 1) % 3 + 1, F.floor((F.col("j") + 2) / 3), (F.col("j") - 1) % 3 + 1, F.regexp_replace(F.format_string("%.9e", "value"), "e", "D"))
    lines = m.select("matrix_id", text.alias("value"))
    odd = m.filter("matrix_id % 4 = 3 and i = 5 and j = 2").select("matrix_id", F.lit("1, 2, 2, 2, 1.0").alias("value"))
    head = m.select("matrix_id").distinct().withColumn("value", F.lit("** comment"))
    path = scratch_path(t.spark, "matrix")
    lines.unionByName(odd).unionByName(head).repartition("matrix_id").write.partitionBy("matrix_id").text(path)
    return path


@query("s09_matrix_files", "matrix_id:i i:i j:i value:7",
       f"WITH m AS ({MTX}), bad AS (SELECT DISTINCT matrix_id FROM m WHERE matrix_id % 4 = 3 AND i = 5 AND j = 2), k AS (SELECT * FROM m WHERE matrix_id NOT IN (SELECT matrix_id FROM bad) AND value <> 0) SELECT * FROM k UNION ALL SELECT matrix_id, j, i, value FROM k WHERE i <> j")
def s09(t):
    e, _ = files.read_matrix_entries(t.spark, matrix_path(t))
    return e.select("matrix_id", ((F.col("i_node") - 1) * 3 + F.col("i_dof")).alias("i"), ((F.col("j_node") - 1) * 3 + F.col("j_dof")).alias("j"), "value")


@query("s10_file_inventory", "package_id:i path role size:i sha256")
def s10(t):
    path = scratch_path(t.spark, "package")
    g = t.fe_points.select(F.col("dataset_id").alias("package_id"), F.concat_ws(",", "instance", "node_id", "x", "y").alias("value"))
    g.repartition("package_id").write.partitionBy("package_id").text(path)
    return files.file_inventory(t.spark, path)


@query("s10_package_hashes", "package_id:i n_files:i package_sha256")
def s10_hashes(t):
    path = scratch_path(t.spark, "package")
    g = t.fe_points.select(F.col("dataset_id").alias("package_id"), F.concat_ws(",", "instance", "node_id", "x", "y").alias("value"))
    g.repartition("package_id").write.partitionBy("package_id").text(path)
    inv = files.file_inventory(t.spark, path)
    return files.package_hashes(inv.withColumn("path", F.lit("geometry")))


# Sinks ---------------------------------------------------------------------------------------------------------------
@query("s11_candidate_evidence", "cmp_id:i fe_mode:i exp_mode:i mac:6 admissible reasons",
       CAND_SQL + " SELECT *, abs(err) <= 15 AND mac >= 0.5 AND coverage_status = 'accepted' AS admissible, concat_ws(';', CASE WHEN abs(err) > 15 THEN 'frequency' END, CASE WHEN mac < 0.5 THEN 'mac' END, CASE WHEN coverage_status <> 'accepted' THEN 'coverage' END) AS reasons FROM cand")
def s11(t):
    path = scratch_path(t.spark, "candidates")
    files.write_candidates(gated(t).select("cmp_id", "fe_mode", "exp_mode", "err", "mac", "coverage_status", "admissible", "reasons"), path)
    back = t.spark.read.schema("cmp_id long, fe_mode long, exp_mode long, err double, mac double, coverage_status string, admissible boolean, reasons string").option("header", True).csv(f"{path}/csv")
    return back.withColumn("reasons", F.coalesce("reasons", F.lit("")))


@query("s12_report_tables", "cmp_id:i fe_mode:i exp_mode:i err:6 mac:6 status order_changed position:i cell_mac:6",
       f"""{CAND_SQL}, ps AS (SELECT *, {STATUS_SQL} AS status, row_number() OVER (PARTITION BY cmp_id ORDER BY fe_hz, fe_mode) <> row_number() OVER (PARTITION BY cmp_id ORDER BY exp_hz, exp_mode) AS order_changed FROM fx_pairs),
 mx AS (SELECT cmp_id, fe_mode, mac AS cell_mac, dense_rank() OVER (PARTITION BY cmp_id ORDER BY exp_mode) AS position FROM cand)
 SELECT ps.cmp_id, ps.fe_mode, ps.exp_mode, ps.err, ps.mac, status, order_changed, position, cell_mac FROM ps LEFT JOIN mx ON mx.cmp_id = ps.cmp_id AND mx.fe_mode = ps.fe_mode""")
def s12(t):
    path = scratch_path(t.spark, "report")
    comparison = pairing.order_changes(t.pairs.withColumn("status", pairing.pair_status(F.col("mac"), F.col("err"))))
    matrix = files.mac_matrix(mac.masked_mac(pairing.frequency_window_pairs(t.modes), t.shapes))
    files.write_tables({"mode_comparison": comparison, "mac_matrix": matrix}, path)
    a, b = t.spark.read.parquet(f"{path}/mode_comparison"), t.spark.read.parquet(f"{path}/mac_matrix")
    return a.join(b, ["cmp_id", "fe_mode"], "left")


@query("s13_session_tables", "family_id:i term_id:i parameter s:6 status", f"WITH {CENTRAL_SQL} SELECT * FROM cs")
def s13(t):
    path = scratch_path(t.spark, "session")
    files.write_tables({"central_sensitivities": se.central_sensitivities(t.states).select("family_id", "term_id", "parameter", "f0", "s", "status")}, path, "csv")
    return t.spark.read.schema("family_id long, term_id long, parameter string, f0 double, s double, status string").option("header", True).csv(f"{path}/central_sensitivities")


@query("s14_modal_inventory", "cmp_id:i role mode_no:i frequency_hz:6 record_class n_points:i spatial_view",
       f"""WITH {AXES_SQL} SELECT m.cmp_id, m.role, m.mode_no, m.frequency_hz, CASE WHEN m.role = 'FE' THEN 'FE_MODE' WHEN m.mode_no % 6 IN (2, 4) THEN 'FRF_PEAK_RESPONSE_SNAPSHOT' WHEN m.mode_no % 6 = 5 THEN 'UNCLASSIFIED_EXPERIMENTAL_RECORD' ELSE 'FITTED_EXPERIMENTAL_MODE' END AS record_class, n_points,
 CASE WHEN spatial_available THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS spatial_view FROM fx_modes m JOIN av ON av.cmp_id = m.cmp_id AND av.role = m.role AND av.mode_no = m.mode_no""")
def s14(t):
    exp = rc.record_class(t.sql(TYPED)).select("cmp_id", "role", "mode_no", "frequency_hz", "record_class")
    fe = t.modes.filter("role = 'FE'").select("cmp_id", "role", "mode_no", "frequency_hz", F.lit("FE_MODE").alias("record_class"))
    inv = exp.unionByName(fe).join(rc.spatial_availability(t.sql(SPARSE)), ["cmp_id", "role", "mode_no"], "left")
    path = scratch_path(t.spark, "inventory")
    files.write_tables({"inventory": inv.select("cmp_id", "role", "mode_no", "frequency_hz", "record_class", "n_points", F.when(F.col("spatial_available"), "AVAILABLE").otherwise("UNAVAILABLE").alias("spatial_view"))}, path)
    return t.spark.read.parquet(f"{path}/inventory")

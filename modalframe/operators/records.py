"""Record tables: classification, modal sets, frequency reconciliation, logs, links, identity and applicability."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modalframe.functions.cplx import abs2, finite
from modalframe.functions.reasons import first_reason
from modalframe.session import cut_lineage

# Analysis types of the universal-file records.
MODAL_TYPES = (2, 3, 7)
NON_MODAL_55 = (1, 4, 5, 6)
NON_MODAL_2414 = (1, 4, 5, 6, 9)
ULP32 = 2.0 ** -23
EIGVAL_RELATIVE = 4 * 2.0 ** -24


def tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def residual_name(label: Column) -> Column:
    """What stands before the words "residual(s) below" or "residual(s) above" of a tidy label; NULL without them."""
    words = F.split(label, " ")
    plain = F.transform(words, lambda w: F.regexp_extract(F.lower(w), r"^\w+", 0))
    marks = F.filter(F.sequence(F.lit(2), F.greatest(F.size(words) - 1, F.lit(2))), lambda k: F.lower(F.get(words, k - 1)).isin("residual", "residuals") & F.get(plain, k).isin("below", "above"))
    return F.when(F.size(marks) > 0, F.array_join(F.slice(words, F.lit(1), F.get(marks, F.lit(0)) - 1), " "))


def described_frequency(text: Column) -> Column:
    """The first number given for a frequency ("freq" or "frequency", then a colon or an equals sign), as it is printed."""
    parts = F.split(text, "[:=]")
    label = lambda k: F.lower(F.element_at(F.split(F.trim(F.get(parts, k)), r"\W+"), -1))
    value = lambda k: F.get(F.split(F.ltrim(F.get(parts, k + 1)), r"[\s,;()]+"), F.lit(0))
    places = F.sequence(F.lit(0), F.greatest(F.size(parts) - 2, F.lit(0)))
    good = F.filter(places, lambda k: (k + 1 < F.size(parts)) & label(k).isin("freq", "frequency") & value(k).try_cast("double").isNotNull())
    return F.when(F.size(good) > 0, value(F.get(good, F.lit(0))))


def classify_records(records: DataFrame) -> DataFrame:
    """physical / ambiguous / residual / non_modal with the processing name and whether the record is kept."""
    kind, label = F.col("analysis_type"), tidy(F.col("id1"))
    before = residual_name(label)
    marked = F.coalesce((F.col("ds_type") == 55) & before.isNotNull(), F.lit(False))
    modal = kind.isin(*MODAL_TYPES)
    non_modal = F.when(F.col("ds_type") == 55, kind.isin(*NON_MODAL_55)).otherwise(kind.isin(*NON_MODAL_2414))
    yes = lambda c: F.coalesce(c, F.lit(False))
    cls = (F.when(yes(modal), F.when(marked, "ambiguous").otherwise("physical"))
           .when(yes(non_modal), F.when(marked, "residual").otherwise("non_modal")).otherwise("ambiguous"))
    name = F.when(yes(modal), label).when(marked, before).otherwise(label)
    return records.withColumn("classification", cls).withColumn("included", ~F.col("classification").isin("residual", "non_modal")).withColumn("processing_name", name)


def fitted_modes(records: DataFrame) -> DataFrame:
    """Mode number, frequency and rejection of each fitted-mode record.

    Dataset 55 falls back to |Im(eig)| / 2 pi, 2414 takes the eigenvalue field as it stands; the mode number falls back to
    the record's position."""
    f, tiny = F.col("freq"), F.lit(1e-30)
    usable = F.when(f.isNotNull() & (F.abs(f) > tiny), f)
    hz = F.when(F.col("ds_type") == 55, F.coalesce(usable, F.abs("eig_im") / (2 * math.pi))).otherwise(F.coalesce(f, F.col("eig")))
    d = records.withColumn("frequency_hz", hz).withColumn("mode_no", F.coalesce("mode_n", F.col("record_index") + 1))
    return d.withColumn("rejected", F.coalesce(F.col("frequency_hz") <= 0, F.lit(True)))


def modal_sets(classified: DataFrame, modes: DataFrame) -> DataFrame:
    """Modal sets of the dataset-55 records by case-folded processing name, with their record counts."""
    d = classified.filter("ds_type = 55").withColumn("set_identity", F.lower(F.col("processing_name")))
    d = d.join(modes.select("dataset_id", "record_index", "rejected"), ["dataset_id", "record_index"], "left")
    n = lambda c: F.sum(c.cast("int"))
    kept = F.col("included") & ~F.col("rejected")
    g = d.groupBy("dataset_id", "set_identity").agg(
        F.min_by("processing_name", "record_index").alias("display_name"), n(kept).alias("n_modes"), n(F.col("classification") == "residual").alias("n_residual"),
        n(F.col("classification") == "non_modal").alias("n_non_modal"), n(kept & (F.col("classification") == "ambiguous")).alias("n_ambiguous"), n(F.col("included") & F.col("rejected")).alias("n_rejected"))
    key = F.regexp_replace(F.regexp_replace(F.col("set_identity"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return g.filter("n_modes > 0").withColumn("set_key", F.coalesce(F.nullif(key, F.lit("")), F.lit("dataset-55")))


def select_set(sets: DataFrame, requests: DataFrame) -> DataFrame:
    """The requested modal set of each dataset (by key, display or processing name); several sets without a request refuse."""
    n = sets.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_sets"), F.min("set_key").alias("only_key"))
    want = F.lower(tidy(F.col("requested")))
    hit = sets.join(requests.filter("requested is not null"), "dataset_id").filter((F.lower("set_key") == want) | (F.lower("display_name") == want) | (F.col("set_identity") == want))
    hit = hit.groupBy("dataset_id").agg(F.min("set_key").alias("hit_key"))
    d = n.join(requests, "dataset_id", "left").join(hit, "dataset_id", "left")
    policy = (F.when(F.col("requested").isNotNull(), F.when(F.col("hit_key").isNull(), "refused: not found").otherwise("explicit"))
              .when(F.col("n_sets") > 1, "refused: several sets").otherwise("implicit_single_set"))
    return d.withColumn("policy", policy).withColumn("set_key", F.when(F.col("policy") == "explicit", F.col("hit_key")).when(F.col("policy") == "implicit_single_set", F.col("only_key")))


def record_class(modes: DataFrame) -> DataFrame:
    """Fitted mode, FRF-peak snapshot or unclassified, from the source metadata."""
    src = F.coalesce("mode_source", F.lit(""))
    peak = (F.col("dataset_type") == 58) | src.contains("FRF peak")
    fitted = F.col("dataset_type").isin(55, 2414) | src.contains("curve-fitted")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return modes.withColumn("record_class", F.when(yes(peak), "FRF_PEAK_RESPONSE_SNAPSHOT").when(yes(fitted), "FITTED_EXPERIMENTAL_MODE").otherwise("UNCLASSIFIED_EXPERIMENTAL_RECORD"))


def spatial_availability(shapes: DataFrame, minimum: int = 3) -> DataFrame:
    """Responding points, measured axes and whether a spatial view can be drawn, per mode."""
    per = shapes.groupBy("cmp_id", "role", "mode_no", "node_id").agg(
        F.bool_and(finite(F.col("re"), F.col("im"))).alias("_ok"), *[F.bool_or((F.col("dof") == d) & (abs2(F.col("re"), F.col("im")) > 0)).alias(f"_a{d}") for d in (1, 2, 3)])
    use = per.filter("_ok")
    any_axis = F.col("_a1") | F.col("_a2") | F.col("_a3")
    g = use.groupBy("cmp_id", "role", "mode_no").agg(F.sum(any_axis.cast("int")).alias("n_points"), *[F.bool_or(f"_a{d}").alias(f"_x{d}") for d in (1, 2, 3)])
    axes = F.concat(*[F.when(F.col(f"_x{d}"), n).otherwise("") for d, n in ((1, "x"), (2, "y"), (3, "z"))])
    return g.withColumn("axes", axes).withColumn("spatial_available", F.col("n_points") >= minimum).drop("_x1", "_x2", "_x3")


def mode_eligibility(modes: DataFrame, limits: DataFrame) -> DataFrame:
    """Modes below the trusted suspension limit are excluded; without a limit all are kept and the check is NOT_AVAILABLE."""
    d = modes.join(limits, "specimen_id", "left")
    return d.withColumn("check_status", F.when(F.col("suspension_max_hz").isNull(), "NOT_AVAILABLE").otherwise("PASS")).withColumn(
        "eligible", F.coalesce(F.col("frequency_hz") >= F.col("suspension_max_hz"), F.lit(True)))


def local_coordinate_warnings(records: DataFrame) -> DataFrame:
    """Node entries with a non-default (not 0 or 1) definition or displacement coordinate system, per dataset."""
    other = lambda c: F.size(F.filter(F.coalesce(c, F.array().cast("array<int>")), lambda v: ~v.isin(0, 1)))
    geo = F.col("ds_type").isin(15, 2411)
    return records.groupBy("dataset_id").agg(F.sum(F.when(geo, other("def_cs") + other("disp_cs")).otherwise(0)).alias("n_non_default"), F.bool_or(F.col("ds_type") == 2420).alias("has_2420"))


def latest_geometry(records: DataFrame) -> DataFrame:
    """Node coordinates of dataset 15 / 2411 records; the last record wins per node."""
    e = records.filter(F.col("ds_type").isin(15, 2411)).select("dataset_id", "record_index", F.explode(F.arrays_zip("node_nums", "x", "y", "z")).alias("n"))
    g = e.groupBy("dataset_id", F.col("n.node_nums").alias("node_id")).agg(F.max_by(F.struct("n.x", "n.y", "n.z"), "record_index").alias("p"))
    return g.select("dataset_id", "node_id", "p.x", "p.y", "p.z")


def record_shapes(records: DataFrame) -> DataFrame:
    """Shapes of fitted-mode records (node_nums, r1..r3 / i1..i3 arrays): a component counts as measured when it is present
    and carries more than 1e-6 of the mode's norm."""
    parts = [F.struct(F.lit(d).alias("dof"), F.col(f"r{d}").alias("re"), F.col(f"i{d}").alias("im")) for d in (1, 2, 3)]
    d = records.select("dataset_id", "mode_no", "node_nums", F.explode(F.array(*parts)).alias("c"))
    d = d.withColumn("present", F.col("c.re").isNotNull())
    e = F.aggregate(F.zip_with(F.coalesce("c.re", F.array()), F.coalesce("c.im", F.array()), lambda a, b: a * a + b * b), F.lit(0.0), lambda a, v: a + v)
    d = d.withColumn("_e", e)
    tot = d.groupBy("dataset_id", "mode_no").agg(F.sum("_e").alias("_t"))
    d = d.join(tot, ["dataset_id", "mode_no"]).withColumn("measured", F.col("present") & (F.col("_t") > 1e-60) & (F.sqrt("_e") > 1e-6 * F.sqrt("_t")))
    rows = F.arrays_zip(F.col("node_nums").alias("n"), F.coalesce("c.re", F.array_repeat(F.lit(0.0), F.size("node_nums"))).alias("r"), F.coalesce("c.im", F.array_repeat(F.lit(0.0), F.size("node_nums"))).alias("i"))
    return d.select("dataset_id", "mode_no", "c.dof", "measured", F.explode(rows).alias("v")).select("dataset_id", "mode_no", F.col("v.n").alias("node_id"), "dof", F.col("v.r").alias("re"), F.col("v.i").alias("im"), "measured")


# ------------------------------------------------------------------------------------------------ frequency reconciliation
def printed_precision(text: Column) -> Column:
    """Half a unit in the last printed digit of a decimal text (with an optional exponent), at least one float32 step."""
    digits = F.length(F.regexp_extract(text, r"\.(\d*)", 1))
    power = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, r"[eE]\+?(-?\d+)$", 1), F.lit("")), F.lit("S999")).cast("double"), F.lit(0.0))
    return F.greatest(0.5 * F.pow(F.lit(10.0), power - digits), F.abs(text.cast("double")) * ULP32)


def reconcile_frequencies(frames: DataFrame, eigfreq: DataFrame, eigval: DataFrame) -> DataFrame:
    """Full-precision history frequency of each mode where it is unique and consistent; otherwise the frame value stays,
    with the reason. ``frames``: package_id, mode_no, frame_text; histories: package_id, mode_no, value."""
    key = ["package_id", "mode_no"]
    d = frames.withColumn("frame_hz", F.col("frame_text").cast("double")).withColumn("_tol", printed_precision(F.col("frame_text")))
    freq = eigfreq.groupBy(*key).agg(F.min("value").alias("eigfreq_hz"), F.count(F.lit(1)).alias("_nf"))
    val = eigval.groupBy(*key).agg(F.min("value").alias("eigval"), F.count(F.lit(1)).alias("_nv"))
    hist = freq.join(val, key, "full_outer").groupBy("package_id").agg(
        F.count("eigfreq_hz").alias("_kf"), F.count("eigval").alias("_kv"), F.max("_nf").alias("_df"), F.max("_nv").alias("_dv"),
        F.sum((F.col("eigfreq_hz").isNull() | F.col("eigval").isNull()).cast("int")).alias("_odd"))
    d = d.join(freq.drop("_nf"), key, "left").join(val.drop("_nv"), key, "left").join(hist, "package_id", "left")
    # another history value inside the tolerance: bins as wide as the package's largest tolerance
    w = d.groupBy("package_id").agg(F.max("_tol").alias("_w"))
    q = d.select(*key, "frame_hz", "_tol").join(w, "package_id").withColumn("_bin", F.explode(F.sequence(F.floor((F.col("frame_hz") - F.col("_tol")) / F.col("_w")), F.floor((F.col("frame_hz") + F.col("_tol")) / F.col("_w")))))
    o = freq.select("package_id", F.col("mode_no").alias("_other"), F.col("eigfreq_hz").alias("_v")).join(w, "package_id").withColumn("_bin", F.floor(F.col("_v") / F.col("_w"))).drop("_w")
    twin = q.join(o, ["package_id", "_bin"]).filter((F.col("_other") != F.col("mode_no")) & (F.abs(F.col("_v") - F.col("frame_hz")) <= F.col("_tol"))).select(*key).distinct().withColumn("_twin", F.lit(True))
    d = d.join(twin, key, "left")
    check = F.abs(F.sqrt(F.greatest("eigval", F.lit(0.0))) / (2 * math.pi) - F.col("eigfreq_hz")) <= EIGVAL_RELATIVE * F.col("eigfreq_hz")
    reason = first_reason(
        (F.coalesce("_kf", F.lit(0)) == 0, "history missing"), (F.col("_df") > 1, "frequency history has a mode twice"), (F.col("_dv") > 1, "eigenvalue history has a mode twice"),
        ((F.col("_kv") > 0) & (F.col("_odd") > 0), "histories cover unequal modes"), (F.col("eigfreq_hz").isNull(), "mode absent from history"),
        (~((F.col("frame_hz") > 0) & (F.abs(F.col("eigfreq_hz") - F.col("frame_hz")) <= F.col("_tol"))), "history disagrees with frame"),
        (F.col("_twin"), "frame fits a second mode"), (F.col("eigval").isNotNull() & ~((F.col("eigval") > 0) & check), "eigenvalue disagrees with frequency"))
    d = d.withColumn("reason", reason)
    return d.withColumn("frequency_hz", F.when(F.col("reason").isNull(), F.col("eigfreq_hz")).otherwise(F.col("frame_hz"))).withColumn(
        "source", F.when(F.col("reason").isNull(), "history").otherwise("frame"))


def reliable_history(eigfreq: DataFrame, eigval: DataFrame) -> DataFrame:
    """EIGFREQ values usable as an independent record (EIGVAL, where the package has one, must agree), else a note."""
    key = ["package_id", "mode_no"]
    has = eigval.select("package_id").distinct().withColumn("_has", F.lit(True))
    d = eigfreq.join(eigval.withColumnRenamed("value", "_v"), key, "left").join(has, "package_id", "left")
    expect = F.sqrt(F.greatest("_v", F.lit(0.0))) / (2 * math.pi)
    bad = F.abs(expect - F.col("value")) > EIGVAL_RELATIVE * F.greatest(F.abs("value"), expect) + 1e-12
    note = F.when(F.col("_has"), F.when(F.col("_v").isNull(), "EIGFREQ without EIGVAL").when(bad, "eigenvalue disagrees with frequency"))
    return d.withColumn("note", note).drop("_v", "_has")


def contradictions(frames: DataFrame, reliable: DataFrame) -> DataFrame:
    """Modes whose manifest frequency contradicts its frame description or a reliable EIGFREQ, with the reasons.

    ``frames``: package_id, mode_no, frame_text, description."""
    d = frames.withColumn("manifest_hz", F.col("frame_text").cast("double")).withColumn("_dt", described_frequency(F.col("description")))
    d = d.withColumn("described_hz", F.col("_dt").cast("double")).join(reliable.filter("note is null").select("package_id", "mode_no", F.col("value").alias("eigfreq_hz")), ["package_id", "mode_no"], "left")
    mt = printed_precision(F.col("frame_text"))
    has = F.col("described_hz").isNotNull()
    ft = F.when(has, printed_precision(F.col("_dt"))).otherwise(mt)
    fv = F.coalesce("described_hz", "manifest_hz")
    r1 = has & (F.abs(F.col("manifest_hz") - F.col("described_hz")) > F.greatest(ft, mt))
    r2 = F.col("eigfreq_hz").isNotNull() & (F.abs(fv - F.col("eigfreq_hz")) > ft + F.abs("eigfreq_hz") * ULP32)
    bad = F.coalesce(r1, F.lit(False)) | F.coalesce(r2, F.lit(False))
    reason = F.concat_ws(";", F.when(r1, "manifest contradicts its description"), F.when(r2, F.concat(F.when(has, "description").otherwise("manifest"), F.lit(" contradicts EIGFREQ"))),
                         F.when(bad & (F.col("manifest_hz") == F.col("mode_no")), "value equals the mode number"))
    return d.withColumn("reason", reason).withColumn("rejected", bad).drop("_dt")


def same_printed(left: DataFrame, right: DataFrame, keys: list[str], digits: int = 5) -> DataFrame:
    """Agreement of two sources at ``digits`` significant digits of the right one (full join; a missing side disagrees)."""
    j = left.join(right, keys, "full_outer")
    places = (digits - 1) - F.floor(F.log10(F.abs(F.when(F.col("right_hz") != 0, F.col("right_hz"))))).cast("int")
    scale = F.pow(F.lit(10.0), places)
    same = F.when(F.col("right_hz") == 0, F.col("left_hz") == 0).otherwise(F.rint(F.col("left_hz") * scale) == F.rint(F.col("right_hz") * scale))
    return j.withColumn("equal", F.coalesce(same, F.lit(False))).withColumn("abs_diff", F.abs(F.col("left_hz") - F.col("right_hz")))


# ------------------------------------------------------------------------------------------------ logs and links
def active_state(log: DataFrame) -> DataFrame:
    """Latest entry per series (ties by sequence); a withdrawal clears the state."""
    g = log.groupBy("series_key").agg(F.max_by(F.struct("action", "recorded_at", "seq"), F.struct("recorded_at", "seq")).alias("l"), F.count(F.lit(1)).alias("n_entries"))
    return g.select("series_key", "n_entries", "l.recorded_at", "l.seq", F.when(F.col("l.action") != "WITHDRAWN", F.col("l.action")).alias("state"))


def first_evaluations(log: DataFrame) -> DataFrame:
    """First journalled evaluation per candidate hash of each series (later ones are replays)."""
    return log.groupBy("series_key", "candidate_hash").agg(F.min_by(F.struct("seq", "outcome"), "seq").alias("f"), (F.count(F.lit(1)) - 1).alias("n_replayed")).select(
        "series_key", "candidate_hash", "f.seq", "f.outcome", "n_replayed")


def run_counts(log: DataFrame) -> DataFrame:
    n = lambda v: F.sum((F.col("outcome") == v).cast("int"))
    return log.groupBy("series_key").agg(F.count(F.lit(1)).alias("n_evaluations"), n("REUSED").alias("n_reused"), (n("SOLVED") + n("FAILED")).alias("n_solves"), n("FAILED").alias("n_failed"))


def classify_repeats(runs: DataFrame) -> DataFrame:
    """Eligibility of each documented remount: frequency and shape, frequency only, insufficiently documented, not eligible."""
    r = runs.filter("remount_of is not null")
    o = runs.select(F.col("test_run_id").alias("remount_of"), *[F.col(c).alias(f"o_{c}") for c in ("specimen_id", "design_id", "protocol", "grid_id")])
    d = r.join(o, "remount_of")
    c = F.col
    e = (F.when(c("specimen_id").isNull() | c("o_specimen_id").isNull(), "INSUFFICIENTLY_DOCUMENTED").when(c("specimen_id") != c("o_specimen_id"), "NOT_ELIGIBLE")
         .when(c("design_id") != c("o_design_id"), "NOT_ELIGIBLE").when(c("protocol").isNull() | c("o_protocol").isNull(), "INSUFFICIENTLY_DOCUMENTED")
         .when(c("protocol") != c("o_protocol"), "NOT_ELIGIBLE").when(c("grid_id") != c("o_grid_id"), "FREQUENCY_ONLY").otherwise("FREQUENCY_AND_SHAPE"))
    return d.withColumn("eligibility", e)


def link_problems(runs: DataFrame) -> DataFrame:
    """Duplicate runs, contradictory identities, unknown or foreign link targets, and cycles: one row per problem.

    A chain is followed by pointer doubling; after log2(n) rounds only runs on or behind a cycle still point somewhere."""
    row = lambda df, text: df.select("test_run_id", F.lit(text).alias("problem"))
    dup = runs.groupBy("test_run_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    ident = runs.filter("specimen_id is not null").groupBy("specimen_id").agg(F.min("design_id").alias("_a"), F.max("design_id").alias("_b")).filter("_a <> _b")
    one = runs.dropDuplicates(["test_run_id"])
    links = one.filter("remount_of is not null").select("test_run_id", "remount_of", "specimen_id")
    tgt = one.select(F.col("test_run_id").alias("remount_of"), F.col("specimen_id").alias("_ts"))
    unknown = links.join(tgt, "remount_of", "left_anti")
    known = links.join(tgt, "remount_of")
    foreign = known.filter(~F.coalesce(F.col("specimen_id") == F.col("_ts"), F.lit(False)))
    step = cut_lineage(known.select("test_run_id", F.col("remount_of").alias("to")))
    n = step.count()
    for _ in range(max(1, math.ceil(math.log2(n + 1)))):
        step = cut_lineage(step.join(step.select(F.col("test_run_id").alias("to"), F.col("to").alias("_next")), "to").select("test_run_id", F.col("_next").alias("to")))
    out = row(dup, "duplicate run").unionByName(row(unknown, "unknown target")).unionByName(row(foreign, "different specimen")).unionByName(row(step, "cycle"))
    return out.unionByName(runs.join(ident, "specimen_id", "left_semi").select("test_run_id", F.lit("contradictory identity").alias("problem"))).distinct()


def job_completeness(specimens: DataFrame, perturbations: list[tuple[str, str]], states: DataFrame) -> DataFrame:
    """Every planned (specimen, perturbation) job with the state found for it: COMPLETE, WRONG_JOB or MISSING.

    ``perturbations`` is the short planned list of one envelope (id, job suffix)."""
    arr = F.array(*[F.struct(F.lit(i).alias("perturbation_id"), F.lit(x).alias("suffix")) for i, x in perturbations])
    want = specimens.select("specimen_id", F.explode(arr).alias("p")).select("specimen_id", "p.perturbation_id", F.concat(F.col("specimen_id").cast("string"), F.col("p.suffix")).alias("planned_job"))
    d = want.join(states, ["specimen_id", "perturbation_id"], "left")
    return d.withColumn("status", F.when(F.col("job").isNull(), "MISSING").when(F.col("job") != F.col("planned_job"), "WRONG_JOB").otherwise("COMPLETE"))


# ------------------------------------------------------------------------------------------------ identity
def geometry_identity(nodes: DataFrame, prefix: int = 3) -> DataFrame:
    """Order-independent SHA-256 of the node ids and exact coordinates of each dataset (-0.0 folded), duplicates refused.

    Node hashes are sorted inside 16^prefix hash buckets and the bucket hashes are hashed once more, so no single task
    holds a whole mesh."""
    bits = [F.format_string("%a", F.col(c).cast("double") + F.lit(0.0)) for c in "xyz"]  # exact hexadecimal doubles
    h = nodes.select("dataset_id", F.sha2(F.concat_ws("|", F.concat_ws(":", "instance", "node_id"), *bits), 256).alias("h"))
    b = h.groupBy("dataset_id", F.substring("h", 1, prefix).alias("bucket")).agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("h"))), 256).alias("bh"), F.count(F.lit(1)).alias("n"))
    g = b.groupBy("dataset_id").agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list(F.concat("bucket", "bh")))), 256).alias("geometry_hash"), F.sum("n").alias("n_nodes"))
    dup = nodes.groupBy("dataset_id", "instance", "node_id").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_duplicates"))
    g = g.join(dup, "dataset_id", "left").withColumn("n_duplicates", F.coalesce("n_duplicates", F.lit(0)))
    return g.withColumn("geometry_hash", F.when(F.col("n_duplicates") == 0, F.col("geometry_hash")))


def compare_inventories(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Changed, missing, new and equal files between two inventories (package_id, role, path, size, sha256)."""
    key = ["package_id", "role", "path"]
    j = recorded.join(current.select(*key, F.col("size").alias("_s"), F.col("sha256").alias("_h")), key, "full_outer")
    state = (F.when(F.col("_h").isNull(), "missing").when(F.col("sha256").isNull(), "new").when((F.col("sha256") != F.col("_h")) | (F.col("size") != F.col("_s")), "changed").otherwise("equal"))
    return j.withColumn("state", state).drop("_s", "_h")


def package_row_counts(manifest: DataFrame, geometry: DataFrame, mode_rows: DataFrame, deck: DataFrame) -> DataFrame:
    """Manifest against geometry and mode-file row counts, and the instance sets of geometry and input deck."""
    g = geometry.groupBy("package_id").agg(F.count(F.lit(1)).alias("n_geometry"))
    m = mode_rows.groupBy("package_id", "mode_no").agg(F.count(F.lit(1)).alias("_n")).join(g, "package_id").groupBy("package_id").agg(F.sum((F.col("_n") != F.col("n_geometry")).cast("int")).alias("n_short_modes"))
    a = geometry.select("package_id", F.upper("instance").alias("i")).distinct().withColumn("_a", F.lit(1))
    b = deck.select("package_id", F.upper("instance").alias("i")).distinct().withColumn("_b", F.lit(1))
    s = a.join(b, ["package_id", "i"], "full_outer").groupBy("package_id").agg(F.sum((F.col("_a").isNull() | F.col("_b").isNull()).cast("int")).alias("n_odd_instances"))
    d = manifest.join(g, "package_id", "left").join(m, "package_id", "left").join(s, "package_id", "left")
    problems = F.concat_ws(";", F.when(~F.coalesce(F.col("n_geometry") == F.col("geometry_node_count"), F.lit(False)), "geometry count differs"), F.when(F.coalesce("n_short_modes", F.lit(1)) > 0, "a mode file misses nodes"),
                           F.when(F.coalesce("n_odd_instances", F.lit(1)) > 0, "instances differ"))
    return d.withColumn("problems", problems)


# ------------------------------------------------------------------------------------------------ reviews and applicability
def apply_reviews(pairs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Manual decisions over automatic pairs: accepted replaces the partner, rejected and unresolved remove the pair.

    ``pairs``: cmp_id, fe_mode, exp_mode; ``reviews``: cmp_id, fe_mode, decision, manual_exp."""
    known = F.lower("decision").isin("automatic", "accepted", "rejected", "unresolved")
    r = reviews.select("cmp_id", "fe_mode", F.when(known, F.lower("decision")).otherwise("automatic").alias("decision"), "manual_exp")
    j = pairs.join(r, ["cmp_id", "fe_mode"], "full_outer").withColumn("decision", F.coalesce("decision", F.lit("automatic")))
    chosen = F.when(F.col("decision") == "accepted", F.coalesce("manual_exp", "exp_mode")).when(F.col("decision") == "automatic", F.col("exp_mode"))
    return j.withColumn("final_exp", chosen).withColumn("replaced", F.coalesce(F.col("final_exp") != F.col("exp_mode"), F.col("final_exp").isNotNull()))


def applicability(recorded: DataFrame, modes: DataFrame, pairs: DataFrame, rtol: float = 1e-6) -> DataFrame:
    """Archived strict pairs against the live comparison, with the first reason that makes one not applicable.

    ``recorded``: cmp_id, row_id, fe_mode, exp_mode, fe_hz, exp_hz, branch_problem, s; ``pairs`` has category."""
    fe = modes.filter("role = 'FE'").select("cmp_id", F.col("mode_no").alias("fe_mode"), F.col("frequency_hz").alias("_fe"))
    ex = modes.filter("role = 'EXP'").select("cmp_id", F.col("mode_no").alias("exp_mode"), F.col("frequency_hz").alias("_ex"))
    pr = pairs.select("cmp_id", "fe_mode", "exp_mode", "category", F.col("mac").alias("live_mac"))
    d = recorded.join(fe, ["cmp_id", "fe_mode"], "left").join(ex, ["cmp_id", "exp_mode"], "left").join(pr, ["cmp_id", "fe_mode", "exp_mode"], "left")
    near = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) <= rtol * F.greatest(F.abs(F.col(a)), F.abs(F.col(b))), F.lit(False))
    reason = first_reason((F.col("branch_problem").isNotNull(), F.col("branch_problem")), (~near("_fe", "fe_hz"), "FE mode missing or different"), (~near("_ex", "exp_hz"), "measured mode missing or different"),
                          (F.col("category").isNull(), "not paired in the comparison"), (F.col("category") != "MAC_SUPPORTED", F.concat(F.lit("pair is "), F.col("category"))))
    d = d.withColumn("reason", reason).withColumn("applicable", F.col("reason").isNull())
    return d.withColumn("s", F.when(F.col("applicable"), F.col("s"))).drop("_fe", "_ex")


def contract_failures(actual: DataFrame, expected: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column whose actual value differs from the pinned one (a missing side differs)."""
    e = expected.select("dataset_id", *[F.col(c).alias(f"_{c}") for c in columns])
    j = expected.select("dataset_id").join(actual, "dataset_id", "left").join(e, "dataset_id")
    items = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.struct(F.lit(c).alias("check_name"), F.col(c).cast("string").alias("actual"), F.col(f"_{c}").cast("string").alias("expected"))) for c in columns]))
    return j.select("dataset_id", F.explode(items).alias("f")).select("dataset_id", "f.*")


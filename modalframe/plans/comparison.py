"""Whole studies composed from the operators: a model-measurement comparison and an FE family response.

Both take tables that hold any number of comparisons or families at once and return lazy DataFrames.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalframe.operators import evidence as ev
from modalframe.operators import frf, mac, pairing
from modalframe.operators import sensitivity as se
from modalframe.operators import shapes as sh
from modalframe.plans.registry import query
from modalframe.plans.shapes import REFS, STATES
from modalframe.session import cut_lineage


def compare(modes: DataFrame, shapes: DataFrame, nodes: DataFrame, policy: pairing.ComparatorPolicy = pairing.ComparatorPolicy()) -> dict[str, DataFrame]:
    """Compare every FE model with its measurement: rigid filter, window, MAC and coverage, gates, one-to-one pairs, labels.

    Returns candidates, pairs, unmatched modes, close groups and the correlation summary."""
    residuals = sh.rigid_residuals(shapes.filter("role = 'FE'"), nodes)
    elastic = sh.elastic_modes(modes, residuals)
    window = pairing.frequency_window_pairs(elastic, policy.max_error_percent / 100)
    # The gated candidates feed the assignment and every report, so they are written once to the shared folder.
    candidates = cut_lineage(pairing.gate_candidates(mac.coverage(window, shapes, nodes), policy))
    admissible = candidates.filter("admissible").withColumn("cost", pairing.pair_cost(F.col("mac"), F.col("err"), policy))
    chosen = ev.assign_pairs(admissible, policy.unmatched_cost).select("cmp_id", "fe_mode", "exp_mode")
    pairs = pairing.order_changes(candidates.join(chosen, ["cmp_id", "fe_mode", "exp_mode"]))
    pairs = pairs.withColumn("status", pairing.pair_status(F.col("mac"), F.col("err")))
    return {"candidates": candidates, "pairs": pairs, "unmatched": pairing.unmatched_modes(elastic, pairs), "close_groups": frf.close_groups(elastic, ["cmp_id", "role"]),
            "summary": mac.correlation_summary(mac.common_rows(pairs, shapes)), "scaling": pairing.scaling_rows(pairs)}


def family_response(reference: DataFrame, states: DataFrame, modes: DataFrame, state_modes: DataFrame) -> dict[str, DataFrame]:
    """Follow every FE branch of every family into its states and derive central sensitivities.

    ``reference``: cmp_id, i, node_id, dof, value; ``states``: cmp_id, direction, j, node_id, dof, value; ``modes``: cmp_id, i, hz;
    ``state_modes``: cmp_id, direction, j, hz, parameter, side, value, p0. Close pairs (3 %) are examined as two-mode clusters;
    a confirmed one is a single term (mean ln f). Larger groups are INDEPENDENT if each mode is tracked on its own, else
    UNSUPPORTED, and modes of an unsupported group make no term."""
    key = ["cmp_id", "direction"]
    rows = modes.select("cmp_id", F.col("i").alias("id"), F.col("hz").alias("exp_hz"), F.col("hz").alias("fe_hz"))
    groups = cut_lineage(sh.trigger_groups(rows, ["cmp_id"]))
    clusters = groups.filter("size = 2").groupBy("cmp_id", F.col("component").alias("cluster_id")).agg(F.min("id").alias("i1"), F.max("id").alias("i2"))
    dirs = state_modes.select(*key).distinct()
    left = reference.join(dirs, "cmp_id")
    # Every listed reference mode with every listed mode of each state.
    listed = reference.join(modes, ["cmp_id", "i"], "left_semi").join(dirs, "cmp_id")
    macs = sh.real_mac(sh.real_products(None, listed, states.join(state_modes, [*key, "j"], "left_semi"), key))
    single = cut_lineage(sh.track_branches(macs, modes.select("cmp_id", "i").join(dirs, "cmp_id"), key))
    spans = cut_lineage(sh.track_subspaces(clusters.join(dirs, "cmp_id"), left, states, key))
    members = spans.select(*key, "cluster_id", F.explode(F.array("i1", "i2")).alias("i"))
    stable = members.join(single, [*key, "i"]).withColumn("stable", F.col("status") == "TRACKED")
    verdicts = sh.confirm_clusters(stable, spans, ["cmp_id"])
    larger = sh.judge_larger_groups(groups, single, ["cmp_id"])
    unsupported = larger.filter("verdict = 'UNSUPPORTED'").select("cmp_id", F.col("cluster_id").alias("component")).join(groups, ["cmp_id", "component"]).select("cmp_id", F.col("id").alias("i"))
    confirmed = verdicts.filter("verdict = 'CONFIRMED'").select("cmp_id", "cluster_id").join(clusters, ["cmp_id", "cluster_id"])
    in_cluster = confirmed.select("cmp_id", "cluster_id", F.explode(F.array("i1", "i2")).alias("i"))
    hz = state_modes.select(*key, "j", F.log("hz").alias("_lf"))
    alone = single.join(in_cluster, ["cmp_id", "i"], "left_anti").join(unsupported, ["cmp_id", "i"], "left_anti").select(*key, F.concat(F.lit("FE"), "i").alias("term_id"), F.array("i").alias("rows"), F.array("j").alias("found"))
    pair = spans.join(confirmed.select("cmp_id", "cluster_id"), ["cmp_id", "cluster_id"]).select(
        *key, F.concat(F.lit("FE"), "i1", F.lit("+FE"), "i2").alias("term_id"), F.array("i1", "i2").alias("rows"), F.array("j", "j2").alias("found"))
    terms = alone.unionByName(pair)
    base = terms.select(*key, "term_id", F.explode("rows").alias("i")).join(modes, ["cmp_id", "i"]).groupBy(*key, "term_id").agg(F.exp(F.avg(F.log("hz"))).alias("f0"))
    new = terms.select(*key, "term_id", F.explode("found").alias("j")).join(hz, [*key, "j"], "left").groupBy(*key, "term_id").agg(
        F.when(F.count("_lf") == F.count(F.lit(1)), F.exp(F.avg("_lf"))).alias("f"))
    info = state_modes.select(*key, "parameter", "side", "value", "p0").distinct()
    table = base.join(new, [*key, "term_id"]).join(info, key).withColumnRenamed("cmp_id", "family_id")
    return {"branches": single, "clusters": verdicts.unionByName(larger, allowMissingColumns=True), "sensitivities": se.central_sensitivities(table)}


@query("comparison_run", "cmp_id:i fe_mode:i exp_mode:i err:6 mac:6 order_changed status")
def comparison_run(t):
    return compare(t.modes, t.shapes, t.nodes)["pairs"]


STATE_MODES = """SELECT cmp_id, d AS direction, mode_no AS j, frequency_hz * pow(0.85e0 + 0.1e0 * d, 0.01e0 * (mode_no % 40)) AS hz, 'E' AS parameter, CASE WHEN d = 1 THEN 'minus' ELSE 'plus' END AS side, 0.85e0 + 0.1e0 * d AS value, 1e0 AS p0
 FROM fx_modes CROSS JOIN (SELECT 1 AS d UNION ALL SELECT 2 AS d) ds WHERE role = 'FE'"""


@query("family_response_run", "family_id:i term_id s:6 s_minus:6 s_plus:6 status")
def family_response_run(t):
    modes = t.modes.filter("role = 'FE'").select("cmp_id", F.col("mode_no").alias("i"), F.col("frequency_hz").alias("hz"))
    return family_response(t.sql(REFS), t.sql(STATES), modes, t.sql(STATE_MODES))["sensitivities"]

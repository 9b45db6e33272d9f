"""Modal tables derived from the star-schema test tables.

Each adapter is one SQL text that Spark and the oracle engine both read, so that only the operators differ between the
two sides. Numeric literals carry an exponent (``0.75e0``) because both engines would otherwise read them as decimals.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

# The one adapter that unnests an array; the two engines spell that differently.
VEC_SPARK = """
SELECT vec_id, label, p, CAST(embedding[p] AS DOUBLE) AS a, CAST(embedding[p + 30] AS DOUBLE) AS b,
       CAST(embedding[(p + 17) % 30 + 30] AS DOUBLE) AS c, CAST(embedding[(p + 11) % 30] AS DOUBLE) AS d
FROM embeddings LATERAL VIEW explode(sequence(0, 29)) t AS p"""
VEC_DUCK = """
SELECT vec_id, label, p, CAST(embedding[p + 1] AS DOUBLE) AS a, CAST(embedding[p + 31] AS DOUBLE) AS b,
       CAST(embedding[(p + 17) % 30 + 31] AS DOUBLE) AS c, CAST(embedding[(p + 11) % 30 + 1] AS DOUBLE) AS d
FROM embeddings CROSS JOIN (SELECT unnest(range(30)) AS p)"""

FX = {
    # One comparison = one FE model run against one test run; a run holds 200 consecutive vectors, so a comparison is
    # bounded by construction however skewed the label is.
    "fx_modes": """
SELECT CAST(floor(vec_id / 200) AS BIGINT) * 100 + label AS cmp_id, CAST(label AS BIGINT) AS specimen_id, 'FE' AS role,
       vec_id AS mode_no, 20e0 + 0.75e0 * (vec_id % 200) + 0.4e0 * (vec_id % 7) AS frequency_hz,
       0.005e0 + 0.001e0 * (vec_id % 11) AS damping_ratio FROM embeddings
UNION ALL
SELECT CAST(floor(vec_id / 200) AS BIGINT) * 100 + label AS cmp_id, CAST(label AS BIGINT) AS specimen_id, 'EXP' AS role,
       vec_id AS mode_no, (20e0 + 0.75e0 * (vec_id % 200) + 0.4e0 * (vec_id % 7))
           * (1e0 + 0.01e0 * ((vec_id * 7) % 9 - 4)) AS frequency_hz,
       CASE WHEN vec_id % 13 = 0 THEN NULL ELSE 0.005e0 + 0.001e0 * (vec_id % 11) END AS damping_ratio FROM embeddings""",
    "fx_shapes": """
SELECT CAST(floor(vec_id / 200) AS BIGINT) * 100 + label AS cmp_id, 'FE' AS role, vec_id AS mode_no,
       CAST(floor(p / 3) AS BIGINT) AS node_id, CAST(p % 3 + 1 AS INT) AS dof, a AS re, 0.3e0 * b AS im, true AS measured
FROM fx_vec
UNION ALL
SELECT CAST(floor(vec_id / 200) AS BIGINT) * 100 + label AS cmp_id, 'EXP' AS role, vec_id AS mode_no,
       CAST(floor(p / 3) AS BIGINT) AS node_id, CAST(p % 3 + 1 AS INT) AS dof,
       a + 0.15e0 * (vec_id % 8) * c AS re, 0.3e0 * b - 0.15e0 * (vec_id % 8) * d AS im,
       NOT (p % 3 = 1 AND vec_id % 3 = 0) AS measured
FROM fx_vec""",
    # Node geometry per comparison (a slightly uneven 5 x 2 grid).
    "fx_nodes": """
SELECT DISTINCT cmp_id, node_id, CAST(node_id % 5 AS DOUBLE) AS x, CAST(floor(node_id / 5) AS DOUBLE) AS y,
       0.05e0 * ((node_id * 3) % 4) AS z FROM fx_shapes WHERE role = 'FE'""",
    # FE surface points and scan points of many geometries, for the spatial operators.
    "fx_fe_points": """
SELECT CAST(floor(p_partkey / 100) AS BIGINT) AS dataset_id, p_partkey AS node_id, CONCAT('I', p_partkey % 2) AS instance,
       10e0 * (p_partkey % 10) + 0.3e0 * (p_size % 7) AS x,
       8e0 * floor((p_partkey % 100) / 10) + 0.2e0 * (p_size % 9) AS y, 0.01e0 * (p_size % 5) AS z FROM part""",
    "fx_exp_points": """
SELECT CAST(floor(c_custkey / 75) AS BIGINT) AS dataset_id, c_custkey AS point_id,
       10e0 * (c_custkey % 75 % 10) + 0.0007e0 * c_acctbal AS x,
       8e0 * floor(c_custkey % 75 / 10) + 0.0003e0 * c_acctbal + 0.001e0 * (c_custkey % 17) AS y, 0e0 AS z
FROM customer""",
    "fx_frf": """
SELECT CAST(floor(user_id / 30) AS BIGINT) AS dataset_id, CAST(user_id % 6 AS INT) AS rsp_node,
       CAST(CASE WHEN user_id % 6 = 4 THEN -2 ELSE user_id % 6 % 3 + 1 END AS INT) AS rsp_dir,
       CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE 2 END AS ref_node, 3 AS ref_dir,
       CAST((day(ts) - 1) * 2 + floor(hour(ts) / 12) AS INT) AS line,
       5e0 + 2e0 * CAST((day(ts) - 1) * 2 + floor(hour(ts) / 12) AS INT) AS f_hz,
       avg(value * cos(event_id)) AS re, avg(value * sin(event_id)) AS im FROM events GROUP BY 1, 2, 3, 4, 5, 6, 7""",
    "fx_coh": """
SELECT CAST(floor(user_id / 30) AS BIGINT) AS dataset_id, CAST(user_id % 6 AS INT) AS rsp_node,
       CAST(CASE WHEN user_id % 6 = 4 THEN -2 ELSE user_id % 6 % 3 + 1 END AS INT) AS rsp_dir,
       CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE 2 END AS ref_node, 3 AS ref_dir,
       CAST((day(ts) - 1) * 2 + floor(hour(ts) / 12) AS INT) AS line,
       least(1e0, 0.6e0 + 0.4e0 * avg(value) / 117.3e0) AS coh FROM events WHERE user_id % 6 <> 5 GROUP BY 1, 2, 3, 4, 5, 6""",
    "fx_states": """
SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS family_id, p_partkey AS term_id, 'P' AS parameter, side, pv AS value,
       1e0 AS p0, p_retailprice AS f0,
       CASE WHEN side = 'plus' AND p_partkey % 17 = 0 THEN NULL
            ELSE p_retailprice * pow(pv, (p_size % 20) / 40e0) END AS f
FROM part CROSS JOIN (SELECT 'minus' AS side, 0.95e0 AS pv UNION ALL SELECT 'plus' AS side, 1.05e0 AS pv)""",
    "fx_sens": """
SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS family_id, p_partkey AS term_id, p_brand AS brand, p_retailprice AS f0,
       parameter, CASE WHEN parameter = 'E1' THEN (p_size % 20) / 40e0 ELSE (p_partkey % 9) / 20e0 END AS s
FROM part CROSS JOIN (SELECT 'E1' AS parameter UNION ALL SELECT 'E2' AS parameter)""",
    "fx_terms": """
SELECT l_suppkey AS specimen_id, l_orderkey * 8 + l_linenumber AS term_id, p_brand AS family, l_partkey AS part_id,
       CASE WHEN l_returnflag = 'R' THEN 'HOLDOUT' ELSE 'FIT' END AS role, (l_discount - 0.05e0) / 0.02e0 AS residual,
       0.003e0 * (1e0 + l_tax) AS sigma, (l_quantity - 25e0) / 25e0 AS j1, (p_size - 25e0) / 25e0 AS j2,
       100e0 + l_extendedprice / 1000e0 AS f_exp
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "fx_meas": """
SELECT l_suppkey AS specimen_id, CAST(l_linenumber AS INT) AS position, l_orderkey AS reading_id, l_quantity / 10e0 AS value,
       CASE WHEN l_linenumber % 5 = 0 THEN 'm' WHEN l_linenumber % 7 = 0 THEN 'inch' ELSE 'mm' END AS unit,
       CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'B' END AS side FROM lineitem""",
    "fx_log": """
SELECT o_custkey AS series_key, o_orderkey AS seq, o_orderdate AS recorded_at,
       CASE WHEN o_orderstatus = 'F' THEN 'WITHDRAWN' ELSE 'SET' END AS action,
       CASE WHEN o_orderpriority LIKE '1%' THEN 'REUSED' WHEN o_orderpriority LIKE '2%' THEN 'FAILED' ELSE 'SOLVED' END AS outcome,
       CONCAT('h', CAST(floor(o_totalprice) AS BIGINT) % 50) AS candidate_hash FROM orders""",
    "fx_matrix": """
SELECT CAST(floor(l_suppkey / 30) AS BIGINT) AS matrix_id, CAST(l_partkey % 30 AS INT) AS i, CAST(l_suppkey % 30 AS INT) AS j,
       sum(l_extendedprice) / 100000e0 AS value, sum(l_quantity) / 100e0 AS mass
FROM lineitem GROUP BY 1, 2, 3""",
    "fx_runs": """
SELECT c_custkey AS test_run_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey - 1 END AS remount_of,
       CAST(floor((c_custkey + 1) / 3) AS BIGINT) AS specimen_id, c_mktsegment AS protocol,
       c_nationkey AS grid_id, c_acctbal > 0 AS has_shapes FROM customer""",
    "fx_records": """
SELECT o_custkey AS dataset_id, o_orderkey AS record_index, CASE WHEN o_orderkey % 5 = 0 THEN 2414 ELSE 55 END AS ds_type,
       CASE WHEN o_orderkey % 11 = 10 THEN NULL ELSE CAST(o_orderkey % 10 AS INT) END AS analysis_type,
       CONCAT('Proc ', substring(o_orderpriority, 1, 1),
              CASE WHEN o_orderkey % 4 = 1 THEN ' residuals below 40 Hz' WHEN o_orderkey % 8 = 3 THEN ' Residual above' ELSE '' END) AS id1,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 12 AS INT) END AS mode_n,
       CASE WHEN o_orderkey % 7 = 0 THEN 0e0 ELSE o_totalprice / 1000e0 END AS freq,
       CASE WHEN o_orderkey % 14 = 0 THEN 0e0 ELSE o_totalprice / 100e0 END AS eig,
       CASE WHEN o_orderkey % 21 = 0 THEN 0e0 ELSE -o_totalprice / 50e0 END AS eig_im FROM orders""",
    # The one-to-one pairs of each comparison with their masked MAC (the same vector seen by both sides).
    "fx_pairs": """
SELECT f.cmp_id, f.mode_no AS fe_mode, e.mode_no AS exp_mode, f.frequency_hz AS fe_hz, e.frequency_hz AS exp_hz,
       (f.frequency_hz - e.frequency_hz) / e.frequency_hz * 100e0 AS err, m.mac
FROM fx_modes f JOIN fx_modes e ON f.cmp_id = e.cmp_id AND f.mode_no = e.mode_no AND f.role = 'FE' AND e.role = 'EXP'
JOIN (SELECT a.cmp_id, a.mode_no,
             least(1e0, (pow(sum(a.re * b.re + a.im * b.im), 2) + pow(sum(a.re * b.im - a.im * b.re), 2))
               / (sum(a.re * a.re + a.im * a.im) * sum(b.re * b.re + b.im * b.im))) AS mac
      FROM fx_shapes a JOIN fx_shapes b ON a.cmp_id = b.cmp_id AND a.mode_no = b.mode_no AND a.node_id = b.node_id
           AND a.dof = b.dof AND a.role = 'FE' AND b.role = 'EXP' AND b.measured GROUP BY 1, 2) m
  ON m.cmp_id = f.cmp_id AND m.mode_no = f.mode_no""",
}
_REF = re.compile(r"\bfx_\w+")


def needed(text: str) -> list[str]:
    """The adapters a text uses, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for inner in _REF.findall(FX.get(name, "")):
            if inner != name:
                visit(inner)
        order.append(name)

    for name in _REF.findall(text):
        if name in FX or name == "fx_vec":
            visit(name)
    return order


class Tables:
    """The modal tables over one data folder; attributes are lazy DataFrames (``t.modes``, ``t.lineitem``)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in TABLES:
            return self._get(name)
        if f"fx_{name}" in FX or name == "vec":
            return self._get(f"fx_{name}")
        raise AttributeError(name)

    def _get(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                self._made[name] = self.sql(VEC_SPARK if name == "fx_vec" else FX[name])
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        """Run a text in which table and adapter names stand for this folder's DataFrames."""
        frames: dict[str, DataFrame] = {}

        def swap(match: re.Match) -> str:
            name = match.group(2)
            if name in TABLES or name in FX or name == "fx_vec":
                frames[name] = self._get(name)
                return f"{match.group(1)} {{{name}}}"
            return match.group(0)

        return self.spark.sql(re.sub(r"\b(FROM|JOIN)\s+(\w+)", swap, text), **frames)

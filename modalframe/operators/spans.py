"""Angles between the spans of two mode groups with any number of members.

Rows of a group are folded to one complex vector per DOF; batches of such vectors become partial Grams (a matrix product each),
which are summed per group. Canonical correlations come from the blocks of the summed Gram, so a task holds a batch of
DOFs, never a group.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def member_grams(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n_p, n_dof, gram`` per group over the DOFs that all members share: real, then imaginary parts, row-major, P members first.

    ``rows``: keys, side ('P' or 'Q'), member, node_id, dof, re, im. A DOF where a member is missing, NULL or repeated is left
    out, and so are rows with a NULL key."""
    rows = rows.select(*keys, "side", "member", "node_id", "dof", F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    members = rows.select(*keys, "side", "member").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"), F.sum((F.col("side") == "P").cast("int")).alias("n_p"))
    per = rows.groupBy(*keys, "node_id", "dof").agg(F.sort_array(F.collect_list(F.struct("side", "member", "re", "im"))).alias("_v"),
                                                    F.count_distinct("side", "member").alias("_d"), F.bool_and(F.col("re").isNotNull() & F.col("im").isNotNull()).alias("_ok"))
    per = per.filter("_ok").join(members, keys).filter((F.size("_v") == F.col("_m")) & (F.col("_d") == F.col("_m")))
    per = per.select(*keys, "n_p", F.transform("_v", lambda x: x["re"]).alias("re"), F.transform("_v", lambda x: x["im"]).alias("im"))
    schema = T.StructType([*[per.schema[k] for k in keys], T.StructField("n_p", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_g", T.ArrayType(T.DoubleType()))])

    def partial(frames):
        for frame in frames:
            out = []
            for key, part in frame.groupby([*keys, "n_p"], sort=False):
                x = np.stack(part["re"].to_numpy()) + 1j * np.stack(part["im"].to_numpy())
                g = x.conj().T @ x
                out.append((*key, len(part), np.concatenate([g.real.ravel(), g.imag.ravel()]).tolist()))
            if out:
                yield pd.DataFrame(out, columns=schema.names)

    entries = per.mapInPandas(partial, schema).select(*keys, "n_p", "_n", F.posexplode("_g").alias("_i", "_v"))
    sums = entries.groupBy(*keys, "n_p", "_i").agg(F.sum("_v").alias("_v"), F.sum("_n").alias("_n"))
    return sums.groupBy(*keys, "n_p").agg(F.max("_n").alias("n_dof"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("gram"))


_ANGLES = T.StructType([T.StructField("rank_p", T.IntegerType()), T.StructField("rank_q", T.IntegerType()), T.StructField("cos2", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(_ANGLES)
def _angles(gram: pd.Series, n_p: pd.Series, tolerance: pd.Series) -> pd.DataFrame:
    out = []
    for flat, p, tol in zip(gram, n_p, tolerance):
        m = math.isqrt(len(flat) // 2)
        half = np.asarray(flat, float).reshape(2, m, m)
        g = half[0] + 1j * half[1]
        if not np.isfinite(half).all():
            out.append((None, None, None))
            continue
        sides = []
        for block in (g[:p, :p], g[p:, p:]):
            val, vec = np.linalg.eigh(block) if len(block) else (np.empty(0), np.empty((0, 0)))
            top = val[-1] if len(val) else 0.0
            keep = val > max(tol * tol, m * np.finfo(float).eps) * top if top > 0 else np.zeros(len(val), bool)
            sides.append(vec[:, keep] / np.sqrt(val[keep]))
        a, b = sides
        cos = np.linalg.svd(a.conj().T @ g[:p, p:] @ b, compute_uv=False) if a.shape[1] and b.shape[1] else None
        out.append((a.shape[1], b.shape[1], None if cos is None else np.clip(cos**2, 0, 1).tolist()))
    return pd.DataFrame(out, columns=[f.name for f in _ANGLES]).astype({"rank_p": "Int32", "rank_q": "Int32"})


def span_angles(rows: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """``keys, n_dof, n_p, n_q, rank_p, rank_q, cos2, subspace_mac`` per group (``rows`` as for `member_grams`).

    A member counts towards the rank while its singular value exceeds ``tolerance`` of the largest (a Gram resolves no less
    than some 1e-8). ``cos2`` falls; ``subspace_mac`` is its sum over the smaller rank, so with one member on side Q it is the
    share of that shape's energy in the span of P. NULL where a side is zero or holds non-finite values; groups without a
    shared DOF, or with an empty side, give no row or NULL."""
    g = member_grams(rows, keys).withColumn("_a", _angles("gram", "n_p", F.lit(float(tolerance))))
    d = g.select(*keys, "n_dof", "n_p", (F.sqrt(F.size("gram") / 2).cast("long") - F.col("n_p")).alias("n_q"), "_a.*")
    total = F.aggregate("cos2", F.lit(0.0), lambda s, x: s + x)
    return d.withColumn("subspace_mac", F.when(F.size("cos2") > 0, F.least(total / F.least("rank_p", "rank_q"), F.lit(1.0))))

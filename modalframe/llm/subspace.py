"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are rotated and cut into blocks of few dimensions. If two of them lie within a squared distance, then in at
least one block they lie within that block's proportional share of it. Each block is searched on its own by a range join,
and what it finds is verified on whole vectors in double precision.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from modalframe.operators.graph import exchanged, star_components
from modalframe.session import scratch_path

BLOCKS = 8
#: Vectors on either side of one comparison task; fuller slabs are cut into pieces of this size.
PIECE = 16_384
#: Allowance for rounding: in the search (single precision) and in the blocks' budgets (double).
SLACK_SEARCH, SLACK = 2e-5, 1e-9


def rotate(x: np.ndarray) -> np.ndarray:
    """Rows turned by fixed signs and the Walsh-Hadamard transform, filled up to a power of two. Every element is a sum taken
    in the same order whatever the other rows are, so a vector's image is the same in every task."""
    n, d = x.shape
    size = 1 << max(0, (d - 1).bit_length())
    signs = np.where(np.random.default_rng(20_011).random(size) < 0.5, -1.0, 1.0)
    y = np.zeros((n, size))
    y[:, :d] = x
    y *= signs
    half = 1
    while half < size:
        z = y.reshape(n, -1, 2, half)
        y = np.concatenate([z[:, :, :1] + z[:, :, 1:], z[:, :, :1] - z[:, :, 1:]], axis=2).reshape(n, size)
        half *= 2
    return y / np.sqrt(size)


def blocks_of(size: int) -> int:
    return min(BLOCKS, size)


def unit(rows: list[bytes], kind: str = "f8") -> np.ndarray:
    """Unit vectors in double precision; ``kind``: how the bytes hold the elements, single precision where the input is."""
    x = np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(v: Column) -> Column:
    """A vector with elements, all finite, not all zero."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def slab_rows(reps: DataFrame, budget: float, kind: str) -> DataFrame:
    """Where each vector is searched: ``dim, block, slab, home, rep, n, vec``. A block is cut into slabs along its first
    coordinate, as wide as its radius; a vector is at home in one slab and visits the next, so partners share a slab."""
    schema = "dim int, block int, slab int, home boolean, rep bigint, n bigint, vec binary"

    def run(batches):
        for b in batches:
            by_dim: dict[int, list[int]] = {}
            vs = b.column(2).to_pylist()
            for i, v in enumerate(vs):
                by_dim.setdefault(len(v), []).append(i)
            reps_, ns = b.column(0).to_numpy(), b.column(1).to_numpy()
            for dim, at in by_dim.items():
                vecs = [np.array(vs[i], kind).tobytes() for i in at]
                y = rotate(unit(vecs, kind))
                m = blocks_of(y.shape[1])
                radius = np.sqrt(budget / m + SLACK)
                slab = np.floor(y[:, :: y.shape[1] // m] / radius).astype(np.int32)
                for k in range(m):
                    for step in (0, 1):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim, np.int32)), pa.array(np.full(len(at), k, np.int32)), pa.array(slab[:, k] + np.int32(step)), pa.array(np.full(len(at), step == 0)),
                                                          pa.array(reps_[at]), pa.array(ns[at]), pa.array(vecs, pa.binary())], names=["dim", "block", "slab", "home", "rep", "n", "vec"])

    return reps.select("rep", "n", "v").mapInArrow(run, schema)


def links_between(left: pd.DataFrame, right: pd.DataFrame, block: int, least_cosine: float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Linked places (in ``left``, in ``right``) that this block is the first to show; two at home in order of their ids."""
    budget = 2 - 2 * least_cosine
    ua, ub = unit(list(left["vec"]), kind), unit(list(right["vec"]), kind)
    ra, rb = rotate(ua), rotate(ub)
    m = blocks_of(ra.shape[1])
    width, share = ra.shape[1] // m, budget / m + SLACK
    own = slice(block * width, (block + 1) * width)
    # |a - b|^2 as one product: (-2a, |a|^2, 1) times (b, 1, |b|^2)
    a, b = ra[:, own], rb[:, own]
    a = np.column_stack([-2 * a, (a * a).sum(1), np.ones(len(a))]).astype(np.float32)
    b = np.ascontiguousarray(np.column_stack([b, np.ones(len(b)), (b * b).sum(1)]).astype(np.float32).T)
    ida, idb, home = left["rep"].to_numpy(), right["rep"].to_numpy(), right["home"].to_numpy()
    out_i, out_j = [], []
    for at in range(0, len(a), 128):
        i, j = np.divmod(np.flatnonzero((a[at : at + 128] @ b).ravel() <= share + SLACK_SEARCH), b.shape[1])
        i += at
        once = ~home[j] | (ida[i] < idb[j])
        i, j = i[once], j[once]
        for s in range(0, len(i), 1 << 16):  # exact checks, a bounded number at a time
            p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            linked = np.einsum("ij,ij->i", ua[p], ub[q]) >= least_cosine
            p, q = p[linked], q[linked]
            within = ((ra[p] - rb[q]) ** 2).reshape(len(p), m, width).sum(2) <= share
            first = np.argmax(within, axis=1) == block
            first &= within[:, block]
            out_i.append(p[first])
            out_j.append(q[first])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.empty(0, int), np.empty(0, int))


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (vertex, least vertex of its component) of the graph with edges a-b."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = inv[: len(a)], inv[len(a) :], np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def near_vectors(vectors: DataFrame, least_cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col, n_links, component_id, kept`` per row: vectors linked at a cosine of at least ``least_cosine``.

    Equal vectors form a class with one representative; classes are compared, and a link counts for all copies. Every link
    is counted in the first block that shows it, so none is counted twice, and pairs are never written out: a task returns
    sums per vector and edges that span its links. Fuller slabs are cut into pieces that meet each other in tasks of
    bounded size.

    A vector that is null, empty, zero or has null or non-finite elements links with nothing: 0 links, its own component,
    kept. Ids are whole numbers from 0 up. Vectors of different lengths never link. Rows repeated under one id count as copies. A row with a null id counts as
    a link for others but has no component (null, kept). An empty table gives an empty one; other columns are not read.
    """
    spark = vectors.sparkSession
    kind = "f4" if vectors.schema[vector_col].dataType.elementType == FloatType() else "f8"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("key", F.when(_usable(F.col("v")), F.md5(F.array_join(F.col("v").cast("array<string>"), ","))))
    classes = rows.filter("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    at = scratch_path(spark, "vectors")
    classes.withColumn("rep", F.coalesce("rep", -1 - F.abs(F.xxhash64("key") % (1 << 62)))).write.parquet(at)
    classes = spark.read.parquet(at)

    at = scratch_path(spark, "slabs")
    slab_rows(classes, 2 - 2 * least_cosine, kind).write.parquet(at)
    placed = spark.read.parquet(at)
    slab = ["dim", "block", "slab"]
    sizes = placed.groupBy(*slab).agg(F.sum(F.col("home").cast("bigint")).alias("n_home"), F.count(F.lit(1)).alias("n_all")).filter("n_home > 0").select(
        *slab, F.ceil(F.col("n_home") / PIECE).cast("int").alias("n_left"), F.ceil(F.col("n_all") / PIECE).cast("int").alias("n_right"))
    placed = placed.join(exchanged(sizes, *slab), slab)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda n: F.pmod(F.xxhash64("rep", "block"), F.col(n)).cast("int")
    left = placed.filter("home").withColumn("i", of("n_left")).withColumn("j", every("n_right")).withColumn("side", F.lit(0))
    right = placed.withColumn("j", of("n_right")).withColumn("i", every("n_left")).withColumn("side", F.lit(1))

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[g["side"] == 0], g[g["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype({"a": "int64", "b": "int64", "n": "int64"})
        i, j = links_between(a, b, int(g["block"].iloc[0]), least_cosine, kind)
        ra, rb, na, nb = a["rep"].to_numpy(), b["rep"].to_numpy(), a["n"].to_numpy(), b["n"].to_numpy()
        ids, inv = np.unique(np.concatenate([ra[i], rb[j]]), return_inverse=True)
        sums = np.bincount(inv, weights=np.concatenate([nb[j], na[i]])).astype(np.int64) if len(ids) else np.empty(0, np.int64)
        x, y = spanning(ra[i], rb[j])
        return pd.DataFrame({"a": np.concatenate([ids, x]), "b": np.concatenate([ids, y]), "n": np.concatenate([sums, np.zeros(len(x), np.int64)])})

    at = scratch_path(spark, "links")
    left.unionByName(right).groupBy(*slab, "i", "j").applyInPandas(compare, "a bigint, b bigint, n bigint").write.parquet(at)
    links = spark.read.parquet(at)
    count = links.filter("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
    # A class without ids stays out of the components' names, not out of their paths.
    parts = star_components(links.filter("a <> b").select("a", "b"))
    named = parts.filter("id >= 0").groupBy("component").agg(F.min("id").alias("least"))
    parts = parts.join(exchanged(named, "component"), "component", "left").select("id", F.when(F.col("component") < 0, F.col("least")).otherwise(F.col("component")).alias("component")).withColumnRenamed("id", "rep")
    per_class = classes.select("key", "rep", "n").join(exchanged(count, "rep"), "rep", "left").join(exchanged(parts, "rep"), "rep", "left").select(
        "key", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("id", "key").join(exchanged(per_class, "key"), "key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))

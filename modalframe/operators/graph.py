"""Connected components of very large edge tables by alternating star contractions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalframe.session import cut_lineage


def exchanged(df: DataFrame, *cols: str) -> DataFrame:
    """The same rows, but a join on ``cols`` shuffles them again instead of reusing an aggregate's partitioning: adaptive
    execution splits a hot key only where both sides of the join are shuffled for it."""
    return df.withColumns({c: F.greatest(F.col(c), F.col(c)) for c in cols})


def _largest_first(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges as (a, b) with a > b, loops and repeats removed."""
    return edges.filter(F.col("a") != F.col("b")).select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(e: DataFrame, keys: list[str]) -> DataFrame:
    """Every neighbour above u is linked to the least of u and its neighbours."""
    both = e.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(*keys, F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy(*keys, "u").agg(F.min(F.least("u", "v")).alias("m"))
    up = e.select(*keys, F.col("b").alias("u"), F.col("a").alias("v"))
    return up.join(exchanged(least, "u"), [*keys, "u"]).select(*keys, F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame, keys: list[str]) -> DataFrame:
    """Every neighbour below a, and a itself, is linked to the least of those neighbours."""
    least = e.groupBy(*keys, "a").agg(F.min("b").alias("m"))
    down = e.join(exchanged(least, "a"), [*keys, "a"]).filter(F.col("b") != F.col("m")).select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionByName(least.select(*keys, "a", F.col("m").alias("b"))).distinct()


def star_components(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Least member of the component of every vertex that has an edge to another: keys, id, component.

    ``edges``: keys, a, b (any direction, repeats and loops allowed; NULL ends are ignored). The number of rounds is
    logarithmic in the size of a component and has no limit; each round is checkpointed reliably. Least members themselves
    are not listed.
    """
    keys = keys or []
    e = cut_lineage(_largest_first(edges, keys))
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(*keys, F.col("a").alias("id"), F.col("b").alias("component"))
        state = now
        e = cut_lineage(_small_star(_large_star(e, keys), keys))

"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, components.

Circulant MinHash needs two permutations only. The first scatters the shingles over the 64-bit circle; the second, turned by
k places, ranks them for coordinate k, and the least rank is that coordinate of the signature.
"""
from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalframe.llm.text import lower_ascii, map_texts, words
from modalframe.operators.graph import exchanged, star_components
from modalframe.session import scratch_path

#: Chance that a pair exactly at the threshold shares no band.
MISS = 1e-6
#: Words whose hash a worker remembers; bounds its memory, not the result.
REMEMBERED = 150_000
#: Members compared in one task of the last search.
FEW, MANY = 128, 512

_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


@lru_cache(maxsize=1)
def _known() -> dict[str, int]:
    return {}


def word_hashes(ws: list[str]) -> np.ndarray:
    """64-bit hash of each word."""
    import xxhash

    known = _known()
    try:
        return np.array([known[w] for w in ws], dtype=np.uint64)
    except KeyError:
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(ws):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.array([known[w] for w in ws], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers."""
    x = x * _ODD[1]
    x ^= x >> np.uint64(29)
    x *= _ODD[2]
    x ^= x >> np.uint64(32)
    return x


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``size`` words; with fewer words the whole sequence is one."""
    ws = words(lower_ascii(text)) if text else []
    if not ws:
        return np.empty(0, np.uint64)
    h, k = word_hashes(ws), min(size, len(ws))
    n = len(h) - k + 1
    s = np.full(n, k, np.uint64) * _ODD[3]
    for j in range(k):
        s = (s + h[j : j + n]) * _ODD[0]
        s ^= s >> np.uint64(31)
    return np.unique(s)


def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows) with the fewest coordinates that keep the miss chance at the threshold below `MISS`, from 4 rows up."""
    rows = 4 if threshold < 0.83 else 5
    return math.ceil(math.log(MISS) / math.log1p(-(threshold**rows))), rows


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinate k is the least rank of the scattered shingles under the second permutation turned by k places."""
    turn = np.arange(coordinates, dtype=np.uint64)[:, None]
    placed = _mix(shingles ^ _ODD[4])
    best = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(placed), 1024):
        x = placed[None, at : at + 1024] - turn
        x *= _ODD[0]
        x ^= x >> np.uint64(32)
        x *= _ODD[2]
        x ^= x >> np.uint64(29)
        np.minimum(best, x.min(axis=1), out=best)
    return best


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band: a hash of the band number and its coordinates."""
    m, key = sig.reshape(bands, rows), np.arange(bands, dtype=np.uint64) * _ODD[3]
    for j in range(rows):
        key = _mix(key + m[:, j])
    return key.view(np.int64)


def _set_key(shingles: np.ndarray) -> bytes | None:
    return hashlib.md5(shingles.tobytes()).digest() if len(shingles) else None


def signatures(docs: DataFrame, size: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """``id_col, n_shingles, set_key, bands`` of every whole text; no key and no bands for an empty set."""
    bands, rows = banding(threshold)

    def compute(texts):
        n, keys, made = [], [], []
        for t in texts:
            s = shingle_set(t, size)
            n.append(len(s))
            keys.append(_set_key(s))
            made.append(band_keys(signature(s, bands * rows), bands, rows) if len(s) else None)
        return [n, keys, made]

    return map_texts(docs, [id_col], text_col, compute, "n_shingles bigint, set_key binary, bands array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``rep, shingles`` of the classes ``wanted`` (set_key, rep, least): read from the documents of their least ids. Where one
    id has several texts, each class takes the one with its own set."""

    def compute(texts):
        sets = [shingle_set(t, size) for t in texts]
        return [[_set_key(s) for s in sets], [s.view(np.int64) for s in sets]]

    some = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t")).join(wanted.select(F.col("least").alias("doc")).distinct(), "doc", "left_semi")
    made = map_texts(some, ["doc"], "t", compute, "set_key binary, shingles array<bigint>")
    return made.join(wanted, "set_key").filter(F.col("doc").cast("bigint") == F.col("least")).dropDuplicates(["set_key"]).select("rep", "shingles")


def _linked(inter, na, nb, percent: int):
    return F.lit(100) * inter >= F.lit(percent) * (na + nb - inter)


def _search(few: pd.DataFrame, many: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between two small lists of sets that join different components, as few as connect them."""
    a, b = [np.asarray(x, np.int64) for x in few["shingles"]], [np.asarray(x, np.int64) for x in many["shingles"]]
    common = np.intersect1d(np.concatenate(a), np.concatenate(b))
    inter = np.zeros((len(a), len(b)), np.float32)

    def rows_of(sets, block):
        m = np.zeros((len(sets), len(block)), np.float32)
        for i, s in enumerate(sets):
            m[i] = np.isin(block, s, assume_unique=True, kind="sort")
        return m

    for at in range(0, len(common), 8192):
        block = common[at : at + 8192]
        inter += rows_of(a, block) @ rows_of(b, block).T
    size_a, size_b = np.array([len(x) for x in a])[:, None], np.array([len(x) for x in b])[None, :]
    got = inter.astype(np.int64)
    hits = np.argwhere(100 * got >= percent * (size_a + size_b - got))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, ca, cb, ra, rb = [], few["component"].tolist(), many["component"].tolist(), few["rep"].tolist(), many["rep"].tolist()
    for i, j in hits.tolist():
        x, y = root(ca[i]), root(cb[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((ra[i], rb[j]))
    return out


def _remaining_links(members: DataFrame, sets: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """Links that the first member of a bucket did not show. In a bucket whose members lie in several components, those
    outside the most frequent one are compared with all its members, in blocks of bounded size. Only links that join two
    components come out, never all pairs."""
    m = members.join(exchanged(components.withColumnRenamed("id", "rep"), "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    per = m.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("h"))
    stats = per.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("n_main"),
                                   F.count(F.lit(1)).alias("parts"), F.sum("h").alias("h")).filter("parts > 1")
    open_ = stats.groupBy("n", "h").agg(F.min("key").alias("key"), F.min_by("main", "key").alias("main"), F.min_by("n_main", "key").alias("n_main")).select(
        "key", "main", F.ceil((F.col("n") - F.col("n_main")) / FEW).alias("n_few"), F.ceil(F.col("n") / MANY).alias("n_many"))
    m = m.join(exchanged(open_, "key"), "key")
    spread = lambda n: F.pmod(F.xxhash64("rep", "key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    few = m.filter(F.col("component") != F.col("main")).withColumn("i", spread("n_few")).withColumn("j", every("n_many")).withColumn("few", F.lit(True))
    many = m.withColumn("j", spread("n_many")).withColumn("i", every("n_few")).withColumn("few", F.lit(False))
    rows = few.unionByName(many).select("key", "i", "j", "few", "rep", "component").join(exchanged(sets, "rep"), "rep")

    def search(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[g["few"]], g[~g["few"]]
        return pd.DataFrame(_search(a, b, percent) if len(a) and len(b) else [], columns=["a", "b"]).astype("int64")

    return rows.groupBy("key", "i", "j").applyInPandas(search, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` per row of ``docs``.

    Documents link where 100 * intersection >= ``percent`` * union of their sets of ``size``-word shingles (words of
    A-Z-lower-cased text; shingles are compared by 64-bit hashes). Texts with the same set form a class that stands for its
    copies; classes are compared only where a band of their signatures agrees, and every link is verified on full sets. At
    the threshold itself a pair shares no band with a chance of one in a million, above it with less.

    Null, empty and wordless texts have no shingles and link with nothing. ``component_id`` is the least linked id (a
    number), and ``kept`` marks it. A row with a null id links with nothing: component null, kept. Classes have numbers of their
    own, so several texts under one id are compared each by itself, and rows repeated under one id get the same answer. An
    empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    at = scratch_path(spark, "signatures")
    signatures(docs, size, percent / 100, id_col, text_col).write.parquet(at)
    sigs = spark.read.parquet(at).withColumnRenamed(id_col, "doc")
    reps = sigs.filter("set_key is not null and doc is not null").groupBy("set_key").agg(F.min(F.col("doc").cast("bigint")).alias("least"), F.first("bands").alias("bands"))
    at = scratch_path(spark, "bands")
    reps.withColumn("rep", F.monotonically_increasing_id()).write.parquet(at)
    reps = spark.read.parquet(at)
    exploded = reps.select("rep", F.explode("bands").alias("key"))
    buckets = exploded.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "hub")
    at = scratch_path(spark, "members")
    exploded.join(exchanged(buckets, "key"), "key").write.parquet(at)
    members = spark.read.parquet(at)
    pairs = members.filter("rep <> hub").select("rep", "hub").distinct()

    wanted = reps.select("set_key", "rep", "least").join(members.select("rep").distinct(), "rep", "left_semi")
    at = scratch_path(spark, "sets")
    _sets(docs, wanted, size, id_col, text_col).write.parquet(at)
    sets = spark.read.parquet(at)
    both = pairs.join(sets, "rep").join(exchanged(sets.select(F.col("rep").alias("hub"), F.col("shingles").alias("others")), "hub"), "hub")
    inter = F.size(F.array_intersect("shingles", "others"))
    first = both.filter(_linked(inter, F.size("shingles"), F.size("others"), percent)).select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    stars = star_components(first)
    rest = _remaining_links(members.select("rep", "key"), sets, stars, percent)
    final = star_components(stars.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(rest))

    joined = reps.select("set_key", "rep", "least").join(exchanged(final.withColumnRenamed("id", "rep"), "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    smallest = joined.groupBy("component").agg(F.min("least").alias("class"))
    classes = joined.join(exchanged(smallest, "component"), "component").select("set_key", "class")
    out = sigs.select("doc", "n_shingles", F.when(F.col("doc").isNotNull(), F.col("set_key")).alias("set_key")).join(exchanged(classes, "set_key"), "set_key", "left")
    component = F.coalesce("class", F.col("doc").cast("bigint"))
    return out.select(F.col("doc").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc").cast("bigint") == component, F.lit(True)).alias("kept"))

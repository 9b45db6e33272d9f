"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised to powers of two. An n-gram of level q is entered q times, with levels 1 to q,
so asking for level 1, 2, ... until a miss returns its level; a false hit can only raise it, by one level with a small
chance, by two with its square. Smoothed probabilities come from these probes alone. Segments of the filter are broadcast
as long as they fit; those that do not are probed by a shuffled look-up, with the same results.
"""
from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modalframe.llm.circulant import word_hashes
from modalframe.llm.text import lower_ascii, words
from modalframe.session import scratch_path

#: Added to every count, as in the base score.
ADDED = 0.1
#: Weight of the word pair against the single word.
PAIR_WEIGHT = 0.3
#: Word pairs enter the filter from this count on.
LEAST_PAIR = 2
BITS_PER_ENTRY, PROBES = 10, 5
#: Bound of the broadcast segments of the filter. All others stay where they are and are looked up by a join.
MAX_FILTER_BYTES = 256 << 20
#: Words whose exact counts are broadcast for the base score (the most frequent); all others are looked up by a join.
FREQUENT = 1 << 16
#: Documents per bucket of n-grams, words handled at a time, and bytes of blocks handed on at a time.
DOCS_PER_BUCKET, CHUNK, HANDED_ON = 8192, 1 << 20, 4 << 20

_M = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], dtype=np.uint64)
#: The end of a text, and the context of its first word.
END = np.uint64(0x1F83D9ABFB41BD6B)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's A-Z-lower-cased words, then the end."""
    ws = words(lower_ascii(text)) if text else []
    return np.append(word_hashes(ws), END) if ws else np.array([END], np.uint64)


def pairs(t: np.ndarray) -> np.ndarray:
    """Keys of (previous word, word) at each place; the first word follows the end of nothing."""
    before = np.concatenate([[END], t[:-1]]).astype(np.uint64)
    return _mix(before * _M[0] + t * _M[3])


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))) + 1, 0).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """Middle of the counts of a level; 0 for none."""
    return np.where(levels > 0, 1.5 * np.exp2(levels - 1.0) - 0.5, 0.0)


def train_row(id_col: str) -> Column:
    """Rows to learn from: crc32 of the id as text is not 0 modulo 10. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 != 0, F.lit(False))


# ------------------------------------------------------------------------------------------------ the filter
def _bits(keys: np.ndarray, level: np.ndarray | int, size: np.ndarray | int, probe: int) -> np.ndarray:
    a = _mix(keys + np.uint64(0x632BE59BD9B4E019) * np.asarray(level, np.uint64))
    b = (a * _M[0]) | np.uint64(1)
    return (a + np.uint64(probe) * b) % np.asarray(size, np.uint64)


def _segment_bytes(entries: int) -> int:
    return max(8, -(-BITS_PER_ENTRY * entries // 8))


def build_segment(keys: np.ndarray, levels: np.ndarray) -> bytes:
    """Bits of the entries (key, 1) to (key, level) of every key."""
    size = 8 * _segment_bytes(int(levels.sum()))
    bits = np.zeros(size, bool)
    for q in range(1, int(levels.max(initial=0)) + 1):
        at = keys[levels >= q]
        for p in range(PROBES):
            bits[_bits(at, q, size, p).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


class LogFrequencyFilter:
    """Segments of a Bloom filter, one for each bucket of keys."""

    def __init__(self, segments: list[bytes]):
        self.sizes = np.array([8 * len(s) for s in segments], np.uint64)
        self.starts = np.concatenate([[0], np.cumsum([len(s) for s in segments])])[:-1].astype(np.int64)
        self.data = np.frombuffer(b"".join(segments), np.uint8)

    def _has(self, keys: np.ndarray, seg: np.ndarray, q: int) -> np.ndarray:
        left = np.arange(len(keys))
        for p in range(PROBES):
            bit = _bits(keys[left], q, self.sizes[seg[left]], p).astype(np.int64)
            left = left[(self.data[self.starts[seg[left]] + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 == 1]
        return left

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key: how many probes from level 1 on succeed."""
        seg, out, active = (keys % np.uint64(len(self.sizes))).astype(np.int64), np.zeros(len(keys), np.int64), np.arange(len(keys))
        for q in range(1, 64):
            active = active[self._has(keys[active], seg[active], q)]
            if not len(active):
                break
            out[active] = q
        return out


# ------------------------------------------------------------------------------------------------ counting
def _by_bucket(kind: str, keys: np.ndarray, counts: np.ndarray, buckets: int):
    b = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    ends = np.searchsorted(b[order], np.arange(buckets + 1))
    for k in range(buckets):
        at = order[ends[k] : ends[k + 1]]
        if len(at):
            yield kind, k, keys[at].tobytes(), counts[at].astype(np.uint32).tobytes()


def _batches(rows, schema: pa.Schema):
    """Arrow batches of rows that end in blocks of bytes, a bounded size each."""
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= HANDED_ON:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)


def _added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def ngram_counts(docs: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """Blocks of added-up counts: kind (word, pair), bucket, keys, counts. Added up per chunk before they are shuffled."""
    schema = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def flush(parts):
        for kind, make in (("word", lambda t: t), ("pair", pairs)):
            keys, counts = np.unique(np.concatenate([make(t) for t in parts]), return_counts=True)
            yield from _batches(_by_bucket(kind, keys, counts, buckets), schema)

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                parts.append(tokens(text))
                n += len(parts[-1])
                if n >= 2 * CHUNK:
                    yield from flush(parts)
                    parts, n = [], 0
        if parts:
            yield from flush(parts)

    return docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "kind string, bucket int, keys binary, counts binary")


def add_up(blocks: DataFrame) -> DataFrame:
    """One row per kind and bucket: sums over all blocks, and the filter segment. Words keep their counts, pairs do not."""

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        kind, bucket = g["kind"].iloc[0], int(g["bucket"].iloc[0])
        keys, counts = _added_up(np.concatenate([np.frombuffer(x, np.uint64) for x in g["keys"]]), np.concatenate([np.frombuffer(x, np.uint32) for x in g["counts"]]).astype(np.int64))
        distinct, total = len(keys), int(counts.sum())
        if kind == "pair":
            keys, counts = keys[counts >= LEAST_PAIR], counts[counts >= LEAST_PAIR]
        levels = level_of(counts)
        per_level = np.bincount(levels, minlength=1)
        return pd.DataFrame({"kind": [kind], "bucket": [bucket], "keys": [keys.tobytes()], "counts": [counts.tobytes()], "distinct": [distinct], "total": [total],
                             "entries": [int((per_level * np.arange(len(per_level))).sum())]})

    return blocks.groupBy("kind", "bucket").applyInPandas(merge, "kind string, bucket int, keys binary, counts binary, distinct bigint, total bigint, entries bigint")


def _segments(sums: DataFrame) -> DataFrame:
    """Filter segment of each kind and bucket."""

    def build(frames):
        for g in frames:
            rows = [build_segment(np.frombuffer(k, np.uint64), level_of(np.frombuffer(c, np.int64))) for k, c in zip(g["keys"], g["counts"])]
            yield pd.DataFrame({"kind": g["kind"], "bucket": g["bucket"], "bits": rows})

    return sums.select("kind", "bucket", "keys", "counts").mapInPandas(build, "kind string, bucket int, bits binary")


def _near(sums: DataFrame, buckets: int) -> dict[str, int]:
    """How many buckets of each kind, from the first on, are broadcast: words before pairs, as long as they fit."""
    sizes = {(r.kind, r.bucket): _segment_bytes(r.entries) for r in sums.select("kind", "bucket", "entries").toLocalIterator()}
    near, left = {"word": 0, "pair": 0}, MAX_FILTER_BYTES
    for kind in near:
        for k in range(buckets):
            left -= sizes.get((kind, k), 0)
            if left < 0:
                return near
            near[kind] = k + 1
    return near


# ------------------------------------------------------------------------------------------------ scoring
def _distinct(t: np.ndarray, ends: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Distinct words and pairs of texts that stand one after the other, and which of them is at each place."""
    before = np.concatenate([[END], t[:-1]]).astype(np.uint64)
    before[ends[:-1]] = END
    return {"word": np.unique(t, return_inverse=True), "pair": np.unique(_mix(before * _M[0] + t * _M[3]), return_inverse=True)}


def far_keys(keys: np.ndarray, buckets: int, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys whose segment is not broadcast, by bucket and then as they stand, and where each bucket starts and ends."""
    b = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    stops = np.searchsorted(b[order], np.arange(near, buckets + 1))
    return order[stops[0] :], stops - stops[0]


class Scorer:
    def __init__(self, shared: dict):
        self.words, self.pairs = LogFrequencyFilter(shared["word"]), LogFrequencyFilter(shared["pair"])
        self.n, self.v, self.near, self.buckets = shared["n"], shared["v"], shared["near"], len(shared["word"])
        self.keys, self.counts = shared["frequent"]
        self.floor = math.log10(self.n + ADDED * (self.v + 1))

    def log10_probabilities(self, t: np.ndarray, uni: np.ndarray, duo: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Smoothed log10 probability at each place, from quantised counts of the word, the pair and the word before."""
        single = (uni + ADDED) / (self.n + ADDED * (self.v + 1))
        share = np.where(before > 0, duo / np.maximum(np.maximum(before, duo), 1.0), 0.0)
        weight = np.where(before > 0, PAIR_WEIGHT, 0.0)
        return np.log10(np.minimum(weight * share + (1 - weight) * single, 1.0))

    def score(self, t: np.ndarray, ends: np.ndarray, far: dict[str, np.ndarray] | None = None) -> np.ndarray:
        """Log10 probability of each text; they stand one after the other in ``t``. ``far``: levels of the keys of `far_keys`."""
        first = np.concatenate([[0], ends[:-1]])
        counts = {}
        for kind, (keys, inv) in _distinct(t, ends).items():
            levels = (self.words if kind == "word" else self.pairs).levels(keys)
            if far is not None:
                levels[far_keys(keys, self.buckets, self.near[kind])[0]] = far[kind]
            counts[kind] = count_of(levels)[inv]
        uni, duo = counts["word"], counts["pair"]
        before = np.concatenate([[0.0], uni[:-1]])
        before[first] = uni[ends[0] - 1]  # every text ends in END
        return np.add.reduceat(self.log10_probabilities(t, uni, duo, before), first)

    def frequent(self, t: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
        """(known, base score) of a text's frequent words; its other words and how often they occur."""
        u, c = np.unique(t, return_counts=True)
        at = np.minimum(np.searchsorted(self.keys, u), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == u if len(self.keys) else np.zeros(len(u), bool)
        base = (c[hit] * (np.log10(self.counts[at[hit]] + ADDED) - self.floor)).sum()
        return int(c[hit].sum()), float(base), u[~hit], c[~hit]


_SCORED = [("rid", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
           ("bucket", pa.int32()), ("rids", pa.binary()), ("keys", pa.binary()), ("times", pa.binary()), ("kind", pa.string())]


def score_documents(docs: DataFrame, shared, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """Texts (no bucket) with what is known on the spot, and blocks of rarer words to be looked up (no kind for either).

    If part of the filter is not broadcast, ``score`` is null and there are two more kinds of rows, whose ``rid`` is that of
    the first text of a chunk: the chunk's words (kind "chunk": ends of its texts, distinct words, which is where), and the
    words and pairs to ask for, by bucket.
    """
    schema = pa.schema([("doc", pa.int64()), *_SCORED])
    scorer: list[Scorer] = []

    def run(batches):
        if not scorer:
            scorer.append(Scorer(shared.value))
        s, rid = scorer[0], uuid.uuid4().int & ((1 << 62) - 1) & ~((1 << 24) - 1)

        def flush(ids, texts):
            nonlocal rid
            rids = np.arange(rid, rid + len(texts), dtype=np.int64)
            rid += len(texts)
            known, base, owner, rare, times = [], [], [], [], []
            for r, t in zip(rids, texts):
                k, b, u, c = s.frequent(t)
                known.append(k), base.append(b), rare.append(u), times.append(c), owner.append(np.full(len(u), r))
            n = len(texts)
            none = [None] * n
            t, ends = np.concatenate(texts), np.cumsum([len(x) for x in texts])
            whole = min(s.near.values()) == buckets
            scores = s.score(t, ends) if whole else none
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip([ids, rids, [len(t) for t in texts], known, base, scores, *[none] * 5], schema, strict=True)], schema=schema)
            rare, times, owner = np.concatenate(rare), np.concatenate(times), np.concatenate(owner)
            b = (rare % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            stops = np.searchsorted(b[order], np.arange(buckets + 1))
            none = (None,) * 6
            yield from _batches(((*none, k, owner[at].tobytes(), rare[at].tobytes(), times[at].astype(np.uint32).tobytes(), None) for k in range(buckets) if len(at := order[stops[k] : stops[k + 1]])), schema)
            if not whole:
                yield from _batches(to_ask(int(rids[0]), t, ends), schema)

        def to_ask(chunk, t, ends):
            none, parts = (None,) * 4, _distinct(t, ends)
            yield None, chunk, *none, None, ends.astype(np.int64).tobytes(), parts["word"][0].tobytes(), parts["word"][1].astype(np.uint32).tobytes(), "chunk"
            for kind, (keys, _) in parts.items():
                at, stops = far_keys(keys, buckets, s.near[kind])
                for k, (x, y) in enumerate(zip(stops, stops[1:]), s.near[kind]):
                    if y > x:
                        yield None, chunk, *none, k, None, keys[at[x:y]].tobytes(), None, kind

        ids, texts, n = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(tokens(text))
                n += len(texts[-1])
                if n >= CHUNK:
                    yield from flush(ids, texts)
                    ids, texts, n = [], [], 0
        if texts:
            yield from flush(ids, texts)

    ddl = "doc bigint, rid bigint, n_tokens bigint, n_known bigint, base_score double, score double, bucket int, rids binary, keys binary, times binary, kind string"
    return docs.select(F.col(id_col).cast("bigint").alias("d"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, ddl)


def _look_up(blocks: DataFrame, dictionary: DataFrame, floor: float) -> DataFrame:
    """Exact base terms of the rarer words, added up per text and bucket: rid, n_known, base_score."""

    def look(key, asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        have = np.frombuffer(known["keys"].iloc[0], np.uint64) if len(known) else np.empty(0, np.uint64)
        counts = np.frombuffer(known["counts"].iloc[0], np.int64) if len(known) else np.empty(0, np.int64)
        out = []
        for rids, keys, times in zip(asked["rids"], asked["keys"], asked["times"]):
            r, k, n = np.frombuffer(rids, np.int64), np.frombuffer(keys, np.uint64), np.frombuffer(times, np.uint32).astype(np.int64)
            at = np.minimum(np.searchsorted(have, k), max(len(have) - 1, 0))
            c = np.where(have[at] == k, counts[at], 0) if len(have) else np.zeros(len(k), np.int64)
            u, inv = np.unique(r, return_inverse=True)
            out.append(pd.DataFrame({"rid": u, "n_known": np.bincount(inv, weights=n * (c > 0)).astype(np.int64), "base_score": np.bincount(inv, weights=n * (np.log10(c + ADDED) - floor))}))
        return pd.concat(out) if out else pd.DataFrame({"rid": [], "n_known": [], "base_score": []}).astype({"rid": "int64", "n_known": "int64", "base_score": "float64"})

    return blocks.groupBy("bucket").cogroup(dictionary.groupBy("bucket")).applyInPandas(look, "rid bigint, n_known bigint, base_score double")


def _far_levels(asked: DataFrame, segments: DataFrame) -> DataFrame:
    """Levels of the keys asked for in segments that are not broadcast: rid, kind, bucket, levels (a byte for each key)."""

    def look(key, asked: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
        blocks = [np.frombuffer(x, np.uint64) for x in asked["keys"]]
        levels = np.zeros(sum(map(len, blocks)), np.uint8)
        if len(segment) and len(blocks):
            keys, inv = np.unique(np.concatenate(blocks), return_inverse=True)
            levels = LogFrequencyFilter([segment["bits"].iloc[0]]).levels(keys).astype(np.uint8)[inv]
        stops = np.cumsum([0, *map(len, blocks)])
        return pd.DataFrame({"rid": asked["rid"], "kind": asked["kind"], "bucket": asked["bucket"], "levels": [levels[x:y].tobytes() for x, y in zip(stops, stops[1:])]})

    return asked.groupBy("kind", "bucket").cogroup(segments.groupBy("kind", "bucket")).applyInPandas(look, "rid bigint, kind string, bucket int, levels binary")


def _far_scores(chunks: DataFrame, levels: DataFrame, shared) -> DataFrame:
    """``rid, score`` of the texts of each chunk, from the broadcast segments and the levels that were looked up."""
    scorer: list[Scorer] = []

    def finish(key, chunk: pd.DataFrame, levels: pd.DataFrame) -> pd.DataFrame:
        if not scorer:
            scorer.append(Scorer(shared.value))
        levels = levels.sort_values("bucket")
        far = {kind: np.frombuffer(b"".join(levels["levels"][levels["kind"] == kind]), np.uint8) for kind in ("word", "pair")}
        r = chunk.iloc[0]
        ends = np.frombuffer(r["rids"], np.int64)
        t = np.frombuffer(r["keys"], np.uint64)[np.frombuffer(r["times"], np.uint32)]
        return pd.DataFrame({"rid": key[0] + np.arange(len(ends), dtype=np.int64), "score": scorer[0].score(t, ends, far)})

    return chunks.groupBy("rid").cogroup(levels.groupBy("rid")).applyInPandas(finish, "rid bigint, score double")


def _frequent(sums: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the most frequent words, at most `FREQUENT`; each task first keeps its own most frequent."""

    def top(frames):
        for g in frames:
            for k, c in zip(g["keys"], g["counts"]):
                keys, counts = np.frombuffer(k, np.int64), np.frombuffer(c, np.int64)
                at = np.argsort(-counts, kind="stable")[:FREQUENT]
                yield pd.DataFrame({"key": keys[at], "n": counts[at]})

    got = sums.filter("kind = 'word'").select("keys", "counts").mapInPandas(top, "key bigint, n bigint").orderBy(F.desc("n"), "key").limit(FREQUENT).toPandas()
    keys, counts = got["key"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    Learns from the rows that are not held out (`train_row`); words are compared by 64-bit hashes. ``base_score`` uses exact
    counts; ``score`` interpolates quantised counts of word pairs and words, read from the filter. The filter holds every
    word and every pair seen at least `LEAST_PAIR` times, whatever its size; at most `MAX_FILTER_BYTES` of it are broadcast
    and the rest is looked up, which changes no score.

    Null and empty texts are one end token. A row with a null id is scored and never learned from. Repeated rows count and
    score once each. Without training rows N and V are 0. An empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col), F.col(text_col))
    buckets = max(16, -(-docs.count() // DOCS_PER_BUCKET))
    at = scratch_path(spark, "ngrams")
    add_up(ngram_counts(docs.filter(train_row(id_col)), text_col, buckets)).write.parquet(at)
    sums = spark.read.parquet(at)
    totals = sums.filter("kind = 'word'").agg(F.sum("total"), F.sum("distinct")).first()
    n, v = totals[0] or 0, totals[1] or 0
    empty = build_segment(np.empty(0, np.uint64), np.empty(0, np.int64))
    near = _near(sums, buckets)
    shared = {"n": n, "v": v, "frequent": _frequent(sums), "near": near, "word": [empty] * buckets, "pair": [empty] * buckets}
    is_near = F.col("bucket") < F.when(F.col("kind") == "word", near["word"]).otherwise(near["pair"])
    for r in _segments(sums.filter(is_near)).toLocalIterator():
        shared[r.kind][r.bucket] = bytes(r.bits)
    at, shared = scratch_path(spark, "scored"), spark.sparkContext.broadcast(shared)
    score_documents(docs, shared, buckets, id_col, text_col).write.parquet(at)
    scored = spark.read.parquet(at)
    floor = math.log10(n + ADDED * (v + 1))
    plain = scored.filter("kind is null")
    rare = _look_up(plain.filter("bucket is not null").select("bucket", "rids", "keys", "times"), sums.filter("kind = 'word'").select("bucket", "keys", "counts"), floor)
    texts = plain.filter("bucket is null").select("rid", "doc", "n_tokens", "n_known", "base_score", "score")
    parts = texts.unionByName(rare, allowMissingColumns=True)
    if min(near.values()) < buckets:
        levels = _far_levels(scored.filter("kind in ('word', 'pair')").select("rid", "kind", "bucket", "keys"), _segments(sums.filter(~is_near)).select("kind", "bucket", "bits"))
        parts = parts.unionByName(_far_scores(scored.filter("kind = 'chunk'").select("rid", "rids", "keys", "times"), levels, shared), allowMissingColumns=True)
    both = parts.groupBy("rid").agg(
        F.max("doc").alias(id_col), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.max("score").alias("score"))
    return both.select(id_col, (~train_row(id_col)).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")

"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""
from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modalframe.llm.text import map_texts, words

#: Size of the hashed feature space; coordinate 0 stands for the label's share in training.
BITS = 24
#: Most labelled rows that training uses, least hash of the id first. Training is one sequential pass over them at a time.
TRAIN_ROWS = 12_000
EPOCHS = 2
#: Learning rate, its offset, and the penalties: per-coordinate rates, L1 for sparsity.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 5.0, 1.0
#: Words whose hash a worker remembers; bounds its memory, not the result.
REMEMBERED = 150_000

_M = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], dtype=np.uint64)
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


@lru_cache(maxsize=1)
def _known() -> dict[str, int]:
    return {}


def _hashes(ws: list[str]) -> np.ndarray:
    """Hash of each word in lower case, without the marks at its ends."""
    import xxhash

    known = _known()
    if len(known) > REMEMBERED:
        known.clear()
    try:
        return np.array([known[w] for w in ws], dtype=np.uint64)
    except KeyError:
        for w in set(ws):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w.strip(_EDGE).lower())
        return np.array([known[w] for w in ws], dtype=np.uint64)


def features(text: str | None) -> np.ndarray:
    """Coordinates (with repeats) of a text's words, word pairs and pairs that skip one word."""
    h = _hashes(words(text))
    shift = np.uint64(64 - BITS)
    parts = [(h * _M[0]) >> shift]
    for gap, salt in ((1, 1), (2, 2)):
        if len(h) > gap:
            x = (h[:-gap] * _M[salt] + h[gap:]) * _M[3]
            x ^= x >> np.uint64(31)
            parts.append((x * _M[0]) >> shift)
    return np.maximum(np.concatenate(parts).astype(np.uint32), 1)


class Ftrl:
    """Weights of binary features, learned one example at a time with a rate of its own for each coordinate.

    ``prior``: log odds of the label before any feature is seen; it is not learned."""

    def __init__(self, size: int, prior: float = 0.0):
        self.z, self.n, self.prior = np.zeros(size, np.float32), np.zeros(size, np.float32), prior

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(self.prior + w.sum(), -35, 35))) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(examples: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates with a weight, and the weights; the prior comes first. No examples: nothing."""
    if not examples:
        return np.empty(0, np.uint32), np.empty(0, np.float64)
    ones = sum(y for _, y in examples)
    model = Ftrl(1 << BITS, float(np.log((ones + 0.5) / (len(examples) - ones + 0.5))))
    for _ in range(EPOCHS):
        for at, label in examples:
            model.learn(at, label)
    at = np.flatnonzero(np.abs(model.z) > L1).astype(np.uint32)
    return np.append(np.uint32(0), at), np.append(model.prior, model.weights(at))


class Scorer:
    def __init__(self, at: np.ndarray, w: np.ndarray):
        self.at, self.w = at, w
        self.any = np.zeros(1 << BITS, bool)
        self.any[at] = True

    def score(self, text: str | None) -> float:
        """Probability of label 1; 0 without a model."""
        if not len(self.at):
            return 0.0
        x = features(text)
        x = np.unique(x[self.any[x]])
        return float(1 / (1 + np.exp(-np.clip(self.w[0] + self.w[np.searchsorted(self.at, x)].sum(), -35, 35))))


def held_out(id_col: str) -> Column:
    """Rows that never train: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most ``rows`` labelled ids that are not held out, one text of each (the one of least hash, where an id has
    several), in one task; only the sparse weights reach the driver."""
    order = F.xxhash64(F.col(id_col).cast("string"))
    sample = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    sample = sample.orderBy(order, id_col).limit(rows)
    texts = docs.select(F.col(id_col), F.col(text_col).alias("t")).join(F.broadcast(sample), id_col)
    texts = texts.groupBy(id_col, "y").agg(F.min_by("t", F.xxhash64("t")).alias("t"))

    def compute(batch):
        return [[np.unique(features(t)).astype(np.int32) for t in batch]]

    made = map_texts(texts, [id_col, "y"], "t", compute, "at array<int>")
    ordered = made.repartition(1).sortWithinPartitions(order, id_col, F.size("at"))

    def learn(frames):
        examples = [(np.asarray(a, np.uint32), int(y)) for f in frames for a, y in zip(f["at"], f["y"])]
        at, w = fit(examples)
        yield pd.DataFrame({"at": at.astype(np.int64), "w": w})

    got = ordered.mapInPandas(learn, "at bigint, w double").orderBy("at").toPandas()
    return got["at"].to_numpy(np.uint32), got["w"].to_numpy(np.float64)


def score_texts(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: list[str], text_col: str) -> DataFrame:
    """Columns ``keep`` and ``score`` of every whole text. The broadcast weights are sparse and lie in 2**BITS coordinates."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ready: list[Scorer] = []

    def compute(texts):
        if not ready:
            ready.append(Scorer(*shared.value))
        return [[ready[0].score(t) for t in texts]]

    return map_texts(docs, keep, text_col, compute, "score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``id_col, held_out, score, predicted`` of every row of ``docs``.

    Learns from labelled ids that are not held out (`held_out`), at most `TRAIN_ROWS` of them with one text each; a score sees the text alone.
    Null and empty texts score by the label's share in training. Repeated rows score alike, a null id is scored and never trains, labels of ids
    without a text are ignored, several labels of one id count by the greatest, and without labels every score is 0. An
    empty table gives an empty one; other columns are not read.
    """
    scored = score_texts(docs.select(id_col, text_col), train(docs, labels, id_col, text_col, label_col), [id_col], text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filter_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``. Each row is judged by itself, so ids may repeat."""
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)])
    scored = score_texts(plain, train(docs, labels, id_col, text_col, label_col), plain.columns, f"k{names.index(text_col)}")
    return scored.filter(F.col("score") < threshold).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])

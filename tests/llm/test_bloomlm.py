"""Language-model scores: exact base scores, the filter's levels, and better held-out scores than the base."""
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from modalframe.llm import bloomlm as b

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None]


def _held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def test_levels_and_filter():
    assert b.level_of(np.array([0, 1, 2, 3, 4, 1023, 1024])).tolist() == [0, 1, 2, 2, 3, 10, 11]
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    levels = b.level_of(rng.zipf(1.5, 20_000))
    seg = (keys % np.uint64(4)).astype(int)
    f = b.LogFrequencyFilter([b.build_segment(keys[seg == k], levels[seg == k]) for k in range(4)])
    got = f.levels(keys)
    assert (got >= levels).all() and (got == levels).mean() > 0.97
    assert (f.levels(rng.integers(2**63, 2**64, 20_000, dtype=np.uint64)) > 0).mean() < 0.03
    assert (b.LogFrequencyFilter([b.build_segment(keys[:0], levels[:0])] * 3).levels(keys) == 0).all()


def test_scores(spark):
    rng = random.Random(4)
    chain = {f"w{i}": [f"w{rng.randrange(80)}" for _ in range(3)] for i in range(80)}

    def text():
        w, out = "w0", []
        for _ in range(rng.randrange(5, 120)):
            out.append(w if rng.random() > 0.05 else f"Rare{rng.randrange(5000)}")
            w = rng.choice(chain[w])
        return " ".join(out)

    rows = [(i, text(), "x") for i in range(400)] + [(1000, None, "x"), (1001, "", "x"), (None, "w1 w2", "x"), (0, text(), "x"), (1002, "é É w1\x0bW1", "x"), (1003, "w1 " * 60_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = b.language_model(df).collect()
    counts = Counter(t for i, x, _ in rows if not _held(i) for t in _tokens(x))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), _held(i), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4)) for i, t in ((i, _tokens(x)) for i, x, _ in rows))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    held = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)
    assert b.language_model(df.limit(0)).collect() == []


def test_rare_words_are_looked_up(spark, monkeypatch):
    monkeypatch.setattr(b, "FREQUENT", 3)
    rows = [(i, " ".join(f"v{(i * k) % 17}" for k in range(20))) for i in range(60)]
    got = {r.doc_id: r for r in b.language_model(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    counts = Counter(t for i, x in rows if not _held(i) for t in _tokens(x))
    n, v = sum(counts.values()), len(counts)
    for i, x in rows:
        assert abs(got[i].base_score - sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in _tokens(x))) < 1e-6


def test_the_bound_leaves_out_rare_levels(spark, monkeypatch):
    monkeypatch.setattr(b, "MAX_FILTER_BYTES", 64)
    rows = [(i, " ".join(f"v{(i * k) % 97}" for k in range(40))) for i in range(60)]
    got = b.language_model(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 60 and all(r.score < 0 for r in got)


def test_scores_do_not_depend_on_the_bound(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join(f"v{int(rng.paretovariate(0.7)) % 500}" for _ in range(rng.randrange(60)))) for i in range(300)] + [(1000, None), (None, "v1 v2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    score = lambda: sorted((str(r.doc_id), r.n_known, round(r.base_score, 6), round(r.score, 9)) for r in b.language_model(df).collect())
    monkeypatch.setattr(b, "CHUNK", 500)
    want = score()
    for bound in (0, 100, 900, 1500):
        monkeypatch.setattr(b, "MAX_FILTER_BYTES", bound)
        assert score() == want, bound

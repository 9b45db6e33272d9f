"""Toxicity: the learner against a plain loop, held-out accuracy, and the edges of the input."""
import math
import zlib

import numpy as np

from modalframe.llm import ftrl as f


def test_learner_is_ftrl_proximal():
    rng = np.random.default_rng(1)
    examples = [(np.unique(rng.integers(1, 30, 6)).astype(np.uint32), int(rng.integers(0, 2))) for _ in range(300)]
    model = f.Ftrl(64)
    z, n = [0.0] * 64, [0.0] * 64

    def weight(i):
        return 0.0 if abs(z[i]) <= f.L1 else -(z[i] - math.copysign(f.L1, z[i])) / ((f.BETA + math.sqrt(n[i])) / f.ALPHA + f.L2)

    for at, y in examples:
        model.learn(at, y)
        w = {int(i): weight(int(i)) for i in at}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i, wi in w.items():
            s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / f.ALPHA
            z[i] += g - s * wi
            n[i] += g * g
    assert np.allclose(model.z, z, atol=1e-3) and np.allclose(model.n, n, atol=1e-3)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = f.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    y = {r.doc_id: r.toxic for r in labels.collect()}
    test = [(y[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in y]
    pos, neg = [s for t, s in test if t], [s for t, s in test if not t]
    assert sum(p > q for p in pos for q in neg) >= 0.9 * len(pos) * len(neg)


def test_edges_of_the_input(spark):
    rows = [(i, "some calm words here" if i % 5 else "what a blorp thing", "x") for i in range(200)] + [(None, None, "x"), (None, "blorp", "x"), (500, "", "x"), (1, "some calm words here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, None if i == 9 else int(i % 5 == 0)) for i in range(200)] + [(None, 1), (9999, 1), (1, 0)], "doc_id long, toxic int")
    out = f.toxicity(docs, labels).collect()
    assert len(out) == len(rows) and {r.predicted for r in out if r.doc_id is not None and r.doc_id < 200 and r.doc_id % 5 == 0} == {1}
    kept = f.filter_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(repr((r[0], r[1], "x")) for r in rows if not (r[1] and "blorp" in r[1]))
    assert {r.score for r in f.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert f.toxicity(docs.limit(0), labels).collect() == []
    scorer = f.Scorer(*f.fit([(np.array([5], np.uint32), 1)] * 40))
    assert scorer.score("word " * 50_000) == scorer.score("word " * 3)


def test_an_id_with_many_texts_trains_with_one(spark):
    from pyspark.sql import functions as F

    docs = spark.range(3000).select((F.col("id") % 30).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    docs = docs.unionByName(spark.range(20_000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("more "), F.col("id")).alias("text")))
    labels = spark.range(30).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    assert len(f.train(docs, labels, "doc_id", "text", "toxic")[0]) <= 30 * 10 + 1

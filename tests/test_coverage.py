"""Coverage experiments against a plain loop."""
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from modalframe.operators import coverage as cv


def plain_normal(*parts):
    u = [(int(hashlib.md5("|".join(map(str, (k, *parts))).encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for k in "rt"]
    return math.sqrt(-2 * math.log(u[0])) * math.cos(2 * math.pi * u[1])


def plain_counts(xy, key, repetitions, realisations, seed, widen):
    x, y = np.array(xy, float).T
    n, sxx = len(x), ((x - x.mean()) ** 2).sum()
    slope = ((x - x.mean()) * (y - y.mean())).sum() / sxx
    s = math.sqrt(((y - y.mean() - slope * (x - x.mean())) ** 2).sum() / (n - 2))
    counts = {}
    for name, truth, se in (("level", y.mean(), s / math.sqrt(n)), ("slope", slope, s / math.sqrt(sxx))):
        counts[name] = 0
        for rep in range(1, repetitions + 1):
            est = truth + se * plain_normal(seed, key, rep, name, 0)
            lo, hi = np.percentile([est + widen * se * plain_normal(seed, key, rep, name, m) for m in range(1, realisations + 1)], [2.5, 97.5])
            counts[name] += lo <= truth <= hi
    return counts


def test_counts_equal_a_plain_loop(spark):
    rng = np.random.default_rng(8)
    data = {k: [(i, 3 + 0.2 * i + rng.normal()) for i in range(6 + k)] for k in (1, 2)}
    rows = [(k, float(x), float(y)) for k, xy in data.items() for x, y in xy] + [(1, None, 5.0), (3, 1.0, 2.0), (4, 2.0, 1.0), (4, 2.0, 2.0), (4, 2.0, 4.0)]
    truth = cv.line_truth(spark.createDataFrame(rows, "k long, x double, y double"), ["k"], "x", "y")
    for widen in (1.0, 0.2):
        out = cv.repeated_coverage(truth, ["k"], cv.line_experiment(["k"], 60, 5, widen), ["level", "slope"], 30).collect()
        got = {(r.k, r.parameter): r for r in out}
        assert len(out) == len(got) == 8
        for k in (1, 2):
            want = plain_counts(data[k], k, 30, 60, 5, widen)
            passed = all(abs(v / 30 - 0.95) <= 0.10 for v in want.values())
            for p, v in want.items():
                assert (got[k, p].n_covered, got[k, p].n_ok, got[k, p].n_failed, got[k, p].passed) == (v, 30, 0, passed)
        # too few rows, or one x: every repetition fails
        assert all((got[k, p].n_ok, got[k, p].n_failed, got[k, p].coverage, got[k, p].passed) == (0, 30, 0.0, False) for k in (3, 4) for p in ("level", "slope"))


def test_a_repetition_without_one_parameter_fails_as_a_whole(spark):
    truth = spark.createDataFrame([(1,), (2,)], "k long")

    def experiment(reps):
        both = reps.withColumn("parameter", F.explode(F.array(F.lit("a"), F.lit("b")))).filter("k = 1 and not (rep = 1 and parameter = 'b')")
        return both.select("k", "rep", "parameter", F.lit(1.0).alias("truth"), F.when(F.col("rep") != 2, 0.0).alias("low"), F.when(F.col("rep") == 3, float("inf")).otherwise(2.0).alias("high"))

    got = {(r.k, r.parameter): (r.n_ok, r.n_failed, r.n_covered) for r in cv.repeated_coverage(truth, ["k"], experiment, ["a", "b"], 10).collect()}
    assert got == {(1, "a"): (7, 3, 7), (1, "b"): (7, 3, 7), (2, "a"): (0, 10, 0), (2, "b"): (0, 10, 0)}
    assert cv.repeated_coverage(truth.limit(0), ["k"], experiment, ["a"]).count() == 0
    with pytest.raises(ValueError):
        cv.repeated_coverage(truth, ["k"], experiment, ["a"], 0)

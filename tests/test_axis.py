"""Long axes in blocks against plain NumPy: smoothing, nearest crossings, peaks and damping."""
import numpy as np
from pyspark.sql import functions as F

from modalframe.operators import axis, frf

KEYS = ["dataset_id", "ref_node", "ref_dir"]


def _savgol(y, window):
    """Least-squares parabola of each full window, the first and last one for the ends."""
    h, out = window // 2, np.empty(len(y))
    t = np.arange(-h, h + 1)
    basis = np.linalg.pinv(np.vander(t, 3))
    for i in range(len(y)):
        c = min(max(i, h), len(y) - 1 - h)
        out[i] = np.polyval(basis @ y[c - h : c + h + 1], i - c)
    return out


def _peaks(y, distance, least):
    tops, i = [], 1
    while i < len(y) - 1:
        j = i
        while j + 1 < len(y) and y[j + 1] == y[i]:
            j += 1
        if j + 1 < len(y) and y[i - 1] < y[i] > y[j + 1]:
            tops.append((i + j) // 2)
        i = j + 1
    kept = []
    for p in sorted(tops, key=lambda p: (y[p], p), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    out = {}
    for p in kept:
        l, r = p, p
        while l > 0 and y[l - 1] <= y[p]:
            l -= 1
        while r < len(y) - 1 and y[r + 1] <= y[p]:
            r += 1
        prom = y[p] - max(y[l : p + 1].min(), y[p : r + 1].min())
        if prom >= least:
            out[p] = prom
    return out


def _lines(spark, axes):
    rows = [(k, 1, 3, i, 0.5 * i, float(v), None) for k, y in axes.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "dataset_id int, ref_node int, ref_dir int, line int, f_hz double, indicator double, coherence double")


def test_moments_of_long_windows_agree():
    y = np.random.default_rng(1).normal(size=9000) + 5
    for half in (2, 40, 600, 2000):
        direct = [np.correlate(y, w, "valid") for w in (np.ones(2 * half + 1), np.arange(-half, half + 1.0), np.arange(-half, half + 1.0) ** 2)]
        for a, b in zip(axis.window_moments(y, half), direct):
            assert np.allclose(a, b, rtol=1e-9, atol=1e-6)


def test_minima_tables():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 100):
        v = rng.integers(0, 6, n).astype(float)
        t = axis.Minima(v)
        for inclusive in (True, False):
            hit = lambda a, b: a <= b if inclusive else a < b
            for level in range(-1, 8):
                at = np.arange(n + 1)
                level_ = np.full(n + 1, float(level))
                assert t.back(at, level_, inclusive).tolist() == [max([j for j in range(i) if hit(v[j], level)], default=-1) for i in at]
                assert t.ahead(at, level_, inclusive).tolist() == [min([j for j in range(i, n) if hit(v[j], level)], default=n) for i in at]


def test_short_axes_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(axis, "BLOCK", 7)
    monkeypatch.setattr(axis, "MOST_BLOCKS", 10**6)
    rng = np.random.default_rng(3)
    axes = {0: [1.0, 2.0], 1: [3.0] * 9, 2: 10 ** rng.normal(size=300), 3: 10.0 ** np.repeat(rng.integers(-2, 3, 60), rng.integers(1, 5, 60)), 4: np.exp(np.sin(np.arange(90) / 4)) + 0.1, 5: [1.0]}
    ind = _lines(spark, axes)
    s = frf.smooth_indicator(ind)
    got = {(r.dataset_id, r.pos): r.smoothed for r in s.collect()}
    for k, y in axes.items():
        log = np.log10(np.array(y))
        want = _savgol(log, 5) if len(y) >= 6 else log
        assert np.allclose([got[k, i] for i in range(len(y))], want, atol=1e-9)
    rough = s.withColumn("smoothed", F.log10("indicator"))  # level stretches stay level
    for table, values in ((s, got), (rough, {(k, i): np.log10(v) for k, y in axes.items() for i, v in enumerate(y)})):
        found = {(r.dataset_id, r.pos): r.prominence for r in frf.find_peaks(table).collect()}
        want = {}
        for k, y in axes.items():
            line = np.array([values[k, i] for i in range(len(y))])
            want |= {(k, p): v for p, v in _peaks(line, 2, max(0.01, 0.02 * np.ptp(line))).items() if p > 0}
        assert found.keys() == want.keys() and np.allclose([found[k] for k in want], list(want.values()), atol=1e-9)


def test_an_axis_of_200_000_lines(spark):
    n = 200_000
    x = np.arange(n)
    y = sum(1 / (1 + ((x - c) / w) ** 2) for c, w in ((9_000, 300), (60_000, 900), (61_500, 200), (150_000, 2_000), (199_500, 400))) + 1e-3 * (2 + np.sin(x / 37))
    ind = spark.range(n).select(F.lit(7).alias("dataset_id"), F.lit(1).alias("ref_node"), F.lit(3).alias("ref_dir"), F.col("id").cast("int").alias("line"), (F.col("id") * 0.1).alias("f_hz"))
    import pandas as pd

    values = spark.createDataFrame(pd.DataFrame({"line": x.astype("int32"), "indicator": y}))
    ind = ind.join(values, "line").withColumn("coherence", F.lit(None).cast("double"))
    s = frf.smooth_indicator(ind)
    line = np.array([r.smoothed for r in s.orderBy("pos").select("smoothed").collect()])
    log = np.log10(y)
    probe = [0, 100, 400, 401, 4095, 4096, 60_000, 199_300, n - 1]
    t = np.arange(-400, 401)
    basis = np.linalg.pinv(np.vander(t / 400, 3))
    for i in probe:
        c = min(max(i, 400), n - 401)
        assert abs(np.polyval(basis @ log[c - 400 : c + 401], (i - c) / 400) - line[i]) < 1e-8
    peaks = frf.find_peaks(s)
    found = {r.pos: r.prominence for r in peaks.collect()}
    want = {p: v for p, v in _peaks(line, 500, max(0.01, 0.02 * np.ptp(line))).items() if p > 0}
    assert found.keys() == want.keys() and len(want) >= 5 and np.allclose([found[p] for p in want], list(want.values()))
    damping = {r.peak_line: r.damping for r in frf.half_power_damping(peaks, ind).collect()}
    for p in found:
        low = np.flatnonzero(y <= y[p] / np.sqrt(2))
        left, right = low[low < p], low[low > p]
        if len(left) and len(right) and left[-1] > 0 and right[0] < n - 1:
            a, b, v = left[-1], right[0], y[p] / np.sqrt(2)
            width = (b - 1 + (v - y[b - 1]) / (y[b] - y[b - 1])) - (a + (v - y[a]) / (y[a + 1] - y[a]))
            zeta = width / (2 * p)
            assert (damping[p] is None) == (zeta >= 0.5) and (damping[p] is None or abs(damping[p] - zeta) < 1e-9)
        else:
            assert damping[p] is None
    assert set(damping) == set(found)

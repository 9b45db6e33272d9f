"""Near-duplicate vectors against brute force."""
import numpy as np

from modalframe.llm import subspace as s


def _brute(rows, least):
    ok = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    n, comp = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}
    ids = sorted(ok)
    for a in ids:
        for b in ids:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / (np.linalg.norm(ok[a]) * np.linalg.norm(ok[b])) >= least:
                n[a] += 1
                n[b] += 1
                lo, hi = sorted((comp[a], comp[b]))
                comp = {k: lo if c == hi else c for k, c in comp.items()}
    return {(i, n[i], comp[i], comp[i] == i) for i in n}


def _rows(rng, dim=64):
    base = rng.normal(size=(40, dim))
    rows = [b for b in base]
    for k in range(8):  # chains of small steps: neighbours link, ends need not
        v = base[k].copy()
        for _ in range(12):
            v = v + rng.normal(size=dim) * 0.22
            rows.append(v.copy())
    rows += [base[0]] * 6 + [base[1] * 3.0, -base[2]]
    out = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    rng.shuffle(out)
    return out + [(900, None), (901, []), (902, [0.0] * dim), (903, [1.0, None] + [0.0] * (dim - 2)), (904, [float("nan")] * dim), (905, [float("inf")] + [0.0] * (dim - 1)), (906, [1.0, 2.0]), (907, [1.0, 2.0])]


def test_against_brute_force(spark, monkeypatch):
    for dim, piece in ((64, 16_384), (64, 50), (5, 16_384)):
        monkeypatch.setattr(s, "PIECE", piece)
        rows = _rows(np.random.default_rng(3), dim)
        df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, n string")
        assert {tuple(r) for r in s.near_vectors(df).collect()} == _brute(rows, 0.95)


def test_edges_of_the_input(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (None, [0.0, 9.0]), (None, None)], "vec_id long, embedding array<float>")
    got = sorted(map(repr, map(tuple, s.near_vectors(df).collect())))
    assert got == sorted(map(repr, [(1, 3, 1, True), (1, 3, 1, True), (None, 3, None, True), (2, 3, 1, False), (3, 1, 3, True), (None, 1, None, True), (None, 0, None, True)]))
    assert s.near_vectors(df.limit(0)).collect() == []


def test_rotation_keeps_distances():
    x = np.random.default_rng(1).normal(size=(20, 50))
    y = s.rotate(x)
    assert y.shape == (20, 64) and np.allclose(np.linalg.norm(y[:, None] - y[None], axis=2), np.linalg.norm(x[:, None] - x[None], axis=2))
    assert (s.rotate(x[3:4]) == y[3]).all()

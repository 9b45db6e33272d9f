"""Spans of mode groups of any size against NumPy."""
import numpy as np

from modalframe.operators import spans as sp

DDL = "g long, side string, member long, node_id long, dof int, re double, im double"


def rows_of(g, p, q):
    return [(g, side, j, i // 3, i % 3, float(m[i, j].real), float(m[i, j].imag)) for side, m in (("P", p), ("Q", q)) for j in range(m.shape[1]) for i in range(m.shape[0])]


def expected(p, q):
    def basis(m):
        u, s, _ = np.linalg.svd(m, full_matrices=False)
        return u[:, s > 1e-6 * s[0]]

    a, b = basis(p), basis(q)
    cos2 = np.linalg.svd(a.conj().T @ b, compute_uv=False) ** 2
    return a.shape[1], b.shape[1], cos2, cos2.sum() / min(a.shape[1], b.shape[1])


def test_groups_of_any_size_match_singular_values(spark):
    rng = np.random.default_rng(1)
    draw = lambda n, k: rng.normal(size=(n, k)) + 1j * rng.normal(size=(n, k))
    one = draw(12, 1)
    cases = {1: (draw(12, 3), draw(12, 3)), 2: (draw(15, 1), draw(15, 4)), 3: (draw(9, 5), draw(9, 2)), 4: (np.hstack([one, 2j * one]), draw(12, 3)),
             5: (one, one @ np.array([[1.0, -3.0]])), 6: (draw(30, 6), draw(30, 5))}
    base = cases[1][0]
    cases[7] = (base, base @ draw(3, 3))  # another basis of the same span
    df = spark.createDataFrame([r for g, (p, q) in cases.items() for r in rows_of(g, p, q)], DDL)
    got = {r.g: r for r in sp.span_angles(df.repartition(7), ["g"]).collect()}
    for g, (p, q) in cases.items():
        rank_p, rank_q, cos2, value = expected(p, q)
        r = got[g]
        assert (r.rank_p, r.rank_q, r.n_p, r.n_q, r.n_dof) == (rank_p, rank_q, p.shape[1], q.shape[1], len(p))
        assert np.allclose(r.cos2, cos2, atol=1e-9) and np.isclose(r.subspace_mac, value)
    assert got[4].rank_p == 1 and np.isclose(got[5].subspace_mac, 1.0) and np.isclose(got[7].subspace_mac, 1.0)


def test_incomplete_repeated_zero_and_null_rows(spark):
    rng = np.random.default_rng(2)
    p, q = rng.normal(size=(9, 2)) + 0j, rng.normal(size=(9, 2)) + 0j
    rows = rows_of(1, p, q)
    rows = [r for r in rows if not (r[1] == "Q" and r[2] == 1 and (r[3], r[4]) == (0, 0))]  # DOF 0 lacks a member
    rows.append((1, "P", 0, 2, 2, 5.0, 0.0))  # DOF 8 has one member twice
    rows = [(*r[:5], None, 0.0) if (r[1], r[2], r[3], r[4]) == ("P", 1, 1, 1) else r for r in rows]  # DOF 4 is NULL
    rows += rows_of(2, 0 * p, q) + [(None, *r[1:]) for r in rows_of(3, p, q)] + [r for r in rows_of(4, p, q) if r[1] == "P"]
    got = {r.g: r for r in sp.span_angles(spark.createDataFrame(rows, DDL), ["g"]).collect()}
    keep = [1, 2, 3, 5, 6, 7]
    assert got[1].n_dof == 6 and np.isclose(got[1].subspace_mac, expected(p[keep], q[keep])[3])
    assert got[2].rank_p == 0 and got[2].subspace_mac is None
    assert got[4].n_q == 0 and got[4].subspace_mac is None and set(got) == {1, 2, 4}


def test_share_of_one_shape_and_empty_table(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(12, 4)) + 0j
    e = p @ rng.normal(size=(4, 1)) + 0.3 * rng.normal(size=(12, 1)) + 0.2j * rng.normal(size=(12, 1))
    r = sp.span_angles(spark.createDataFrame(rows_of(1, p, e), DDL), ["g"]).first()
    inside = np.linalg.norm(p @ np.linalg.lstsq(p, e, rcond=None)[0]) ** 2 / np.linalg.norm(e) ** 2
    assert np.isclose(r.subspace_mac, inside)
    assert sp.span_angles(spark.createDataFrame([], DDL), ["g"]).count() == 0

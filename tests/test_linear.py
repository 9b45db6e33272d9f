"""Linear models with any number of parameters against NumPy, brute force over faces and the two-parameter operators."""
import itertools

import numpy as np
import pytest

from modalframe.operators import evidence as ev
from modalframe.operators import linear as li

J5 = [f"j{i}" for i in range(1, 6)]
DDL = "campaign long, specimen long, family string, role string, " + ", ".join(f"{c} double" for c in J5) + ", residual double"


def table(spark, rows):
    return spark.createDataFrame(rows, DDL)


def draw(seed, sizes, families=3):
    """Terms of specimens (campaign, specimen): rows, and per specimen the FIT design, residuals and families."""
    rng = np.random.default_rng(seed)
    rows, by = [], {}
    for (c, s), n in sizes.items():
        m, r = rng.normal(size=(n, 5)), rng.normal(size=n)
        fam = [f"F{i % families}" for i in range(n)]
        by[c, s] = (m, r, np.array(fam))
        rows += [(c, s, f, "FIT", *map(float, a), float(b)) for a, b, f in zip(m, r, fam)]
        rows += [(c, s, "F0", "HOLDOUT", *[50.0] * 5, 9.0), (c, s, "F0", "FIT", *[1.0] * 4, None, 9.0), (c, s, "F1", "FIT", *[1.0] * 5, None)]
    return rows, by


def left(m, r):
    return float(((r - m @ np.linalg.lstsq(m, r, rcond=None)[0]) ** 2).sum())


def test_shared_against_separate_matches_least_squares(spark):
    rows, by = draw(1, {(1, 1): 12, (1, 2): 9, (1, 3): 20, (2, 4): 11, (3, 5): 12, (3, 6): 4})
    got = {r.campaign: r for r in li.consistency(table(spark, rows), "campaign", "specimen", J5, chi2_valid=True).collect()}
    parts = [by[k] for k in by if k[0] == 1]
    shared, separate = left(np.vstack([m for m, _, _ in parts]), np.concatenate([r for _, r, _ in parts])), sum(left(m, r) for m, r, _ in parts)
    assert np.isclose(got[1].chi2_shared, shared) and np.isclose(got[1].chi2_separate, separate) and np.isclose(got[1].delta, shared - separate)
    assert got[1].dof == 10 and got[1].n_specimens == 3 and got[1].status in ("PASS", "FAIL")
    assert abs(got[1].bootstrap_p - got[1].chi2_p) < 0.05  # unit noise: both estimate the same probability
    assert got[2].status == "NOT_EVALUABLE" and got[2].delta is None
    assert got[3].status == "NOT_EVALUABLE_RANK_DEFICIENT" and got[3].bootstrap_p is None


def test_two_parameters_agree_with_the_closed_form(spark):
    rows, _ = draw(2, {(1, 1): 12, (1, 2): 9, (2, 3): 20, (2, 4): 11})
    t = table(spark, rows).filter("residual is not null and j5 is not null")
    key = lambda d: sorted((r.campaign, round(r.delta, 8), r.dof, round(r.chi2_p, 8), round(r.bootstrap_p, 8), r.status) for r in d.collect())
    assert key(li.consistency(t, "campaign", "specimen", ["j1", "j2"], True)) == key(ev.family_consistency(t, "campaign", "specimen", True))


def test_left_out_families_match_refits(spark):
    rows, by = draw(3, {(1, 1): 30, (1, 2): 24, (1, 3): 7}, families=3)
    cases = li.left_out_shifts(table(spark, rows), ["specimen"], J5)
    got = {(r.specimen, r.family): r for r in cases.collect()}
    for (_, s), (m, r, fam) in by.items():
        for f in ("F0", "F1", "F2"):
            keep = fam != f
            row = got[s, f]
            assert row.n == keep.sum()
            if keep.sum() >= 5:
                assert row.status == "VALID" and np.allclose(row.shift, -np.linalg.lstsq(m[keep], r[keep], rcond=None)[0], atol=1e-8)
            else:
                assert row.status == "REFUSED_RANK_DEFICIENT" and row.shift is None
    ranges = {(r.specimen, r.parameter): r for r in li.shift_ranges(cases, ["specimen"], J5).collect()}
    assert len(ranges) == 15 and not ranges[3, "j1"].complete and ranges[1, "j5"].complete
    assert np.isclose(ranges[1, "j2"].low, min(got[1, f].shift[1] for f in ("F0", "F1", "F2")))


def test_a_family_that_carries_the_design_alone_leaves_no_rank(spark):
    rng = np.random.default_rng(4)
    big = [(1, 1, "A", "FIT", *map(float, 1e3 * rng.normal(size=5)), 1.0) for _ in range(9)]
    small = [(1, 1, "B", "FIT", *[0.0] * 5, 1.0) for _ in range(9)]
    only = [(1, 2, "A", "FIT", *map(float, rng.normal(size=5)), 1.0) for _ in range(9)]
    got = {(r.specimen, r.family): (r.status, r.shift) for r in li.left_out_shifts(table(spark, big + small + only), ["specimen"], J5).collect()}
    assert got[1, "A"] == ("REFUSED_RANK_DEFICIENT", None) and got[1, "B"][0] == "VALID" and got[2, "A"] == ("REFUSED_NO_FIT_TERMS", None)


def faces(g, b, low, high):
    """Least objective over the box, by trying every face."""
    k, best = len(b), (np.inf, None)
    for pick in itertools.product((None, low, high), repeat=k):
        free = [i for i in range(k) if pick[i] is None]
        x = np.array([0.0 if p is None else p for p in pick])
        if free:
            x[free] = np.linalg.solve(g[np.ix_(free, free)], b[free] - g[free] @ x)
        if (x >= low - 1e-12).all() and (x <= high + 1e-12).all():
            best = min(best, (0.5 * x @ g @ x - b @ x, tuple(x)))
    return np.array(best[1])


@pytest.mark.parametrize("k, low, high", [(1, -0.7, 0.7), (2, -0.7, 0.7), (3, -0.7, 0.7), (5, -0.7, 0.7), (5, 0.1, 0.9), (5, -0.5, 0.0)])
def test_box_minimum_equals_all_faces(k, low, high):
    rng = np.random.default_rng(k)
    m = rng.normal(size=(60, k + 1, k)) * np.exp(rng.normal(size=(60, 1, k)))
    g = m.transpose(0, 2, 1) @ m
    b = rng.normal(size=(60, k)) * rng.choice([0.0, 0.1, 1.0, 10.0], size=(60, 1))
    got = li.box_minimum(g, b, low, high)
    assert (got >= low).all() and (got <= high).all()
    for a, c, x in zip(g, b, got):
        assert np.allclose(x, faces(a, c, low, high), atol=1e-7)


def test_boxed_fit_recovers_bounds_refuses_and_explains(spark):
    rng = np.random.default_rng(6)
    rows, truth = [], {1: [0.2, -0.1, 0.05, 0.0, 0.3], 2: [2.0, -0.1, -3.0, 0.0, 0.3]}
    for g, x in truth.items():
        for s in rng.normal(size=(30, 5)):
            rows.append((g, *map(float, s), 100.0, float(100 * np.exp(s @ x))))
    rows += [(3, *[1.0] * 5, 100.0, 101.0)] * 8 + [(1, *[1.0] * 5, 100.0, -1.0), (1, *[1.0] * 5, None, 5.0), (4, *[1.0] * 5, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "g long, s1 double, s2 double, s3 double, s4 double, s5 double, f0 double, f_exp double")
    names = [f"s{i}" for i in range(1, 6)]
    fits = li.boxed_fit(df, ["g"], names)
    got = {r.g: r for r in fits.collect()}
    assert np.allclose(got[1].x, truth[1]) and got[1].n_terms == 30
    assert got[2].x[0] == pytest.approx(np.log(2)) and got[2].x[2] == pytest.approx(-np.log(2))
    assert got[3].status == "REFUSED_RANK_DEFICIENT" and got[3].rank == 1 and got[3].x is None and 4 not in got
    rows = {(r.g, r.parameter): r for r in li.boxed_parameters(fits, ["g"], names).collect()}
    assert rows[2, "s1"].at_bound and not rows[1, "s1"].at_bound and rows[1, "s1"].beyond_range and not rows[1, "s4"].beyond_range
    assert rows[3, "s1"].ratio is None and rows[3, "s1"].at_bound is False
    after = li.boxed_residuals(df.filter("g = 1 and f0 > 0 and f_exp > 0"), fits, ["g"], names).collect()
    assert max(abs(r.error_after) for r in after) < 1e-6


def test_empty_tables_give_empty_results(spark):
    t = table(spark, [])
    assert li.consistency(t, "campaign", "specimen", J5, True).count() == 0
    assert li.left_out_shifts(t, ["specimen"], J5).count() == 0
    assert li.boxed_fit(t.withColumn("f0", t.j1).withColumn("f_exp", t.j2), ["specimen"], J5).count() == 0

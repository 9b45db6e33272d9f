"""Sensitivities, identifiability and specimen statistics against direct computations."""
import numpy as np
import pandas as pd

from modalframe.operators import evidence as ev
from modalframe.operators import sensitivity as se


def test_exponents_are_recovered(spark):
    rows = [(1, t, "E", side, p, 1.0, 100.0 + t, (100.0 + t) * p ** (0.1 * t)) for t in range(5) for side, p in (("minus", 0.95), ("plus", 1.05))]
    df = spark.createDataFrame(rows, "family_id long, term_id long, parameter string, side string, value double, p0 double, f0 double, f double")
    for r in se.central_sensitivities(df).collect():
        assert np.isclose(r.s, 0.1 * r.term_id, atol=1e-12) and abs(r.one_sided_difference) < 1e-12


def sens(spark, seed=0, n=12, names=("A", "B", "C")):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, len(names)))
    return m, spark.createDataFrame([(1, i, p, float(m[i, k])) for i in range(n) for k, p in enumerate(names)], "family_id long, term_id long, parameter string, s double")


def test_two_parameter_analysis_matches_numpy(spark):
    m, df = sens(spark, 1, names=("E1", "E2"))
    r = se.practical_identifiability(se.two_parameter_gram(df, ["family_id"], ("E1", "E2"), 0.003)).first()
    a = m / 0.003
    cov = np.linalg.inv(a.T @ a)
    sv = np.linalg.svd(a, compute_uv=False)
    assert np.allclose([r.sv1, r.sv2], sv) and np.allclose([r.sd_1, r.sd_2], np.sqrt(np.diag(cov)))
    assert np.isclose(r.correlation, cov[0, 1] / np.sqrt(cov[0, 0] * cov[1, 1])) and r.rank == 2


def test_subsets_and_covariance_match_numpy(spark):
    m, df = sens(spark, 2)
    g = se.gram_arrays(df, ["family_id"])
    got = {r.subset: r for r in se.parameter_subsets(g, ["family_id"]).collect()}
    assert len(got) == 7
    sv = np.linalg.svd(m[:, [0, 2]], compute_uv=False)
    unit = m[:, [0, 2]] / np.linalg.norm(m[:, [0, 2]], axis=0)
    assert np.isclose(got["A+C"].condition, sv[0] / sv[1]) and np.isclose(got["A+C"].gamma, 1 / np.sqrt(np.linalg.eigvalsh(unit.T @ unit)[0]))
    cov = np.linalg.inv(m.T @ m)
    sd = {r.parameter: r.sd for r in se.local_covariance(g, ["family_id"]).collect()}
    assert np.allclose([sd[p] for p in "ABC"], np.sqrt(np.diag(cov)))


def test_unobservable_parameter_has_no_interval(spark):
    df = spark.createDataFrame([(1, i, p, v) for i in range(4) for p, v in (("A", 1.0 + i), ("B", 0.0))], "family_id long, term_id long, parameter string, s double")
    got = {r.parameter: r for r in se.local_covariance(se.gram_arrays(df, ["family_id"]), ["family_id"]).collect()}
    assert got["B"].status == "UNOBSERVABLE" and got["B"].sd is None and got["A"].status == "OBSERVABLE"


def test_bounded_fit_stays_in_the_box(spark):
    rng = np.random.default_rng(3)
    rows, truth = [], {}
    for g, x in enumerate([(0.2, -0.1), (1.5, 0.3), (-2.0, 2.0)]):
        s = rng.normal(size=(8, 2))
        truth[g] = (s, s @ x + 0.01 * rng.normal(size=8))
        rows += [(g, float(a), float(b), 100.0, float(100 * np.exp(y))) for (a, b), y in zip(s, truth[g][1])]
    df = spark.createDataFrame(rows, "g long, s1 double, s2 double, f0 double, f_exp double")
    lim = np.log(2)
    grid = np.linspace(-lim, lim, 401)
    for r in se.bounded_fit(df, ["g"]).collect():
        s, b = truth[r.g]
        cost = lambda u, v: ((s[:, 0] * u + s[:, 1] * v - b) ** 2).sum()
        assert abs(r.x1) <= lim + 1e-12 and abs(r.x2) <= lim + 1e-12
        assert cost(r.x1, r.x2) <= min(cost(u, v) for u in grid[::8] for v in grid[::8]) + 1e-9


def test_full_covariance_whitening(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(3, 3))
    cov = a @ a.T + np.eye(3)
    s = rng.normal(size=(3, 2))
    rows = spark.createDataFrame([(1, i, float(s[i, 0]), float(s[i, 1])) for i in range(3)], "g long, row_no long, s1 double, s2 double")
    c = spark.createDataFrame([(1, i, [float(v) for v in cov[i]]) for i in range(3)], "g long, row_no long, cov array<double>")
    got = np.array([(r.s1, r.s2) for r in se.whiten_full(rows, c, ["g"], ["s1", "s2"]).orderBy("row_no").collect()])
    assert np.allclose(got.T @ got, s.T @ np.linalg.inv(cov) @ s)


def test_full_covariance_query_reads_every_term(spark, small):
    from modalframe.plans import catalog

    part = spark.read.parquet(f"{small}/part.parquet").select("p_partkey", "p_size").collect()
    want = {}
    for r in part:
        want.setdefault(r.p_partkey // 40, []).append((r.p_partkey % 40, (r.p_size % 20) / 40, (r.p_partkey % 9) / 20))
    got = {}
    for r in catalog.QUERIES["a36_full_covariance_whitening"](spark, small).collect():
        got.setdefault(r.family_id, []).append((r.row_no, r.s1, r.s2))
    assert {f: sorted(x[0] for x in v) for f, v in got.items()} == {f: sorted(x[0] for x in v) for f, v in want.items()}
    for f, v in want.items():
        low = np.linalg.cholesky(np.full((len(v), len(v)), 0.2) + 0.8 * np.eye(len(v)))
        y, w = np.array(sorted(got[f]))[:, 1:], np.linalg.solve(low, np.array(sorted(v))[:, 1:])
        assert np.allclose(y.T @ y, w.T @ w)


def terms(spark, seed=5, shift=0.0):
    rng = np.random.default_rng(seed)
    rows = []
    for sp in range(3):
        j = rng.normal(size=(9, 2))
        r = rng.normal(size=9) + j @ [shift * sp, 0.0]
        rows += [(0, sp, f"f{i % 3}", "FIT", float(j[i, 0]), float(j[i, 1]), float(r[i]), 0.01) for i in range(9)]
    return pd.DataFrame(rows, columns=["campaign", "specimen", "family", "role", "j1", "j2", "residual", "sigma"])


def test_family_consistency_statistic(spark):
    for shift, verdict in ((0.0, "PASS"), (4.0, "FAIL")):
        pdf = terms(spark, shift=shift)
        r = ev.family_consistency(spark.createDataFrame(pdf), "campaign", "specimen", True).first()

        def left(d):
            j, y = d[["j1", "j2"]].to_numpy(), d.residual.to_numpy()
            e = y + j @ np.linalg.lstsq(j, -y, rcond=None)[0]
            return e @ e

        delta = left(pdf) - sum(left(d) for _, d in pdf.groupby("specimen"))
        assert np.isclose(r.delta, delta) and r.dof == 4 and r.status == verdict
        assert abs(r.bootstrap_p - r.chi2_p) < 0.04  # the linearised statistic is chi-square under the shared model


def test_leave_one_out_equals_a_refit(spark):
    pdf = terms(spark, 6)
    got = {(r.specimen, r.family): r for r in ev.leave_one_family_out(spark.createDataFrame(pdf), ["specimen"]).collect()}
    for (s, f), r in got.items():
        d = pdf[(pdf.specimen == s) & (pdf.family != f)]
        x = np.linalg.lstsq(d[["j1", "j2"]].to_numpy(), -d.residual.to_numpy(), rcond=None)[0]
        assert np.allclose([r.shift_1, r.shift_2], x, atol=1e-9)


def test_draws_do_not_depend_on_partitioning_and_stay_positive(spark):
    m = spark.createDataFrame([(i, n, v, u) for i in range(3) for n, v, u in (("m", 0.2, 0.001), ("L", 250.0, 0.0), ("W", 180.0, 0.2), ("h", 0.5, 0.6))], "specimen_id long, name string, value double, std_unc double")
    a, b = (ev.draw_measurements(m.repartition(p), 300, 11, ["specimen_id"]).orderBy("specimen_id", "name", "draw").toPandas() for p in (1, 5))
    assert np.array_equal(a["sample"].to_numpy(), b["sample"].to_numpy()) and (a["sample"] > 0).all()
    assert abs(a[a.name == "W"]["sample"].mean() - 180) < 0.05 and abs(a[a.name == "W"]["sample"].std() - 0.2) < 0.03


def test_strict_pairing_maximises_count_then_mac_and_flags_ties(spark):
    rows = [(1, 1, 1, 100.0, 100.0, 0.95), (1, 2, 1, 101.0, 100.0, 0.90), (1, 1, 2, 100.0, 101.0, 0.85), (2, 1, 1, 100.0, 100.0, 0.9), (2, 2, 1, 100.0, 100.0, 0.9)]
    got = {(r.cmp_id, r.fe_mode, r.exp_mode): r.tied for r in ev.strict_pairs(spark.createDataFrame(rows, "cmp_id long, fe_mode long, exp_mode long, fe_hz double, exp_hz double, mac double")).collect()}
    assert {k for k in got if k[0] == 1} == {(1, 2, 1), (1, 1, 2)}
    assert [v for k, v in got.items() if k[0] == 2] == [True]


def test_assignment_lets_no_bad_pair_take_a_good_partner(spark):
    rows = [(1, 1, 1, 0.05), (1, 1, 2, 0.30), (1, 2, 1, 0.10), (1, 3, 3, 0.2)]
    got = {(r.fe_mode, r.exp_mode) for r in ev.assign_pairs(spark.createDataFrame(rows, "cmp_id long, fe_mode long, exp_mode long, cost double")).collect()}
    assert got == {(1, 2), (2, 1), (3, 3)}


def test_assignment_is_optimal_over_whole_comparisons(spark):
    rng = np.random.default_rng(8)
    rows = [(1, int(a), int(b), float(rng.random())) for a in range(7) for b in range(7) if abs(a - b) <= 1]
    df = spark.createDataFrame(rows, "cmp_id long, fe_mode long, exp_mode long, cost double")
    cost = {(a, b): c for _, a, b, c in rows}
    got = [(r.fe_mode, r.exp_mode) for r in ev.assign_pairs(df).collect()]
    total = lambda pairs: sum(cost[p] for p in pairs) + 1.15 * (14 - 2 * len(pairs))

    def best(a, used):
        if a == 7:
            return []
        ways = [best(a + 1, used)] + [[(a, b), *best(a + 1, used | {b})] for b in range(7) if (a, b) in cost and b not in used]
        return min(ways, key=total)

    assert abs(total(got) - total(best(0, frozenset()))) < 1e-9

"""Range, as-of, spatial and ordered operators against brute force, including skewed groups."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from modalframe.operators import ordered, pairing
from modalframe.operators import spatial as sp


def modes(spark, seed=0, n=150):
    rng = np.random.default_rng(seed)
    rows = [(1 if rng.random() < 0.6 else int(rng.integers(2, 6)), "FE" if rng.random() < 0.5 else "EXP", i, float(rng.choice([rng.uniform(5, 400), 100.0]))) for i in range(n)]
    return pd.DataFrame(rows, columns=["cmp_id", "role", "mode_no", "frequency_hz"])


def test_window_join_is_exact(spark):
    pdf = modes(spark)
    m = pdf[pdf.role == "FE"].merge(pdf[pdf.role == "EXP"], on="cmp_id")
    for w in (0.03, 0.15, 0.6):
        got = {(r.fe_mode, r.exp_mode) for r in pairing.frequency_window_pairs(spark.createDataFrame(pdf), w).collect()}
        hit = m[(m.frequency_hz_x - m.frequency_hz_y).abs() <= w * m.frequency_hz_y]
        assert got == set(zip(hit.mode_no_x, hit.mode_no_y))


def test_nearest_frequencies_with_ties(spark):
    pdf = modes(spark, 3)
    m = pdf[pdf.role == "FE"].merge(pdf[pdf.role == "EXP"], on="cmp_id")
    m["gap"] = (m.frequency_hz_x - m.frequency_hz_y).abs()
    for k in (1, 2, 4):
        want = m.sort_values(["gap", "mode_no_x"]).groupby(["cmp_id", "mode_no_y"]).head(k)
        got = {(r.exp_mode, r.fe_mode) for r in pairing.nearest_frequencies(spark.createDataFrame(pdf), k).collect()}
        assert got == set(zip(want.mode_no_y, want.mode_no_x))


def test_ordered_helpers_across_bins(spark):
    pdf = modes(spark, 4)[["cmp_id", "mode_no", "frequency_hz"]]
    df = spark.createDataFrame(pdf)
    out = ordered.with_order(df, ["cmp_id"], ordered.log_bin(F.col("frequency_hz"), 0.2), ["frequency_hz", "mode_no"], rank="rk", previous={"p": "mode_no"}, following={"n": "mode_no"}).toPandas()
    s = pdf.sort_values(["cmp_id", "frequency_hz", "mode_no"])
    s["rk"] = s.groupby("cmp_id").cumcount() + 1
    s["p"], s["n"] = s.groupby("cmp_id").mode_no.shift(1), s.groupby("cmp_id").mode_no.shift(-1)
    a, b = out.sort_values("mode_no").reset_index(drop=True), s.sort_values("mode_no").reset_index(drop=True)
    for c in ("rk", "p", "n"):
        assert np.array_equal(a[c].fillna(-1).to_numpy(float), b[c].fillna(-1).to_numpy(float))
    run = ordered.running_sum(df, ["cmp_id"], ordered.log_bin(F.col("frequency_hz"), 0.2), ["frequency_hz", "mode_no"], F.col("mode_no"), "t").toPandas().sort_values("mode_no")
    s["t"] = s.groupby("cmp_id").mode_no.cumsum()
    assert np.array_equal(run.t.to_numpy(float), s.sort_values("mode_no").t.to_numpy(float))


def points(seed, groups, n):
    rng = np.random.default_rng(seed)
    return pd.DataFrame([(g, g * 1000 + i, *rng.normal(size=3) * (1, 1, 0.05)) for g in range(groups) for i in range(n)], columns=["g", "id", "x", "y", "z"])


def test_nearest_points_match_brute_force_even_far_outside(spark):
    t, q = points(1, 2, 80), points(2, 2, 30)
    q.loc[::7, ["x", "y"]] *= 40  # far outside every cell
    td, qd = spark.createDataFrame(t.rename(columns={"id": "tid"})), spark.createDataFrame(q.rename(columns={"id": "qid"}))
    for k in (1, 3, 8):
        got = {}
        for r in sp.nearest_points(qd, td, ["g"], ["qid"], "tid", k).collect():
            got.setdefault(r.qid, []).append((r.nearness, r.tid))
        for _, p in q.iterrows():
            c = t[t.g == p.g]
            d = np.linalg.norm(c[["x", "y", "z"]].to_numpy(float) - p[["x", "y", "z"]].to_numpy(float), axis=1)
            assert [v for _, v in sorted(got[int(p.id)])] == list(c.id.to_numpy()[np.argsort(d, kind="stable")[:k]])


def test_orientation_search_recovers_a_rotation(spark):
    rng = np.random.default_rng(5)
    fe = rng.uniform(0, [10, 6, 1], size=(60, 3))
    r = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]])
    exp = (fe[:20] @ r) * 2.0 + [3, 4, 5]
    exp = np.vstack([exp, (fe[[fe[:, c].argmin() for c in range(3)] + [fe[:, c].argmax() for c in range(3)]] @ r) * 2.0 + [3, 4, 5]])
    fd = spark.createDataFrame(pd.DataFrame([(1, i, *p) for i, p in enumerate(fe)], columns=["dataset_id", "node_id", "x", "y", "z"]))
    ed = spark.createDataFrame(pd.DataFrame([(1, i, *p) for i, p in enumerate(exp)], columns=["dataset_id", "point_id", "x", "y", "z"]))
    sc = spark.createDataFrame([(1, 0, 2.0, 2.0, 2.0)], "dataset_id long, scale_no int, sx double, sy double, sz double")
    cand, maps = sp.score_orientations(fd, ed, sc)
    best = cand.orderBy("rms").first()
    assert best.rms < 1e-9 and best.matched == 1.0 and best.det == 1 and cand.count() == 48
    m = {x.point_id: x.node_id for x in maps.filter(F.col("orientation") == best.orientation).collect()}
    assert all(m[i] == i for i in range(20))


def test_quads_interpolate_linear_fields_and_refuse_outside(spark):
    n = [(1, i + 4 * j, i + 0.1 * (j % 2), float(j), 2.0 * (i + 0.1 * (j % 2)) - 3.0 * j + 1) for i in range(4) for j in range(4)]
    nd = spark.createDataFrame(n, "dataset_id long, node_id long, x double, y double, v double")
    qd = spark.createDataFrame([(1, i + 4 * j, i + 4 * j, i + 1 + 4 * j, i + 5 + 4 * j, i + 4 + 4 * j) for i in range(3) for j in range(3)], "dataset_id long, element_id long, n1 long, n2 long, n3 long, n4 long")
    pts = [(1, 0, 0.7, 0.3), (1, 1, 2.2, 2.9), (1, 2, 9.0, 9.0)]
    got = {r.point_id: r for r in sp.sample_quads(spark.createDataFrame(pts, "dataset_id long, point_id long, x double, y double"), qd, nd, "v").collect()}
    for _, i, x, y in pts[:2]:
        assert np.isclose(got[i].value, 2 * x - 3 * y + 1)
    assert got[2].refused


def test_quads_of_all_sizes_shapes_and_turns(spark):
    """Random convex elements from 1e-3 to 1e6 wide, both orientations, against the forward map; parallelograms have no quadratic term."""
    rng = np.random.default_rng(3)
    nodes, quads, points, want = [], [], [], {}
    for e in range(60):
        size, centre = 10.0 ** rng.uniform(-3, 6), rng.uniform(-50, 50, 2)
        base = np.array([[-1, -1], [1, -1], [1, 1], [-1, 1.0]]) + (rng.uniform(-0.6, 0.6, (4, 2)) if e % 3 else 0)
        turn = rng.uniform(0, 2 * np.pi)
        c = base @ np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]]) * size + centre
        c = c[::-1] if e % 2 else c
        v = rng.normal(size=4)
        nodes += [(e, i, *map(float, c[i]), float(v[i])) for i in range(4)]
        quads.append((e, 7, 0, 1, 2, 3))
        for k, (xi, eta) in enumerate([(0.0, 0.0), (1.0, 1.0), (-1.0, 0.3), *rng.uniform(-1, 1, (5, 2))]):
            n = np.array([(1 - xi) * (1 - eta), (1 + xi) * (1 - eta), (1 + xi) * (1 + eta), (1 - xi) * (1 + eta)]) / 4
            points.append((e, k, *map(float, n @ c)))
            want[e, k] = float(n @ v)
        points.append((e, 99, *map(float, 1.02 * c[0] - 0.02 * c[2])))
    got = {(r.dataset_id, r.point_id): r for r in sp.sample_quads(
        spark.createDataFrame(points, "dataset_id long, point_id long, x double, y double"),
        spark.createDataFrame(quads, "dataset_id long, element_id long, n1 long, n2 long, n3 long, n4 long"),
        spark.createDataFrame(nodes, "dataset_id long, node_id long, x double, y double, v double"), "v").collect()}
    assert len(got) == len(points) and all(got[k].refused == (k[1] == 99) for k in got)
    assert all(abs(got[k].value - v) < 1e-6 for k, v in want.items())


def test_a_huge_element_among_small_ones_and_rows_without_coordinates(spark):
    n = 40
    nodes = [(1, i + 100 * j, float(i), float(j), float(i + j)) for i in range(n + 1) for j in range(n + 1)]
    nodes += [(1, 90001, -1e5, -1e5, 0.0), (1, 90002, 1e5, -1e5, 0.0), (1, 90003, 1e5, 1e5, 0.0), (1, 90004, -1e5, 1e5, 0.0), (1, 90005, None, 0.0, 0.0)]
    quads = [(1, i + 100 * j, i + 100 * j, i + 1 + 100 * j, i + 101 + 100 * j, i + 100 + 100 * j) for i in range(n) for j in range(n)]
    quads += [(1, 80000, 90001, 90002, 90003, 90004), (1, 80001, 90005, 90002, 90003, 90004), (1, 80002, 0, 0, 0, 0), (1, 80003, 0, 1, 2, 424242)]
    points = [(1, 1, 3.5, 7.25), (1, 2, -5000.0, 20.0), (1, 3, 2e5, 0.0), (1, 4, None, 1.0), (1, 5, 3.0, 7.0), (2, 1, 0.5, 0.5)]
    frames = (spark.createDataFrame(points, "dataset_id long, point_id long, x double, y double"),
              spark.createDataFrame(quads, "dataset_id long, element_id long, n1 long, n2 long, n3 long, n4 long"),
              spark.createDataFrame(nodes, "dataset_id long, node_id long, x double, y double, v double"))
    got = {(r.dataset_id, r.point_id): (r.element_id, r.value, r.refused) for r in sp.sample_quads(*frames, "v").collect()}
    assert got[1, 1] == (703, 10.75, False) and got[1, 2][::2] == (80000, False) and got[1, 5][0] == 602
    assert all(got[k] == (None, None, True) for k in ((1, 3), (1, 4), (2, 1)))
    assert sp.sample_quads(frames[0].limit(0), frames[1], frames[2], "v").count() == 0


def test_nearest_points_of_turned_planes(spark):
    """Most points of a turned plane lie far from every node; the descent must find the same nodes as brute force."""
    rng = np.random.default_rng(5)
    nodes = np.c_[rng.random((20_000, 2)) * [400.0, 300.0], np.zeros(20_000)]
    plane = np.c_[rng.random((60, 2)) * [400.0, 300.0], np.zeros(60)] - [200.0, 150.0, 0.0]
    turned = [plane[:, list(p)] * s + [200.0, 150.0, 0.0] for p in ((0, 1, 2), (2, 1, 0), (0, 2, 1)) for s in (1.0, -1.0)]
    points = np.concatenate([*turned, [[5000.0, -3000.0, 10.0]]])
    q = spark.createDataFrame(pd.DataFrame({"key": 1, "qid": range(len(points)), "x": points[:, 0], "y": points[:, 1], "z": points[:, 2]}))
    t = spark.createDataFrame(pd.DataFrame({"key": 1, "tid": range(len(nodes)), "x": nodes[:, 0], "y": nodes[:, 1], "z": nodes[:, 2]}))
    d = np.sort(np.linalg.norm(points[:, None] - nodes[None], axis=2), axis=1)
    for k in (1, 3):
        out = sp.nearest_points(q, t, ["key"], ["qid"], "tid", k)
        got = {(r.qid, r.nearness): r.distance for r in out.collect()}
        assert len(got) == k * len(points) and all(abs(got[i, n + 1] - d[i, n]) < 1e-9 for i in range(len(points)) for n in range(k))


def test_order_keeps_rows_without_an_axis_value(spark):
    rows = [(1, None, 1), (1, None, 2), (1, 0.0, 3), (1, -2.0, 4), (1, 5.0, 5), (1, 5.0, 6), (1, 900.0, 7), (None, None, 8), (None, 3.0, 9)]
    df = spark.createDataFrame(rows, "k long, hz double, id long")
    got = ordered.with_order(df, ["k"], F.floor(F.log("hz") / 0.01), ["hz", "id"], rank="rank", previous={"before": "id"}, following={"after": "id"})
    assert {r.id: (r.rank, r.before, r.after) for r in got.collect()} == {
        1: (1, None, 2), 2: (2, 1, 4), 4: (3, 2, 3), 3: (4, 4, 5), 5: (5, 3, 6), 6: (6, 5, 7), 7: (7, 6, None), 8: (1, None, 9), 9: (2, 8, None)}

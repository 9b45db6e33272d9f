"""Plans and files that must not grow with the rows: few exchanges, no pair rows, few files."""
import itertools
import os

import numpy as np
from pyspark.sql import functions as F

from modalframe.operators import coverage as cv
from modalframe.operators import evidence as ev
from modalframe.operators import shapes as sh
from modalframe.operators import spatial as sp
from modalframe.plans import comparison
from modalframe.sources import files


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_far_queries_are_settled_without_the_octree(spark, monkeypatch):
    def never(*_):
        raise AssertionError("descended")

    monkeypatch.setattr(sp, "_descend", never)
    t = [(1, 10 * i + j, float(i), float(j), 0.0) for i in range(8) for j in range(8)]
    q = [(1, 0, -50.0, 3.1, 0.0), (1, 1, 2.2, 90.0, 0.0), (1, 2, 5.1, 4.9, 40.0), (1, 3, 30.0, -30.0, -30.0)]
    near = sp.nearest_points(spark.createDataFrame(q, "g int, qid int, x double, y double, z double"),
                             spark.createDataFrame(t, "g int, tid int, x double, y double, z double"), ["g"], ["qid"], "tid")
    assert {r.qid: r.tid for r in near.collect()} == {0: 3, 1: 27, 2: 55, 3: 70}


def lines_by_hand(rows, n):
    """(x, y) of one key's (node_id, u, v, w): the nearest id of each grid point, all signs of that id, the median of the inner lines."""
    top = 0.05 * max(abs(w) for *_, w in rows)
    near = {}
    for i in range(n):
        for j in range(n):
            x, y = i * (2.0 / (n - 1)) - 1.0, j * (2.0 / (n - 1)) - 1.0
            _, named, node = min(((x - u) ** 2 + (y - v) ** 2, d is not None, d or 0) for d, u, v, _ in rows if u is not None)
            if named:
                near[i, j] = sorted(np.sign(w) for d, *_, w in rows if d == node and abs(w) > top)
    counts = [[], []]
    for out, turn in zip(counts, (lambda a, b: (b, a), lambda a, b: (a, b))):
        for line in range(1, n - 1):
            on = [near[turn(line, k)] for k in range(n) if turn(line, k) in near]
            signs = [s for point in on for s in point]
            out += [sum(a != b for a, b in zip(signs, signs[1:]))] if on else []
    return tuple(int(np.floor(np.median(c))) for c in counts)


def test_nodal_lines_of_a_grid_that_is_never_rows(spark, monkeypatch):
    def never(*_):
        raise AssertionError("descended")

    monkeypatch.setattr(sp, "_descend", never)
    monkeypatch.setattr(sp, "GRID_PART", 5000, raising=False)
    rng, n = np.random.default_rng(3), 9
    shape = lambda u, v: float(np.cos(3 * u) * np.sin(4 * v))
    ring = [(i, np.cos(i / 7), np.sin(i / 7), shape(np.cos(i / 7), np.sin(i / 7))) for i in range(44)]  # a hole that no cell spans
    many = [(i, float(u), float(v), shape(u, v)) for i, (u, v) in enumerate(rng.uniform(-1, 1, (12000, 2)))]  # cut in parts, and within a part
    ties = [(i, u, v, w) for i, (u, v, w) in enumerate([(-1.0, -1.0, 1.0), (-1.0, 1.0, -1.0), (1.0, -1.0, -1.0), (1.0, 1.0, 1.0)])]
    odd = [*ring, (3, 0.1, 0.2, -0.7), (3, 0.1, 0.2, 0.9), (5, None, 0.1, -0.6), (None, -0.6, 0.5, 0.8)]
    keys = {1: ring, 2: many, 3: ties, 4: odd, 5: [(1, None, 0.0, 1.0)], None: ring}
    rows = [(k, r[0], *[None if x is None else float(x) for x in r[1:]]) for k, v in keys.items() for r in v]
    out = sp.nodal_lines(spark.createDataFrame(rows, "k int, node_id int, u double, v double, w double").repartition(3), ["k"], n)
    assert "Generate explode(sequence" not in plan(out) and plan(out).count("Join") == 1
    assert {r.k: (r.nodal_x, r.nodal_y) for r in out.collect()} == {k: lines_by_hand(keys[k], n) for k in (1, 2, 3, 4)}


def test_families_of_shapes_with_holes_take_one_plan(spark, monkeypatch):
    def never(*_):
        raise AssertionError("descended")

    monkeypatch.setattr(sp, "_descend", never)
    side = [i / 8 - 1 for i in range(17)]
    # x * y without its middle, which no node is near
    rows = [(1, i * 17 + j, x, y, x * y) for i, x in enumerate(side) for j, y in enumerate(side) if max(abs(x), abs(y)) > 0.8]
    out = sp.shape_families(spark.createDataFrame(rows, "k int, node_id int, x double, y double, w double"), ["k"])
    assert [(r.family, r.torsion) for r in out.collect()] == [("Px:O|Py:O|nx:1|ny:1", True)]


def images_by_hand(nodes, points, scale, k):
    """Per orientation and point, the least residual of the k nearest nodes in the metric of the nodes."""
    mid = lambda v: (v.min(0) + v.max(0)) / 2
    nodes, points, out, no = nodes - mid(nodes), points - mid(points), {}, 0
    for perm in itertools.permutations(range(3)):
        for sign in itertools.product((-1.0, 1.0), repeat=3):
            q = np.empty_like(points)
            q[:, perm] = points / scale * sign
            near = np.argsort(((q[:, None] - nodes[None]) ** 2).sum(2), axis=1, kind="stable")[:, :k]
            out[no] = np.sqrt(((nodes[near][:, :, perm] * sign * scale - points[:, None]) ** 2).sum(2)).min(1)
            no += 1
    return out


def test_images_of_points_meet_the_nodes_without_rows_of_their_own(spark, monkeypatch):
    asked, nearest = [], sp.nearest_points
    monkeypatch.setattr(sp, "nearest_points", lambda q, *rest, **more: asked.append(q.count()) or nearest(q, *rest, **more))
    rng = np.random.default_rng(11)
    block = rng.uniform(0, [9, 6, 5], (150, 3))  # one cell; some images are far from all nodes
    plate = np.c_[rng.uniform(0, [90, 60], (5000, 2)), rng.uniform(0, 0.1, 5000)]  # many cells, and a hole
    plate = plate[(abs(plate[:, 0] - 30) > 8) | (abs(plate[:, 1] - 20) > 8)]
    sets = {1: (block, rng.uniform(0, [18, 15, 10], (40, 3)), (2.0, 2.5, 2.0)), 2: (plate, rng.uniform(0, [90, 60, 0.1], (25, 3)), (1.0, 1.0, 1.0))}
    frame = lambda of, name: spark.createDataFrame([(d, i, *map(float, r)) for d, v in sets.items() for i, r in enumerate(v[of])], f"dataset_id long, {name} long, x double, y double, z double")
    scales = spark.createDataFrame([(d, 0, *v[2]) for d, v in sets.items()], "dataset_id long, scale_no int, sx double, sy double, sz double")
    for k in (1, 3):
        cand, maps = sp.score_orientations(frame(0, "node_id"), frame(1, "point_id"), scales, k)
        want = {(d, no, i): r for d, v in sets.items() for no, row in images_by_hand(*map(np.asarray, v), k).items() for i, r in enumerate(row)}
        got = {(r.dataset_id, r.orientation, r.point_id): r.residual for r in maps.collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
        assert cand.count() == 96
    # a small set asks nothing of nearest_points, of a large one only what the hole leaves open
    assert len(asked) <= 2 and all(0 < n < 0.5 * 25 * 48 for n in asked)
    asked.clear()
    small = lambda df: df.filter("dataset_id = 1")
    assert sp.score_orientations(small(frame(0, "node_id")), small(frame(1, "point_id")), small(scales))[0].count() == 48
    assert not asked


def test_odd_points_and_nodes_keep_their_images(spark):
    nodes = [(1, 1, 0.0, 0.0, 0.0), (1, 2, 4.0, 0.0, 0.0), (1, 2, 4.0, 3.0, 0.0), (1, 3, 0.0, 3.0, 1.0), (2, 5, 0.0, 0.0, 0.0), (2, 6, 4.0, 3.0, 1.0), (2, 6, 4.0, 3.0, 1.0)]
    points = [(d, i, *p) for d in (1, 2) for i, p in ((1, (0.0, 0.0, 0.0)), (2, (4.0, 3.0, 1.0)), (2, (4.0, 3.0, 1.0)), (3, (0.0, 3.0, 0.0)), (3, (0.1, 3.0, 0.0)), (4, (None, 1.0, 0.0)), (None, (1.0, 1.0, 0.0)))]
    at = "x double, y double, z double"
    scales = spark.createDataFrame([(d, 0, 1.0, 1.0, 1.0) for d in (1, 2)], "dataset_id long, scale_no int, sx double, sy double, sz double")
    cand, maps = sp.score_orientations(spark.createDataFrame(nodes, f"dataset_id long, node_id long, {at}"), spark.createDataFrame(points, f"dataset_id long, point_id long, {at}"), scales)
    same = next(i for i, (p, s) in enumerate(itertools.product(itertools.permutations(range(3)), itertools.product((-1, 1), repeat=3))) if p == (0, 1, 2) and s == (1, 1, 1))
    got = {(r.dataset_id, r.point_id): (r.node_id, None if r.residual is None else round(r.residual, 6)) for r in maps.filter(F.col("orientation") == same).collect()}
    # the id 2 stands for two places and the point 3 too, of which the nearest counts; the point without a place has the first node
    assert got == {(1, 1): (1, 0.0), (1, 2): (2, 1.0), (1, 3): (3, 1.0), (1, 4): (1, None), (2, 1): (5, 0.0), (2, 2): (6, 0.0), (2, 3): (5, 3.0), (2, 4): (5, None)}
    assert maps.count() == 8 * 48 and cand.count() == 96


def test_repeated_query_ids_answer_for_all_their_rows(spark):
    t = spark.createDataFrame([(1, i, float(i), 0.0, 0.0) for i in range(10)], "g int, tid int, x double, y double, z double")
    q = spark.createDataFrame([(1, 7, 2.1, 0.0, 0.0), (1, 7, 2.1, 0.0, 0.0), (1, None, 8.2, 0.0, 0.0)], "g int, qid int, x double, y double, z double")
    rows = sorted((r.qid or 0, r.nearness, r.tid) for r in sp.nearest_points(q, t, ["g"], ["qid"], "tid").collect())
    assert rows == [(0, 1, 8), (7, 1, 2), (7, 1, 2)]


def test_draws_are_put_together_where_they_are_made(spark):
    m = spark.createDataFrame([(1, "m", 1.0, 0.1), (1, "L", 2.0, 0.0), (1, "W", 3.0, 0.0), (1, "h", 1.0, 0.0)], "k int, name string, value double, std_unc double")
    out = ev.derive_plate(ev.draw_measurements(m, 20, 1, ["k"]), ["k"])
    assert "RepartitionByExpression [k" in plan(out) and out.filter("areal_mass > 0").count() == 20


def test_coverage_does_not_make_a_row_of_every_realisation(spark):
    rows = spark.createDataFrame([(1, float(x), 2.0 * x + (x % 3)) for x in range(9)], "k int, x double, y double")
    truth = cv.line_truth(rows, ["k"], "x", "y")
    reps = truth.withColumn("rep", F.lit(1))
    fast = cv.line_experiment(["k"], 50, 3)(reps)
    assert "percentile" not in plan(fast)
    who = [F.lit(3), F.col("k"), F.col("rep"), F.lit("slope")]
    v = reps.withColumn("e", F.col("slope") + F.col("se_slope") * cv.digest_normal(*who, F.lit(0))).withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(50))))
    want = v.select(F.percentile(F.col("e") + F.col("se_slope") * cv.digest_normal(*who, F.col("m")), F.array(F.lit(0.025), F.lit(0.975)))).first()[0]
    got = fast.filter("parameter = 'slope'").first()
    assert abs(got.low - want[0]) < 1e-12 and abs(got.high - want[1]) < 1e-12


def test_many_documents_share_files_and_plain_files_still_read(spark, tmp_path):
    deck = "*Heading\n*Density\n 1.5e-09,\n*Step"
    files.write_texts(spark.range(0, 40, 1, 2).select(F.concat(F.lit("deck_id="), "id").alias("name"), F.lit(deck).alias("value")), str(tmp_path / "d"))
    assert sum(f.startswith("part-") for f in os.listdir(tmp_path / "d")) <= 2
    assert {r.file for r in files.read_material_decks(spark, str(tmp_path / "d")).collect()} == {f"deck_id={i}" for i in range(40)}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.inp").write_text(deck + "\n")
    got = files.read_material_decks(spark, str(tmp_path / "p")).collect()
    assert len(got) == 1 and got[0].file.endswith("one.inp") and got[0].value == 1.5e-9


SHAPE = "k int, {} int, node_id int, dof int, value double"


def test_all_products_are_summed_where_rows_meet(spark):
    at = [(0, 1), (63, 1), (64, 2), (200, 3)]
    left = [(1, i, n, d, float((i or 5) * n + d) if (i, n) != (2, 63) else None) for i in (1, 2, None) for n, d in at] + [(1, 1, 64, 2, 7.0), (None, 3, 0, 1, 1.0), (2, 1, 0, 1, 1.0)]
    right = [(1, j, n, d, float(j - n + 2 * d)) for j in (1, 2, 3) for n, d in at if (j, n) != (3, 0)] + [(1, 2, 0, 1, None), (1, 4, 5, 1, 1.0), (None, 3, 0, 1, 1.0), (3, 1, 0, 1, 1.0)]
    l, r = spark.createDataFrame(left, SHAPE.format("i")), spark.createDataFrame(right, SHAPE.format("j"))
    w = spark.createDataFrame([(1, n, 1.5 + n) for n, _ in at], "k int, node_id int, weight double")
    pairs = l.select("k", "i").distinct().join(r.select("k", "j").distinct(), "k")
    for weights in (None, w):
        fast = sh.real_products(None, l, r, ["k"], weights)
        assert "Join" not in plan(sh.real_products(None, l, r, ["k"])) and "RepartitionByExpression [k" in plan(fast)
        got, want = ({(x.i, x.j): (x.ab, x.aa, x.bb) for x in df.collect()} for df in (fast, sh.real_products(pairs, l, r, ["k"], weights)))
        assert got.keys() == want.keys() == {(i, j) for i in (1, 2) for j in (1, 2, 3)}
        assert all(abs(a - b) < 1e-6 for key in want for a, b in zip(got[key], want[key]))


def test_branches_take_one_pass_over_the_macs(spark):
    macs = spark.createDataFrame([(1, 1, 1, 0.95), (1, 1, 2, 0.2), (1, 2, 2, 0.91), (1, 2, 3, 0.97), (1, 3, 4, 0.93), (1, 4, 4, 0.99), (1, 5, 1, None)], "k int, i int, j int, mac double")
    got = {r.i: (r.j, r.best_mac, r.status) for r in sh.track_branches(macs, None, ["k"]).collect()}
    assert got == {1: (1, 0.95, "TRACKED"), 2: (None, 0.97, "AMBIGUOUS"), 3: (None, 0.93, "EXCHANGE"), 4: (None, 0.99, "EXCHANGE"), 5: (None, None, "LOSS")}


def test_subspaces_meet_their_candidates_by_blocks(spark):
    vectors = {1: (1.0, 0.0, 0.0, 0.0), 2: (0.0, 1.0, 0.0, 0.0), 3: (0.6, 0.8, 0.0, 0.0), 4: (-0.8, 0.6, 0.0, 0.0), 5: (0.0, 0.0, 1.0, 0.0)}
    rows = lambda mode, of: spark.createDataFrame([(1, m, 70 * n, 1, v) for m in of for n, v in enumerate(vectors[m])], SHAPE.format(mode))
    clusters = spark.createDataFrame([(1, 9, 1, 2)], "k int, cluster_id int, i1 int, i2 int")
    got = sh.track_subspaces(clusters, rows("i", (1, 2)), rows("j", (3, 4, 5)), ["k"])
    assert "RepartitionByExpression [k" in plan(got)
    row = got.first()
    assert (row.n_pairs, row.j, row.j2, row.status) == (1, 3, 4, "TRACKED_CLUSTER") and abs(row.cos2_2 - 1) < 1e-9


def test_a_family_makes_no_rows_of_its_pairs(spark, monkeypatch):
    asked, products = [], sh.real_products
    monkeypatch.setattr(sh, "real_products", lambda pairs, *rest: asked.append(pairs) or products(pairs, *rest))
    shape = {1: (1.0, 0.0, 0.0), 2: (0.0, 1.0, 0.0), 3: (0.0, 0.0, 1.0), 4: (1.0, 0.1, 0.0)}
    ref = spark.createDataFrame([(1, m, n, 1, v) for m in (1, 2, 3) for n, v in enumerate(shape[m])], "cmp_id int, i int, node_id int, dof int, value double")
    states = spark.createDataFrame([(1, d, m, n, 1, v) for d in (1, 2) for m in (1, 2, 4) for n, v in enumerate(shape[m])], "cmp_id int, direction int, j int, node_id int, dof int, value double")
    modes = spark.createDataFrame([(1, 1, 10.0), (1, 2, 20.0)], "cmp_id int, i int, hz double")
    changed = spark.createDataFrame([(1, d, m, 10.0 * m * (1 + 0.1 * d), "E", side, 0.9 + 0.1 * d, 1.05) for d, side in ((1, "minus"), (2, "plus")) for m in (1, 2)],
                                    "cmp_id int, direction int, j int, hz double, parameter string, side string, value double, p0 double")
    out = comparison.family_response(ref, states, modes, changed)
    assert asked == [None]
    # the reference mode 3 and the mode 4 of the states are not listed, so the first is not followed and the second makes nothing ambiguous
    assert sorted((r.i, r.direction, r.j, r.status) for r in out["branches"].collect()) == [(1, 1, 1, "TRACKED"), (1, 2, 1, "TRACKED"), (2, 1, 2, "TRACKED"), (2, 2, 2, "TRACKED")]
    assert out["sensitivities"].count() == 2

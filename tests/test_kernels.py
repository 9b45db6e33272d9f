"""Small numeric helpers against direct computations."""
import math

import numpy as np
import pandas as pd
import pytest

from modalframe.operators.frf import thin
from modalframe.operators.matching import SCALE, Matching, exact


def _matchings(rows, edges):
    """All matchings as sets of edge numbers."""
    if not rows:
        yield frozenset()
        return
    first, *rest = rows
    yield from _matchings(rest, edges)
    for k, (r, c, _) in enumerate(edges):
        if r == first:
            for m in _matchings(rest, [(*e[:2], e[2]) if e[1] != c else (-1, -1, 0) for e in edges]):
                yield m | {k}


@pytest.mark.parametrize("seed", range(6))
def test_sparse_matching_by_enumeration(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        m, n = rng.integers(1, 6, 2)
        pairs = [(r, c) for r in range(m) for c in range(n) if rng.random() < 0.6]
        edges = [(r, c, int(rng.integers(-6, 3 if seed % 2 else 0))) for r, c in pairs]
        got = Matching(int(m), int(n), edges)
        weight = {(r, c): w for r, c, w in edges}
        mine = sum(weight[r, c] for r, c in enumerate(got.column_of) if c is not None)
        every = {x: sum(edges[k][2] for k in x) for x in _matchings(list(range(m)), edges)}
        assert mine == min(every.values()) and len({c for c in got.column_of if c is not None}) == sum(c is not None for c in got.column_of)
        for tolerance in (0, 1, 2):
            tied = got.replaceable(tolerance)
            for r, c in enumerate(got.column_of):
                if c is not None:
                    k = edges.index((r, c, weight[r, c]))
                    assert tied[r] == (min((w for x, w in every.items() if k not in x), default=10**9) <= mine + tolerance)


def test_a_large_component_is_matched():
    rng = np.random.default_rng(5)
    n = 1700
    edges = [(i, (i + d) % n, -(n + 1) * SCALE - exact(rng.random())) for i in range(n) for d in (0, 1, 7)]  # 5100 edges, one component
    got = Matching(n, n, edges)
    assert sorted(c for c in got.column_of if c is not None) == list(range(n))
    weight = {(r, c): w for r, c, w in edges}
    total = sum(weight[r, c] for r, c in enumerate(got.column_of))
    # Prices prove that no matching is lighter: no edge is below the price of its column and the level of its row.
    level = [w - got.price[c] for c, w in got.place]
    assert all(w - got.price[c] - level[r] >= 0 for r, c, w in edges) and max(got.price) <= 0
    assert total == sum(level) + sum(got.price) and not any(got.replaceable(0))


def test_thinning_by_hand():
    pos, height = np.array([1, 3, 6, 8, 11]), np.array([1.0, 3.0, 2.0, 1.9, 3.0])
    assert list(pos[thin(pos, height, 1)]) == [1, 3, 6, 8, 11]
    assert list(pos[thin(pos, height, 3)]) == [3, 6, 11]  # the higher one of two near peaks stays
    assert list(pos[thin(pos, height, 9)]) == [1, 11]  # of equal ones the later


def test_chi_square_tail(spark):
    from modalframe.operators.evidence import chi2_survival

    rows = [(1.0, 2), (5.991464547, 2), (18.307038, 10), (30.0, 10), (3.841458821, 1), (0.5, 7)]
    got = [r[0] for r in spark.createDataFrame(pd.DataFrame(rows, columns=["x", "k"])).select(chi2_survival("x", "k")).collect()]
    assert np.allclose(got[:3], [math.exp(-0.5), 0.05, 0.05], atol=1e-6)
    assert np.isclose(got[3], math.exp(-15) * sum(15 ** i / math.factorial(i) for i in range(5)), rtol=1e-10)
    assert np.isclose(got[4], math.erfc(math.sqrt(3.841458821 / 2)), rtol=1e-9)
    assert 0.99 < got[5] < 1

"""Periodic runs against brute force."""
import hashlib
import random

import numpy as np
import pytest

from modalframe.llm.queries import planted_period
from modalframe.llm.runs import SuffixTree, find_runs, periodic_runs, repeating_stretches, run_digests, runs_of


def _brute(s, least, power):
    """Every (start, length, period): for each period the maximal stretches of equal words q apart, smallest period only."""
    out, seen = [], {}
    for q in range(1, len(s) // power + 1):
        i = 0
        while i + q < len(s):
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, power * q) and not any(q % p == 0 and a <= i and i + length <= a + n for (a, n), p in seen.items()):
                out.append((i, length, q))
                seen.setdefault((i, length), q)
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_trees_give_common_extensions_and_orders():
    rng = random.Random(4)
    for _ in range(60):
        s = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
        t, n = SuffixTree(s), len(s)
        pairs = [(i, j) for i in range(n + 1) for j in range(n + 1) if i != j]
        got = t.extension(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])).tolist()
        for (i, j), e in zip(pairs, got):
            k = 0
            while max(i, j) + k < n and s[i + k] == s[j + k]:
                k += 1
            assert e == k
        assert np.argsort(t.rank).tolist() == sorted(range(n + 1), key=lambda i: s[i:])
        assert np.argsort(t.reversed_rank()).tolist() == sorted(range(n + 1), key=lambda i: [-x for x in s[i:]])


@pytest.mark.parametrize("least,power", [(24, 3), (3, 3), (6, 3), (7, 3), (10, 4)])
def test_runs_against_brute_force(least, power):
    rng = random.Random(least * 10 + power)
    for _ in range(300):
        s = []
        for _ in range(rng.randrange(1, 5)):
            root = [rng.randrange(rng.choice([2, 3, 30])) for _ in range(rng.randrange(1, 12))]
            s += root * rng.randrange(1, 9) + root[: rng.randrange(len(root) + 1)]
        want = _brute(s, least, power)
        assert sorted(runs_of(s, least, power), key=lambda r: (r[0], r[2])) == want
        assert find_runs([str(x) for x in s], least, power) == want


def test_stretches_are_only_where_words_come_again():
    assert repeating_stretches(np.arange(500), 24, 3) == []
    far = np.concatenate([np.arange(100), np.arange(1000, 1900), np.arange(100)])
    assert repeating_stretches(far, 24, 3) == []
    (a, b), = repeating_stretches(np.concatenate([np.arange(100), np.tile(np.arange(500, 510), 5)]), 24, 3)
    assert (a, b) == (100, 150)


def _digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def _plain(doc_id, text):
    ws = planted_period(doc_id, [w for w in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if w])
    runs = _brute(ws, 24, 3)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, _digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            _digest(" ".join(w for i, w in enumerate(ws) if i not in drop)))


def test_documents_against_plain_version(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("the a cat sat on mat and so it was".split()) for _ in range(rng.randrange(120))) for _ in range(150)]
    texts += [None, "", "\n \t", "x " * 24, "x " * 23, "a b c " * 8 + "\n" + "a b c d " * 8, "tie " * 30 + "end " * 30]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "again"), (3, texts[5], "again"), (None, "z " * 40, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    got = run_digests(periodic_runs(df, prepare=planted_period))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((_plain(i, t) for i, t, _ in rows), key=key)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert run_digests(periodic_runs(df.limit(0))).collect() == []


def test_a_very_long_text(spark):
    root = [f"w{k % 977}" for k in range(5000)]
    text = " ".join([*root, *root, *root, "x", *["y z".split()[k % 2] for k in range(100_000)]])
    got = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in got["runs"]] == [tuple(x) for x in find_runs(text.split(" "), 24, 3)]
    assert got["best"].period == 2 and got["best"].length == 100_000


def test_fewer_than_three_periods_are_refused(spark):
    with pytest.raises(ValueError):
        periodic_runs(spark.createDataFrame([(1, "a")], "doc_id long, text string"), least_exponent=2)

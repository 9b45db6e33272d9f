"""Near duplicates against brute force, and the last search on its own."""
import random

import pandas as pd

from modalframe.llm import circulant as c


def _brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        ws = [w for w in "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in (t or "")).replace("\t", " ").replace("\n", " ").split(" ") if w]
        sets[i] = {tuple(ws[k : k + size]) for k in range(len(ws) - size + 1)} if len(ws) >= size else ({tuple(ws)} if ws else set())
    ids = sorted(sets)
    comp = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                    lo, hi = sorted((comp[i], comp[j]))
                    comp = {k: lo if v == hi else v for k, v in comp.items()}
    return {(i, len(sets[i]), comp[i], comp[i] == i) for i in ids}


def _texts(rng):
    vocab = [f"w{i}" for i in range(400)]
    rows, base = [], [rng.choices(vocab, k=rng.choice([2, 12, 60, 150])) for _ in range(12)]
    for b in base:  # chains of edits: neighbours link, ends need not
        t = list(b)
        for _ in range(14):
            rows.append(" ".join(t))
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
    shared = rng.choices(vocab, k=80)
    rows += [" ".join(shared + rng.choices(vocab, k=25)) for _ in range(40)]  # a long common passage, mostly below the threshold
    rows += ["", "  \n ", "One", "one", "Two words", "two\twords", "é É", "é é"] + [rows[0].upper()] * 5
    rng.shuffle(rows)
    return list(enumerate(rows)) + [(9000, None)]


def test_against_brute_force(spark):
    rows = _texts(random.Random(5))
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, rep string")
    for size, percent in ((3, 85), (5, 80)):
        got = {tuple(r) for r in c.near_duplicates(df, size, percent).collect()}
        assert got == _brute(rows, size, percent)


def test_edges_of_the_input(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d"), (3, None)], "doc_id long, text string")
    got = sorted(map(tuple, c.near_duplicates(df, 3, 85).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (2, 2, 1, False), (3, 0, 3, True)], key=repr)
    assert c.near_duplicates(df.limit(0), 3, 85).collect() == []


def test_last_search_finds_every_merge():
    few = pd.DataFrame({"rep": [5, 6], "component": [5, 6], "shingles": [[1, 2, 3, 4, 5], [100, 101]]})
    many = pd.DataFrame({"rep": [1, 2, 5, 6], "component": [1, 2, 5, 6], "shingles": [[1, 2, 3, 4, 5, 6], [7], [1, 2, 3, 4, 5], [100, 101]]})
    assert c._search(few, many, 80) == [(5, 1)]


def test_band_counts_keep_the_miss_chance():
    for t in (0.8, 0.85, 0.9):
        b, r = c.banding(t)
        assert (1 - t**r) ** b <= c.MISS


def test_two_texts_under_one_id_keep_their_links(spark):
    rng = random.Random(2)
    a, b = ([f"{x}{rng.randrange(900)}" for _ in range(60)] for x in "ab")
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join(a + ["tail"])), (9, " ".join(b + ["tail"])), (5, " ".join(a)), (3, "alone in here")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, least int").repartition(3)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in c.near_duplicates(df, 3, 85).collect())
    assert got == [(3, 3, True), (5, 5, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False)]


def test_a_pair_exactly_at_the_threshold_links(spark):
    shared = [f"s{k}" for k in range(87)]  # 85 of 100 shingles are common
    rows = [(1, " ".join([*shared, *(f"x{k}" for k in range(15))])), (2, " ".join(shared)), (3, " ".join([*shared[:-1], *(f"y{k}" for k in range(16))]))]
    got = {(r.doc_id, r.component_id) for r in c.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {(1, 1), (2, 1), (3, 3)}

"""Phrase collocations against plain counts."""
import random
import re
from collections import Counter, defaultdict

from modalframe.llm import phrases
from modalframe.llm.phrases import collocations, frequent_phrases


def _counts(rows):
    f, n = defaultdict(Counter), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def _plain(rows, least, top):
    f, n = _counts(rows)
    out = []
    for lang in f:
        cand = {p: c for p, c in f[lang].items() if c >= least and " " in p}
        scored = []
        for p, a in cand.items():
            w = p.split(" ")
            cuts = [(f[lang][" ".join(w[:k])], f[lang][" ".join(w[k:])]) for k in range(1, len(w))]
            score, _, left, right = min((2000000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(cuts))
            if not any(len(q.split(" ")) > len(w) and f" {p} " in f" {q} " and 100 * b >= 80 * a for q, b in cand.items()):
                scored.append((-score, -a, p.encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def _rows():
    rng = random.Random(9)
    vocabulary = ["new", "York", "city", "of", "the", "a", "é", "É", "x\x1fy", "naïve", "🙂", "it's", "-", "10"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "; ", "!", "\r\n", "\x0b", "\x0c", ":?"]
    rows = []
    for i in range(400):
        text = "".join(rng.choice(vocabulary[: rng.choice([3, 8, 14])]) + rng.choice(ends) for _ in range(rng.randrange(60)))
        rows.append((i, rng.choice(["en", "de", None, "und", ""]), text))
    return rows + [(400, "en", None), (401, "en", ""), (402, "fr", "..!"), (3, "en", rows[3][2]), (None, "en", "New york city " * 30), (403, "en", "York"), (404, "en", "city"), (405, "es", "a b " * 20_000)]


def test_against_plain_counts(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "phrase long, lang string, text string").repartition(4)
    assert sorted(map(tuple, collocations(df, least=5, top=40).collect())) == _plain(rows, 5, 40)
    assert sorted(map(tuple, collocations(df, least=1, top=None).collect())) == _plain(rows, 1, 10**9)
    assert collocations(df.limit(0)).collect() == []
    assert collocations(df.filter("text = ''")).collect() == []


def test_collisions_are_parted_by_the_text(spark, monkeypatch):
    rows = _rows()
    df = spark.createDataFrame(rows, "phrase long, lang string, text string").repartition(2)
    for bits in (0, 3, 9):
        assert sorted(map(tuple, collocations(df, least=20, top=None, bits=bits).collect())) == _plain(rows, 20, 10**9)


def test_small_blocks_and_counts_of_words(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 50)
    rows = _rows()
    batch = __import__("pyarrow").RecordBatch.from_arrays([__import__("pyarrow").array(["en"] * 3), __import__("pyarrow").array(["ab", "c d. E", "f" * 100])], names=["lang", "text"])
    words = [b.bytes_of(i) for b in phrases._blocks(batch, 64) for i in range(len(b.start))]
    assert words == [b"ab", b"c", b"d", b"e", b"f" * 100]
    _, n = _counts(rows)
    found = frequent_phrases(spark.createDataFrame(rows, "phrase long, lang string, text string"), least=30)
    assert {r.lang: r.f for r in found.filter("words = 0").collect()} == {k: v for k, v in n.items() if v}


def test_scores_pass_64_bits_exactly(spark):
    got = spark.sql("SELECT CAST(9000000000000000000 AS DECIMAL(20,0)) * 2000000 div (CAST(9000000000000000001 AS DECIMAL(20,0)) + 9000000000000000003L) AS s").first().s
    assert got == 2000000 * 9000000000000000000 // 18000000000000000004

"""Quality rules against a plain version of each measure and of the distance."""
import math
import random
import re

from modalframe.llm import divergence as d

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _plain(text):
    text = text or ""
    ws = WORD.findall(text)
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    inside = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 8)}
    seen, dup = [], 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.append(line)
    return len(ws), sum(len(w) for w in ws), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def _clean(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "house", "river", "stone", "is", "a", "walking", "green", "in", "to", "Paris,", "there."]) + rng.choice(["", "", "s"]) for _ in range(n))


def test_measures():
    rng = random.Random(7)
    texts = [None, "", " \n\t ", "é\x0b日本 🙂", "a\nb\na\n\n \n a\na", "x " * 30, "to be or not to be that is " * 3 + "end", "\x0c".join("abcdefgh" * 4)]
    texts += [" ".join(rng.choice("ab") for _ in range(60)) for _ in range(30)] + [_clean(rng, 300)]
    for t in texts:
        assert d.measures(t)[:5] == _plain(t), t
        assert sum(d.measures(t)[5]) == len(t or "") and sum(d.measures(t)[6]) == len(WORD.findall(t or ""))


def _rows(rng):
    good = [(i, _clean(rng, rng.randrange(120, 400)), "en", "x") for i in range(60)]
    junk = [(100 + i, " ".join("".join(rng.choice("QWRTZ") for _ in range(5)) + "!!%%%" for _ in range(200)), "en", "x") for i in range(5)]
    odd = [(200, None, "en", "x"), (201, "", None, "x"), (202, "too short", "de", "x"), (None, _clean(rng, 150), "??", "x"), (0, good[0][1], "en", "x"), (203, "same words here " * 50, "en", "x")]
    return good + junk + odd


def test_verdicts_and_distance(spark):
    rows = _rows(random.Random(8))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    out = d.quality_rules(df).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    assert all(got[i].kept for i in range(60)) and got[None].kept and not any(got[100 + i].kept for i in range(5))
    assert got[200].base_failed and got[202].base_failed and got[203].base_failed and got[200].n_words == 0 and got[200].char_distance is None

    good = [d.measures(r[1])[5] for r in rows if r[2] == "en" and not got[r[0]].base_failed and len(r[1]) >= d.MIN_CHARACTERS]
    share = lambda c: [x / sum(c) for x in c]
    ref = [sum(x) / len(good) for x in zip(*map(share, good))]
    h = lambda p: -sum(x * math.log2(x) for x in p if x > 0)
    p = share(d.measures(rows[62][1])[5])
    want = math.sqrt(h([(a + b) / 2 for a, b in zip(p, ref)]) - (h(p) + h(ref)) / 2)
    assert abs(got[rows[62][0]].char_distance - want) < 1e-9


def test_filter_keeps_rows_and_columns(spark):
    rows = _rows(random.Random(8))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    out = d.filter_quality(df)
    assert out.columns == df.columns and sorted(map(repr, map(tuple, out.collect()))) == sorted(repr(r) for r in rows if (r[0] is None or r[0] < 60))
    assert d.filter_quality(df.limit(0)).count() == 0 and d.quality_rules(df.limit(0)).count() == 0


def test_a_fifth_language_keeps_its_clean_texts(spark):
    import random

    rng = random.Random(3)
    finnish = "ja on ei se että hän oli mutta niin kuin minä sen kun joka olla talo metsä järvi kaunis päivä yö kesä talvi vanha".split()
    rows = [(i, "fi", " ".join(rng.choices(finnish, k=150)) + f" {i}.") for i in range(40)]
    rows += [(100 + i, None, " ".join(rng.choices(finnish, k=150)) + f" {i}.") for i in range(5)]
    rows += [(200 + i, "en", " ".join(rng.choices(d.COMMON["en"] + ["house", "lake", "summer"], k=150)) + f" {i}.") for i in range(40)]
    rows += [(300, "en", " ".join(rng.choices(finnish, k=150))), (301, "fi", "@#% " * 10 + " ".join(f"{k:x}$#" * 9 for k in range(60)))]
    got = {r.doc_id: r for r in d.quality_rules(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert all(got[i].kept for i in got if i < 300)
    assert all(got[i].word_distance is None and got[i].char_distance is not None for i in got if i < 200)
    assert not got[300].kept and not got[301].kept

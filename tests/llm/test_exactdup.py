"""Exact duplicates against a plain version, with a weak digest and with very large groups."""
import hashlib
import random
import re

from pyspark.sql import functions as F

from modalframe.llm.exactdup import exact_duplicates


def _plain(rows):
    groups = {}
    for k, (i, t, _) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append(k)
    out = []
    for content, members in groups.items():
        best = min(members, key=lambda k: (-len(rows[k][1] or ""), rows[k][0] is None, rows[k][0] or 0, k))
        sha = hashlib.sha256(content.encode()).hexdigest()
        out += [(rows[k][0], rows[best][0], len(members), k == best, sha) for k in members]
    return sorted(out, key=_key)


def _key(r):
    return tuple((x is not None, x) for x in r)


def _rows():
    rng = random.Random(5)
    pool = ["", "a b", "ab", "a\nb", " ab ", "é 🙂", "é🙂", "A b", "x y", "xy", "long " * 3000, "long" * 3000, "\x1fz", "z"]
    rows = [(i, rng.choice(pool), "clash") for i in range(400)] + [(400 + i, f"only {i}", "clash") for i in range(300)]
    rows += [(900, None, "c"), (901, "", "c"), (None, "ab", "c"), (None, "nobody's", "c"), (7, "two texts", "c"), (7, "other text", "c")]
    rows += [(950, "same row", "c")] * 5 + [(951, "sa me row", "c")] * 3 + [(951, "same  row", "c")] + [(None, "n", "c")] * 2
    rng.shuffle(rows)
    return rows


def test_against_plain_version(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(5)
    got = exact_duplicates(df)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=_key) == _plain(rows)
    assert exact_duplicates(df.limit(0)).collect() == []


def test_shared_digests_never_join_different_texts(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(5)
    for weak in (lambda c: F.substring(F.sha2(c, 256), 1, 1), lambda c: F.lit("x")):
        assert sorted(map(tuple, exact_duplicates(df, digest=weak).collect()), key=_key) == _plain(rows)


def test_a_group_of_a_third_of_all_rows(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    got = exact_duplicates(df).groupBy("kept").agg(F.count("*"), F.max("group_size")).collect()
    assert sorted(map(tuple, got)) == [(False, 9999, 10000), (True, 20001, 10000)]
    same = spark.range(250_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("again").alias("text"))
    assert sorted(map(tuple, exact_duplicates(same).groupBy("kept", "group_size").count().collect())) == [(False, 250_000, 249_999), (True, 250_000, 1)]

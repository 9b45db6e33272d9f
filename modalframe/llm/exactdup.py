"""Exact duplicates, combined in stages that no hot text can overload.

Texts are equal when they are identical without their white space. Every stage groups by the digest and by the whole
normalised text: each task first merges its own rows (the partial aggregate), salted groups merge what the tasks found, and
the winners of the salts are combined at the end, so however many copies a text has, one row of it per task is shuffled.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modalframe.session import scratch_path

BLANKS = " \t\n\x0b\x0c\r"
#: Parts into which the rows of one text are split before they are combined.
SALTS = 16
#: Texts with more than one in so many rows are looked up from memory; there can be no more of them than this.
HOT_SHARE = 1000
#: Rows written by one task for rows that are repeated under one id.
REPEATS = 100_000


def normalised(text: Column) -> Column:
    """The text without blanks and U+0009 to U+000D; a null one is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _rows(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), normalised(text).alias("content"), F.char_length(F.coalesce(text.cast("string"), F.lit(""))).cast("bigint").alias("chars"))
    return rows.withColumn("digest", digest(F.col("content")))


def combine(rows: DataFrame) -> DataFrame:
    """One row per different content: ``digest, content, keep_id, keep_chars, group_size``, partitioned by digest.

    Lengths are grouped apart first, so that every aggregate has numbers only in its buffer and stays a hash aggregate.
    """
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    merged = salted.groupBy("digest", "salt", "content", "chars").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    by_length = merged.repartition("digest").groupBy("digest", "content", "chars").agg(F.min("id").alias("id"), F.sum("n").alias("n"))
    return by_length.groupBy("digest", "content").agg(F.max_by("id", "chars").alias("keep_id"), F.max("chars").alias("keep_chars"), F.sum("n").alias("group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """One row per row of ``docs``: ``id_col, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the most characters in the original text stays, then the one of least id (a null id counts as the
    largest); of rows that agree in id and length exactly one is marked as kept. Null texts are empty ones, and empty texts are equal to each
    other. An empty table gives an empty one; other columns are not read.

    ``digest`` only leads texts together; it decides nothing. Where two texts share a digest, their rows are matched by their
    content. The groups (no texts) are written to the shared scratch folder. Rows find their group by digest: texts that make up more than
    1 / `HOT_SHARE` of all rows are at most `HOT_SHARE` and are broadcast, all others are joined by a shuffle in which no key
    is hot.
    """
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col, digest)
    path = scratch_path(spark, "groups")
    one = combine(rows).groupBy("digest").agg(F.count(F.lit(1)).alias("n_contents"), F.max("keep_id").alias("keep_id"), F.max("keep_chars").alias("keep_chars"), F.sum("group_size").alias("group_size"))
    one.write.parquet(path)
    groups = spark.read.parquet(path)
    n_rows, shared = groups.agg(F.sum("group_size"), F.max("n_contents")).first()

    hot = groups.filter((F.col("group_size") * HOT_SHARE > F.lit(n_rows or 0)) & (F.col("n_contents") == 1))
    member = rows.select("id", "chars", "digest", F.sha2("content", 256).alias("text_sha256"))
    group = ["keep_id", "keep_chars", "group_size", "n_contents"]
    named = lambda df, p: df.select(F.col("digest").alias(f"{p}digest"), *[F.col(c).alias(p + c) for c in group])
    h, g = named(hot, "h_"), named(groups, "g_")
    found = member.join(F.broadcast(h), F.col("digest") == F.col("h_digest"), "left")
    # Rows of hot texts are done: they get a key of their own, which meets nothing and spreads them evenly.
    found = found.withColumn("key", F.when(F.col("h_digest").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.col("id").cast("string"))))
    found = found.join(g, F.col("key") == F.col("g_digest"), "left")
    found = found.select("id", "chars", "text_sha256", "digest", *[F.coalesce(f"h_{c}", f"g_{c}").alias(c) for c in group])
    if shared and shared > 1:
        mixed = groups.filter("n_contents > 1").select("digest")
        among = rows.join(mixed, "digest", "left_semi")
        exact = combine(among)
        by_content = among.select("id", "chars", "digest", "content", F.sha2("content", 256).alias("text_sha256")).join(exact, ["digest", "content"])
        columns = ["id", "chars", "text_sha256", "keep_id", "keep_chars", "group_size"]
        found = found.filter("n_contents = 1").select(*columns).unionByName(by_content.select(*columns))
    winner = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    out = ["id", "keep_id", "group_size", "text_sha256"]
    lost = found.filter(~winner).select(*out, F.lit(False).alias("kept"))
    # Winners that are alike in everything: one is kept. What one key stands for is a number, dealt out in bounded portions.
    won = found.filter(winner).groupBy(*out).agg(F.count(F.lit(1)).alias("n"))
    once = won.filter("n = 1").select(*out, F.lit(True).alias("kept"))
    part = won.filter("n > 1").select(*out, "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {REPEATS})")).alias("part")).repartition("part", "id")
    many = part.select(*out, F.explode(F.expr(f"sequence(part * {REPEATS}, least(n, (part + 1) * {REPEATS}) - 1)")).alias("i")).select(*out, (F.col("i") == 0).alias("kept"))
    rest = lost.unionByName(once).unionByName(many)
    return rest.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")

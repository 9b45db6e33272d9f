"""Quality rules by distribution divergence: character classes and common words against language references."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from modalframe.llm.circulant import word_hashes
from modalframe.llm.text import map_texts, words
from modalframe.session import scratch_path

# Frequent words of each language that has a reference.
COMMON = {
    "de": "der die das und ist in zu den mit von ein eine nicht für auf im sich als auch es an dem des war wie bei oder aus nach werden".split(),
    "en": "the of and to in a is that for it was on with as by this from or an be are at which not have but they his you we".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque".split(),
    "fr": "de la le et les des en un une du que est pour dans qui par sur au plus ne pas avec ce il sont se ou aux son cette".split(),
}
VOCABULARY = sorted({w for ws in COMMON.values() for w in ws})
_AT = {w: i + 1 for i, w in enumerate(VOCABULARY)}  # 0: any other word
WORD_BINS = len(VOCABULARY) + 1

#: Character classes: lower, upper, digit, blank, line end, sentence marks, other ASCII, other letters, the rest.
CLASSES = 9
_CLASS = np.full(128, 6, np.intp)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[10] = 0, 1, 2, 3, 4
_CLASS[[ord(c) for c in ".,;:!?'\"-()"]] = 5

#: Jensen-Shannon distances (base 2, 0 to 1) beyond which a text is unlike every reference, and the lengths from which
#: a histogram says something.
MAX_CHARACTERS, MIN_CHARACTERS = 0.30, 100
MAX_WORDS, MIN_WORDS = 0.34, 100
#: A language has a reference if at least one in so many judged texts is written in it; so there are never more than this.
REFERENCE_SHARE = 1000
#: Base rule.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8


def character_histogram(text: str) -> np.ndarray:
    """Number of characters of each class."""
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    plain = cp < 128
    out = np.bincount(_CLASS[cp[plain]], minlength=CLASSES)
    beyond = len(cp) - int(plain.sum())
    if beyond:
        rest = cp[~plain]
        letters = int(((rest >= 0xC0) & (rest != 0xD7) & (rest != 0xF7) & ((rest < 0x2000) | (rest >= 0x2C00)) & (rest < 0xFE00)).sum())
        out[7] += letters
        out[8] += beyond - letters
    return out


def word_histogram(ws: list[str]) -> np.ndarray:
    """Number of each common word (A-Z lower-cased); bin 0 holds all others."""
    at = _AT.get
    return np.bincount(np.array([at(w, 0) or at(w.lower(), 0) for w in ws], np.intp), minlength=WORD_BINS)


def repeated_words(ws: list[str], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more in the text, the first occurrence included."""
    n = len(ws) - window + 1
    if n < 2 or len(set(ws)) == len(ws):
        return 0
    h = word_hashes(ws)
    code = np.zeros(n, np.uint64)
    for j in range(window):
        code = (code + h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    mark = np.zeros(len(ws) + 1, np.int64)
    at = np.flatnonzero(twice)
    mark[at] += 1
    np.add.at(mark, at + window, -1)
    return int((np.cumsum(mark)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            n += line in seen
            seen.add(line)
    return n


def measures(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, character counts, common-word counts)."""
    text = text or ""
    ws = words(text)
    return (len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), duplicate_lines(text), repeated_words(ws),
            character_histogram(text).tolist(), word_histogram(ws).tolist())


ADDED = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, characters array<bigint>, common array<bigint>"


def measure(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    def compute(texts):
        return list(zip(*map(measures, texts), strict=True)) if texts else [[] for _ in range(7)]

    return map_texts(docs, keep, text_col, compute, ADDED)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, to base 2, of each row of ``p`` to the shares ``q``."""
    m = (p + q) / 2

    def part(x):
        return (x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1))).sum(axis=1)

    return np.sqrt(np.maximum((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0))


def _rows_of(column, bins: int) -> np.ndarray:
    """Arrow lists of equal length as the rows of an array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, bins).astype(float)


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


_KINDS = (("characters", CLASSES, MIN_CHARACTERS), ("common", WORD_BINS, MIN_WORDS))


def references(measured: DataFrame, lang_col: str) -> list[list[np.ndarray]]:
    """Per histogram the mean shares of each language's texts that pass the base rule and are long enough.

    Characters have a reference for every language that at least one in `REFERENCE_SHARE` of these texts is written in, words for the
    languages with a list in `COMMON`. Every such text of the corpus counts once. Shares are added up batch by batch, then over batches:
    what reaches the driver has one row per histogram and language, at most `REFERENCE_SHARE` a histogram, whatever the input.
    """

    def add_up(batches):
        for b in batches:
            codes, names = pd.factorize(np.array(b.column("lang").to_pylist(), object))
            rows = []
            for k, (name, bins, least) in enumerate(_KINDS):
                counts = _rows_of(b.column(name), bins)
                shares, long_ = _shares(counts), counts.sum(axis=1) >= least
                for code, language in enumerate(names):
                    at = long_ & (codes == code)
                    if at.any() and (name == "characters" or language in COMMON):
                        rows.append({"kind": k, "language": language, "n": int(at.sum()), "sums": shares[at].sum(axis=0).tolist()})
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    out = pa.schema([("kind", pa.int32()), ("language", pa.string()), ("n", pa.int64()), ("sums", pa.list_(pa.float64()))])
    parts = measured.filter(~base_failed()).select(F.col(lang_col).cast("string").alias("lang"), "characters", "common").mapInArrow(add_up, "kind int, language string, n bigint, sums array<double>")
    bins = parts.select("kind", "language", F.posexplode("sums").alias("bin", "s"), "n")
    sums = bins.groupBy("kind", "language", "bin").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).groupBy("kind", "language").agg(
        F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("bin", (F.col("s") / F.col("n")).alias("share")))), lambda x: x["share"]).alias("mean"))
    often = F.col("n") * REFERENCE_SHARE >= F.sum("n").over(Window.partitionBy("kind"))
    rows = sums.withColumn("often", often).filter("often").orderBy("kind", "language").collect()
    return [[np.array(r["mean"]) for r in rows if r["kind"] == k] for k in range(len(_KINDS))]


def verdicts(measured: DataFrame, lang_col: str) -> DataFrame:
    """``measured`` (a stored table), but for the histograms, with base_failed, char_distance, word_distance and kept."""
    refs = references(measured, lang_col)
    plain = [c for c in measured.columns if c not in ("characters", "common")]
    n = len(plain)
    schema = StructType([*measured.select(*plain).schema.fields, StructField("char_distance", DoubleType()), StructField("word_distance", DoubleType())])

    def judge(batches):
        for b in batches:
            made, listed = [], np.array(b.column(n + len(_KINDS)).to_pylist(), bool)
            for k, (name, bins, least) in enumerate(_KINDS):
                counts = _rows_of(b.column(n + k), bins)
                near = np.min([jensen_shannon(_shares(counts), r) for r in refs[k]], axis=0) if refs[k] else np.zeros(len(counts))
                silent = (counts.sum(axis=1) < least) | (not refs[k])
                made.append(pa.array(near, mask=silent | ~listed if name == "common" else silent))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *made], names=schema.names)

    listed = F.coalesce(F.col(lang_col).cast("string").isin(*COMMON), F.lit(False))
    d = measured.select(*plain, "characters", "common", listed.alias("listed_language")).mapInArrow(judge, schema).withColumn("base_failed", base_failed())
    unlike = F.coalesce(F.col("char_distance") > MAX_CHARACTERS, F.lit(False)) | F.coalesce(F.col("word_distance") > MAX_WORDS, F.lit(False))
    return d.withColumn("kept", ~F.col("base_failed") & ~unlike)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance``.

    A text is kept unless it fails the base rule or its character classes or common words are farther than a limit from
    every language reference. References are the mean shares over all texts of the corpus that pass the base rule, per
    language; a text shorter than the minimum length of a histogram is not judged by it (distance null). Null and empty
    texts have no words, so they fail the base rule. The words of a text are judged only if its language has a list of common
    words; texts of other languages (or null) are judged by their characters alone. Texts of a null language feed no reference.
    Without any reference only the base rule decides. Repeated rows and null ids come back as they are; an
    empty table gives an empty one; other columns are not read. Texts are read once: their counts are written to the shared
    scratch folder, and only the references reach the driver.
    """
    spark = docs.sparkSession
    at = scratch_path(spark, "measures")
    renamed = docs.select(F.col(id_col).alias("doc"), F.col(lang_col).alias("language"), F.col(text_col).alias("t"))
    measure(renamed, ["doc", "language"], "t").write.parquet(at)
    v = verdicts(spark.read.parquet(at), "language")
    return v.select(F.col("doc").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def filter_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, that `quality_rules` keeps. Each row is judged by itself, so ids may repeat."""
    spark = docs.sparkSession
    names = docs.columns
    at = scratch_path(spark, "measured")
    plain = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)])
    measure(plain, plain.columns, f"k{names.index(text_col)}").write.parquet(at)
    v = verdicts(spark.read.parquet(at), f"k{names.index(lang_col)}")
    return v.filter("kept").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])

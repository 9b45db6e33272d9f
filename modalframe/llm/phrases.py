"""Phrase collocations: Rabin-Karp fingerprints of word n-grams, counted level by level, verified and cut from the text.

A block of texts is one byte array. Prefix polynomials over its bytes give the fingerprint of every word, prefix polynomials over
the words give that of every n-gram, all by numpy. Tasks count the fingerprints of a block and keep a pointer to an occurrence of
each; a shuffle adds the counts up. An n-gram is no more frequent than its parts, so a level only counts n-grams whose parts passed
the level before. In the last pass the occurrences that share a fingerprint are compared with the text at its pointer, and only
frequent phrases are cut from there; their counts are then added up by the text itself.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modalframe.session import scratch_path

#: Bytes of text fingerprinted at once; longer documents are a block of their own.
BLOCK = 1 << 21
#: Size of the filter that tells the next pass which fingerprints are frequent (16 MiB whatever the input). A full filter lets
#: more n-grams be counted, and changes no count.
FILTER_BITS = 27
LONGEST = 4

_BASE, _STEP = 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25  # odd bases of the two polynomials
_KIND = np.zeros(256, np.uint8)  # 0: part of a word, 1: blank, 2: end of a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?\n\x0b\x0c\r"]] = 2


def _mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to ``size`` - 1 of an odd base modulo 2^64, and of its inverse."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(size, b, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def _spans(values: np.ndarray, base: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Polynomial hash of ``values[start:stop]`` for each span, from one array of prefixes."""
    size = 1 << max(12, len(values).bit_length())
    power, inverse = _powers(base, size)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=prefix[1:])
    return (prefix[stop] - prefix[start]) * inverse[start]


class Block:
    """Words and n-gram fingerprints of some documents. ``bits`` shortens fingerprints (for tests of collisions)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: list[str], codes: np.ndarray, bits: int = 64):
        import xxhash

        upper = (data >= 65) & (data <= 90)
        self.data = data + (upper * np.uint8(32))
        self.langs, self.mask = langs, np.uint64((1 << bits) - 1)
        kind = _KIND[self.data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = kind == 0
        begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        cut = offsets[(offsets > 0) & (offsets < len(data))]  # a word never goes on into the next document
        begins[cut] = inside[1:-1][cut]
        ends[cut - 1] = inside[1:-1][cut - 1]
        self.start, self.stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.lang = codes[doc]
        self.piece = np.cumsum(kind == 2)[self.start] + doc if len(data) else doc  # both only grow, so equal sums mean one piece
        size = (self.stop - self.start).astype(np.uint64)
        self.word = _mix(_spans(_BYTE[self.data], _BASE, self.start, self.stop) + size) & self.mask
        self.seed = _mix(np.array([xxhash.xxh64_intdigest(x) for x in langs] or [0], np.uint64))[self.lang] if len(self.lang) else np.zeros(0, np.uint64)
        self.values = _mix(self.word)

    def grams(self, n: int) -> np.ndarray:
        """Fingerprint of the ``n`` words from each place, in its language; meaningful where `whole` holds."""
        m = max(0, len(self.word) - n + 1)
        at = np.arange(m)
        return _mix((_spans(self.values, _STEP, at, at + n) ^ self.seed[:m]) + np.uint64(n)) & self.mask

    def whole(self, n: int) -> np.ndarray:
        """Whether the ``n`` words from each place lie in one piece."""
        m = max(0, len(self.word) - n + 1)
        return self.piece[:m] == self.piece[n - 1 : n - 1 + m]

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.stop[i]].tobytes()

    def word_ids(self) -> np.ndarray:
        """Numbers that are equal exactly for equal words: the first word of each fingerprint, compared byte by byte."""
        _, first, inverse = np.unique(self.word, return_index=True, return_inverse=True)
        rep = first[inverse]
        size = self.stop - self.start
        same = size == size[rep]
        if same.all():
            ahead = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            same = self.data[np.repeat(self.start, size) + ahead] == self.data[np.repeat(self.start[rep], size) + ahead]
        if same.all():
            return rep
        known: dict[bytes, int] = {}  # two words share a fingerprint: number them by their bytes
        return np.array([known.setdefault(self.bytes_of(i), i) for i in range(len(size))], np.int64)

    def phrases(self, n: int, at: np.ndarray, fingerprints: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, bytes, int]]:
        """(language code, phrase, count) of the occurrences ``at``, verified word by word against the first of each fingerprint."""
        _, first, inverse, count = np.unique(fingerprints, return_index=True, return_inverse=True, return_counts=True)
        pointer = at[first]
        rep = pointer[inverse]
        same = self.lang[at] == self.lang[rep]
        for k in range(n):
            same &= ids[at + k] == ids[rep + k]
        if not same.all():  # phrases share a fingerprint: part them by their words
            rows = np.stack([self.lang[at].astype(np.int64), *(ids[at + k] for k in range(n))], axis=1)
            _, first, count = np.unique(rows, axis=0, return_index=True, return_counts=True)
            pointer = at[first]
        data, start, stop = self.data.tobytes(), self.start, self.stop
        codes = self.lang[pointer].tolist()
        bounds = [(start[pointer + k].tolist(), stop[pointer + k].tolist()) for k in range(n)]
        for j, (code, c) in enumerate(zip(codes, count.tolist())):
            yield code, b" ".join([data[a[j] : b[j]] for a, b in bounds]), c


def _blocks(batch: pa.RecordBatch, bits: int) -> Iterator[Block]:
    """Blocks of about `BLOCK` bytes of an Arrow batch of (lang, text), read from its buffers without making strings."""
    lang, text = batch.column(0).dictionary_encode(), batch.column(1)
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    _, where, raw = text.buffers()
    offsets = np.frombuffer(where, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    codes, langs = lang.indices.to_numpy(zero_copy_only=False), lang.dictionary.to_pylist()
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, side="right")) - 1)
        yield Block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], langs, codes[a:b], bits)
        a = b


def _passes(filter_words: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
    """Which fingerprints the filter knows (both of their bits are set)."""
    out = np.ones(len(fingerprints), bool)
    for place in (fingerprints >> np.uint64(64 - FILTER_BITS), (fingerprints >> np.uint64(10)) & np.uint64((1 << FILTER_BITS) - 1)):
        out &= ((filter_words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
    return out


def frequent_filter(fingerprints: DataFrame) -> np.ndarray:
    """A filter of fixed size over a column ``fp``; its words are put together by Spark, the driver only gets the filter."""
    places = [F.shiftrightunsigned("fp", 64 - FILTER_BITS), F.shiftrightunsigned("fp", 10).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))]
    bit = fingerprints.select(F.explode(F.array(*places)).alias("p")).select(F.shiftrightunsigned("p", 6).alias("word"), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("bit"))
    found = bit.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _counted(texts: DataFrame, select: Callable[[Block], list[np.ndarray]], bits: int) -> DataFrame:
    """Fingerprints with their counts: what ``select`` finds in each block, added up over all blocks."""

    def run(batches):
        for batch in batches:
            for block in _blocks(batch, bits):
                fp, n = np.unique(np.concatenate(select(block)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(n.astype(np.int64))], names=["fp", "n"])

    return texts.mapInArrow(run, "fp bigint, n bigint").groupBy("fp").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text", bits: int = 64) -> DataFrame:
    """All phrases of 1 to ``longest`` words with at least ``least`` occurrences in a language: ``lang, words, phrase, f``.

    A row with ``words`` = 0 and an empty phrase counts all words of a language. Phrases are lower-cased (A-Z), within pieces
    between `.,;:!?` and line ends, words joined by one blank. A null language is ``und``, a null text is empty. Counts are exact.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def level(name, select):
        path = scratch_path(spark, name)
        _counted(texts, select, bits).filter(F.col("n") >= least).select("fp").write.parquet(path)
        return spark.read.parquet(path)

    def chained(block, n, pairs):
        """Places whose ``n`` words hold frequent pairs only."""
        m = max(0, len(block.word) - n + 1)
        ok = np.ones(m, bool)
        for k in range(n - 1):
            ok &= pairs[k : k + m]
        return ok

    levels = [level("words", lambda b: [b.grams(1)])]
    if longest >= 2:
        known = sc.broadcast(frequent_filter(levels[0]))

        def pairs_of(b):
            one = _passes(known.value, b.grams(1))
            return [b.grams(2)[b.whole(2) & one[:-1] & one[1:]]]

        levels.append(level("pairs", pairs_of))
    if longest >= 3:
        linked = sc.broadcast(frequent_filter(levels[1]))

        def longer_of(b):
            pairs = b.whole(2) & _passes(linked.value, b.grams(2))
            return [b.grams(n)[chained(b, n, pairs)] for n in range(3, longest + 1)]

        levels.append(level("longer", longer_of))
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    wanted = sc.broadcast(frequent_filter(every))

    def materialise(batches):
        schema = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])
        for batch in batches:
            for b in _blocks(batch, bits):
                langs, words, phrases, counts = [], [], [], []
                for code, n in zip(*np.unique(b.lang, return_counts=True)):
                    langs.append(b.langs[code]), words.append(0), phrases.append(""), counts.append(int(n))
                ids = b.word_ids()
                pairs = None
                for n in range(1, longest + 1):
                    fp = b.grams(n)
                    ok = _passes(wanted.value, fp)
                    if n == 2:
                        pairs = ok = ok & b.whole(2)
                    elif n > 2:
                        ok &= chained(b, n, pairs)
                    at = np.flatnonzero(ok)
                    if len(at):
                        for code, phrase, count in b.phrases(n, at, fp[at], ids):
                            langs.append(b.langs[code]), words.append(n), phrases.append(phrase), counts.append(count)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.int32()), pa.array(phrases, pa.string()), pa.array(counts, pa.int64())], schema=schema)

    found = texts.mapInArrow(materialise, "lang string, words int, phrase string, f bigint").groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    path = scratch_path(spark, "phrases")
    found.filter((F.col("f") >= least) | (F.col("words") == 0)).write.parquet(path)
    return spark.read.parquet(path)


def collocations(docs: DataFrame, least: int = 30, top: int | None = 2000, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text", bits: int = 64) -> DataFrame:
    """The strongest phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Candidates are phrases of 2 to ``longest`` words with ``a >= least`` occurrences. Each is cut where it holds together worst: with
    ``l`` and ``r`` occurrences of its two parts the score is floor(2000000 a / (l + r)), the least over all cuts (ties: the
    earliest cut). A candidate inside a longer one with at least 80 percent of its occurrences is left out. ``n`` counts all words of the
    language; arithmetic is exact. ``top`` phrases a language are returned (None: all), by score, occurrences (both falling) and
    phrase (by bytes).

    Null languages are ``und``, null and empty texts have no words, repeated rows count each time, other columns are not read, an
    empty table gives an empty one. Four passes over the texts; shuffled are counts of fingerprints and frequent phrases, never
    texts. Memory: about 70 bytes a byte of a block, so of `BLOCK` or of the longest document.
    """
    stored = frequent_phrases(docs, least, longest, lang_col, text_col, bits)
    total = stored.filter("words = 0").select("lang", F.col("f").alias("n"))
    parts = stored.filter("words > 0")
    candidates = parts.filter("words > 1").select("lang", "words", "phrase", F.split("phrase", " ").alias("w"), F.col("f").alias("a"))
    joined = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = candidates.select("lang", "words", "phrase", "w", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    scored = scored.withColumn("score", F.expr("CAST(a AS DECIMAL(20,0)) * 2000000 div (CAST(l AS DECIMAL(20,0)) + r)"))
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    spans = candidates.select("lang", "words", "w", "a", F.explode(F.sequence(F.lit(2), F.col("words"))).alias("size")).filter("size < words")
    inner = spans.select("lang", "w", "a", "size", F.explode(F.expr("sequence(1, words - size + 1)")).alias("start"))
    held = inner.select("lang", joined(F.col("start"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("outer_a"))
    free = worst.join(held, ["lang", "phrase"], "left").filter("outer_a IS NULL OR 100 * CAST(outer_a AS DECIMAL(20,0)) < 80 * CAST(a AS DECIMAL(20,0))")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = free.withColumn("rank", F.row_number().over(order).cast("bigint"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

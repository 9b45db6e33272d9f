"""The registered queries of this subpackage, with production parameters, and their oracle texts."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def public_tokenizer(name: str) -> str:
    """Path of an installed tokenizer file; every worker has the same installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op8_forced_boundary_bpe")
def op8(spark, folder):
    """Encode and decode every whole text."""
    from modalframe.llm.forced_bpe import token_digests

    return token_digests(table(spark, folder, "documents"), public_tokenizer("word_bpe_49k.json"))


@query("op10_best_fit_packing")
def op10(spark, folder):
    """Pack every document into sequences of at most 1024 ids."""
    from modalframe.llm.bestfit import pack_documents

    return pack_documents(table(spark, folder, "documents"), public_tokenizer("byte_bpe_50k.json"), end_id=2, capacity=1024)


@query("op3_circulant_minhash")
def op3(spark, folder):
    """Near-duplicate documents by three-word shingles at 85 percent."""
    from modalframe.llm.circulant import near_duplicates

    return near_duplicates(table(spark, folder, "documents"), size=3, percent=85)


@query("op2_distribution_divergence")
def op2(spark, folder):
    """Quality verdict of every whole text."""
    from modalframe.llm.divergence import quality_rules

    return quality_rules(table(spark, folder, "documents"))


@query("op5_ftrl_toxicity")
def op5(spark, folder):
    """Toxicity score of every whole text."""
    from modalframe.llm.ftrl import toxicity

    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), threshold=0.3)


@query("op6_candidate_boosting")
def op6(spark, folder):
    """Personal data in every whole text."""
    from modalframe.llm.pii import personal_data

    return personal_data(table(spark, folder, "documents"))


@query("op4_zip_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
     d AS (SELECT page_id, octet_length(raw) AS n, sha1(raw) AS h FROM p),
     f AS (SELECT h, n, min(page_id) AS first FROM d GROUP BY h, n),
     bits AS (SELECT DISTINCT h, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1) FOR i IN range(32)], '') AS b32 FROM d)
SELECT d.page_id AS page_id, CAST(d.n AS BIGINT) AS payload_bytes, bits.b32 AS payload_digest,
       CASE WHEN f.first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
FROM d JOIN f USING (h, n) JOIN bits ON bits.h = d.h
""")
def op4(spark, folder):
    """Write every page to ZIP-packaged WARC and read it back."""
    from modalframe.llm.zipwarc import archive_pages

    return archive_pages(table(spark, folder, "pages"), least_bytes=0)


@query("op7_log_frequency_bloom")
def op7(spark, folder):
    """Language-model score of every whole text."""
    from modalframe.llm.bloomlm import language_model

    return language_model(table(spark, folder, "documents"))


@query("op1_subspace_pigeonhole")
def op1(spark, folder):
    """Near-duplicate vectors at a cosine of 0.95."""
    from modalframe.llm.subspace import near_vectors

    return near_vectors(table(spark, folder, "embeddings"), least_cosine=0.95)


@query("op9_snapshot_collapse", """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
     p AS (SELECT *, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS h,
                  max(pos) OVER (PARTITION BY conv_id) AS n FROM t),
     w AS (SELECT n, h, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE pos = n GROUP BY n, h),
     m AS (SELECT w.* FROM w ANTI JOIN (SELECT DISTINCT pos, h FROM p WHERE pos < n) q ON w.n = q.pos AND w.h = q.h)
SELECT m.conv_id, CAST(m.n AS BIGINT) AS n_turns, CAST(m.n_copies AS BIGINT) AS n_copies,
       (SELECT string_agg('<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10), '' ORDER BY t.pos) FROM t WHERE t.conv_id = m.conv_id) AS chat
FROM m
""")
def op9(spark, folder):
    """Retain maximal conversations and render them."""
    from modalframe.llm.snapshots import collapse_snapshots

    return collapse_snapshots(table(spark, folder, "conversations"))


def planted_period(doc_id, ws: list[str]) -> list[str]:
    """The words of `op11`: in one document of ten, those from place a on repeat the p original words from there."""
    import zlib

    h, n = zlib.crc32(str(doc_id).encode()), len(ws)
    if doc_id is None or h % 10 or not n:
        return ws
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return ws[:a] + [ws[a + k % p] for k in range(n - a)]


@query("op11_suffix_tree_runs")
def op11(spark, folder):
    """Periodic runs of every whole text."""
    from modalframe.llm.runs import periodic_runs, run_digests

    return run_digests(periodic_runs(table(spark, folder, "documents"), least_length=24, least_exponent=3, prepare=planted_period))


@query("op12_salted_exact_dedup", r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
     g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
""")
def op12(spark, folder):
    """Exact duplicates of every whole text."""
    from modalframe.llm.exactdup import exact_duplicates

    return exact_duplicates(table(spark, folder, "documents"))


@query("op13_fingerprint_phrases", r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
     p AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS w FROM d),
     o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p WHERE len(w) > 0),
     c AS (SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM o, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
     f AS (SELECT lang, words, phrase, count(*)::HUGEINT AS f FROM c GROUP BY ALL HAVING count(*) >= 30),
     n AS (SELECT lang, count(*) AS n FROM o GROUP BY lang),
     a AS (SELECT lang, words, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE words > 1),
     k AS (SELECT *, unnest(range(1, words)) AS k FROM a),
     s AS (SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, (2000000 * k.a) // (l.f + r.f) AS score FROM k
           JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1:], ' ')),
     b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
     i AS (SELECT x.lang, array_to_string(x.w[st:st + sz - 1], ' ') AS phrase, max(x.a) AS outer_a FROM a x, (SELECT unnest([2, 3]) AS sz), (SELECT unnest([1, 2, 3]) AS st)
           WHERE sz < x.words AND st + sz - 1 <= x.words GROUP BY 1, 2),
     r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, encode(b.phrase)) AS rank FROM b
           LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.outer_a IS NULL OR 100 * i.outer_a < 80 * b.a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM r JOIN n USING (lang) WHERE rank <= 2000
""")
def op13(spark, folder):
    """Phrase collocations of every whole text."""
    from modalframe.llm.phrases import collocations

    return collocations(table(spark, folder, "documents"), least=30, top=2000)

"""Forced-boundary BPE and packing against the tokenizers library and against brute force."""
import hashlib
import random
import zlib

import pytest

from modalframe.llm.bestfit import FragmentEncoder, best_fit_decreasing, cut, pack_documents
from modalframe.llm.forced_bpe import ForcedBpe, encode_documents, token_digests
from modalframe.llm.queries import public_tokenizer

ODD = ["", None, " ", "a", "The quick\tbrown  fox\n\n jumps. ", "it's we'll 123 4567 x²½", "Ünïcode é ́b ſ İ ß", "a\x1cb\x85c\xa0d e　", "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>",
       "foo  <|endoftext|>  bar", "日本語テキスト 🙂🙃 ​ z\u0000q", "x" * 30_000, "a \n b \t\n\tc \n", "  lead and trail  ", "\n", "zqxjkvb qqqq--!!§§" * 50, "word " * 20_000]


def _tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizer(name))
    t.no_truncation()
    t.no_padding()
    return t


def _ids(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_forced_boundaries_agree_with_the_library():
    ours, theirs = ForcedBpe(public_tokenizer("word_bpe_49k.json")), _tokenizer("word_bpe_49k.json")
    rng = random.Random(1)
    noise = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 900), rng.randrange(8190, 8300), 10, 9])) for _ in range(rng.randrange(60))) for _ in range(1500)]
    for text in ODD + noise:
        want = theirs.encode(text or "", add_special_tokens=False).ids
        assert ours.encode(text) == (_ids(want), theirs.decode(want, skip_special_tokens=False)), repr(text)[:80]


def test_fragments_agree_with_the_library():
    ours, theirs = FragmentEncoder(public_tokenizer("byte_bpe_50k.json")), _tokenizer("byte_bpe_50k.json")
    rng = random.Random(3)
    noise = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 900), rng.randrange(8190, 8300), 10, 9, 32, 32])) for _ in range(rng.randrange(60))) for _ in range(1500)]
    plain = ["".join(rng.choice("ab1. \n\t'éß_-×αs") for _ in range(40)) for _ in range(4000)]
    for text in ODD + noise + plain:
        assert ours.encode_all([text]) == [_ids(theirs.encode(text or "", add_special_tokens=False).ids)], repr(text)[:80]


def test_plain_words_need_no_whole_tokenizer():
    ours, theirs = FragmentEncoder(public_tokenizer("byte_bpe_50k.json")), _tokenizer("byte_bpe_50k.json")
    whole, asked = ours.whole, []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return whole.encode_batch_fast(texts, **options)

    ours.whole = Counting()
    texts = ["Xqzv überñandt, plain words\n", "it's 42 xqzv abc123", None, "\u01c5 \u00d7\u00f7 \u0250ab", "", " überñandt"]
    want = [_ids(theirs.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert ours.bare and ours.encode_all(texts) == want
    assert asked and not {"Xqzv", " überñandt", " plain", " words", " xqzv"} & set(asked)
    assert {" it's", "it's"} & set(asked)


def test_words_are_cut_where_no_token_joins():
    e = ForcedBpe(public_tokenizer("word_bpe_49k.json"))
    assert len(e.fragments("the")) == 1
    assert len(e.fragments("zqxjkvbqqqq")) > 1


def test_encode_documents_rows(spark):
    texts = [(i, t, "x") for i, t in enumerate(ODD)] + [(0, "", "y"), (None, "the", "z")]
    df = spark.createDataFrame(texts, "doc_id long, text string, n_tokens string")
    theirs = _tokenizer("word_bpe_49k.json")
    got = token_digests(df, public_tokenizer("word_bpe_49k.json")).collect()
    want = []
    for i, t, _ in texts:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(_ids(ids)).hexdigest(), hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert encode_documents(df.limit(0), public_tokenizer("word_bpe_49k.json")).collect() == []


def test_cut_and_best_fit():
    assert cut(1024, 1024) == [(0, 1024)] and cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)] and cut(2048, 1024) == [(0, 1024), (1024, 1024)]
    rng = random.Random(2)
    for cap in (7, 64, 1024):
        lengths = sorted((rng.randrange(1, cap + 1) for _ in range(400)), reverse=True)
        bins, offsets = best_fit_decreasing(lengths, cap)
        room, want = {}, []
        for n in lengths:  # brute force: least room that fits
            fit = [(r, b) for b, r in room.items() if r >= n]
            r = min(fit)[0] if fit else cap
            want.append(cap - r)
            b = next((b for b in room if room[b] == r), len(room)) if fit else len(room)
            room[b] = r - n
        assert offsets == want and max(bins) + 1 == len(room)
    with pytest.raises(ValueError):
        best_fit_decreasing([5], 4)


def test_pack_documents(spark):
    texts = [(i, t, "x") for i, t in enumerate(ODD)] + [(0, "", "y"), (None, "the", "z")] + [(100 + i, "some words here " * (i % 90), "q") for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string, length string")
    rows = pack_documents(df, public_tokenizer("byte_bpe_50k.json")).collect()
    theirs, by = _tokenizer("byte_bpe_50k.json"), {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t, _ in texts:
        ids = _ids(theirs.encode(t or "", add_special_tokens=False).ids + [2])
        for p in by[i]:
            assert p.ids_crc32 == zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)])
        assert sum(p.length for p in by[i]) == len(ids) // 4 * (2 if i == 0 else 1)
        assert len(by[i]) == (2 if i == 0 else max(1, -(-len(ids) // 4096)))
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert len(seqs) <= 1.02 * sum(r.length for r in rows) / 1024 + 1
    assert pack_documents(df.limit(0), public_tokenizer("byte_bpe_50k.json")).collect() == []


def test_equal_pieces_are_dealt_into_all_groups(spark, tmp_path):
    from pyspark.sql import functions as F

    from modalframe.llm.bestfit import pack_pieces

    spark.range(20_000).select(F.lit(1).alias("doc_id"), F.lit(300).cast("bigint").alias("length")).write.parquet(str(tmp_path / "pieces"))
    packed = pack_pieces(spark.read.parquet(str(tmp_path / "pieces")), 1024)
    sizes = [r["count"] for r in packed.groupBy(F.shiftright("sequence_id", 36)).count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) == 5 and max(sizes) < 5000

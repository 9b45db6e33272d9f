"""The pipeline on the smallest tables: each stage against a plain version on its own input."""
import zlib

import corpus_pipeline as cp
from modalframe.llm import divergence, ftrl
from modalframe.llm.queries import public_tokenizer


def _kept_by_brute_force(rows, size, percent):
    from modalframe.llm.text import lower_ascii, words

    sets = {}
    for r in rows:
        ws = words(lower_ascii(r.text or ""))
        sets[r.doc_id] = {tuple(ws[k : k + size]) for k in range(len(ws) - size + 1)} if len(ws) >= size else ({tuple(ws)} if ws else set())
    comp = {i: i for i in sets}
    for a in sorted(sets):
        for b in sets:
            if a < b and sets[a] and sets[b] and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                lo, hi = sorted((comp[a], comp[b]))
                comp = {k: lo if v == hi else v for k, v in comp.items()}
    return {i for i in comp if comp[i] == i}


def test_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    names, inputs = docs.columns, {}
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality rules", "MinHash near-dedup", "PII", "best-fit packing"]
    for name, stage in cp.STAGES:
        inputs[name] = docs
        out = stage(spark, docs, folder)
        assert name == "best-fit packing" or out.columns == names
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        inputs[name + " out"] = docs
    ids = lambda k: {r.doc_id for r in inputs[k].select("doc_id").collect()}

    scores = {r.doc_id: r.predicted for r in ftrl.toxicity(inputs["toxicity"], labels).collect()}
    assert ids("toxicity out") == {i for i, p in scores.items() if p == 0}
    verdict = {r.doc_id: r.kept for r in divergence.quality_rules(inputs["quality rules"]).collect()}
    assert ids("quality rules out") == {i for i, k in verdict.items() if k}
    assert ids("MinHash near-dedup out") == _kept_by_brute_force(inputs["MinHash near-dedup"].collect(), 5, 80)
    assert ids("PII out") == ids("PII")
    texts = {r.doc_id: r for r in inputs["PII out"].collect()}
    assert all(r.n_chars == len(r.text) for r in texts.values()) and not any("@example" in r.text for r in texts.values())

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizer("byte_bpe_50k.json"))
    rows = inputs["best-fit packing out"].collect()
    for i, r in texts.items():
        want = t.encode(r.text, add_special_tokens=False).ids + [2]
        mine = sorted((p for p in rows if p.doc_id == i), key=lambda p: p.piece)
        assert sum(p.length for p in mine) == len(want)
        for p in mine:
            assert p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in want[p.start : p.start + p.length]))
    assert {p.doc_id for p in rows} == set(texts)


def test_run_and_empty_input(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_leave_one_document(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long, "en", "s", 1)] * 4 + [(2, long + " more", "en", "s", 1), (3, "another text of seven words in all", "en", "s", 1), (None, long, "en", "s", 1), (None, long, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id is not None, r.doc_id) for r in got.collect()) == [(False, None), (True, 1), (True, 3)]

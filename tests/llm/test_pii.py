"""Personal data: base spans against a plain version, added spans, redaction, and no Python in the plan."""
import hashlib
import random
import re

from modalframe.llm import pii

RULES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _ok(kind, v):
    d = [int(c) for c in v if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum((x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def _base(text):
    out = [(m.start(), k, m.end()) for k, (kind, rx) in enumerate(RULES) for m in re.finditer(rx, text or "") if _ok(kind, m.group())]
    return ",".join(f"{RULES[k][0]}:{s}:{e}" for s, k, e in sorted(out))


def _card(rng):
    d = [4] + [rng.randrange(10) for _ in range(14)]
    total = sum((2 * x - 9 if x > 4 else 2 * x) if i % 2 == 0 else x for i, x in enumerate(reversed(d)))
    return "".join(map(str, d)) + str(-total % 10)


def _texts(rng):
    bits = ["a.b+c@mail1.example.com", "x@y", "a@b.c_x@d.e", "@@a@b..c", "10.0.0.1", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.002.003.0255", "12.34", "+1 (843) 555-7672", "+49 30-1234567",
            "+1", "(843) 555-7672", "4111 1111 1111 1111", "1234-5678-9012-3456", "0000000000000", "é", "🙂", "\n", "word", "token", "n°5", "7.", "call", "-", "+", "9", "55"]
    out = [" ".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(250)] + ["".join(rng.choice("01 -+.@a()é🙂") for _ in range(50)) for _ in range(250)]
    out += [f"the stone {_card(rng)} of" for _ in range(20)] + [f"in it {rng.randrange(10**15, 10**16)} and" for _ in range(60)]
    out += [f"word +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} word" for _ in range(30)] + ["(843) 555-7672 on", "843-555-7672 on"] * 8
    return out + ["", None, "a" * 60_000, "1" * 60_000, "1 " * 30_000, "a@b.c " * 3000, "1.1.1.1 " * 2000, "+1 (843) 555-7672 170.106.47.218 Et"]


def test_against_plain_rules(spark):
    texts = _texts(random.Random(3))
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "10.0.0.1", "x"), (0, texts[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string")
    out = pii.personal_data(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    got = out.collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, _ in rows:
        if i is None or i == 0:
            continue
        want, r = _base(t), by[i]
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t or "")[:80]
        assert {k: r[f"n_{k}"] for k, _ in RULES} == {k: len(re.findall(rf"\b{k}:", want)) for k, _ in RULES}
        spans = [x for x in r.spans.split(",") if x]
        assert set(filter(None, want.split(","))) <= set(spans) and len(spans) == len(filter_ := set(spans)) and r.n_added == len(filter_) - len([x for x in want.split(",") if x])
    assert "phone:0:17" in by[len(texts) - 1].spans  # the base pattern runs on into the address and fails
    assert by[None].n_ip == 1


def test_redaction(spark):
    rows = [(1, "mail a@b.co now", 15, 7), (2, None, None, 7), (3, "clean text", 10, 7), (4, "🙂 10.0.0.1 é +49 30-1234567", 28, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans long")
    out = pii.redact(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, "mail [EMAIL] now", 16, 7), (2, None, None, 7), (3, "clean text", 10, 7), (4, "🙂 [IP] é [PHONE]", 16, 7)]
    assert pii.redact(df.limit(0)).collect() == [] and pii.personal_data(df.limit(0)).collect() == []


def test_forms_without_a_base_rule_are_found_at_any_share(spark):
    def texts(n_other):
        rng = random.Random(n_other)
        n = lambda a, b: rng.randrange(a, b)
        out = [f"word user{n(0, 99)}@mail.example.com word {n(1, 200)}.{n(1, 200)}.7.{n(300, 999) if k % 3 == 0 else n(1, 200)} word" for k in range(1000)]
        out += [f"word +{n(10, 99)} {n(100, 999)} {n(100, 999)} {n(1000, 9999)} word +1 {n(10, 99)} {n(10, 99)} word" for _ in range(1000)]
        out += [f"in it {n(10**15, 10**16)} and {_card(rng)} or" for _ in range(300)]
        phone = lambda k: f"({n(200, 999)}) 555-{n(1000, 9999)}" if k % 2 else f"{n(200, 999)}-555-{n(1000, 9999)}"
        email = lambda k: f"name{k} [at] host [dot] com" if k % 2 else f"name{k}(at)mail(dot)host(dot)org"
        return out, [(phone(k), email(k)) for k in range(n_other)]

    for n_other in (10, 1000):
        out, other = texts(n_other)
        rows = [(i, x) for i, x in enumerate(out)] + [(10_000 + k, f"on {p} word {e} word") for k, (p, e) in enumerate(other)]
        got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        for k, (p, e) in enumerate(other):
            assert got[10_000 + k] == f"phone:3:{3 + len(p)},email:{9 + len(p)}:{9 + len(p) + len(e)}", (n_other, p, e, got[10_000 + k])
        assert not [x for i, x in enumerate(out) if 1000 <= i < 2000 and got[i].count("phone") != 1]  # too few digits


def test_a_kind_without_rivals_is_learned(spark):
    rows = [(i, f"word a{i}@b.org word") for i in range(50)] + [(100, "word name [at] host [dot] com word")]
    assert {r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id = 100").collect()} == {"email:5:29"}

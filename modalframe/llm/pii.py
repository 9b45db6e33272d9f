"""Personal data by candidate gradient boosting, in column expressions only.

Base rules find spans that always stay. High-recall generators propose further, overlapping spans; boosted trees over format
and context features score them, and a calibrated threshold per kind selects the ones to add.
"""
from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modalframe.session import scratch_path

KINDS = ["email", "ip", "card", "phone"]

# Each pattern finds what the base rule's pattern finds: possessive repeats keep long runs from recursion, and a match may
# begin inside a run of its first characters only where the previous match has ended.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": [rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}(?:@|\x20?[(\[]at[)\]]\x20?){_HOST}{{1,63}}(?:(?:\.|\x20?[(\[]dot[)\]]\x20?){_HOST}{{1,63}}){{1,8}}"],
    "ip": [r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"],
    "card": [r"(?<![0-9])[0-9]{12,19}(?![0-9])", r"(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){2}[\x20-][0-9]{1,7}(?![0-9])"],
    "phone": [*[rf"\+[0-9]{{1,3}}[\x20.-]?(?:\([0-9]{{1,4}}\)[\x20.-]?)?[0-9]{{2,4}}(?:[\x20.-][0-9]{{2,4}}){{{n}}}(?![0-9])" for n in (1, 2, 3)],
              r"(?<![0-9+(])\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"(?<![0-9])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"],
}
_HINT = {"email": "(?i)@|[(\\[]at[)\\]]", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "[0-9]"}
_CUE = {"email": "(?i)mail|contact", "ip": "(?i)\\bip\\b|host|server|address", "card": "(?i)card|visa|payment|iban", "phone": "(?i)phone|call|tel|fax|mobile"}

#: Boosting: rounds of depth-two trees per kind, shrinkage, ridge.
ROUNDS, RATE, RIDGE = 10, 0.5, 1.0
#: A threshold is the least score from which on at least this share of labelled candidates of its kind is personal data.
PRECISION = 0.97
FEATURES = ["kind", "digits", "breaks", "luhn", "large", "left", "right", "cue"]
_LARGEST = {"kind": 3, "digits": 20, "breaks": 6}
_SPAN = "array<struct<s:int,e:int,v:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def running_sums(xs: Column, block: int = 128) -> Column:
    """Inclusive running sums of an array of numbers; linear in its length but for a factor of the block size."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("int"), lambda s, x: s + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda k: F.slice(xs, k * block + 1, block))

    def inside(b: Column, before: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(b)), lambda i: before + total(F.slice(b, F.lit(1), i)))

    def join(bs: Column) -> Column:
        sums = F.transform(bs, total)
        starts = F.transform(F.sequence(F.lit(0), F.size(bs) - 1), lambda k: total(F.slice(sums, F.lit(1), k)))
        return F.flatten(F.zip_with(bs, starts, inside))

    return let(blocks, join)


def find(text: Column, pattern: str, hint: str) -> Column:
    """All matches of a pattern, leftmost first and without overlap, as (s, e, v) with code point positions."""
    def place(hits: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
        ahead = F.concat(F.array(F.lit(0)), F.transform(hits, lambda h: F.length(h)))
        steps = let(F.zip_with(gaps, ahead, lambda g, h: (g + h).cast("int")), lambda x: running_sums(x))
        return F.zip_with(F.slice(steps, F.lit(1), F.size(hits)), hits, lambda s, h: F.struct(s.alias("s"), (s + F.length(h)).cast("int").alias("e"), h.alias("v")))

    none = F.array().cast(_SPAN)
    hits = F.when(text.rlike(hint), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return let(hits, lambda h: F.when(F.size(h) == 0, none).otherwise(place(h)))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def term(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (i % 2 + 1)
        return F.when(d > 9, d - 9).otherwise(d)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.when(F.length(digits) > 0, F.aggregate(places, F.lit(0), lambda s, i: s + term(i)) % 10 == 0).otherwise(F.lit(False))


def _parts_fit(v: Column) -> Column:
    """No part of an address above 255, however many leading zeros it has."""
    return F.forall(F.split(v, r"\."), lambda p: p.rlike("^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def valid(kind: str, v: Column) -> Column:
    """The base rule's check of a match."""
    if kind == "email":
        return v.rlike(rf"^{_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++$")
    if kind == "ip":
        return v.rlike(r"^[0-9.]++$") & _parts_fit(v)
    if kind == "card":
        return let(_digits(v), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))
    return v.startswith("+") & F.length(_digits(v)).between(9, 15)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(find(text, BASE[kind], _HINT[kind]), lambda m: valid(kind, m["v"]))


def _flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def usual(kind: str, v: Column) -> Column:
    """A proposal in the form that the base rule knows: `@` and dots for words in brackets, a country code before ten digits."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(v, r"\x20?[(\[]at[)\]]\x20?", "@"), r"\x20?[(\[]dot[)\]]\x20?", ".")
    return F.when(v.startswith("+"), v).otherwise(F.concat(F.lit("+1 "), v)) if kind == "phone" else v


def candidates(text: Column, kind: str) -> Column:
    """Proposed spans of a kind with their features and the base rule's check; ``known`` if the base rule knows the form.

    Features describe the `usual` form, so a form that the base rule cannot express is told apart by nothing but its context.
    A phone number's digits count as 12 where the base rule takes their number.
    """
    def describe(m: Column) -> Column:
        v, s, e = m["v"], m["s"], m["e"]
        before, after = F.substring(text, F.greatest(s - 23, F.lit(1)), F.least(s, F.lit(24))), F.substring(text, e + 1, F.lit(1))
        plain = usual(kind, v)
        digits = _digits(plain)
        n = F.least(F.length(digits), F.lit(20))
        n = F.when(n.between(9, 15), 12).otherwise(n) if kind == "phone" else n
        values = [F.lit(KINDS.index(kind)), n, F.least(F.length(F.regexp_replace(plain, "[^\\x20().-]", "")), F.lit(6)),
                  _flag(_luhn(digits)), _flag(plain.rlike("0*(?:[3-9][0-9]{2}|2[6-9][0-9]|25[6-9]|[1-9][0-9]{3,})")),
                  _flag(before.rlike("[\\p{L}0-9_.+-]$")), _flag(after.rlike("[\\p{L}0-9_]")), _flag(before.rlike(_CUE[kind]))]
        return F.struct(F.lit(KINDS.index(kind)).alias("k"), s.alias("s"), e.alias("e"), valid(kind, v).alias("valid"), (plain == v).alias("known"), *[x.cast("int").alias(n) for n, x in zip(FEATURES, values, strict=True)])

    found = [find(text, p, _HINT[kind]) for p in GENERATORS[kind]]
    return F.transform(F.array_distinct(F.concat(*found)) if len(found) > 1 else found[0], describe)


@dataclass(frozen=True)
class Split:
    """``feature < bound`` goes left; a leaf when there is no feature."""
    feature: str | None
    bound: int = 0
    left: "Split | None" = None
    right: "Split | None" = None
    value: float = 0.0

    def column(self, of: Callable[[str], Column]) -> Column:
        if self.feature is None:
            return F.lit(self.value)
        return F.when(of(self.feature) < self.bound, self.left.column(of)).otherwise(self.right.column(of))


@dataclass(frozen=True)
class Boosted:
    """Trees, and per kind the margin from which a candidate is selected (none: never)."""
    trees: tuple[Split, ...]
    thresholds: tuple[float | None, ...]

    def margin(self, of: Callable[[str], Column]) -> Column:
        out = F.lit(0.0)
        for t in self.trees:
            out = out + t.column(of)
        return out

    def selects(self, c: Column) -> Column:
        def chosen(m: Column) -> Column:
            hit = F.lit(False)
            for k, t in enumerate(self.thresholds):
                if t is not None:
                    hit = hit | ((c["k"] == k) & (m >= t - 1e-9))
            return hit

        return let(self.margin(lambda f: c[f]), chosen)


def _best_split(sums: list) -> tuple[str, int] | None:
    """Best (feature, bound) from rows (feature, value, g, h); None if no split gains."""
    best, out = 1e-9, None
    for f in FEATURES:
        rows = sorted((r.value, r.g, r.h) for r in sums if r.feature == f)
        g_all, h_all = sum(r[1] for r in rows), sum(r[2] for r in rows)
        g = h = 0.0
        for (_, gi, hi), (nxt, _, _) in zip(rows, rows[1:]):
            g, h = g + gi, h + hi
            gain = g * g / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all * g_all / (h_all + RIDGE)
            if gain > best:
                best, out = gain, (f, nxt)
    return out


def _leaf(sums: list) -> Split:
    rows = [r for r in sums if r.feature == FEATURES[0]]
    return Split(None, value=-RATE * sum(r.g for r in rows) / (sum(r.h for r in rows) + RIDGE))


def boost(table: DataFrame) -> Boosted:
    """Boosted trees on counts per feature vector: columns `FEATURES`, n, ones.

    Every round sums gradients per feature value with one grouped query a level; the sums are bounded by the number of
    feature values, whatever the corpus. Each kind weighs the same, however often it occurs, and has its own splits, so that
    a kind without zeros is not judged by those of another. Where there are only ones, a tree is one leaf.
    """
    trees: list[Split] = []
    weight = F.lit(1000.0) / F.sum("n").over(Window.partitionBy("kind"))
    counts, table = table, table.withColumn("w", weight).withColumns({"n": F.col("n") * F.col("w"), "ones": F.col("ones") * F.col("w")})
    for _ in range(ROUNDS):
        so_far = Boosted(tuple(trees), ())
        p = 1 / (1 + F.exp(-so_far.margin(F.col)))
        d = table.withColumn("g", F.col("n") * p - F.col("ones")).withColumn("h", F.col("n") * p * (1 - p)).withColumn("side", F.lit(""))

        def sums(frame: DataFrame) -> dict[tuple[int, str], list]:
            pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])).alias("x")
            out: dict[tuple[int, str], list] = {}
            for r in frame.select("kind", "side", "g", "h", pairs).groupBy("kind", "side", "x.feature", "x.value").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                out.setdefault((r.kind, r.side), []).append(r)
            return out

        nodes, cuts = sums(d), {}
        for depth in range(2):
            new = {at: cut for at, rows in nodes.items() if len(at[1]) == depth and (cut := _best_split(rows))}
            if not new:
                break
            side = F.col("side")
            for (k, path), (f, bound) in new.items():
                side = F.when((F.col("kind") == k) & (F.col("side") == path), F.when(F.col(f) < bound, path + "l").otherwise(path + "r")).otherwise(side)
            d, cuts = d.withColumn("side", side), cuts | new
            nodes |= sums(d)
        kinds = sorted(k for k, path in nodes if path == "")
        if not kinds or not cuts and trees:
            break

        def grow(k: int, path: str = "") -> Split:
            return Split(*cuts[k, path], grow(k, path + "l"), grow(k, path + "r")) if (k, path) in cuts else _leaf(nodes[k, path])

        tree = grow(kinds[-1])
        for k in reversed(kinds[:-1]):
            tree = Split("kind", k + 1, grow(k), tree)
        trees.append(tree)
    model = Boosted(tuple(trees), ())
    scored = counts.withColumn("m", F.round(model.margin(F.col), 9)).groupBy("kind", "m").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).collect()
    thresholds: list[float | None] = []
    for k in range(len(KINDS)):
        n = ones = 0
        chosen = None
        for r in sorted((r for r in scored if r.kind == k), key=lambda r: -r.m):
            n, ones = n + r.n, ones + r.ones
            if ones >= PRECISION * n and r.m > 0:
                chosen = r.m
        thresholds.append(chosen if chosen is not None and math.isfinite(chosen) else None)
    return Boosted(tuple(trees), tuple(thresholds))


def _overlap(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def spans_found(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """``keep``, ``text``, ``base`` and ``cand`` (proposals that overlap no base span but equal none, or equal one)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(*keep, F.col(text_col).cast("string").alias("text"))
    tag = lambda k, c: F.transform(c, lambda m: F.struct(F.lit(k).alias("k"), m["s"].alias("s"), m["e"].alias("e")))
    base = F.concat(*[tag(k, base_spans(text, kind)) for k, kind in enumerate(KINDS)])
    cand = F.concat(*[candidates(text, kind) for kind in KINDS])
    return d.withColumn("base", base).withColumn("cand", cand)


def training_counts(found: DataFrame) -> DataFrame:
    """Counts per feature vector over all documents: ones are proposals that are base spans; zeros fail the base check in a
    form that it knows and touch no base span; other proposals are left out, as the base check says nothing about their form."""
    c = found.filter(F.size("cand") > 0).select("base", F.explode("cand").alias("c"))
    same = F.exists("base", lambda b: (b["k"] == F.col("c.k")) & (b["s"] == F.col("c.s")) & (b["e"] == F.col("c.e")))
    touched = F.exists("base", lambda b: _overlap(b, F.col("c")))
    c = c.withColumn("one", same).filter(F.col("one") | (F.col("c.known") & ~F.col("c.valid") & ~touched))
    return c.groupBy(*[F.col(f"c.{f}").alias(f) for f in FEATURES]).agg(F.count(F.lit(1)).alias("n"), F.sum(_flag(F.col("one"))).alias("ones"))


def all_spans(found: DataFrame, model: Boosted) -> DataFrame:
    """Adds ``spans``: base spans and selected proposals (the earliest, then longest, of those that overlap), in order."""
    picked = F.filter("cand", lambda c: model.selects(c) & ~F.exists("base", lambda b: _overlap(b, c)))
    ordered = F.array_sort(F.transform(picked, lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("x"), c["k"].alias("k"))))

    def add(got: Column, c: Column) -> Column:
        free = (F.size(got) == 0) | (F.element_at(got, -1)["e"] <= c["s"])
        return F.when(F.size(got) == 0, F.array(F.struct(c["k"].alias("k"), c["s"].alias("s"), (-c["x"]).alias("e")))).when(
            free, F.concat(got, F.array(F.struct(c["k"].alias("k"), c["s"].alias("s"), (-c["x"]).alias("e"))))).otherwise(got)

    empty = F.array().cast("array<struct<k:int,s:int,e:int>>")
    added = let(ordered, lambda o: F.when(F.size(o) == 0, empty).otherwise(F.aggregate(o, empty, add)))
    return found.withColumn("spans", in_order(F.concat("base", added)))


def in_order(spans: Column) -> Column:
    sorted_ = F.array_sort(F.transform(spans, lambda m: F.struct(m["s"].alias("s"), m["k"].alias("k"), m["e"].alias("e"))))
    return F.when(F.size(spans) == 0, F.array().cast("array<struct<s:int,k:int,e:int>>")).otherwise(sorted_)


def spelled(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.element_at(names, m["k"] + 1), m["s"].cast("string"), m["e"].cast("string"))), ",")


def learn(found: DataFrame) -> Boosted:
    """Fit on the counts of all documents; the counts are stored once in the shared scratch folder."""
    at = scratch_path(found.sparkSession, "pii-counts")
    training_counts(found).coalesce(1).write.parquet(at)
    return boost(found.sparkSession.read.parquet(at))


def _stored(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """Spans found, stored so that texts are searched once; the text itself is not stored again."""
    at = scratch_path(docs.sparkSession, "pii-spans")
    spans_found(docs, keep, text_col).drop("text").write.parquet(at)
    return docs.sparkSession.read.parquet(at)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` of every row of ``docs``.

    Counts and the hash are those of the base spans; ``spans`` spells base spans and added ones as ``kind:start:end``
    (code points, end exclusive) by start, then kind. Null and empty texts have no spans. Rows are independent: repeated
    rows and null ids come back as they are, other columns are not read, an empty table gives an empty one. Without any
    base span that a generator proposes too, nothing is learned of a kind, and nothing is added for it.
    """
    found = _stored(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t")), ["doc"], "t")
    out = all_spans(found, learn(found)).withColumn("b", in_order(F.col("base")))
    count = lambda k: F.size(F.filter("base", lambda m: m["k"] == k)).cast("bigint")
    return out.select(F.col("doc").alias(id_col), *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)], F.sha2(spelled(F.col("b")).cast("binary"), 256).alias("base_sha256"),
                      spelled(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("bigint").alias("n_added"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by the name of its kind in brackets; overlapping spans share the first name."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, m: Column) -> Column:
        fresh = m["s"] >= acc["at"]
        part = F.concat(F.substring(text, acc["at"] + 1, m["s"] - acc["at"]), F.element_at(names, m["k"] + 1))
        return F.struct(F.greatest(acc["at"], m["e"]).alias("at"), F.when(fresh, F.concat(acc["parts"], F.array(part))).otherwise(acc["parts"]).alias("parts"))

    whole = let(F.aggregate(spans, state, step), lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced, all columns kept; ``length_col``, if there, counts the new text.

    A null text stays null. Rows are independent, whatever their ids.
    """
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)])
    t = f"k{names.index(text_col)}"
    at = scratch_path(docs.sparkSession, "pii-found")
    spans_found(plain, plain.columns, t).drop("text").write.parquet(at)
    found = docs.sparkSession.read.parquet(at)
    out = all_spans(found, learn(found)).withColumn("new", redacted(F.col(t), F.col("spans")))
    pick = lambda i, c: F.col("new") if c == text_col else F.when(F.size("spans") > 0, F.length("new").cast(docs.schema[c].dataType)).otherwise(F.col(f"k{i}")) if c == length_col else F.col(f"k{i}")
    return out.select(*[pick(i, c).alias(c) for i, c in enumerate(names)])

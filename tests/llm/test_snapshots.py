"""Snapshot collapse against a plain version."""
import random

from modalframe.llm.snapshots import collapse_snapshots


def _plain(rows):
    convs = {}
    for c, turn, role, text, _ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {c: tuple((r, x) for *_, r, x in sorted(t)) for c, t in convs.items()}
    prefixes = {s[:k] for s in seqs.values() for k in range(1, len(s))}
    out = []
    for s in set(seqs.values()) - prefixes:
        same = [c for c, v in seqs.items() if v == s]
        out.append((min(same), len(s), len(same), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in s)))
    return sorted(out)


def test_against_plain_version(spark):
    rng = random.Random(6)
    rows, conv = [], 0
    for _ in range(30):
        turns = [(("user", "assistant")[k % 2], rng.choice(["hi", "yes", "no", "🙂 é"])) for k in range(rng.randrange(1, 9))]
        for n in sorted({rng.randrange(1, len(turns) + 1) for _ in range(4)}):
            rows += [(conv, k, r, x, "q") for k, (r, x) in enumerate(turns[:n])]
            conv += 1
    rows += [(conv, 0, None, None, "q"), (conv + 1, None, "user", "hi", "q"), (conv + 1, 0, "user", "", "q"), (None, 0, "user", "hi", "q"), (conv + 2, 1, "user", "hi", "q"), (conv + 2, 1, "user", "hi", "q"),
             (conv + 3, 0, "us", "erx", "q"), (conv + 4, 0, "user", "x", "q")] + [(conv + 5, k, "user", "t", "q") for k in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string")
    assert sorted(map(tuple, collapse_snapshots(df).collect())) == _plain(rows)
    assert collapse_snapshots(df.limit(0)).collect() == []

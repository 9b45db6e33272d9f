"""Periodic runs of words: suffix trees answer longest common extensions, Lyndon roots propose the runs.

A run is a stretch of words with smallest period q that no neighbouring word extends. Every run contains, as one period, the
longest Lyndon word that starts at some place, under the order of the words or under its reverse. So each place proposes two
periods; extending both ways, with one suffix tree of the words and one of their reversal, finds the run or refutes it.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalframe.llm.text import map_texts, words

_END = -1  # the word after the last one, smaller than all others
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_FAR = np.iinfo(np.int64).max

RUN = "struct<start:bigint,length:bigint,period:bigint>"


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of non-negative integers, with constant-time longest common extensions.

    The Euler tour is kept as one number for each step from a leaf to the next, the depth of the shallowest node between
    them; a sparse table over it gives the depth of the lowest common ancestor of any two leaves.
    """

    def __init__(self, symbols: list[int]):
        self.n = len(symbols)
        s = [*symbols, _END]
        self.start, self.stop, self.child = self._grow(s)
        self.leaf_of = [k for k in range(1, len(self.child)) if self.child[k] is None]  # leaves come in the order of suffixes
        self.suffix_of = {leaf: i for i, leaf in enumerate(self.leaf_of)}
        self._tour(len(s))

    @staticmethod
    def _grow(s: list[int]):
        n = len(s)
        start, stop, link, child = [0], [0], [0], [{}]
        node, edge, length, waiting = 0, 0, 0, 0
        for i, c in enumerate(s):
            waiting += 1
            unlinked = -1
            while waiting:
                if not length:
                    edge = i
                below = child[node].get(s[edge])
                if below is None:
                    child[node][s[edge]] = len(start)
                    start.append(i), stop.append(n), link.append(0), child.append(None)
                    if unlinked >= 0:
                        link[unlinked], unlinked = node, -1
                else:
                    size = min(stop[below], i + 1) - start[below]
                    if length >= size:
                        edge, length, node = edge + size, length - size, below
                        continue
                    at = start[below] + length
                    if s[at] == c:
                        length += 1
                        if unlinked >= 0:
                            link[unlinked] = node
                        break
                    middle = len(start)
                    start.append(start[below]), stop.append(at), link.append(0), child.append({s[at]: below, c: middle + 1})
                    start.append(i), stop.append(n), link.append(0), child.append(None)
                    child[node][s[edge]], start[below] = middle, at
                    if unlinked >= 0:
                        link[unlinked] = middle
                    unlinked = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        return start, stop, child

    def _tour(self, n: int) -> None:
        """Suffixes in order, and the depth of the node at which the tour turns from each to the next."""
        start, stop, child, suffix_of = self.start, self.stop, self.child, self.suffix_of
        order, turns, turn = [], [], 0
        stack = [(0, 0, 0)]  # node, its depth, depth of the node where the tour turned to it
        while stack:
            node, depth, turn_here = stack.pop()
            if child[node] is None:
                order.append(suffix_of[node])
                turns.append(turn_here)
                continue
            below = sorted(child[node].items(), reverse=True)
            first = below[-1][1]
            for _, b in below:
                stack.append((b, depth + stop[b] - start[b], turn_here if b == first else depth))
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        level = np.array(turns[1:], np.int32)  # level[k]: common depth of the leaves k and k + 1
        self.table = [level]
        width = 1
        while len(level) > width:
            level = np.minimum(level[:-width], level[width:])
            self.table.append(level)
            width *= 2

    def reversed_rank(self) -> np.ndarray:
        """Rank of each suffix when the order of the words is turned round (a prefix still comes before what it begins)."""
        child, suffix_of = self.child, self.suffix_of
        order, stack = [], [0]
        while stack:
            node = stack.pop()
            if child[node] is None:
                order.append(suffix_of[node])
                continue
            below = sorted(child[node].items())
            if below[0][0] == _END:
                below = [*below[1:], below[0]]
            stack.extend(b for _, b in below)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return rank

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``i`` and ``j`` (never equal; ``n`` is the empty one)."""
        a, b = self.rank[i], self.rank[j]
        low, wide = np.minimum(a, b), np.abs(a - b)
        out = np.empty(len(low), np.int64)
        steps = np.frexp(wide)[1] - 1
        for k in np.unique(steps):
            m = steps == k
            level = self.table[k]
            out[m] = np.minimum(level[low[m]], level[low[m] + wide[m] - (1 << int(k))])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix but the empty one the next that is smaller: the longest Lyndon word at a place ends before it."""
    ranks, n = rank.tolist(), len(rank) - 1
    out, stack = [n] * n, []
    for i in range(n + 1):
        while stack and ranks[stack[-1]] > ranks[i]:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(symbols: list[int], least_length: int, least_exponent: int) -> set[tuple[int, int, int]]:
    """All runs (start, length, period) with ``length >= max(least_length, least_exponent * period)``."""
    n = len(symbols)
    if n < 2:
        return set()
    ahead, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    i, found = np.arange(n), set()
    for rank in (ahead.rank, ahead.reversed_rank()):
        j = next_smaller(rank)
        period = j - i
        right = ahead.extension(i, j)
        left = np.zeros(n, np.int64)
        left[1:] = back.extension(n - i[1:], n - j[1:])
        length = left + period + right
        hit = length >= np.maximum(least_length, least_exponent * period)
        found.update(zip((i - left)[hit].tolist(), length[hit].tolist(), period[hit].tolist()))
    return found


def repeating_stretches(ids: np.ndarray, least_length: int, least_exponent: int) -> list[tuple[int, int]]:
    """Stretches [a, b) outside of which no run can lie, so that trees are built for these alone.

    A run has at least three periods, so each of its windows of ``least_length // 3`` words comes again within it, one period
    away. Windows are compared by hash; equal hashes of unequal windows only make a stretch longer.
    """
    wide = max(1, least_length // 3)
    n = len(ids) - wide + 1
    if len(ids) < least_length:
        return []
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _FACTOR
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(n, np.uint64)
    for k in range(wide):
        key = key * _FACTOR + mixed[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return []
    gap = (order[1:] - order[:-1])[same]
    near = np.full(n, _FAR)
    near[order[1:][same]] = gap
    before = order[:-1][same]
    near[before] = np.minimum(near[before], gap)
    live = near < _FAR
    for _ in range(4):  # each pass drops windows whose twin is too far off for their stretch; more passes would only drop more
        edge = np.flatnonzero(np.diff(np.concatenate(([0], live.view(np.int8), [0]))))
        a, b = edge[::2], edge[1::2]
        size = b - a + wide - 1
        reach = np.zeros(n, np.int64)
        reach[live] = np.repeat(np.where(size >= least_length, size // least_exponent, 0), b - a)
        now = live & (near <= reach)
        if (now == live).all():
            break
        live = now
    edge = np.flatnonzero(np.diff(np.concatenate(([0], live.view(np.int8), [0]))))
    return [(int(a), int(b) + wide - 1) for a, b in zip(edge[::2], edge[1::2]) if b - a + wide - 1 >= least_length]


def find_runs(ws: list[str], least_length: int, least_exponent: int) -> list[tuple[int, int, int]]:
    """Runs of a sequence of words by start, then period."""
    if len(ws) < least_length:
        return []
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in ws], np.int64)
    found = []
    for a, b in repeating_stretches(ids, least_length, least_exponent):
        found += [(a + s, length, q) for s, length, q in runs_of(ids[a:b].tolist(), least_length, least_exponent)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(ws: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that some run contains after its first period."""
    if not runs:
        return ws
    over = np.zeros(len(ws) + 1, np.int64)
    for s, length, q in runs:
        over[s + q] += 1
        over[s + length] -= 1
    return [w for w, k in zip(ws, np.cumsum(over).tolist()) if not k]


def most_repetitive(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period; of equal ones that with the least start, then period."""
    best = None
    for r in runs:  # by start, then period, so the first of equal ones stays
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def periodic_runs(docs: DataFrame, least_length: int = 24, least_exponent: int = 3, id_col: str = "doc_id", text_col: str = "text",
                  prepare: Callable[[object, list[str]], list[str]] | None = None) -> DataFrame:
    """Runs of words in every whole text: ``id_col, n_runs, best, runs, collapsed``.

    Words are runs of characters other than blank and U+0009 to U+000D, compared as they are. ``runs`` lists every run of at
    least ``least_length`` words and ``least_exponent`` (3 or more) periods as (start, length, period), by start, then period; ``best`` is the
    one of greatest length / period (least start, then period; null without a run); ``collapsed`` joins by single blanks the words
    that no run contains after its first period. ``prepare(id, words)`` may change the words before they are searched.

    A null or empty text has no words, no runs and an empty ``collapsed``. Rows are independent: repeated rows and null ids come
    back as they are, other columns are not read and may have any name, an empty table gives an empty one. No shuffle; the time is
    in proportion to the number of words, the memory of a task to the longest stretch of one text that repeats itself (about half
    a kilobyte a word).
    """
    if least_exponent < 3 or least_length < 3:
        raise ValueError("a run needs at least three words and three periods")

    def compute(ids, texts):
        counts, best, runs, left = [], [], [], []
        for key, text in zip(ids, texts):
            ws = words(text)
            if prepare is not None:
                ws = prepare(key, ws)
            found = find_runs(ws, least_length, least_exponent)
            top = most_repetitive(found)
            shown = [dict(zip(("start", "length", "period"), r)) for r in found]
            counts.append(len(found))
            best.append(dict(zip(("start", "length", "period"), top)) if top else None)
            runs.append(shown)
            left.append(" ".join(collapse(ws, found)))
        return [counts, best, runs, left]

    return map_texts(docs, [id_col], text_col, compute, f"n_runs bigint, best {RUN}, runs array<{RUN}>, collapsed string", with_keys=True)


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Numbers and digests of `periodic_runs`: ``id_col, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256``."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(id_col, "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))

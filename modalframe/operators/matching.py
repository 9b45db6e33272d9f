"""Sparse one-to-one matching: shortest augmenting paths over adjacency lists with prices, and ties by alternating cycles.

Weights are integers (`exact` scales doubles), so sums and comparisons are exact. Every row has a column of its own of weight 0
beside its edges; a row on that column is unmatched. Memory and time follow the edges of a component, never rows x columns.
"""
from __future__ import annotations

from heapq import heappop, heappush

SCALE = 1 << 52


def exact(x: float) -> int:
    """A double as a multiple of 2^-52."""
    return round(x * SCALE)


class Matching:
    """Least total weight over all matchings of ``edges`` (row, column, integer weight); rows and columns are numbers from 0.

    Afterwards ``column_of[row]`` is the column of a matched row, or None.
    """

    def __init__(self, n_rows: int, n_cols: int, edges: list[tuple[int, int, int]]):
        self.n_cols = n_cols
        self.near = [[(n_cols + r, 0)] for r in range(n_rows)]
        for r, c, w in edges:
            self.near[r].append((c, w))
        self.price = [0] * (n_cols + n_rows)
        self.owner: list[int | None] = [None] * (n_cols + n_rows)
        self.place = [(n_cols + r, 0) for r in range(n_rows)]  # column and weight of each row
        for row in range(n_rows):
            self._augment(row)
        self.column_of = [c if c < n_cols else None for c, _ in self.place]

    def _augment(self, start: int) -> None:
        price, owner, place = self.price, self.owner, self.place
        best: dict[int, int] = {}
        back: dict[int, tuple[int, int]] = {}
        done: dict[int, int] = {}
        heap: list[tuple[int, int]] = []
        row, offset = start, 0
        while True:
            for c, w in self.near[row]:
                d = offset + w - price[c]
                if c not in done and (c not in best or d < best[c]):
                    best[c], back[c] = d, (row, w)
                    heappush(heap, (d, c))
            while True:
                d, col = heappop(heap)
                if col not in done and best[col] == d:
                    break
            if owner[col] is None:
                break
            done[col] = d
            row = owner[col]
            offset = d - (place[row][1] - price[col])
        for c, x in done.items():
            price[c] += x - d
        while True:  # turn the path round
            row, w = back[col]
            before = place[row][0]
            owner[col], place[row] = row, (col, w)
            if row == start:
                return
            col = before

    def replaceable(self, tolerance: int) -> list[bool]:
        """For each row whether another matching, at most ``tolerance`` heavier, does not have its pair.

        In the graph of columns a row leads from its column to each other one, at its reduced weight; a node stands for all
        free columns. A pair can be replaced if its column lies on a cycle no longer than the tolerance: such cycles stay
        inside the strong components of the arcs that are no longer than it.
        """
        free = len(self.price)
        arcs: list[list[tuple[int, int]]] = [[] for _ in range(free + 1)]
        for row, (col, w) in enumerate(self.place):
            level = w - self.price[col]
            for c, x in self.near[row]:
                if c != col and x - self.price[c] - level <= tolerance:
                    arcs[col].append((c, x - self.price[c] - level))
        for c, o in enumerate(self.owner):
            if o is None:
                arcs[c].append((free, 0))
            elif -self.price[c] <= tolerance:
                arcs[free].append((c, -self.price[c]))
        part = strong_components([[c for c, _ in a] for a in arcs])
        size: dict[int, int] = {}
        for p in part:
            size[p] = size.get(p, 0) + 1
        flat = {p: True for p in size}
        for a, out in enumerate(arcs):
            for c, x in out:
                if x and part[a] == part[c]:
                    flat[part[a]] = False
        return [size[part[col]] > 1 and (flat[part[col]] or self._cycle(arcs, part, col, tolerance)) for col, _ in self.place]

    @staticmethod
    def _cycle(arcs, part, start: int, tolerance: int) -> bool:
        """Whether a cycle through ``start`` is no longer than the tolerance."""
        best, heap = {}, [(x, c) for c, x in arcs[start] if part[c] == part[start]]
        heap.sort()
        while heap:
            d, node = heappop(heap)
            if node == start:
                return True
            if d > best.get(node, tolerance):
                continue
            for c, x in arcs[node]:
                if part[c] == part[start] and d + x <= tolerance and d + x < best.get(c, tolerance + 1):
                    if c != start:
                        best[c] = d + x
                    heappush(heap, (d + x, c))
        return False


def strong_components(near: list[list[int]]) -> list[int]:
    """Number of the strong component of each node (one depth-first pass, without recursion)."""
    n = len(near)
    order, low, part, stack, on = [-1] * n, [0] * n, [-1] * n, [], [False] * n
    count = parts = 0
    for root in range(n):
        if order[root] >= 0:
            continue
        work = [(root, -1)]
        while work:
            node, k = work.pop()
            if k < 0:
                k = 0
                order[node] = low[node] = count
                count += 1
                stack.append(node)
                on[node] = True
            descend = False
            for i in range(k, len(near[node])):
                c = near[node][i]
                if order[c] < 0:
                    work.append((node, i))  # looked at again afterwards, when c has its low
                    work.append((c, -1))
                    descend = True
                    break
                if on[c]:
                    low[node] = min(low[node], low[c] if order[c] > order[node] else order[c])
            if descend:
                continue
            if low[node] == order[node]:
                while True:
                    x = stack.pop()
                    on[x] = False
                    part[x] = parts
                    if x == node:
                        break
                parts += 1
    return part

"""Small graph and grid kernels: 4-connected components, spanning forests, minimum-cost flow on a face graph."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right

import numpy as np


class Forest:
    """Union by size; ``join`` tells whether two sets became one."""

    def __init__(self, n: int) -> None:
        self.above, self.size = list(range(n)), [1] * n

    def root(self, x: int) -> int:
        while self.above[x] != x:
            self.above[x] = self.above[self.above[x]]
            x = self.above[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.above[b] = a
        self.size[a] += self.size[b]
        return True


def components(keep: np.ndarray, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Labels 1.. of 4-connected kept pixels (of one owner) in order of their first pixel, 0 elsewhere; and sizes by label.

    Works on horizontal runs, joined where runs of adjacent rows touch.
    """
    rows, cols = keep.shape
    owner = np.zeros(keep.shape, np.int64) if owner is None else owner
    begins = keep.copy()
    begins[:, 1:] &= ~(keep[:, :-1] & (owner[:, 1:] == owner[:, :-1]))
    run = np.where(keep, np.cumsum(begins.ravel()).reshape(keep.shape), 0)
    n = int(begins.sum())
    forest = Forest(n + 1)
    touch = keep[1:] & keep[:-1] & (owner[1:] == owner[:-1])
    for a, b in np.unique(np.stack([run[:-1][touch], run[1:][touch]], 1), axis=0).tolist():
        forest.join(a, b)
    roots = np.array([forest.root(k) for k in range(n + 1)])
    first = np.full(n + 1, n + 1)
    np.minimum.at(first, roots[1:], np.arange(1, n + 1))
    order = np.unique(first[roots[1:]]) if n else np.zeros(0, np.int64)
    number = np.zeros(n + 1, np.int64)
    number[1:] = np.searchsorted(order, first[roots[1:]]) + 1
    label = number[run] * keep
    return label, np.bincount(label.ravel(), minlength=len(order) + 1) * (np.arange(len(order) + 1) > 0)


def spanning_offsets(nodes: list, edges: list[tuple]) -> dict:
    """Integer offset of every node along a maximum-weight forest; ``edges`` are (lo, hi, o_lo - o_hi, weight).

    Ties go to the smaller (lo, hi); the least node of a tree has offset 0.
    """
    index = {v: k for k, v in enumerate(sorted(nodes))}
    forest, near = Forest(len(index)), {v: [] for v in index}
    for lo, hi, diff, _ in sorted(edges, key=lambda e: (-e[3], e[0], e[1])):
        if forest.join(index[lo], index[hi]):
            near[lo].append((hi, -diff))
            near[hi].append((lo, diff))
    offset: dict = {}
    for start in sorted(index):
        if start in offset:
            continue
        offset[start], todo = 0, [start]
        while todo:
            u = todo.pop()
            for v, step in near[u]:
                if v not in offset:
                    offset[v] = offset[u] + step
                    todo.append(v)
    return offset


class Level:
    """Faces that the outer node reaches at no reduced cost, in the order in which a search settles them: least number first.

    The order is kept from search to search: a change takes back the faces settled since one that it touches.
    Only faces near a search's own change, so a search does not walk the whole border again.
    """

    def __init__(self, high: int, wide: int) -> None:
        self.high, self.wide = high, wide
        self.clear([])

    def clear(self, first: list[int]) -> None:
        """Start anew from the border faces ``first``."""
        self.first, self.waiting = set(first), sorted(first)
        self.order, self.top, self.when = [], [], {}  # settled faces, greatest number so far, place in the order
        self.since, self.back, self.seen = {}, {}, []  # found by which place, from where, in the order found

    def known(self, v: int) -> bool:
        return v in self.first or v in self.since

    def untouched(self, faces) -> int:
        """How many settled faces precede the first that is one of ``faces`` or next to one."""
        least = len(self.order) + 1
        for v in faces:
            j = v % self.wide
            for u in (v, v - self.wide, v + self.wide, v - 1 if j else v, v + 1 if j + 1 < self.wide else v):
                least = min(least, self.when.get(u, least))
        return least - 1

    def keep(self, n: int) -> None:
        """Take back all but the first ``n`` settled faces."""
        while len(self.order) > n:
            v = self.order.pop()
            self.top.pop()
            del self.when[v]
            if v in self.first or self.since[v] <= n:
                heapq.heappush(self.waiting, v)
        while self.seen and self.since[self.seen[-1]] > n:
            v = self.seen.pop()
            del self.since[v], self.back[v]

    def next(self) -> int | None:
        while self.waiting:
            v = heapq.heappop(self.waiting)
            if self.known(v) and v not in self.when:
                return v
        return None

    def settle(self, v: int) -> None:
        self.order.append(v)
        self.top.append(max(v, self.top[-1]) if self.top else v)
        self.when[v] = len(self.order)

    def find(self, v: int, by: tuple) -> None:
        self.since[v], self.back[v] = len(self.order), by
        self.seen.append(v)
        heapq.heappush(self.waiting, v)


def face_flow(residue: np.ndarray, wx: np.ndarray, wy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers ``(kx, ky)`` per grid edge of least total ``|k| * w`` that cancel every residue.

    Faces are nodes, edges of the pixel grid are arcs of cost ``w`` in both ways, and one outer node
    takes what is left over.  Shortest augmenting paths in reduced costs: a search stops at the
    nearest node that can absorb, and only nodes it settled change their potential.  Of equally near
    nodes the one of least number is settled first, so a search that has settled the outer node goes
    on along :class:`Level`; if that ends without a node that can absorb, it is done over in full.
    """
    high, wide = residue.shape
    cols = wide + 1
    outer = high * wide
    wx, wy = wx.ravel().tolist(), wy.ravel().tolist()
    kx, ky = [0] * len(wx), [0] * len(wy)
    excess = residue.ravel().astype(int).tolist() + [-int(residue.sum())]
    potential = [0] * (outer + 1)
    way: dict[int, tuple] = {}  # arcs from the outer node to the level's first faces
    level = Level(high, wide)
    border = {v for i in range(high) for v in (i * wide, i * wide + wide - 1)} | {v for j in range(wide) for v in (j, (high - 1) * wide + j)}

    def arcs(f: int):
        """(neighbour, is a horizontal edge, edge, sign): moving a unit adds ``sign`` to the edge's integer."""
        if f == outer:
            for j in range(wide):
                yield j, True, j, 1
                yield (high - 1) * wide + j, True, high * wide + j, -1
            for i in range(high):
                yield i * wide, False, i * cols, -1
                yield i * wide + wide - 1, False, i * cols + wide, 1
            return
        i, j = divmod(f, wide)
        yield (f - wide if i else outer), True, f, -1
        yield (f + wide if i + 1 < high else outer), True, f + wide, 1
        yield (f - 1 if j else outer), False, i * cols + j, 1
        yield (f + 1 if j + 1 < wide else outer), False, i * cols + j + 1, -1

    def cost(flat: bool, edge: int, sign: int) -> int:
        w = (wx if flat else wy)[edge]
        return w if (kx if flat else ky)[edge] * sign >= 0 else -w

    def entrance(v: int) -> tuple | None:
        """The arc from the outer node to a border face, if its reduced cost is 0."""
        i, j = divmod(v, wide)
        ways = ((i == 0, True, v, 1), (i == high - 1, True, high * wide + j, -1), (j == 0, False, i * cols, -1), (j == wide - 1, False, i * cols + wide, 1))
        return next(((outer, *arc) for ok, *arc in ways if ok and cost(*arc) + potential[outer] - potential[v] == 0), None)

    def search(start: int, whole: bool) -> tuple[int, dict, dict] | None:
        """Where it ends, distances of settled nodes and ways back; None if the level does not lead to an end."""
        dist, settled, back, heap = {start: 0}, {}, {}, [(0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            if u in settled:
                continue
            settled[u] = d
            if excess[u] < 0:
                return u, settled, back
            if u == outer and not whole:
                end = along(settled)
                return None if end is None else (end, settled, back)
            for v, flat, edge, sign in arcs(u):
                if v in settled:
                    continue
                to = d + cost(flat, edge, sign) + potential[u] - potential[v]
                if to < dist.get(v, math.inf):
                    dist[v], back[v] = to, (u, flat, edge, sign)
                    heapq.heappush(heap, (to, v))
        raise AssertionError("excess and deficit do not match")

    def along(settled: dict) -> int | None:
        level.keep(level.untouched(v for v in settled if v != outer))
        while (u := level.next()) is not None:
            if u in settled:
                held.append(u)
                continue
            level.settle(u)
            if excess[u] < 0:
                return u
            for v, flat, edge, sign in arcs(u):
                if v not in settled and not level.known(v) and cost(flat, edge, sign) + potential[u] - potential[v] == 0:
                    level.find(v, (u, flat, edge, sign))
        return None

    for start in [f for f in range(outer + 1) if excess[f] > 0]:
        while excess[start] > 0:
            held: list[int] = []  # faces of the level that the search had settled before the outer node
            found = search(start, False)
            whole = found is None
            end, settled, back = found or search(start, True)
            last = settled.get(end, settled.get(outer))
            touched = set(settled)
            for v, d in settled.items():
                potential[v] += d - last
            # one unit at a time: a step against flow is cheap only while there is flow
            v = end
            while v != start:
                touched.add(v)
                u, flat, edge, sign = back[v] if v in back and (v in settled or whole) else level.back[v] if v in level.back else way[v]
                (kx if flat else ky)[edge] += sign
                v = u
            excess[start] -= 1
            excess[end] += 1
            if whole and outer in settled:
                way = {v: arc for v in border if (arc := entrance(v))}
                level.clear(list(way))
                continue
            touched.discard(outer)
            now = {v: entrance(v) for v in touched if v in border}
            keep = min([level.untouched(touched), *(bisect_right(level.top, v) for v in held), *(bisect_right(level.top, v) for v, arc in now.items() if arc and v not in level.first)])
            level.keep(keep)
            for v, arc in now.items():
                if arc:
                    way[v] = arc
                    if v not in level.first or v in held:
                        level.first.add(v)
                        heapq.heappush(level.waiting, v)
                else:
                    level.first.discard(v)
                    way.pop(v, None)
    return np.array(kx, float).reshape(high + 1, wide), np.array(ky, float).reshape(high, cols)

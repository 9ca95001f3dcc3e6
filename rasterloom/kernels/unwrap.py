"""Two-dimensional phase unwrapping: costs, branch cuts by minimum-cost flow, tiles, regions, multi-scale.  Numpy only.

``psi`` is wrapped phase in radians, ``corr`` coherence in 0..1, both (row, col).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from rasterloom.errors import UnwrapError

from .graphs import components, face_flow, spanning_offsets

TURN = 2 * math.pi
COST_SCALE, COST_FLOOR, COHERENCE_CEILING = 1e4, 1.0, 0.99  # fixed values
OVERLAP = 16  # pixels by which a tile's window exceeds its core
MIN_CORR, MIN_SHARE, REGROW = 0.15, 0.001, 2
TRUST, OVERLAP_CORR, MIN_AGREE = 0.4, 0.5, 16  # multi-scale: coarse trust, overlap coherence, agreeing pixels


def half_away(x: np.ndarray) -> np.ndarray:
    """Rounds halves away from zero."""
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def wrap(x: np.ndarray) -> np.ndarray:
    return x - TURN * half_away(x / TURN)


def gradients(psi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return wrap(np.diff(psi, axis=1)), wrap(np.diff(psi, axis=0))


def residues(ax: np.ndarray, ay: np.ndarray) -> np.ndarray:
    """Turns around each 2x2 cell."""
    return half_away((ax[:-1] + ay[:, 1:] - ax[1:] - ay[:, :-1]) / TURN).astype(np.int64)


def edge_costs(corr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integer precision of each horizontal and vertical edge; a coherence that is not a number counts as 0."""
    corr = np.nan_to_num(corr.astype(float))

    def cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        g = np.clip((a + b) / 2, 0, COHERENCE_CEILING) ** 2
        return half_away(np.maximum(g / (1 - g), COST_FLOOR) * COST_SCALE).astype(np.int64)

    return cost(corr[:, :-1], corr[:, 1:]), cost(corr[:-1], corr[1:])


def branch_cuts(ax: np.ndarray, ay: np.ndarray, corr: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Cycles to add to each gradient, None without residues."""
    r = residues(ax, ay)
    return face_flow(r, *edge_costs(corr)) if r.any() else None


def integrate(psi: np.ndarray, ax: np.ndarray, ay: np.ndarray) -> np.ndarray:
    """Sum of gradients down the first column, then along rows."""
    out = np.empty_like(psi)
    out[:, 0] = psi[0, 0] + np.concatenate([[0.0], np.cumsum(ay[:, 0])])
    out[:, 1:] = out[:, :1] + np.cumsum(ax, axis=1)
    return out


def unwrap_grid(psi: np.ndarray, corr: np.ndarray) -> np.ndarray:
    """One grid as a whole; phases that are not numbers count as 0."""
    if min(psi.shape) < 2:
        raise UnwrapError(f"grid too small: {psi.shape}")
    if corr.shape != psi.shape:
        raise UnwrapError(f"coherence {corr.shape} does not fit phase {psi.shape}")
    psi = np.where(np.isfinite(psi), psi, 0.0)
    ax, ay = gradients(psi)
    cuts = branch_cuts(ax, ay, corr)
    if cuts is not None:
        ax, ay = ax + TURN * cuts[0], ay + TURN * cuts[1]
    return integrate(psi, ax, ay)


def label_regions(corr: np.ndarray, min_corr: float = MIN_CORR, min_share: float = MIN_SHARE) -> np.ndarray:
    """Components of coherent pixels: 1 is the largest, equal sizes by first pixel, 0 for the rest and for small ones."""
    label, size = components(corr >= min_corr)
    least = math.ceil(min_share * corr.size)
    order = sorted((k for k in range(1, len(size)) if size[k] >= least), key=lambda k: (-size[k], k))
    rank = np.zeros(len(size), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    return rank[label]


def spans(n: int, parts: int, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """``(core start, core end, window start, window end)`` along an axis."""
    parts = max(1, min(parts, max(n, 1)))
    core = -(-n // parts)
    return [(a, min(a + core, n), max(a - overlap, 0), min(a + core + overlap, n)) for a in range(0, n, core)]


def grow(label: np.ndarray, steps: int = REGROW, owner: np.ndarray | None = None) -> np.ndarray:
    """Unlabelled pixels take the least label among 4-neighbours (of their owner), ``steps`` times."""
    none = np.iinfo(np.int64).max
    owner = np.zeros(label.shape, np.int64) if owner is None else owner
    for _ in range(steps):
        padded = np.pad(np.where(label == 0, none, label), 1, constant_values=none)
        near = np.pad(owner, 1, constant_values=-1)
        best = np.full(label.shape, none)
        for dr, dc in ((0, 1), (2, 1), (1, 0), (1, 2)):
            at = (slice(dr, dr + label.shape[0]), slice(dc, dc + label.shape[1]))
            best = np.minimum(best, np.where(near[at] == owner, padded[at], none))
        label = np.where((label == 0) & (best != none), best, label)
    return label


def seam_votes(psi: np.ndarray, corr: np.ndarray, value: np.ndarray, label: np.ndarray) -> list[tuple]:
    """``(lo, hi, o_lo - o_hi, weight)`` for touching regions: heaviest difference, then least, then smaller; all votes' weight."""
    votes: dict[tuple, dict[int, float]] = {}
    for p, q in (((slice(None, -1), slice(None)), (slice(1, None), slice(None))), ((slice(None), slice(None, -1)), (slice(None), slice(1, None)))):
        on = (label[p] != 0) & (label[q] != 0) & (label[p] != label[q])
        d = half_away((value[q] - value[p] - wrap(psi[q] - psi[p])) / TURN)[on].astype(int)
        for r, s, x, w in zip(label[p][on].tolist(), label[q][on].tolist(), d.tolist(), np.minimum(corr[p], corr[q])[on].tolist()):
            pair, x = ((r, s), x) if r < s else ((s, r), -x)
            own = votes.setdefault(pair, {})
            own[x] = own.get(x, 0.0) + w
    return [(*pair, max(own, key=lambda x: (own[x], -abs(x), -x)), sum(own.values())) for pair, own in votes.items()]


def unwrap_tiled(psi: np.ndarray, corr: np.ndarray, tiles: tuple[int, int], min_corr: float = MIN_CORR, regrow: int = REGROW) -> np.ndarray:
    """Tiles solved on overlapping windows; whole cycles per coherent region make their values agree over seams."""
    value, owner = np.empty(psi.shape), np.empty(psi.shape, np.int64)
    layout = [(r, c) for r in spans(psi.shape[0], tiles[0]) for c in spans(psi.shape[1], tiles[1])]
    for k, (r, c) in enumerate(layout):
        window = (slice(r[2], r[3]), slice(c[2], c[3]))
        solved = unwrap_grid(psi[window], corr[window])
        core = (slice(r[0], r[1]), slice(c[0], c[1]))
        value[core] = solved[r[0] - r[2] : r[1] - r[2], c[0] - c[2] : c[1] - c[2]]
        owner[core] = k
    label, size = components(corr >= min_corr, owner)
    tile_of = np.zeros(len(size), np.int64)
    tile_of[label.ravel()] = owner.ravel()
    label = grow(label, regrow, owner)
    offset = spanning_offsets(list(range(1, len(size))), seam_votes(psi, corr, value, label))
    of_tile = np.zeros(len(layout))
    for k in sorted(range(1, len(size)), key=lambda k: (size[k], -k)):
        of_tile[tile_of[k]] = offset[k]
    by_label = np.array([0.0, *(offset[k] for k in range(1, len(size)))])
    return value + TURN * np.where(label > 0, by_label[label], of_tile[owner])


def unwrap(psi: np.ndarray, corr: np.ndarray, tiles: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unwrapped phase and component labels."""
    return (unwrap_grid(psi, corr) if tiles is None else unwrap_tiled(psi, corr, tiles)), label_regions(corr)


def downsample(z: np.ndarray, corr: np.ndarray, by: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Coherence-weighted mean phasor of blocks, and its length as their coherence; partial blocks are dropped."""
    dy, dx = max(1, by[0]), max(1, by[1])
    rows, cols = z.shape[0] // dy, z.shape[1] // dx
    blocks = lambda x: x[: rows * dy, : cols * dx].reshape(rows, dy, cols, dx).sum(axis=(1, 3))
    total, weight = blocks(z * corr), np.maximum(blocks(corr), 1e-12)
    return total / weight, np.abs(total) / weight


def fill_untrusted(phase: np.ndarray, corr: np.ndarray, floor: float = TRUST) -> np.ndarray:
    """Pixels under ``floor`` take the mean of trusted 4-neighbours, outward in rounds; unchanged if none is trusted."""
    phase, good = phase.astype(float), corr >= floor
    while good.any() and not good.all():
        p, g = np.pad(np.where(good, phase, 0.0), 1), np.pad(good, 1)
        cut = lambda x, a, b: x[a : a + phase.shape[0], b : b + phase.shape[1]]
        around = [(0, 1), (2, 1), (1, 0), (1, 2)]
        n = sum(cut(g, a, b).astype(int) for a, b in around)
        new = ~good & (n > 0)
        phase = np.where(new, sum(cut(p, a, b) for a, b in around) / np.maximum(n, 1), phase)
        good = good | new
    return phase


def upsample(x: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Block repeat to ``shape``; rows and columns past the last whole block repeat the last."""
    rows, cols = (np.minimum(np.arange(n) // max(1, n // m), m - 1) for n, m in zip(shape, x.shape))
    return x[np.ix_(rows, cols)]


@dataclass
class Tile:
    core: tuple[int, int, int, int]  # r0, r1, c0, c1
    window: tuple[int, int, int, int]
    phase: np.ndarray


def tile_regions(shape: tuple[int, int], parts: tuple[int, int], overlap: tuple[int, int]) -> list[tuple[tuple, tuple]]:
    """``(core, window)`` of even tiles, row by row."""
    out = []
    for a in range(max(1, parts[0])):
        for b in range(max(1, parts[1])):
            core = tuple(x for k, n, p in ((a, shape[0], max(1, parts[0])), (b, shape[1], max(1, parts[1]))) for x in (k * n // p, (k + 1) * n // p))
            out.append((core, (max(core[0] - overlap[0], 0), min(core[1] + overlap[0], shape[0]), max(core[2] - overlap[1], 0), min(core[3] + overlap[1], shape[1]))))
    return out


def grid_edges(parts: tuple[int, int]) -> list[tuple[int, int]]:
    """Right and lower neighbours in a grid of tiles numbered row by row."""
    rows, cols = parts
    return [(k, k + s) for k in range(rows * cols) for s, ok in ((1, (k + 1) % cols), (cols, k // cols + 1 < rows)) if ok]


def overlap_edge(a: Tile, b: Tile, corr: np.ndarray) -> tuple[int, int] | None:
    """Cycles of ``b - a`` by the upper median over coherent shared pixels (all if none is), and how many agree."""
    r0, r1 = max(a.window[0], b.window[0]), min(a.window[1], b.window[1])
    c0, c1 = max(a.window[2], b.window[2]), min(a.window[3], b.window[3])
    if r0 >= r1 or c0 >= c1:
        return None
    part = lambda t: t.phase[r0 - t.window[0] : r1 - t.window[0], c0 - t.window[2] : c1 - t.window[2]]
    d, good = (part(b) - part(a)).ravel(), corr[r0:r1, c0:c1].ravel() > OVERLAP_CORR
    d = np.sort(d[good] if good.any() else d)
    cycles = half_away(d[len(d) // 2] / TURN)
    return int(cycles), int((half_away(d / TURN) == cycles).sum())


def tile_offsets(tiles: list[Tile], parts: tuple[int, int], corr: np.ndarray, least: int = MIN_AGREE) -> tuple[list[int], list[int]]:
    """Whole cycles per tile, and the number of its connected set of tiles."""
    edges = []
    for i, j in grid_edges(parts):
        found = overlap_edge(tiles[i], tiles[j], corr)
        if found and found[1] >= least:
            edges.append((i, j, found[0], found[1]))
    offset = spanning_offsets(list(range(len(tiles))), edges)
    group = components_of(len(tiles), [(i, j) for i, j, _, _ in edges])
    return [offset[k] for k in range(len(tiles))], group


def components_of(n: int, edges: list[tuple[int, int]]) -> list[int]:
    from .graphs import Forest

    forest = Forest(n)
    for a, b in edges:
        forest.join(a, b)
    seen: dict[int, int] = {}
    return [seen.setdefault(forest.root(k), len(seen)) for k in range(n)]


def anchors(coarse: np.ndarray, tiles: list[Tile], offset: list[int], group: list[int]) -> list[int]:
    """Whole cycles per set of tiles that bring their cores' mean to the coarse phase."""
    total, count = np.zeros(max(group, default=-1) + 1), np.zeros(max(group, default=-1) + 1)
    for t, o, g in zip(tiles, offset, group):
        r0, r1, c0, c1 = t.core
        own = t.phase[r0 - t.window[0] : r1 - t.window[0], c0 - t.window[2] : c1 - t.window[2]] + TURN * o
        total[g] += (coarse[r0:r1, c0:c1] - own).sum()
        count[g] += own.size
    return half_away(total / np.maximum(count, 1) / TURN).astype(int).tolist()


def feather(core: tuple, window: tuple) -> np.ndarray:
    """Weights over a window: 1 in the core, falling evenly towards the window's edge."""

    def ramp(lo: int, hi: int, first: int, last: int) -> np.ndarray:
        x = np.arange(first, last)
        return np.where(x < lo, (x - first + 1) / (lo - first + 1), np.where(x >= hi, (last - x) / max(last - hi, 1), 1.0))

    return np.outer(ramp(core[0], core[1], window[0], window[1]), ramp(core[2], core[3], window[2], window[3]))


def unwrap_multiscale(z: np.ndarray, corr: np.ndarray, by: tuple[int, int] = (3, 3), parts: tuple[int, int] = (2, 2), overlap: tuple[int, int] = (16, 16)) -> tuple[np.ndarray, np.ndarray]:
    """Coarse phase first, then tiles made to agree on overlaps, anchored to it and blended; one component everywhere."""
    coarse_z, coarse_corr = downsample(z, corr, by)
    if min(coarse_z.shape) < 2:
        raise UnwrapError(f"coarse grid too small: {coarse_z.shape}")
    coarse = upsample(fill_untrusted(unwrap_grid(np.angle(coarse_z), coarse_corr), coarse_corr), z.shape)
    tiles = []
    for core, window in tile_regions(z.shape, parts, overlap):
        at = (slice(window[0], window[1]), slice(window[2], window[3]))
        tiles.append(Tile(core, window, unwrap_grid(np.angle(z[at]), corr[at])))
    offset, group = tile_offsets(tiles, parts, corr)
    base = anchors(coarse, tiles, offset, group)
    total, weight = np.zeros(z.shape), np.zeros(z.shape)
    for t, o, g in zip(tiles, offset, group):
        at, w = (slice(t.window[0], t.window[1]), slice(t.window[2], t.window[3])), feather(t.core, t.window)
        total[at] += w * (t.phase + TURN * (o + base[g]))
        weight[at] += w
    return total / weight, np.ones(z.shape, np.int64)

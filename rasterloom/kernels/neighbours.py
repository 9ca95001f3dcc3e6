"""Statistically similar neighbours: likelihood-ratio and Kolmogorov-Smirnov tests on amplitudes.  Numpy only.

A mask is (out row, out col, window row, window col).  Windows are cut at borders and their places
count from the cut window's first pixel, unlike those of the covariance.  A pixel is never its own neighbour.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def critical_chi2(alpha: float) -> float:
    """Quantile 1 - alpha of chi-squared with one degree of freedom."""
    return NormalDist().inv_cdf(1 - alpha / 2) ** 2


def critical_distance(n: int, alpha: float) -> float:
    """Least of 0.01, 0.011, ... whose Kolmogorov probability is at most ``alpha``; 0.1 if none is."""
    root = math.sqrt(n / 2)
    for step in range(991):
        d = 0.01 + 0.001 * step
        v = d * (root + 0.12 + 0.11 / root)
        p = 2 * sum((-1) ** (t - 1) * math.exp(-2 * v * v * t * t) for t in range(1, 101))
        if min(max(p, 0.0), 1.0) <= alpha:
            return d
    return 0.1


def _windows(shape: tuple[int, int], half: tuple[int, int], strides: tuple[int, int]):
    """Centres along both axes, and for each window place the neighbour's row and col and whether it is inside."""
    centre = [s // 2 + np.arange(n // s) * s for n, s in zip(shape, strides)]
    start = [np.maximum(c - h, 0) for c, h in zip(centre, half)]
    stop = [np.minimum(c + h + 1, n) for c, h, n in zip(centre, half, shape)]

    def places():
        for a in range(2 * half[0] + 1):
            for b in range(2 * half[1] + 1):
                r, c = start[0] + a, start[1] + b
                inside = (r < stop[0])[:, None] & (c < stop[1])[None]
                own = (r == centre[0])[:, None] & (c == centre[1])[None]
                yield a, b, np.minimum(r, shape[0] - 1), np.minimum(c, shape[1] - 1), inside & ~own

    return centre, start, stop, places


def glrt(mean: np.ndarray, variance: np.ndarray, n: int, half: tuple[int, int], strides: tuple[int, int] = (1, 1), alpha: float = 0.001) -> np.ndarray:
    """Pixels whose Rayleigh scale passes the likelihood-ratio test; a centre of mean 0 has none."""
    scale = (variance + mean**2) / 2
    (rows, cols), _, _, places = _windows(mean.shape, half, strides)
    own = scale[np.ix_(rows, cols)]
    out = np.zeros((len(rows), len(cols), 2 * half[0] + 1, 2 * half[1] + 1), bool)
    limit, live = critical_chi2(alpha), mean[np.ix_(rows, cols)] != 0
    for a, b, r, c, ok in places():
        other = scale[np.ix_(r, c)]
        with np.errstate(divide="ignore", invalid="ignore"):
            test = n * (2 * np.log((own + other) / 2) - np.log(own) - np.log(other))
            out[:, :, a, b] = ok & live & (limit > test)
    return out


def largest_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Largest distance of the empirical distributions of rows of ``a`` and ``b``, of equal length."""
    both = np.concatenate([a, b], axis=1)
    share = lambda x: (x[:, None, :] <= both[:, :, None]).mean(axis=2)
    return np.abs(share(a) - share(b)).max(axis=1)


def ks(amplitude: np.ndarray, half: tuple[int, int], strides: tuple[int, int] = (1, 1), alpha: float = 0.001) -> np.ndarray:
    """Pixels whose amplitudes (epoch, row, col) have a close distribution; a window cut at a border has none."""
    (rows, cols), start, stop, places = _windows(amplitude.shape[1:], half, strides)
    out = np.zeros((len(rows), len(cols), 2 * half[0] + 1, 2 * half[1] + 1), bool)
    full = (stop[0] - start[0] == 2 * half[0] + 1)[:, None] & (stop[1] - start[1] == 2 * half[1] + 1)[None]
    limit = critical_distance(len(amplitude), alpha)
    at = np.argwhere(full)
    own = amplitude[:, rows[at[:, 0]], cols[at[:, 1]]].T
    for a, b, r, c, ok in places():
        other = amplitude[:, r[at[:, 0]], c[at[:, 1]]].T
        out[at[:, 0], at[:, 1], a, b] = ok[at[:, 0], at[:, 1]] & (largest_distance(own, other) < limit)
    return out


def choose(amplitude: np.ndarray, how) -> np.ndarray | None:
    """The mask that the settings ask for, None for the whole window."""
    if how.method == "rect":
        return None
    if how.method == "ks":
        return ks(amplitude, how.half, how.strides, how.alpha)
    return glrt(amplitude.mean(axis=0), amplitude.var(axis=0), len(amplitude), how.half, how.strides, how.alpha)


def persistent(amplitude: np.ndarray, threshold: float = 0.25, least: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, dispersion and flag of finite amplitudes (epoch, row, col): 1 under the threshold, 0 over it, 255 without a dispersion."""
    ok = np.isfinite(amplitude)
    n = ok.sum(axis=0)
    few = n < (len(amplitude) if least is None else least)
    x = np.where(ok, amplitude, 0.0)
    mean = np.where(few | (n == 0), 0.0, x.sum(axis=0) / np.maximum(n, 1))
    spread = np.sqrt(np.where(ok, (x - mean) ** 2, 0.0).sum(axis=0) / np.maximum(n, 1))
    dispersion = np.where(few | (mean == 0), 0.0, spread / np.where(mean == 0, 1.0, mean))
    return mean, dispersion, np.where(dispersion == 0, 255, np.where(dispersion < threshold, 1, 0)).astype(np.uint8)


def fill_persistent(theta: np.ndarray, temp_coh: np.ndarray, stack: np.ndarray, flags: np.ndarray, strides: tuple[int, int] = (1, 1), reference: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Output cells with a flagged pixel take the phase of the brightest (the last of equals) against ``reference``, and quality 1."""
    theta, temp_coh = theta.copy(), temp_coh.copy()
    amplitude = np.abs(stack)
    mean = np.where(np.isfinite(amplitude), amplitude, 0).sum(axis=0) / np.maximum(np.isfinite(amplitude).sum(axis=0), 1)
    rows, cols = theta.shape[1:]
    blocks = np.where(flags == 1, mean, -1.0)[: rows * strides[0], : cols * strides[1]].reshape(rows, strides[0], cols, strides[1]).transpose(0, 2, 1, 3).reshape(rows, cols, -1)
    best = blocks.shape[2] - 1 - np.argmax(blocks[:, :, ::-1], axis=2)
    r, c = np.nonzero(blocks.max(axis=2) >= 0)
    src = (r * strides[0] + best[r, c] // strides[1], c * strides[1] + best[r, c] % strides[1])
    z = stack[:, src[0], src[1]]
    theta[:, r, c] = np.angle(z * np.exp(-1j * np.angle(z[reference])))
    temp_coh[r, c] = 1.0
    return theta, temp_coh

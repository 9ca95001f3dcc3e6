"""Numpy kernels of phase linking: windowed covariance, estimators, quality and compression.  No Spark here.

Arrays are (epoch, row, col) complex; a batch of matrices is (pixel, n, n).  Windows of the
covariance keep their full size: at a border they shift inward.  ``window_sums`` is the plain
moving sum that shrinks there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

JITTER = 1e-6


def window_sums(x: np.ndarray, half: tuple[int, int]) -> np.ndarray:
    """Sums over (2 half + 1) windows of the last two axes, clamped at the borders by shrinking."""
    for axis, h in ((-2, half[0]), (-1, half[1])):
        n = x.shape[axis]
        total = np.concatenate([np.zeros_like(np.take(x, [0], axis)), np.cumsum(x, axis)], axis)
        k = np.arange(n)
        x = np.take(total, np.minimum(k + h + 1, n), axis) - np.take(total, np.maximum(k - h, 0), axis)
    return x


def origins(dim: int, half: int, stride: int = 1) -> np.ndarray:
    """First index of each output's window along an axis."""
    win = 2 * half + 1
    if win > dim:
        raise ValueError(f"a window of {win} does not fit {dim}")
    return np.clip(stride // 2 + np.arange(dim // stride) * stride - half, 0, dim - win)


def box_sums(x: np.ndarray, half: tuple[int, int], strides: tuple[int, int] = (1, 1)) -> np.ndarray:
    """Sums over full windows of the last two axes, one per output."""
    for axis, h, s in ((-2, half[0], strides[0]), (-1, half[1], strides[1])):
        at = origins(x.shape[axis], h, s)
        total = np.concatenate([np.zeros_like(np.take(x, [0], axis)), np.cumsum(x, axis)], axis)
        x = np.take(total, at + 2 * h + 1, axis) - np.take(total, at, axis)
    return x


def masked_sums(x: np.ndarray, half: tuple[int, int], strides: tuple[int, int], neighbours: np.ndarray) -> np.ndarray:
    """Like :func:`box_sums` over the window places that ``neighbours`` (out row, out col, window row, window col) allows."""
    r, c = (origins(x.shape[a], half[a], strides[a]) for a in (-2, -1))
    out = np.zeros((*x.shape[:-2], len(r), len(c)), x.dtype)
    for a in range(2 * half[0] + 1):
        for b in range(2 * half[1] + 1):
            if neighbours[:, :, a, b].any():
                out += np.take(np.take(x, r + a, -2), c + b, -1) * neighbours[:, :, a, b]
    return out


def coherence(stack: np.ndarray, half: tuple[int, int], strides: tuple[int, int] = (1, 1), neighbours: np.ndarray | None = None) -> np.ndarray:
    """(out row, out col, n, n) sample coherence; samples that are not finite count as 0, as does an entry whose amplitudes' product is at most 1e-6."""
    z = np.where(np.isfinite(stack), stack, 0)
    n = len(z)
    sums = (lambda x: box_sums(x, half, strides)) if neighbours is None else (lambda x: masked_sums(x, half, strides, neighbours))
    power = np.sqrt(np.maximum(sums((z * z.conj()).real), 0))
    out = np.empty((*power.shape[1:], n, n), complex)
    for i in range(n):
        cross = sums(z[i] * z[i:].conj())
        scale = power[i] * power[i:]
        c = np.where(scale > JITTER, cross / np.where(scale > JITTER, scale, 1), 0)
        out[:, :, i, i:] = np.moveaxis(c, 0, -1)
        out[:, :, i:, i] = np.moveaxis(c.conj(), 0, -1)
    return out


def magnitudes(c: np.ndarray, beta: float = 0.0, cut: float = 0.0) -> np.ndarray:
    """|C|, mixed with the identity by ``beta``; what is then under ``cut`` counts as 0."""
    g = np.abs(c)
    if beta > 0:
        g = (1 - beta) * g + beta * np.eye(c.shape[1])
    return np.where(g < cut, 0.0, g)


def positive_definite(m: np.ndarray) -> np.ndarray:
    """Which matrices of a batch have a Cholesky factor: all pivots of an elimination are positive."""
    a, ok = m.astype(float), np.ones(len(m), bool)
    for k in range(m.shape[1]):
        pivot = a[:, k, k]
        ok &= pivot > 0
        column = a[:, k + 1 :, k] / np.where(pivot > 0, pivot, 1.0)[:, None]
        a[:, k + 1 :, k + 1 :] -= column[:, :, None] * a[:, None, k, k + 1 :]
    return ok


def evd(c: np.ndarray) -> np.ndarray:
    """Leading eigenvector of C times |C| (elementwise)."""
    return np.linalg.eigh(c * np.abs(c))[1][:, :, -1]


def emi(c: np.ndarray, beta: float = 0.0, cut: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Least eigenvector of inv(|C|) times C where |C| is positive definite, else that of ``evd``; and which was which."""
    g = magnitudes(c, beta, cut)
    ok = positive_definite(g)
    v = np.empty(c.shape[:2], complex)
    if ok.any():
        inverse = np.linalg.inv(g[ok])
        fine = np.isfinite(inverse).all(axis=(1, 2))
        ok[np.flatnonzero(ok)[~fine]] = False
        v[ok] = np.linalg.eigh(inverse[fine] * c[ok])[1][:, :, 0]
    if (~ok).any():
        v[~ok] = evd(c[~ok])
    return v, ok


def phases(v: np.ndarray, reference: int = 0) -> np.ndarray:
    """Angles relative to the reference epoch."""
    theta = np.angle(v * np.exp(-1j * np.angle(v[:, reference]))[:, None])
    theta[:, reference] = 0
    return theta


def temporal_coherence(c: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """|mean over i < j of exp(j (arg C_ij - (theta_i - theta_j)))|."""
    i, j = np.triu_indices(c.shape[1], 1)
    return np.abs(np.exp(1j * (np.angle(c[:, i, j]) - theta[:, i] + theta[:, j])).mean(axis=1))


def bound(c: np.ndarray, looks: float, reference: int = 0, beta: float = 0.0, cut: float = 0.0) -> np.ndarray:
    """Cramer-Rao standard deviation per epoch; not a number off the reference where it has none."""
    g = magnitudes(c, beta, cut)
    n = g.shape[1]
    keep = [k for k in range(n) if k != reference]
    out = np.full(g.shape[:2], np.nan)
    out[:, reference] = 0
    ok = positive_definite(g + JITTER * np.eye(n))
    info = np.zeros_like(g)
    if ok.any():
        info[ok] = 2 * looks * (g[ok] * np.linalg.inv(g[ok] + JITTER * np.eye(n)) - np.eye(n))
    sub = info[:, keep][:, :, keep] + JITTER * np.eye(n - 1)
    ok &= positive_definite(sub)
    if ok.any():
        out[np.ix_(ok, keep)] = np.sqrt(np.einsum("pii->pi", np.linalg.inv(sub[ok])))
    return out


def closure(c: np.ndarray) -> np.ndarray:
    """Phases of C[k, k+1] C[k+1, k+2] conj(C[k, k+2]); n - 2 per pixel, none for two epochs."""
    k = np.arange(max(c.shape[1] - 2, 0))
    return np.angle(c[:, k, k + 1] * c[:, k + 1, k + 2] * c[:, k, k + 2].conj())


def average_coherence(c: np.ndarray) -> np.ndarray:
    """Mean of |C| along each epoch's row, its own entry included."""
    return np.abs(c).mean(axis=2)


def coherence_total(c: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the finite averages of epochs ``first`` on; layers of several runs add up."""
    a = average_coherence(c)[:, first:]
    return np.where(np.isfinite(a), a, 0.0).sum(axis=1), np.isfinite(a).sum(axis=1)


def upsample(x: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Block repeat of the last two axes; what is left over repeats the last block."""
    at = [np.minimum(np.arange(n) // max(1, n // m), m - 1) for n, m in zip(shape, x.shape[-2:])]
    return x[..., at[0][:, None], at[1]]


def compress(stack: np.ndarray, theta: np.ndarray, first: int = 0, reference: int | None = None) -> np.ndarray:
    """One layer from epochs ``first`` on: mean amplitude with the phase of the linked sum.

    ``theta`` is (epoch, row, col), of the stack's grid or a coarser one.  A phase of exactly 0 has no
    layer; samples that are not finite are left out of the phase and make the amplitude missing.
    """
    if reference is not None:
        theta = theta - theta[reference]
    z, theta = stack[first:], upsample(theta[first:], stack.shape[1:])
    with np.errstate(invalid="ignore"):
        term = z * np.exp(-1j * theta)
    angle = np.angle(np.where(np.isfinite(term), term, 0).sum(axis=0))
    return np.where(angle == 0, np.nan, np.abs(z).mean(axis=0) * np.exp(1j * angle))


def empty_epochs(stack: np.ndarray) -> list[int]:
    """Epochs without a finite sample."""
    return np.flatnonzero(~np.isfinite(stack).any(axis=(1, 2))).tolist()


def bias_rate(closures: np.ndarray) -> float:
    """Half the mean finite closure phase, 0 without any."""
    finite = closures[np.isfinite(closures)]
    return float(finite.mean() / 2) if finite.size else 0.0


def remove_bias(theta: np.ndarray, rate: float) -> np.ndarray:
    """Phases (epoch, ...) less epoch times ``rate``."""
    return theta - rate * np.arange(len(theta)).reshape(-1, *[1] * (theta.ndim - 1))


def residual_closure(closures: np.ndarray, rate: float) -> np.ndarray:
    return closures - 2 * rate


def mean_abs_closure(closures: np.ndarray) -> float:
    finite = closures[np.isfinite(closures)]
    return float(np.abs(finite).mean()) if finite.size else 0.0


@dataclass(frozen=True)
class Linking:
    """Settings of one linking run."""

    half: tuple[int, int] = (1, 1)
    strides: tuple[int, int] = (1, 1)
    estimator: str = "emi"  # or evd
    beta: float = 0.0
    cut: float = 0.0
    method: str = "rect"  # neighbours: rect, glrt or ks
    alpha: float = 0.001
    crlb: bool = True
    closure: bool = False
    average: bool = False

    def __post_init__(self) -> None:
        if self.estimator not in ("emi", "evd"):
            raise ValueError(f"unknown estimator {self.estimator!r}")
        if self.method not in ("rect", "glrt", "ks"):
            raise ValueError(f"unknown neighbour method {self.method!r}")

    @property
    def looks(self) -> float:
        return float(np.sqrt(self.half[0] * self.half[1]))


def estimate(c: np.ndarray, how: Linking, reference: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Referenced phases and the estimator flag (1 full, 0 fallback) of a batch of coherence matrices."""
    v, ok = emi(c, how.beta, how.cut) if how.estimator == "emi" else (evd(c), np.ones(len(c), bool))
    return phases(v, reference), ok


def link_stack(stack: np.ndarray, how: Linking, first: int = 0, reference: int = 0, crlb_reference: int = 0, looks: float | None = None) -> dict[str, np.ndarray]:
    """All products of one stack in one pass: coherence matrices never leave it.

    Epochs before ``first`` are carried layers; they take no part in choosing neighbours.
    """
    missing = empty_epochs(stack)
    if missing:
        raise ValueError(f"epochs without a finite sample: {missing}")
    from . import neighbours as shp

    c = coherence(stack, how.half, how.strides, shp.choose(np.abs(stack[first:]), how))
    rows, cols, n = c.shape[:3]
    c = c.reshape(-1, n, n)
    theta, ok = estimate(c, how, reference)
    grid = lambda x: np.moveaxis(x, -1, 0).reshape(x.shape[-1], rows, cols)
    out = {"theta": grid(theta), "flag": ok.reshape(rows, cols), "temp_coh": temporal_coherence(c, theta).reshape(rows, cols)}
    if how.crlb:
        out["sigma"] = grid(bound(c, how.looks if looks is None else looks, crlb_reference, how.beta, how.cut))
    if how.closure:
        out["closure"] = grid(closure(c))
    if how.average:
        total, count = coherence_total(c, first)
        out["coherence_sum"], out["coherence_count"] = total.reshape(rows, cols), count.reshape(rows, cols)
    return out

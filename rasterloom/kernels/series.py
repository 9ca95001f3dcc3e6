"""Batched series kernels: network inversion, trends, models, loop closure.  Numpy only.

A batch is (pixel, value); missing values are not finite.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from rasterloom.errors import EngineError

from .graphs import components

YEAR = 365.25
RHO, ALPHA, ROUNDS = 0.4, 1.0, 20  # fixed values of the least-absolute-deviation solver
MOST_CORRELATION = 0.98


def incidence(pairs: list[tuple[int, int]]) -> tuple[np.ndarray, list[int]]:
    """Matrix (pair, date) of -1 at the earlier and +1 at the later date, without the lowest used date; and its dates."""
    dates = sorted({d for p in pairs for d in p})
    column = {d: k - 1 for k, d in enumerate(dates)}
    out = np.zeros((len(pairs), max(len(dates) - 1, 0)))
    for row, (i, j) in enumerate(pairs):
        for d, sign in ((i, -1.0), (j, 1.0)):
            if column[d] >= 0:
                out[row, column[d]] = sign
    return out, dates[1:]


def solve_normal(design: np.ndarray, y: np.ndarray, weight: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted least squares per row of ``y``: parameters, inverse normal matrix, residuals, valid samples.

    A sample is valid with a finite value and a finite positive weight.  Rows with under ``least`` valid
    samples or a singular system have no parameters (not a number).
    """
    valid = np.isfinite(y) & np.isfinite(weight) & (weight > 0)
    w, v = np.where(valid, weight, 0.0), np.where(valid, y, 0.0)
    normal = np.einsum("pm,mi,mj->pij", w, design, design)
    scale = np.sqrt(np.maximum(np.einsum("pii->pi", normal), 1e-300))
    low = np.linalg.eigvalsh(normal / scale[:, :, None] / scale[:, None, :])[:, 0] if normal.shape[1] else np.ones(len(y))
    ok = (valid.sum(axis=1) >= least) & (low > 1e-12)
    inverse = np.full(normal.shape, np.nan)
    if ok.any():
        inverse[ok] = np.linalg.inv(normal[ok])
    x = np.einsum("pij,pj->pi", inverse, np.einsum("pm,mi,pm->pi", w, design, v))
    return x, inverse, np.where(valid, y - x @ design.T, np.nan), valid


def _inflation(residual: np.ndarray, weight: np.ndarray, valid: np.ndarray, terms: int) -> np.ndarray:
    """max(1, weighted residual sum over degrees of freedom), 1 without any."""
    spare = valid.sum(axis=1) - terms
    sse = np.nansum(np.where(valid, weight, 0.0) * np.where(valid, residual, 0.0) ** 2, axis=1)
    return np.where(spare > 0, np.maximum(1.0, sse / np.maximum(spare, 1)), 1.0)


def _rms(residual: np.ndarray, valid: np.ndarray) -> np.ndarray:
    return np.sqrt(np.where(valid, residual, 0.0).__pow__(2).sum(axis=1) / np.maximum(valid.sum(axis=1), 1))


def invert(phase: np.ndarray, pairs: list[tuple[int, int]], weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(series, variance, rms)`` per pixel of a pair network by weighted least squares; the first used date is zero.

    Variances grow with the weighted residuals where those exceed one; without parameters all are not a number.
    """
    design, _ = incidence(pairs)
    weight = np.ones_like(phase) if weight is None else weight
    x, inverse, residual, valid = solve_normal(design, phase, weight, design.shape[1])
    variance = np.einsum("pii->pi", inverse) * _inflation(residual, weight, valid, design.shape[1])[:, None]
    return x, variance, np.where(np.isfinite(x).all(axis=1), _rms(residual, valid), np.nan)


def invert_l1(phase: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """Least absolute deviations by a fixed number of splitting rounds; a missing value makes its pixel missing."""
    design, _ = incidence(pairs)
    solve = np.linalg.solve(design.T @ design, design.T)
    z, u = np.zeros_like(phase), np.zeros_like(phase)
    x = np.zeros((len(phase), design.shape[1]))
    for _ in range(ROUNDS):
        x = (phase + z - u) @ solve.T
        h = ALPHA * x @ design.T + (1 - ALPHA) * (z + phase)
        a = h - phase + u
        z = np.maximum(a - 1 / RHO, 0) - np.maximum(-a - 1 / RHO, 0)
        u = u + h - z - phase
    return np.where(np.isfinite(phase).all(axis=1)[:, None], x, np.nan)


def pair_precisions(sigma: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """1 / (variance of both dates) per pair from date deviations (pixel, date); pixels with a missing one count 1."""
    i, j = (np.array([p[k] for p in pairs], int) for k in (0, 1))
    p = 1 / np.maximum(sigma[:, i] ** 2 + sigma[:, j] ** 2, 1e-12)
    return np.where(usable(sigma)[:, None], p, 1.0)


def date_precisions(sigma: np.ndarray) -> np.ndarray:
    return np.where(usable(sigma)[:, None], 1 / np.maximum(sigma**2, 1e-12), 1.0)


def usable(sigma: np.ndarray) -> np.ndarray:
    """Pixels whose deviations are all finite."""
    return np.isfinite(sigma).all(axis=1)


def polyfit_rate(days: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Yearly slope where a weight multiplies the residual (so counts squared); a missing value gives a missing slope."""
    w = np.ones_like(y) if weight is None else weight**2
    sw, sx, sxx = w.sum(axis=1), (w * days).sum(axis=1), (w * days**2).sum(axis=1)
    sy, sxy = (w * y).sum(axis=1), (w * days * y).sum(axis=1)
    det = sw * sxx - sx**2
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(det != 0, (sw * sxy - sx * sy) / det, np.nan) * YEAR


def lag_one(residual: np.ndarray) -> np.ndarray:
    """Inflation of a deviation by lag-1 correlation of the valid residuals in order; not a number without any."""
    out = np.full(len(residual), np.nan)
    for k, row in enumerate(residual):
        r = row[np.isfinite(row)]
        if not len(r):
            continue
        r = r - r.mean()
        own = float(r @ r)
        rho = 0.0 if len(r) < 3 or own <= 0 else min(max(float(r[:-1] @ r[1:]) / own, 0.0), MOST_CORRELATION)
        out[k] = np.sqrt((1 + rho) / (1 - rho))
    return out


@dataclass(frozen=True)
class VelocityModel:
    """A line, optionally with a yearly cycle and steps at days after the first acquisition."""

    seasonal: bool = False
    steps: tuple[float, ...] = ()

    def design(self, days: np.ndarray) -> np.ndarray:
        turn = 2 * np.pi * days / YEAR
        columns = [np.ones_like(days), days, *((np.sin(turn), np.cos(turn)) if self.seasonal else ()), *((days >= s).astype(float) for s in self.steps)]
        return np.stack(columns, axis=1)


def fit_model(days: np.ndarray, y: np.ndarray, precision: np.ndarray | None, model: VelocityModel) -> dict[str, np.ndarray]:
    """Yearly rate, its deviation, lag-1 inflation, residual size and the terms of ``model`` per pixel; needs a spare sample."""
    days = np.asarray(days, float)
    design = model.design(days)
    weight = np.ones_like(y) if precision is None else precision
    x, inverse, residual, valid = solve_normal(design, y, weight, design.shape[1] + 1)
    out = {
        "velocity": x[:, 1] * YEAR, "sigma": np.sqrt(inverse[:, 1, 1] * _inflation(residual, weight, valid, design.shape[1])) * YEAR,
        "inflation": lag_one(residual), "residual_rms": np.where(np.isfinite(x[:, 0]), _rms(residual, valid), np.nan),
    }
    if model.seasonal:
        out["seasonal_amplitude"] = np.hypot(x[:, 2], x[:, 3])
        out["seasonal_peak_day"] = np.mod(np.arctan2(x[:, 2], x[:, 3]) * YEAR / (2 * np.pi), YEAR)
    for k in range(len(model.steps)):
        out[f"step_{k}"] = x[:, design.shape[1] - len(model.steps) + k]
    return out


def triplets(pairs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Positions of (i, j), (j, k), (i, k) for every closed triangle."""
    at = {p: k for k, p in enumerate(pairs)}
    return [(a, b, at[i, k]) for a, (i, j) in enumerate(pairs) for b, (j2, k) in enumerate(pairs) if j2 == j and (i, k) in at]


def loop_closure(phase: np.ndarray, pairs: list[tuple[int, int]], tolerance: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loops that fail by over ``tolerance`` cycles, loops that can be told, and the worst in cycles (missing without any)."""
    loops = np.array(triplets(pairs), int).reshape(-1, 3)
    cycles = np.abs(phase[:, loops[:, 0]] + phase[:, loops[:, 1]] - phase[:, loops[:, 2]]) / (2 * np.pi)
    told = np.isfinite(cycles)
    worst = np.where(told, cycles, -1.0).max(axis=1, initial=-1.0)
    return (told & (cycles > tolerance)).sum(axis=1), told.sum(axis=1), np.where(worst >= 0, worst, np.nan)


def mask_failed(phase: np.ndarray, failed: np.ndarray) -> np.ndarray:
    """No pair keeps its value where a loop failed."""
    return np.where((failed > 0)[:, None], np.nan, phase)


def reference_point(quality: np.ndarray, threshold: float) -> tuple[int, int] | None:
    """Pixel of the largest set over ``threshold`` nearest to its weighted centre; first set and least (row, col) win ties."""
    label, size = components(np.isfinite(quality) & (np.nan_to_num(quality) > threshold))
    if len(size) < 2:
        return None
    rows, cols = np.nonzero(label == int(np.argmax(size)))
    w = quality[rows, cols]
    far = (rows - (w * rows).sum() / w.sum()) ** 2 + (cols - (w * cols).sum() / w.sum()) ** 2
    k = min(range(len(rows)), key=lambda k: (far[k], rows[k], cols[k]))
    return int(rows[k]), int(cols[k])


def check_uncertainty_options(method: str, posterior: bool, velocity: bool, crlb: bool, correlation: bool = False) -> None:
    """Refuse settings under which the deviations asked for cannot exist."""
    if posterior and method.lower() == "l1":
        raise EngineError("posterior uncertainty needs least squares")
    if correlation and not velocity:
        raise EngineError("temporal correlation corrects the velocity uncertainty, which is off")
    if velocity and not crlb:
        raise EngineError("velocity uncertainty needs the linked deviations")

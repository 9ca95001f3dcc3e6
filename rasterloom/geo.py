"""Reference systems: WGS 84 degrees, Web Mercator and UTM zones, by closed series; other systems are refused."""

from __future__ import annotations

import math

import numpy as np

from rasterloom.errors import SourceError

A, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996  # fixed values of the ellipsoid and of UTM
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# third-order Krueger series, forward and inverse
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
DENSIFY = 21


def utm_zone(epsg: int) -> tuple[int, bool] | None:
    """Zone and whether it is southern."""
    for base, south in ((32600, False), (32700, True)):
        if base < epsg <= base + 60:
            return epsg - base, south
    return None


def to_degrees(x, y, epsg: int):
    """Longitude and latitude in degrees."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if epsg == 4326:
        return x, y
    if epsg == 3857:
        return np.degrees(x / A), np.degrees(2 * np.arctan(np.exp(y / A)) - math.pi / 2)
    zone = utm_zone(epsg)
    if zone is None:
        raise SourceError(f"reference system EPSG:{epsg} is not supported")
    xi0, eta0 = (y - (1e7 if zone[1] else 0.0)) / (SCALE * _RADIUS), (x - 5e5) / (SCALE * _RADIUS)
    xi = xi0 - sum(b * np.sin(2 * k * xi0) * np.cosh(2 * k * eta0) for k, b in enumerate(_BETA, 1))
    eta = eta0 - sum(b * np.cos(2 * k * xi0) * np.sinh(2 * k * eta0) for k, b in enumerate(_BETA, 1))
    chi = np.arcsin(np.sin(xi) / np.cosh(eta))
    lat = chi + sum(d * np.sin(2 * k * chi) for k, d in enumerate(_DELTA, 1))
    return np.degrees(np.arctan2(np.sinh(eta), np.cos(xi))) + 6 * zone[0] - 183, np.degrees(lat)


def from_degrees(lon, lat, epsg: int):
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    if epsg == 4326:
        return lon, lat
    if epsg == 3857:
        return np.radians(lon) * A, np.log(np.tan(math.pi / 4 + np.radians(lat) / 2)) * A
    zone = utm_zone(epsg)
    if zone is None:
        raise SourceError(f"reference system EPSG:{epsg} is not supported")
    phi, lam = np.radians(lat), np.radians(lon - (6 * zone[0] - 183))
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi0, eta0 = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    xi = xi0 + sum(a * np.sin(2 * k * xi0) * np.cosh(2 * k * eta0) for k, a in enumerate(_ALPHA, 1))
    eta = eta0 + sum(a * np.cos(2 * k * xi0) * np.sinh(2 * k * eta0) for k, a in enumerate(_ALPHA, 1))
    return 5e5 + SCALE * _RADIUS * eta, (1e7 if zone[1] else 0.0) + SCALE * _RADIUS * xi


def transform(x, y, source: int, target: int):
    return (np.asarray(x, float), np.asarray(y, float)) if source == target else from_degrees(*to_degrees(x, y, source), target)


def transform_bounds(bounds: tuple[float, float, float, float], source: int, target: int) -> tuple[float, float, float, float]:
    """Envelope of the box's outline in another system; its edges are cut into ``DENSIFY`` + 1 parts."""
    left, bottom, right, top = bounds
    if not (left < right and bottom < top) or not all(map(math.isfinite, bounds)):
        raise SourceError(f"bounds {bounds} are not left < right and bottom < top")
    if source == target:
        return bounds
    t = np.linspace(0, 1, DENSIFY + 2)
    x = np.concatenate([left + t * (right - left)] * 2 + [np.full_like(t, left), np.full_like(t, right)])
    y = np.concatenate([np.full_like(t, bottom), np.full_like(t, top)] + [bottom + t * (top - bottom)] * 2)
    x, y = transform(x, y, source, target)
    return float(x.min()), float(y.min()), float(x.max()), float(y.max())


def geotransform(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float, float, float]:
    """From centre coordinates of columns and rows to the upper left corner."""
    if len(x) < 2 or len(y) < 2:
        raise SourceError("coordinates of one pixel tell no posting")
    dx, dy = float(x[1] - x[0]), float(y[1] - y[0])
    return float(x[0]) - dx / 2, dx, 0.0, float(y[0]) - dy / 2, 0.0, dy


def pixel_lonlat(grid, row: float, col: float) -> tuple[float, float]:
    """Longitude and latitude of a pixel's centre."""
    lon, lat = to_degrees(grid.gt[0] + (col + 0.5) * grid.gt[1], grid.gt[3] + (row + 0.5) * grid.gt[5], grid.epsg)
    return float(lon), float(lat)


def centroid_lonlat(grid) -> tuple[float, float]:
    return pixel_lonlat(grid, grid.rows / 2 - 0.5, grid.cols / 2 - 0.5)


def corner_lonlat(grid) -> list[tuple[float, float]]:
    """Centres of the corner pixels: upper left, upper right, lower left, lower right."""
    return [pixel_lonlat(grid, r, c) for r in (0, grid.rows - 1) for c in (0, grid.cols - 1)]

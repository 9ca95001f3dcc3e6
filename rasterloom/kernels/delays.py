"""Filters, resampling and path-delay models on grids.  Numpy only."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime

import numpy as np

from rasterloom import geo
from rasterloom.errors import CorrectionError

IONOSPHERE = 40.31  # m3 / s2
# fixed values: Love and Shida numbers, radii (m), mass ratios to the Earth's, and the astronomical unit (m)
LOVE, SHIDA, EARTH = 0.6078, 0.0847, 6378136.6
MOON_MASS, SUN_MASS, UNIT = 0.0123000371, 332946.0487, 1.495978707e11
ELLIPSOID_A, ELLIPSOID_E2 = 6378137.0, 0.00669437999014
TERRESTRIAL_LEAD = 69.184  # seconds of terrestrial time ahead of UTC since 2017
J2000 = 2451545.0
OVERLAP_GATE, LEAST_OVERLAP = 1.0, 32  # degrees of the median disagreement; pixels from which it is judged


# --- filters


def high_pass(x: np.ndarray, cutoff: float, spacing: float) -> np.ndarray:
    """``x`` less its Gaussian low-pass of half power at wavelength ``cutoff``; missing values count as 0, and 0 stays 0."""
    sigma = cutoff * math.sqrt(math.log(2.0)) / (2 * math.pi) / spacing
    if sigma > min(x.shape):
        raise CorrectionError("the cutoff wavelength exceeds the image")
    filled = np.where(np.isfinite(x), x, 0.0)
    fr, fc = np.fft.fftfreq(x.shape[0]), np.fft.fftfreq(x.shape[1])
    gain = np.exp(-2 * (math.pi * sigma) ** 2 * (fr[:, None] ** 2 + fc[None] ** 2))
    return filled - np.fft.ifft2(np.fft.fft2(filled) * gain).real * (filled != 0)


def goldstein(z: np.ndarray, alpha: float = 0.5, size: int = 32) -> np.ndarray:
    """Patches weighted by their own spectrum to the power ``alpha``, half overlapping, blended by a tent.

    Samples that are missing or of phase exactly 0 give 0; a far edge short of a whole step is not reached.
    """
    empty = np.isnan(z) | (np.angle(z) == 0)
    if empty.all():
        return z.copy()
    half = size // 2
    ramp = 1 - np.abs(np.arange(half) - (half - 1)) / (half - 1)
    ramp = np.concatenate([ramp, ramp[::-1]])
    out = np.zeros(z.shape, complex)
    for i in range(0, z.shape[0] - size, half):
        for j in range(0, z.shape[1] - size, half):
            f = np.fft.fft2(z[i : i + size, j : j + size])
            out[i : i + size, j : j + size] += np.outer(ramp, ramp) * np.fft.ifft2(f * np.abs(f) ** alpha)
    out[empty] = 0
    return out


# --- resampling


def bilinear(src: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Values at fractional pixel centres, clamped at the edges."""
    low = lambda x, n: np.clip(np.floor(x), 0, n - 1).astype(int)
    r0, c0 = low(rows, src.shape[0]), low(cols, src.shape[1])
    r1, c1 = np.minimum(r0 + 1, src.shape[0] - 1), np.minimum(c0 + 1, src.shape[1] - 1)
    a, b = np.clip(rows - r0, 0, 1), np.clip(cols - c0, 0, 1)
    return (src[r0, c0] * (1 - b) + src[r0, c1] * b) * (1 - a) + (src[r1, c0] * (1 - b) + src[r1, c1] * b) * a


def resample(src: np.ndarray, src_gt: tuple, dst_gt: tuple, shape: tuple[int, int], src_epsg: int = 0, dst_epsg: int = 0) -> np.ndarray:
    """A grid on another one; in another reference system its pixel centres are transformed first, and those outside are missing."""
    y, x = np.mgrid[: shape[0], : shape[1]]
    x, y = dst_gt[0] + (x + 0.5) * dst_gt[1], dst_gt[3] + (y + 0.5) * dst_gt[5]
    if src_epsg != dst_epsg:
        if not src_epsg:
            raise CorrectionError("the source grid has no reference system")
        x, y = geo.transform(x, y, dst_epsg, src_epsg)
    cols, rows = (x - src_gt[0]) / src_gt[1] - 0.5, (y - src_gt[3]) / src_gt[5] - 0.5
    out = bilinear(src, rows, cols)
    if src_epsg != dst_epsg:
        inside = (rows >= -0.5) & (rows <= src.shape[0] - 0.5) & (cols >= -0.5) & (cols <= src.shape[1] - 0.5)
        out = np.where(inside, out, np.nan)
    return out


def require_finite(x: np.ndarray) -> np.ndarray:
    if not np.isfinite(x).all():
        raise CorrectionError("the delay grid has missing values inside the frame")
    return x


def source_window(src_gt: tuple, shape: tuple[int, int], bounds: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
    """Rows and columns of a source that bilinear values inside ``bounds`` need: one pixel more on each side."""
    c = sorted(((b - src_gt[0]) / src_gt[1] for b in (bounds[0], bounds[2])))
    r = sorted(((b - src_gt[3]) / src_gt[5] for b in (bounds[1], bounds[3])))
    out = (max(math.floor(r[0]) - 1, 0), min(math.ceil(r[1]) + 1, shape[0]), max(math.floor(c[0]) - 1, 0), min(math.ceil(c[1]) + 1, shape[1]))
    if out[0] >= out[1] or out[2] >= out[3]:
        raise CorrectionError("the source does not cover the frame")
    return out


def looks_geographic(gt: tuple) -> bool:
    """Whether a grid without a system spans degrees of longitude and latitude."""
    return abs(gt[0]) <= 181 and abs(gt[3]) <= 91 and abs(gt[1]) < 5 and abs(gt[5]) < 5


def at_heights(levels: np.ndarray, planes: np.ndarray, height: np.ndarray) -> np.ndarray:
    """Linear in height between planes (level, row, col), extended beyond the ends; a missing height takes the first plane."""
    if len(levels) == 1:
        return planes[0].copy()
    up = np.clip(np.searchsorted(levels, np.where(np.isfinite(height), height, levels[0])), 1, len(levels) - 1)
    span = levels[up] - levels[up - 1]
    w = np.where(span > 0, (height - levels[up - 1]) / np.where(span > 0, span, 1), 0.0)
    r, c = np.indices(height.shape)
    return np.where(np.isfinite(height), planes[up - 1, r, c] * (1 - w) + planes[up, r, c] * w, planes[0])


def needed_levels(levels: np.ndarray, height: np.ndarray) -> tuple[int, int]:
    """First and last level that the heights need."""
    h = height[np.isfinite(height)]
    lo = int(np.searchsorted(levels, h.min(), side="right")) - 1 if h.size else 0
    hi = int(np.searchsorted(levels, h.max())) if h.size else 0
    lo, hi = max(lo, 0), min(hi, len(levels) - 1)
    return min(lo, hi), max(lo, hi)


# --- ionosphere


@dataclass
class TecMaps:
    minutes: np.ndarray
    lats: np.ndarray
    lons: np.ndarray
    tec: np.ndarray  # (map, lat, lon) in units of 1e16 electrons per square metre

    def value(self, seconds: float, lat: float, lon: float) -> float:
        """Linear in time, latitude and longitude; clamped at the ends."""
        cube = self.tec
        for axis, x in ((self.minutes, seconds / 60), (self.lats, lat), (self.lons, lon)):
            sign = -1 if len(axis) > 1 and axis[1] < axis[0] else 1
            at = float(np.interp(sign * x, sign * axis, np.arange(len(axis)))) if len(axis) > 1 else 0.0
            k = min(int(at), max(len(axis) - 2, 0))
            cube = cube[k] if len(axis) == 1 else cube[k] + (cube[k + 1] - cube[k]) * (at - k)
        return float(cube)


def parse_ionex(text: str) -> TecMaps:
    """Maps of an IONEX file, spread evenly over the day."""
    head, _, body = text.partition("END OF HEADER")
    spec: dict[str, list[float]] = {}
    for line in head.splitlines():
        words = line.split()
        if words and words[-1] in ("DLAT", "DLON", "EXPONENT"):
            spec[words[-1]] = [float(w) for w in words[: 1 if words[-1] == "EXPONENT" else 3]]
    for name in ("DLAT", "DLON"):
        if len(spec.get(name, [])) != 3:
            raise CorrectionError(f"IONEX header lacks {name}")
    axes = [a + s * np.arange(round((b - a) / s) + 1) for a, b, s in (spec["DLAT"], spec["DLON"])]
    maps = []
    for block in body.split("START OF TEC MAP")[1:]:
        numbers: list[float] = []
        for line in block.partition("END OF TEC MAP")[0].rpartition("\n")[0].splitlines():
            if not line.strip() or line.rstrip()[-1].isalpha():
                continue
            numbers += [float(w) for w in line.split()]
        if len(numbers) != len(axes[0]) * len(axes[1]):
            raise CorrectionError(f"a TEC map has {len(numbers)} values, {len(axes[0]) * len(axes[1])} expected")
        maps.append(np.array(numbers).reshape(len(axes[0]), -1))
    if not maps:
        raise CorrectionError("no TEC maps")
    step = 1440 / (len(maps) - 1) if len(maps) > 1 else 0.0
    return TecMaps(step * np.arange(len(maps)), *axes, np.stack(maps) * 10 ** spec.get("EXPONENT", [-1.0])[0])


def ionosphere_delay(tec, incidence_deg, frequency: float):
    """Range delay in metres of a vertical content on a thin shell."""
    index = 1 + IONOSPHERE * tec * 1e16 / frequency**2
    bent = np.arcsin(np.sin(np.radians(incidence_deg)) / index)
    return tec / np.cos(bent) * 1e16 * IONOSPHERE / frequency**2


# --- solid earth tide


def julian(at: datetime) -> float:
    """Julian date of a UTC time."""
    return at.toordinal() + 1721424.5 + (at.hour * 3600 + at.minute * 60 + at.second + at.microsecond / 1e6) / 86400


def _earth_fixed(lon: float, lat: float, at: datetime, centuries: float) -> np.ndarray:
    """Unit vector of an ecliptic direction (degrees) in the rotating frame."""
    tilt, lam, beta = np.radians([23.439291 - 0.0130042 * centuries, lon, lat])
    x, y, z = math.cos(beta) * math.cos(lam), math.cos(beta) * math.sin(lam), math.sin(beta)
    y, z = y * math.cos(tilt) - z * math.sin(tilt), y * math.sin(tilt) + z * math.cos(tilt)
    turn = math.radians((280.46061837 + 360.98564736629 * (julian(at) - J2000)) % 360)
    return np.array([x * math.cos(turn) + y * math.sin(turn), y * math.cos(turn) - x * math.sin(turn), z])


# fixed values: terms (amplitude, phase, rate per century) of the almanac's low-precision series, in degrees
MOON_LON = [(6.29, 135.0, 477198.87), (-1.27, 259.3, -413335.35), (0.66, 235.7, 890534.22), (0.21, 269.9, 954397.74), (-0.19, 357.5, 35999.05), (-0.11, 186.6, 966404.03)]
MOON_LAT = [(5.13, 93.3, 483202.02), (0.28, 228.2, 960400.89), (-0.28, 318.3, 6003.15), (-0.17, 217.6, -407332.21)]
MOON_PARALLAX = [(0.0518, 135.0, 477198.85), (0.0095, 259.3, -413335.38), (0.0078, 235.7, 890534.22), (0.0028, 269.9, 954397.70)]


def moon(at: datetime) -> tuple[np.ndarray, float]:
    """Direction and distance in metres."""
    t = (julian(at) + TERRESTRIAL_LEAD / 86400 - J2000) / 36525
    series = lambda terms, f: sum(a * f(math.radians(p + r * t)) for a, p, r in terms)
    distance = EARTH / math.sin(math.radians(0.9508 + series(MOON_PARALLAX, math.cos)))
    return _earth_fixed(218.32 + 481267.881 * t + series(MOON_LON, math.sin), series(MOON_LAT, math.sin), at, t), distance


def sun(at: datetime) -> tuple[np.ndarray, float]:
    days = julian(at) + TERRESTRIAL_LEAD / 86400 - J2000
    g = math.radians(357.528 + 0.9856003 * days)
    lon = 280.460 + 0.9856474 * days + 1.915 * math.sin(g) + 0.020 * math.sin(2 * g)
    return _earth_fixed(lon, 0.0, at, days / 36525), (1.00014 - 0.01671 * math.cos(g) - 0.00014 * math.cos(2 * g)) * UNIT


def bodies(at: datetime) -> list[tuple[np.ndarray, float]]:
    """Direction and tidal scale (mass ratio times R^4 / d^3, metres) of Moon and Sun; one for a whole frame."""
    return [(d, m * EARTH**4 / r**3) for (d, r), m in ((moon(at), MOON_MASS), (sun(at), SUN_MASS))]


def geodetic_to_ecef(lon, lat, height=0.0) -> np.ndarray:
    lon, lat = np.radians(lon), np.radians(lat)
    n = ELLIPSOID_A / np.sqrt(1 - ELLIPSOID_E2 * np.sin(lat) ** 2)
    return np.stack([(n + height) * np.cos(lat) * np.cos(lon), (n + height) * np.cos(lat) * np.sin(lon), (n * (1 - ELLIPSOID_E2) + height) * np.sin(lat)], axis=-1)


def ecef_to_enu(v: np.ndarray, lon, lat) -> np.ndarray:
    lon, lat = np.radians(lon), np.radians(lat)
    x, y, z = v[..., 0], v[..., 1], v[..., 2]
    out = x * np.cos(lon) + y * np.sin(lon)
    return np.stack([y * np.cos(lon) - x * np.sin(lon), z * np.cos(lat) - out * np.sin(lat), out * np.cos(lat) + z * np.sin(lat)], axis=-1)


def tide_enu(at: datetime, lon, lat, height=0.0) -> np.ndarray:
    """East, north and up displacement in metres by the degree-2 tide."""
    s = geodetic_to_ecef(np.asarray(lon, float), np.asarray(lat, float), height)
    s = s / np.linalg.norm(s, axis=-1, keepdims=True)
    total = np.zeros_like(s)
    for d, scale in bodies(at):
        c = (s @ d)[..., None]
        total += scale * (LOVE * (3 * c * c - 1) / 2 * s + 3 * SHIDA * c * (d - c * s))
    return ecef_to_enu(total, lon, lat)


def lonlat_grid(corners: list[tuple[float, float]], shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes and latitudes between the corner pixels: upper left, upper right, lower left, lower right."""
    f = [np.arange(n) / (n - 1) if n > 1 else np.zeros(n) for n in shape]
    k = np.array(corners, float)
    mix = lambda a: (k[0, a] + f[1] * (k[1, a] - k[0, a]))[None] * (1 - f[0])[:, None] + (k[2, a] + f[1] * (k[3, a] - k[2, a]))[None] * f[0][:, None]
    return mix(0), mix(1)


def tide_delay(at: datetime, lon: np.ndarray, lat: np.ndarray, east: np.ndarray, north: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Range delay: ground that moves towards the sensor shortens the path."""
    return -(tide_enu(at, lon, lat) * np.stack([east, north, up], axis=-1)).sum(axis=-1)


# --- viewing geometry


def up_component(east: np.ndarray, north: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(1 - east**2 - north**2, 0))


def incidence_deg(up: np.ndarray) -> np.ndarray:
    return np.degrees(np.arccos(up))


def incidence_stats(up: np.ndarray) -> dict[str, float] | None:
    x = incidence_deg(up)
    x = x[np.isfinite(x)]
    return {"mean": float(x.mean()), "std": float(x.std()), "min": float(x.min()), "max": float(x.max())} if x.size else None


def mosaic_geometry(layers: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """East, north and up of the first layer that covers each pixel; (0, 0) and missing values cover nothing.

    Layers must agree where they overlap (in the upper median) and cover every pixel.
    """
    if not layers:
        raise CorrectionError("no geometry layers")
    east, north = np.zeros(layers[0][0].shape), np.zeros(layers[0][0].shape)
    covered, apart = np.zeros(east.shape, bool), []
    for e, n in layers:
        valid = np.isfinite(e) & np.isfinite(n) & ((e != 0) | (n != 0))
        both = valid & covered
        cosine = east * e + north * n + up_component(east, north) * up_component(e, n)
        apart.append(np.degrees(np.arccos(np.clip(cosine[both], -1, 1))))
        new = valid & ~covered
        east[new], north[new] = e[new], n[new]
        covered |= valid
    if not covered.all():
        raise CorrectionError(f"{int((~covered).sum())} pixels have no viewing geometry")
    angles = np.sort(np.concatenate(apart))
    if len(angles) >= LEAST_OVERLAP and angles[len(angles) // 2] > OVERLAP_GATE:
        raise CorrectionError(f"geometry layers differ by {angles[len(angles) // 2]:.3f} degrees where they overlap")
    return east, north, up_component(east, north)


def subtract_delay(series: np.ndarray, delay: np.ndarray, wavelength: float) -> np.ndarray:
    """Series (date - 1, row, col) in radians less each date's delay (date, row, col, metres) against the first date's."""
    if not wavelength > 0:
        raise CorrectionError("a positive wavelength is needed")
    if delay.shape != (series.shape[0] + 1, *series.shape[1:]):
        raise CorrectionError(f"delays {delay.shape} do not fit the series {series.shape}")
    return series + (delay[1:] - delay[0]) * (4 * math.pi / wavelength)


def sum_layers(layers: list[np.ndarray | None]) -> np.ndarray | None:
    present = [x for x in layers if x is not None]
    return sum(present[1:], present[0].copy()) if present else None


def seconds_of_day(name: str) -> float:
    """Time stamped into a name as YYYYMMDDThhmmss, noon without one."""
    import re

    for m in re.finditer(r"(?=(\d{8}T\d{6}))", name.rsplit("/", 1)[-1]):
        try:
            t = datetime.strptime(m[1], "%Y%m%dT%H%M%S")
        except ValueError:
            continue
        return t.hour * 3600.0 + t.minute * 60 + t.second
    return 43200.0

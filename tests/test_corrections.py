"""Filters, resampling, delays and viewing geometry against plain formulas."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.errors import CorrectionError
from rasterloom.kernels import delays as k
from rasterloom.operators import corrections as c

IONEX = """     2                                                      # OF MAPS
    10.0   -10.0   -10.0                                    LAT1 / LAT2 / DLAT
     0.0    20.0    20.0                                    LON1 / LON2 / DLON
    -1                                                      EXPONENT
END OF HEADER
     1                                                      START OF TEC MAP
    10.0 0.0 20.0 20.0 450.0                                LAT/LON1/LON2/DLON/H
   10   20
     0.0 0.0 20.0 20.0 450.0                                LAT/LON1/LON2/DLON/H
   30   40
   -10.0 0.0 20.0 20.0 450.0                                LAT/LON1/LON2/DLON/H
   50   60
     1                                                      END OF TEC MAP
     2                                                      START OF TEC MAP
   110  120
   130  140
   150  160
     2                                                      END OF TEC MAP
"""


def test_ionex_maps():
    m = k.parse_ionex(IONEX)
    assert m.lats.tolist() == [10, 0, -10] and m.lons.tolist() == [0, 20] and m.minutes.tolist() == [0, 1440]
    assert m.value(0, 10, 0) == 1.0 and m.value(86400, -10, 20) == 16.0
    assert m.value(43200, 5, 10) == pytest.approx((1 + 2 + 3 + 4) / 4 + 5)
    assert m.value(-5, 90, -90) == 1.0 and m.value(1e9, -90, 99) == 16.0
    for bad in ("no header", IONEX.replace("DLAT", "XLAT"), IONEX.replace("   10   20\n", "   10\n"), IONEX.partition("END OF HEADER")[0] + "END OF HEADER\n"):
        with pytest.raises(CorrectionError):
            k.parse_ionex(bad)


def test_ionosphere_and_levels():
    assert k.ionosphere_delay(10.0, 0.0, 5.4e9) == pytest.approx(10 * 1e16 * 40.31 / 5.4e9**2)
    assert k.ionosphere_delay(10.0, 40.0, 5.4e9) > k.ionosphere_delay(10.0, 10.0, 5.4e9)
    levels, planes = np.array([0.0, 100, 300]), np.stack([np.full((1, 5), v) for v in (3.0, 2.0, 1.0)])
    got = k.at_heights(levels, planes, np.array([[50.0, 200, -100, 500, np.nan]]))
    assert got.tolist() == [[2.5, 1.5, 4.0, 0.0, 3.0]]
    assert k.needed_levels(levels, np.array([120.0, 250])) == (1, 2) and k.needed_levels(levels, np.array([-5.0, 20])) == (0, 1)
    assert k.at_heights(levels[:1], planes[:1], np.zeros((1, 5))).tolist() == [[3.0] * 5]


def test_resampling():
    src = np.arange(12.0).reshape(3, 4)
    gt = (0.0, 10.0, 0.0, 30.0, 0.0, -10.0)
    assert np.allclose(k.resample(src, gt, gt, (3, 4)), src)
    fine = k.resample(src, gt, (0.0, 5.0, 0.0, 30.0, 0.0, -5.0), (6, 8))
    assert fine[0, 0] == 0 and fine[-1, -1] == 11 and fine[1, 1] == pytest.approx(0.25 + 1.0)
    deg = (-118.0, 0.5, 0.0, 36.0, 0.0, -0.5)
    lat = np.repeat(np.linspace(35.75, 33.25, 6)[:, None], 6, 1)
    out = k.resample(lat, deg, (420000.0, 1000.0, 0.0, 3850000.0, 0.0, -1000.0), (20, 20), 4326, 32611)
    assert np.isfinite(out).all() and out[0, 0] > out[-1, 0] and out[0, 0] == pytest.approx(34.78, abs=0.02)
    assert np.isnan(k.resample(lat, deg, (900000.0, 1000.0, 0.0, 3850000.0, 0.0, -1000.0), (2, 2), 4326, 32611)).all()
    with pytest.raises(CorrectionError):
        k.resample(lat, deg, deg, (2, 2), 0, 32611)
    with pytest.raises(CorrectionError):
        k.require_finite(np.array([1.0, np.nan]))
    assert k.source_window(gt, (30, 40), (55.0, -80.0, 95.0, -41.0)) == (6, 12, 4, 11)
    with pytest.raises(CorrectionError):
        k.source_window(gt, (3, 4), (5000.0, 0.0, 6000.0, 30.0))
    assert k.looks_geographic(deg) and not k.looks_geographic((4e5, 30.0, 0, 4e6, 0, -30.0))


def test_filters():
    y, x = np.mgrid[:64, :64]
    short, long = np.sin(2 * np.pi * x / 4), np.sin(2 * np.pi * x / 64)
    out = k.high_pass(short + long + 5.0, 32.0, 1.0)
    assert np.abs(out - short).max() < 0.15
    # half power at the cutoff
    wave = np.sin(2 * np.pi * x / 16)
    assert np.std(wave - k.high_pass(wave + 1e-9, 16.0, 1.0)) / np.std(wave) == pytest.approx(0.5**0.5, abs=0.01)
    gap = (short + 5.0).copy()
    gap[3, 3] = np.nan
    assert k.high_pass(gap, 32.0, 1.0)[3, 3] == 0
    with pytest.raises(CorrectionError):
        k.high_pass(short, 1e6, 1.0)
    rng = np.random.default_rng(0)
    clean = np.exp(1j * 0.2 * x)
    noisy = clean * np.exp(1j * rng.normal(0, 0.8, x.shape))
    noisy[5, 5] = np.nan
    noisy = np.where(np.isnan(noisy), 0, noisy)
    got = k.goldstein(noisy, 0.9, 16)
    inner = (slice(8, 40), slice(8, 40))
    error = lambda z: np.abs(np.angle(z[inner] * clean[inner].conj()))
    assert error(got).mean() < 0.6 * error(noisy).mean() and got[5, 5] == 0 and (got[-1] == 0).all()
    assert (k.goldstein(np.ones((8, 8), complex), 0.5, 4) == 1).all()


def test_tide():
    at = datetime(2024, 1, 15, 6, 30)
    assert k.julian(datetime(2000, 1, 1, 12)) == 2451545.0
    (m, dm), (s, ds) = k.moon(at), k.sun(at)
    assert np.linalg.norm(m) == pytest.approx(1) and 3.5e8 < dm < 4.1e8 and 1.47e11 < ds < 1.53e11
    # at 6:30 UTC the Sun stands some 98 degrees west of noon at Greenwich, south of the equator in January
    assert np.degrees(np.arctan2(s[1], s[0])) == pytest.approx(84.8, abs=1) and np.degrees(np.arcsin(s[2])) == pytest.approx(-21.2, abs=0.3)
    # overhead, the radial shift is h2 times the scale
    lat, lon = np.degrees(np.arctan2(m[2] / (1 - k.ELLIPSOID_E2), np.hypot(m[0], m[1]))), np.degrees(np.arctan2(m[1], m[0]))
    up = k.tide_enu(at, lon, lat)[2]
    assert 0.1 < up < 0.45
    lons, lats = k.lonlat_grid([(0, 10), (2, 10), (0, 8), (2, 8)], (3, 2))
    assert lons.tolist() == [[0, 2]] * 3 and lats[:, 0].tolist() == [10, 9, 8]
    vertical = k.tide_delay(at, lons, lats, 0 * lons, 0 * lons, 1 + 0 * lons)
    assert np.allclose(vertical, -k.tide_enu(at, lons, lats)[..., 2])
    xyz = k.geodetic_to_ecef(0.0, 90.0)
    assert xyz[2] == pytest.approx(6356752.314, abs=1e-3)
    assert np.allclose(k.ecef_to_enu(np.array([0.0, 0, 1]), 0.0, 90.0), [0, 0, 1], atol=1e-12)


def test_tide_columns_equal_the_kernel(spark):
    at = datetime(2024, 5, 3, 17, 5, 9)
    rng = np.random.default_rng(1)
    rows = [tuple(map(float, r)) for r in np.stack([rng.uniform(-180, 180, 20), rng.uniform(-80, 80, 20), *(rng.uniform(-0.5, 0.5, (2, 20))), rng.uniform(0.5, 1, 20)], 1)]
    got = c.tide_delay(spark.createDataFrame(rows, "lon double, lat double, east double, north double, up double"), at).collect()
    for r in got:
        assert r["tide_delay"] == pytest.approx(float(k.tide_delay(at, r["lon"], r["lat"], r["east"], r["north"], r["up"])), abs=1e-12)


def test_geometry(spark):
    e, n = np.full((6, 8), 0.5), np.full((6, 8), -0.1)
    left, right = (e.copy(), n.copy()), (e.copy(), n.copy())
    left[0][:, 6:] = left[1][:, 6:] = 0
    right[0][:, :2] = np.nan
    east, north, up = k.mosaic_geometry([left, right])
    assert np.allclose(up, np.sqrt(1 - 0.26)) and (east == 0.5).all()
    with pytest.raises(CorrectionError):
        k.mosaic_geometry([left])
    with pytest.raises(CorrectionError):
        k.mosaic_geometry([])
    with pytest.raises(CorrectionError):
        k.mosaic_geometry([(e, n), (-e, n)])
    assert k.incidence_stats(up)["std"] == pytest.approx(0) and k.incidence_stats(np.full(2, np.nan)) is None
    flat = lambda g, layer: [(g, r, q, float(layer[0][r, q]), float(layer[1][r, q])) for r in range(6) for q in range(8)]
    frame = lambda rows: spark.createDataFrame(rows, "granule int, row long, col long, east double, north double")
    found = c.check_geometry(c.mosaic_geometry(frame(flat(0, left) + flat(1, right))), 48)
    assert found.count() == 48 and found.where("apart IS NOT NULL").count() == 24
    with pytest.raises(CorrectionError):
        c.check_geometry(c.mosaic_geometry(frame(flat(0, left))), 48)
    with pytest.raises(CorrectionError):
        c.check_geometry(c.mosaic_geometry(frame(flat(0, (e, n)) + flat(1, (-e, n)))), 48)


def test_delays(spark):
    series, delay = np.zeros((2, 1, 1)), np.array([0.01, 0.02, 0.005]).reshape(3, 1, 1)
    got = k.subtract_delay(series, delay, 0.05)
    assert got.ravel() == pytest.approx([0.01 * 4 * np.pi / 0.05, -0.005 * 4 * np.pi / 0.05])
    for bad in (0.0, float("nan")):
        with pytest.raises(CorrectionError):
            k.subtract_delay(series, delay, bad)
        with pytest.raises(CorrectionError):
            c.subtract_delay(None, None, [], bad)
    with pytest.raises(CorrectionError):
        k.subtract_delay(series, delay[:2], 0.05)
    assert k.sum_layers([None, None]) is None and k.sum_layers([np.ones(1), None, np.ones(1)])[0] == 2
    assert k.seconds_of_day("/x/S1_20240115T063005_a.h5") == 6 * 3600 + 30 * 60 + 5 and k.seconds_of_day("a_20240115") == 43200
    grid = spark.createDataFrame([(0, 0, 1.0), (0, 1, None)], "row long, col long, value double")
    with pytest.raises(CorrectionError):
        c.require_finite(grid)
    assert c.require_finite(grid.where("col = 0")).count() == 1
    one = spark.createDataFrame([(0, 0, 7.0)], "sr long, sc long, value double")
    p = spark.createDataFrame([(1, -3.0), (2, 9.0)], "id int, x double")
    assert {r["value"] for r in c.interpolated(p, ["id"], [(F.col("x"), 1), (F.col("x"), 1)], one, ["sr", "sc"], "value").collect()} == {7.0}

"""Blocks, tiles, frames, areas, dates, settings and reference systems."""

from datetime import date

import numpy as np
import pytest

from rasterloom import config, geo
from rasterloom.errors import BoundsError, ConfigError, SourceError
from rasterloom.plans import blocks as b

UTM = 32611


def grid(x=500000.0, y=4000000.0, rows=40, cols=50, d=30.0, epsg=UTM):
    return b.Grid(epsg, (x, d, 0.0, y, 0.0, -d), rows, cols)


@pytest.mark.parametrize("case", [((100, 64), (24, 20), (0, 0)), ((7, 9), (3, 4), (1, 2)), ((5, 5), (10, 10), (2, 2))])
def test_blocks_cover_everything(case):
    seen = np.zeros(case[0], int)
    for x in b.iter_blocks(*case):
        seen[x.r0 : x.r1, x.c0 : x.c1] += 1
    assert seen.min() == 1 and (case[2] != (0, 0) or seen.max() == 1)
    assert b.iter_blocks((5, 5), (0, 3)) == [] and b.iter_blocks((0, 5), (2, 2)) == []
    with pytest.raises(ConfigError):
        b.iter_blocks((5, 5), (2, 2), (2, 0))


@pytest.mark.parametrize("strides,half", [((1, 1), (2, 3)), ((2, 3), (5, 7)), ((3, 6), (4, 11))])
def test_strided_blocks_cover_the_inside_once(strides, half):
    shape = (100, 96)
    out = b.out_shape(shape, strides)
    seen, margin = np.zeros(out, int), None
    for x in b.strided_blocks(shape, (30, 36), strides, half):
        seen[x.out.r0 : x.out.r1, x.out.c0 : x.out.c1] += 1
        margin = x.trim
        assert x.full_trim.shape == x.plain.shape and x.padded.r0 + x.full_trim.r0 == x.plain.r0
    want = np.zeros(out, int)
    want[margin[0] : out[0] - margin[0], margin[1] : out[1] - margin[1]] = 1
    assert (seen == want).all()


@pytest.mark.parametrize("depth", [1, 3])
@pytest.mark.parametrize("strides,half", [((1, 1), (3, 2)), ((2, 3), (5, 7))])
def test_tiles_hold_their_windows(depth, strides, half):
    shape = (101, 98)
    seen = np.zeros(b.out_shape(shape, strides), int)
    for t in b.plan_tiles(shape, strides, half, depth, (16, 11)):
        seen[t.out.r0 : t.out.r1, t.out.c0 : t.out.c1] += 1
        assert t.read.r0 % strides[0] == 0 and t.read.shape[0] % strides[0] == 0
        assert t.local[0] == t.out.r0 - t.read.r0 // strides[0]
        for g in (t.out.r0, t.out.r1 - 1):
            lo = min(max(strides[0] // 2 + g * strides[0] - half[0], 0), shape[0] - 2 * half[0] - 1)
            assert t.read.r0 <= lo and min(lo + 2 * half[0] + 1, shape[0] // strides[0] * strides[0]) <= t.read.r1
    assert (seen == 1).all()


def test_frames_areas_and_coverage():
    left, right = grid(), grid(x=500000.0 + 30 * 45, y=4000000.0 - 30 * 5)
    frame = b.frame_grid([left, right])
    assert frame.shape == (45, 95) and b.burst_offset(frame, right) == (5, 45)
    area = (500000 + 30 * 40.5, 4000000 - 30 * 30.2, 500000 + 30 * 60, 4000000 - 30 * 9.9)
    plan = b.plan_bounds(area, UTM, [left, right], (2, 3))
    assert plan.target == b.Block(9, 31, 40, 60) and plan.analysis == b.Block(7, 33, 37, 63)
    assert plan.windows == [b.Block(7, 33, 37, 50), b.Block(2, 28, 0, 18)] and plan.target_in_analysis == b.Block(2, 24, 3, 23)
    assert b.plan_bounds(None, UTM, [left], (0, 0)) is None
    assert b.analysis_reference((10, 40), plan.analysis) == (3, 3)
    for bad in ((0, 0, 10, 10), (500000, 3999990, 500010, 3999995)):
        with pytest.raises(BoundsError):
            b.plan_bounds(bad, UTM, [left, right], (0, 0))
    with pytest.raises(BoundsError):  # the corner that no burst covers
        b.plan_bounds((500000 + 30 * 60, 4000000 - 30 * 20, 500000 + 30 * 80, 4000000), UTM, [left, right], (0, 0))
    with pytest.raises(BoundsError):
        b.frame_grid([left, grid(x=500010.0)])
    with pytest.raises(BoundsError):
        b.frame_grid([left, grid(epsg=32612)])
    with pytest.raises(BoundsError):
        b.analysis_reference((0, 0), plan.analysis)
    with pytest.raises(BoundsError):
        b.validate_coverage([left, grid(x=500000.0 + 30 * 50)], b.frame_grid([left, grid(x=500000.0 + 30 * 50)]), b.Block(0, 40, 0, 100))
    assert b.analysis_halo((2, 3), (5, 7), 30, 15, (16, 16), 2) == (6 + 18, 6 + 18)
    assert frame.part(b.Block(2, 12, 3, 9), (2, 3)).gt == (500090.0, 90.0, 0.0, 3999940.0, 0.0, -60.0)
    assert b.unwrap_tiles((200, 63)) == (3, 1) and b.unwrap_tiles((2048, 512), True, 3) == (3, 1)
    with pytest.raises(SourceError):
        b.require_grid(grid(epsg=0))


def test_dates():
    assert b.parse_date("/a/t1_x20221119_20230101.h5") == date(2022, 11, 19)
    assert b.parse_date("f2022-11-19.h5", "%Y-%m-%d") == date(2022, 11, 19)
    assert b.decimal_days(["b_20200110", "a_20200101"]) == [0.0, -9.0]
    for bad in ("no date", "99999999"):
        with pytest.raises(SourceError):
            b.parse_date(bad)
    assert b.step_days(["2020-02-01"], date(2020, 1, 1)) == (31.0,)
    with pytest.raises(ConfigError):
        b.step_days(["2020-13-01"], date(2020, 1, 1))


def test_settings():
    d = config.parse("")
    assert d.phase_linking.half_window.rows_cols() == (7, 14) and d.interferogram_network.resolved().reference_idx == 0
    got = config.parse("unknown: 1\nphase_linking: {ministack_size: 10, beta: 1, half_window: {x: 3, y: 2}}\ninterferogram_network: {max_bandwidth: 2}\n")
    assert got.phase_linking.ministack_size == 10 and got.phase_linking.beta == 1.0 and got.interferogram_network.resolved().reference_idx is None
    assert config.parse(config.dump(got)) == got
    for bad in ("a: [", "phase_linking: {ministack_size: x}", "phase_linking: {shp_method: best}", "phase_linking: 3", "unwrap_options: {run_interpolation: true}", "cslc_file_list: 3"):
        with pytest.raises(ConfigError):
            config.parse(bad)


def test_reference_systems():
    x, y = geo.from_degrees(-117.0, 0.0, 32611)
    assert (x, y) == pytest.approx((500000.0, 0.0), abs=1e-6)
    # meridian arc to 45 degrees, times the scale
    assert geo.from_degrees(-117.0, 45.0, 32611)[1] == pytest.approx(4984944.378 * 0.9996, abs=0.01)
    rng = np.random.default_rng(0)
    for epsg, lon, lat in ((32611, rng.uniform(-120, -114, 50), rng.uniform(0, 80, 50)), (32733, rng.uniform(12, 18, 50), rng.uniform(-80, 0, 50)), (3857, rng.uniform(-180, 180, 50), rng.uniform(-80, 80, 50))):
        back = geo.to_degrees(*geo.from_degrees(lon, lat, epsg), epsg)
        assert np.allclose(back[0], lon, atol=1e-9) and np.allclose(back[1], lat, atol=1e-9)
    box = geo.transform_bounds((-118.0, 34.0, -117.0, 35.0), 4326, 32611)
    assert box[0] < 410000 and box[1] < 3763500 and box[3] > 3873000
    assert geo.transform_bounds((0, 0, 1, 1), 4326, 4326) == (0, 0, 1, 1)
    for bad in ((1, 0, 0, 1), (0, 0, float("nan"), 1)):
        with pytest.raises(SourceError):
            geo.transform_bounds(bad, 4326, 32611)
    with pytest.raises(SourceError):
        geo.to_degrees(0, 0, 2154)
    assert geo.geotransform(np.array([5.0, 15]), np.array([95.0, 85])) == (0.0, 10.0, 0.0, 100.0, 0.0, -10.0)
    g = grid()
    assert geo.centroid_lonlat(g)[0] == pytest.approx(geo.to_degrees(500750, 3999400, UTM)[0]) and len(geo.corner_lonlat(g)) == 4

"""Mosaics, masks, provenance and station scores on edge rows with expected values from formulas."""

import json
import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.errors import EngineError, SourceError, StitchError
from rasterloom.kernels import neighbours as shp
from rasterloom.operators import mosaic as m
from rasterloom.operators import provenance as p
from rasterloom.operators import validation as v

NAN = float("nan")


def burst(spark, cols, turn, quality=0.9, epochs=2):
    rows = [(r, c, t, math.cos(0.3 * t + 0.1 * c + turn[t]), math.sin(0.3 * t + 0.1 * c + turn[t]), quality) for r in range(3) for c in cols for t in range(epochs)]
    return spark.createDataFrame(rows, "row long, col long, epoch int, re double, im double, quality double")


def test_bursts_are_levelled_and_stitched(spark):
    out = m.stitch([burst(spark, range(0, 5), [0, 0]), burst(spark, range(3, 9), [0.7, -0.4])], 2)
    got = out.collect()
    assert len(got) == 3 * 9 * 2
    for r in got:
        assert math.atan2(r["im"], r["re"]) == pytest.approx(0.3 * r["epoch"] + 0.1 * r["col"], abs=1e-9)
    with pytest.raises(StitchError) as e:
        m.stitch([burst(spark, range(0, 5), [0, 0]), burst(spark, range(4, 9), [0, 0])], 2)
    assert (e.value.burst, e.value.epoch, e.value.found, e.value.required) == (1, 0, 3, 4)
    with pytest.raises(StitchError):
        m.stitch([burst(spark, range(0, 5), [0, 0]), burst(spark, range(0, 5), [0, 0], 0.4)], 2)


def test_masks_and_gaps(spark):
    rows = [(0, 0, 1.0), (0, 1, NAN), (0, 2, None), (0, 3, float("inf"))]
    layer = spark.createDataFrame(rows, "row long, col long, quality double")
    assert [r["corr"] for r in m.analysis_correlation(layer).orderBy("col").collect()] == [1.0, 0, 0, 0]
    keep = spark.createDataFrame([(0, 0, 0)], "row long, col long, keep int")
    assert m.analysis_correlation(layer, keep).agg(F.max("corr")).first()[0] == 0
    two = spark.createDataFrame([(0, "a", 1.0), (0, "b", NAN), (1, "a", NAN), (1, "b", None)], "k int, layer string, y double")
    assert {(r["k"], r["y"]) for r in m.mean_of_finite(two, ["k"], "y").collect()} == {(0, 1.0), (1, None)}
    assert [(r["k"], r["y"]) for r in m.paste(two, ["k"], "y", "layer").collect()] == [(0, 1.0)]
    cover = m.coverage(spark.createDataFrame([(0, 0, [1.0, NAN]), (0, 1, [1.0, 2.0]), (0, 9, [None, 1.0])], "row long, col long, z array<double>"), 8).orderBy("tc").collect()
    assert [(r["pixels"], r["complete"], r["linked"]) for r in cover] == [(2, 1, True), (1, 0, False)]


def test_persistent_selection_drops_missing_samples(spark):
    data = [(1, t, 1.0 + 0.01 * (t % 2)) for t in range(15)] + [(1, 15, NAN)] + [(2, t, 1.0) for t in range(14)] + [(3, t, 0.0) for t in range(20)] + [(4, t, float(t % 2)) for t in range(20)]
    got = {r["user_id"]: (r["flag"], r["dispersion"]) for r in m.select_persistent(spark.createDataFrame(data, "user_id long, t int, y double")).collect()}
    assert got[1][0] == 1 and got[2] == (255, 0) and got[3] == (255, 0) and got[4] == (0, 1.0)


@pytest.mark.parametrize("method", ["ks", "glrt"])
def test_neighbours_over_tiles_equal_the_kernel(spark, method):
    rng = np.random.default_rng(2)
    amp = rng.rayleigh(1.0, (12, 9, 8))
    amp[:, :, 4:] *= 5
    z = np.zeros((9, 8, 24))
    z[:, :, 0::2] = amp.transpose(1, 2, 0)
    stack = spark.createDataFrame([(r, c, z[r, c].tolist()) for r in range(9) for c in range(8)], "row long, col long, z array<double>")
    want = shp.ks(amp, (1, 1), alpha=0.05) if method == "ks" else shp.glrt(amp.mean(0), amp.var(0), 12, (1, 1), alpha=0.05)
    for r in m.neighbours(stack, (9, 8), method, epochs=12, tile=4).collect():
        assert r["places"] == np.flatnonzero(want[r["row"], r["col"]]).tolist()


def granules(spark, **change):
    t = datetime(2024, 1, 1)
    orbit = [(float(s), 7e6, 1000.0 * s, 0.0, 0.0, 10.0, 7500.0) for s in (0, 10, 20)]
    base = dict(name="a", direction="Ascending", burst="T144-308011-IW2", start=t.replace(second=4), stop=t.replace(second=8), epoch=t, range_m=2.3, interval_s=0.002, lon=0.0, lat=0.0, orbit=orbit)
    rows = [base, base | {"name": "b", "direction": "ASCENDING"} | change]
    return spark.createDataFrame([tuple(r.values()) for r in rows], p.GRANULE)


def test_provenance_of_agreeing_granules(spark):
    inc = spark.createDataFrame([(38.0, 1.0, 30.0, 46.0)], "mean_deg double, std_deg double, min_deg double, max_deg double")
    g = granules(spark)
    found = p.assemble(g, inc)
    r = found.first()
    assert r["heading_deg"] == pytest.approx(math.degrees(math.atan2(10, 7500))) and r["direction"] == "ascending" and r["time_of_day_s"] == 6.0
    assert r["azimuth_spacing_m"] == pytest.approx(0.002 * math.hypot(10, 7500) * 6378137.0 / math.hypot(7e6, 6000)) and r["complete"]
    assert json.loads(p.document(found))["fields"]["heading_deg"] == "sourced"
    static = g.limit(1).withColumn("burst", F.lit("t144_1_iw1"))
    assert p.assemble(g, inc, static).first()["complete"]
    wrong = p.assemble(g, inc, static.withColumn("burst", F.lit("t7_1_iw1"))).first()
    assert not wrong["complete"] and wrong["mean_deg"] is None and wrong["fields"]["mean_deg"] == "absent"
    assert p.mismatched(static.withColumn("direction", F.lit("descending")), g).count() == 1


@pytest.mark.parametrize("change,field", [({"direction": "descending"}, "direction"), ({"direction": "up"}, "direction"), ({"start": datetime(2024, 1, 1, 1), "stop": datetime(2024, 1, 1, 1)}, "heading_deg"),
                                          ({"range_m": 2.4}, "range_spacing_m"), ({"range_m": NAN}, "range_spacing_m"), ({"interval_s": 0.003}, "azimuth_spacing_m"), ({"orbit": []}, "time_of_day_s"), ({"orbit": [(float(s), 7e6, 0.0, 0.0, 0.0, 500.0, 7483.3) for s in (0, 20)]}, "heading_deg")])
def test_disagreeing_granules_have_no_value(spark, change, field):
    inc = spark.createDataFrame([(38.0, 1.0, 30.0, 46.0)], "mean_deg double, std_deg double, min_deg double, max_deg double")
    assert p.assemble(granules(spark, **change), inc).first()[field] is None


def test_station_files(spark):
    line = lambda day, east, name="P001": f"{name} {day} 2020.0 58849 2086 3 -117.5 100 {east} 200 0.25 300 0.5 0.0 0.001 0.002 0.003 0 0 0 35.0 -117.5 700.0"
    read = lambda *x: v.parse_tenv3(spark.createDataFrame([(s,) for s in x], "value string"))
    got = read("site YYMMMDD yyyy.yyyy", line("20JAN02", 0.75), "", line("20JAN01", 0.5)).collect()
    assert [str(r["date"]) for r in got] == ["2020-01-01", "2020-01-02"] and got[0]["east_m"] == 100.5 and got[0]["sigma_u_m"] == 0.003
    for bad in ((), ("P001 20JAN01 1",), (line("20JAN01", "x"),), (line("20XXX01", 1),), (line("20JAN01", 1), line("20JAN01", 2)), (line("20JAN01", 1), line("20JAN02", 2, "P002"))):
        with pytest.raises(SourceError):
            read(*bad)


def test_alignment_and_projection(spark):
    rec = spark.createDataFrame([("s", 0, 1.0), ("s", 4, 3.0), ("s", 20, 5.0)], "station string, t int, y double")
    ask = spark.createDataFrame([("s", t) for t in (-1, 0, 1, 4, 10, 21)], "station string, t int")
    got = {r["t"]: (r["y"], r["kind"]) for r in v.align(rec, ask, ["station"], ["y"], 5).collect()}
    assert got == {-1: (None, None), 0: (1.0, "exact"), 1: (1.5, "interpolated"), 4: (3.0, "exact"), 10: (None, None), 21: (None, None)}
    with pytest.raises(EngineError):
        v.align_all(rec, ask, ["station"], ["y"], 5)
    for bad in ((1.0, 1.0, 0.0), (NAN, 0.0, 1.0)):
        with pytest.raises(EngineError):
            v.project(F.lit(1.0), F.lit(1.0), F.lit(1.0), bad)
    a = spark.createDataFrame([(0, 1.0), (1, 4.0)], "t int, y double")
    assert [r["y"] for r in v.spatial_difference(a, a.where("t = 1"), "y").collect()] == [0.0]
    with pytest.raises(EngineError):
        v.window_sample(rec, ask, 4, 0.5, (9, 9))


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=30))
    y = 0.9 * x + rng.normal(0, 0.2, 30) + 2
    rows = [(1, t, float(x[t]), float(y[t])) for t in range(30)] + [(2, 0, 1.0, 1.0), (3, 0, 0.0, 1.0), (3, 1, 1.0, 1.0), (3, 2, 2.0, 1.0)]
    got = {r["k"]: r for r in v.fit_metrics(spark.createDataFrame(rows, "k int, t int, truth double, estimate double"), "k").collect()}
    _, _, vh = np.linalg.svd(np.column_stack([x - x.mean(), y - y.mean()]), full_matrices=False)
    assert got[1]["tls_slope"] == pytest.approx(vh[0, 1] / vh[0, 0]) and got[1]["ols_slope"] == pytest.approx(np.polyfit(x, y, 1)[0])
    assert got[1]["correlation"] == pytest.approx(np.corrcoef(x, y)[0, 1]) and got[1]["endpoint_residual"] == pytest.approx(y[-1] - x[-1])
    assert 2 not in got and got[3]["correlation"] is None and got[3]["tls_slope"] == 0
    res = spark.createDataFrame([(1, 1.0, 1.0), (1, 5.0, 1.0), (1, NAN, 1.0), (1, 1.0, 0.0), (1, None, 1.0)], "k int, residual double, sigma double")
    r = v.interval_scores(res, ["k"], {"90": v.LEVELS["90"]}).first()
    assert (r["evaluated"], r["abstained"], r["coverage"]) == (2, 3, 0.5) and r["score"] == pytest.approx(2 * v.Z90 + (5 - v.Z90) * 20 / 2)
    many = rng.normal(size=17)
    scale = v.burst_scale(spark.createDataFrame([(1, float(z), 1.0) for z in many], "b int, residual double, sigma double"), "b").first()["scale"]
    assert scale == pytest.approx(np.quantile(np.abs(many) / v.Z90, 0.9, method="higher"))


def test_cohort_is_calibrated_on_the_other_bursts(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(0, 2, (6, 20))
    rows = [(b, name, float(z[b, t]), s) for b in range(6) for t in range(20) for name, s in (("crlb_only", 1.0), ("posterior_only", 0.1))]
    df = spark.createDataFrame(rows, "burst int, method string, residual double, sigma double")
    got = {r["burst"]: r for r in v.cohort_score(df).collect()}
    scales = [np.quantile(np.abs(z[b]) / v.Z90, 0.9, method="higher") for b in range(6)]
    for b in range(6):
        assert got[b]["method"] == "crlb_only" and got[b]["scale"] == pytest.approx(np.median([s for k, s in enumerate(scales) if k != b]))
    assert v.cohort_score(df.where("burst < 4")).count() == 0


def test_station_pairs_near_the_pole_and_the_date_line(spark):
    rng = np.random.default_rng(1)
    lat = np.concatenate([rng.uniform(-90, 90, 150), rng.uniform(89.5, 90, 20), np.full(20, 10.0) + rng.uniform(0, 0.2, 20)])
    lon = np.concatenate([rng.uniform(-180, 180, 150), rng.uniform(-180, 180, 20), np.where(rng.random(20) < 0.5, 179.95, -179.95)])
    df = spark.createDataFrame([(k, float(a), float(o)) for k, (a, o) in enumerate(zip(lat, lon))], "id int, lat double, lon double")
    got = {(r["a"], r["b"]) for r in v.station_pairs(df, 1.0, 30.0).collect()}
    f, g = np.radians(lat), np.radians(lon)
    d = 2 * v.EARTH_KM * np.arcsin(np.sqrt(np.sin((f[:, None] - f) / 2) ** 2 + np.cos(f)[:, None] * np.cos(f) * np.sin((g[:, None] - g) / 2) ** 2))
    assert got == {(i, j) for i in range(len(f)) for j in range(i + 1, len(f)) if 1 <= d[i, j] <= 30} and len(got) > 50


def uses(df, name):
    return df._jdf.queryExecution().optimizedPlan().toString().count(name + "(")


def test_an_orbit_is_searched_once_a_row(spark):
    orbit = [(float(t), 7e6, 10.0 * t, 0.0, 100.0, 7500.0, float(t)) for t in range(0, 70, 10)]
    when = datetime(2024, 1, 15, 6, 30)
    rows = [(f"g{k}", "ascending", "T1-1-IW2", when.replace(second=k), when.replace(second=k + 3), when, 2.3, 0.002, 0.1, 1.5, o) for k, o in ((20, orbit), (40, orbit), (20, orbit[:1]), (20, []), (20, None))]
    found = p.granule_geometry(spark.createDataFrame(rows, p.GRANULE))
    assert uses(found, "filter") == 1
    got = found.select("heading", "azimuth_m", "time_of_day").collect()
    assert [r["heading"] is not None for r in got] == [True, True, False, False, False]
    for r, t in zip(got, (21.5, 41.5)):
        v, pos, lon, lat = (100.0, 7500.0, t), (7e6, 10 * t, 0.0), math.radians(0.1), math.radians(1.5)
        east, north = v[1] * math.cos(lon) - v[0] * math.sin(lon), v[2] * math.cos(lat) - math.sin(lat) * (v[0] * math.cos(lon) + v[1] * math.sin(lon))
        assert r["heading"] == pytest.approx(math.degrees(math.atan2(east, north)) % 360) and r["time_of_day"] == 23400 + t
        assert r["azimuth_m"] == pytest.approx(0.002 * math.hypot(*v) * 6378122 / math.hypot(*pos), rel=1e-4)


def test_amplitudes_are_summed_twice_a_pixel(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(16, 64))
    z[5] = 0.0
    df = spark.createDataFrame([(k // 4, k % 4, [float(x) for x in z[k]]) for k in range(16)], "row long, col long, z array<double>")
    found = m.fill_persistent(df, 0.6)
    assert uses(found, "aggregate") == 2
    amp = np.abs(z[:, 0::2] + 1j * z[:, 1::2])
    with np.errstate(invalid="ignore"):
        good = (amp.mean(1) > 0) & (amp.std(1) / amp.mean(1) < 0.6)
    best = {}
    for k in np.flatnonzero(good):
        best[k // 8, k % 4 // 2] = max(best.get((k // 8, k % 4 // 2), (0.0, -1)), (amp[k].mean(), k))
    got = {(r["row"], r["col"], r["epoch"]): r["phase"] for r in found.collect()}
    want = {(r, c, t): np.angle(z[k, 2 * t] + 1j * z[k, 2 * t + 1]) - np.angle(z[k, 0] + 1j * z[k, 1]) for (r, c), (_, k) in best.items() for t in range(32)}
    assert set(got) == set(want) and got and all(got[x] == pytest.approx(want[x], abs=1e-9) for x in got)


@pytest.mark.parametrize("bursts", [5, 6, 1100, 1101])
def test_held_out_scales_are_medians_of_the_others_without_a_list_of_all(spark, bursts):
    rng = np.random.default_rng(bursts)
    n = np.where(np.arange(bursts) % 7 == 3, 2, 4)  # two epochs are too few for a scale
    z = np.round(rng.normal(0, 2, (bursts, 4)), 1)  # equal scales occur
    rows = [(b, name, float(z[b, t]), s) for b in range(bursts) for t in range(n[b]) for name, s in (("crlb_only", 1.0), ("posterior_only", 0.1))]
    df = spark.createDataFrame(rows, "burst int, method string, residual double, sigma double")
    out = v.cohort_score(df)
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["burst"]: r["scale"] for r in out.collect()}
    scales = {b: np.sort(np.abs(z[b]) / v.Z90)[3] for b in range(bursts) if n[b] == 4}
    assert len(got) == bursts and all(got[b] == pytest.approx(np.median([s for k, s in scales.items() if k != b])) for b in got)


def test_stations_of_one_place_share_distances_and_nothing_is_broadcast(spark):
    rng = np.random.default_rng(3)
    places = [(float(a), float(o)) for a, o in zip(rng.uniform(40, 40.6, 12), rng.uniform(7, 7.6, 12))]
    at = [places[k % 12] for k in rng.permutation(60)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(at)] + [(60, None, 7.0), (61, 40.0, None)], "id int, lat double, lon double")
    f, g = np.radians(np.array(at).T)
    d = 2 * v.EARTH_KM * np.arcsin(np.sqrt(np.sin((f[:, None] - f) / 2) ** 2 + np.cos(f)[:, None] * np.cos(f) * np.sin((g[:, None] - g) / 2) ** 2))
    for least in (0.0, 1.0):
        out = v.station_pairs(df, least, 30.0)
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        got = {(r["a"], r["b"]): r["km"] for r in out.collect()}
        assert set(got) == {(i, j) for i in range(60) for j in range(i + 1, 60) if least <= d[i, j] <= 30} and out.count() == len(got)
        assert all(got[p] == pytest.approx(d[p], abs=1e-9) for p in got)


def test_affine_fit_against_lstsq(spark):
    rng = np.random.default_rng(8)
    x, y, a = rng.normal(size=(3, 300))
    z = 1.5 * a + 0.2 * x - 0.1 * y + 4 + rng.normal(0, 0.01, 300)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, z, x, y)] + [(NAN, 1.0, 0.0, 0.0)], "a double, y double, x_m double, y_m double")
    got = v.affine_fit(df)
    want = np.linalg.lstsq(np.column_stack([a, x, y, np.ones(300)]), z, rcond=None)[0]
    assert [got[k] for k in ("scale", "bx", "by", "c")] == pytest.approx(want.tolist()) and got["n"] == 300 and got["pattern_corr"] > 0.999
    assert v.affine_fit(df.limit(50)) is None
    none = v.zero_pixel(df.selectExpr("1L AS row", "1L AS col", "1.0D AS value"), df.selectExpr("1L AS row", "1L AS col", "1.0D AS quality"))
    assert none.count() == 0

"""Files and tables round trip, windows prune, folds equal reruns, and a run recovers a known motion."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import config, pipeline
from rasterloom.errors import CorrectionError, ConfigError, SourceError, UnwrapError
from rasterloom.kernels import linking as k
from rasterloom.kernels import sequential as q
from rasterloom.plans.blocks import Block, Grid
from rasterloom.sources import geotiff, rasters
from rasterloom.streaming.incremental import Series, event_windows, pack, unpack

GRID = Grid(32611, (500000.0, 30.0, 0.0, 4000000.0, 0.0, -30.0), 300, 270)


@pytest.mark.parametrize("kind", ["u1", "i2", "u4", "f4", "f8", "c8"])
def test_geotiff_round_trip(kind):
    x = (np.random.default_rng(1).normal(size=(300, 270)) * 100).astype(kind if kind != "c8" else complex).astype(kind)
    data = geotiff.encode(x, GRID, {"a": 'x<y & "z"'}, -9999.0 if kind == "f4" else None)
    h = geotiff.header(data)
    assert h.grid == GRID and h.metadata == {"a": 'x<y & "z"'} and h.nodata == (-9999.0 if kind == "f4" else None)
    assert (geotiff.decode(data) == x).all() and (geotiff.decode(data, (250, 270, 100, 262)) == x[250:270, 100:262]).all()
    assert geotiff.header(data[: h.header_end]) == h
    for bad in (b"nothing at all", geotiff.encode(x, GRID)[:8]):
        with pytest.raises(Exception):
            geotiff.header(bad)
    with pytest.raises(SourceError):
        geotiff.decode(data, (0, 301, 0, 1))


def test_raster_files_through_spark(spark, tmp_path):
    x = np.arange(300 * 270, dtype=float).reshape(300, 270)
    rows = spark.createDataFrame([(r, c, float(x[r, c]) if r else None) for r in range(0, 300, 50) for c in range(270)], "row long, col long, value double")
    path = f"file://{tmp_path}/a.tif"
    rasters.write_raster(rows, path, (300, 270), GRID, "f4", {"k": "v"}, nodata=-1.0)
    h = rasters.read_header(spark, path)
    assert h.grid == GRID and h.metadata == {"k": "v"}
    got = rasters.read_raster(spark, path, Block(0, 60, 5, 8)).collect()
    assert len(got) == 180 and {(r["row"], r["col"]): r["value"] for r in got if r["value"] is not None} == {(50, c): x[50, c] for c in (5, 6, 7)}
    part = Grid(32611, (500060.0, 30.0, 0.0, 3998500.0, 0.0, -30.0), 2, 3)
    assert {(r["row"], r["col"]): r["value"] for r in rasters.read_aligned(spark, path, part, 7.0).collect()} == {(r, c): x[50, c + 2] if r == 0 else 7.0 for r in (0, 1) for c in range(3)}
    for change in (dict(epsg=32612), dict(gt=(500061.0, 30.0, 0.0, 3998500.0, 0.0, -30.0)), dict(gt=(500060.0, 20.0, 0.0, 3998500.0, 0.0, -30.0)), dict(rows=400)):
        bad = Grid(**({"epsg": part.epsg, "gt": part.gt, "rows": part.rows, "cols": part.cols} | change))
        with pytest.raises(SourceError):
            rasters.read_aligned(spark, path, bad)
    assert rasters.overlap_window(GRID, Grid(32611, (620000.0, 30.0, 0.0, 4000000.0, 0.0, -30.0), 2, 2)) is None
    assert rasters.read_los(spark, path, path, part).count() == 6
    assert rasters.stage(spark, [path, path], f"file://{tmp_path}/copies") == [f"file:{tmp_path}/copies/00000-a.tif", f"file:{tmp_path}/copies/00001-a.tif"]
    with pytest.raises(SourceError):
        rasters.stage(spark, [f"file://{tmp_path}/none"], f"file://{tmp_path}/copies")


def test_complex_stacks(spark, tmp_path):
    z = np.random.default_rng(0).normal(size=(3, 5, 4)) + 1j
    paths = []
    for e in (2, 0, 1):
        df = spark.createDataFrame([(r, c, float(z[e, r, c].real), float(z[e, r, c].imag)) for r in range(5) for c in range(4)], "row long, col long, re double, im double")
        paths.append(f"file://{tmp_path}/s_2024010{e + 1}.tif")
        rasters.write_raster(df, paths[-1], (5, 4), kind="c8")
    got = rasters.as_samples(rasters.read_stack(spark, paths, Block(1, 3, 0, 2)), 3).collect()
    assert len(got) == 4
    for r in got:
        assert np.allclose(r["z"], np.stack([z[:, r["row"], r["col"]].real, z[:, r["row"], r["col"]].imag], 1).ravel(), atol=1e-6)
    rasters.write_raster(df.limit(1), f"file://{tmp_path}/s_20240109.tif", (6, 4), kind="c8")
    with pytest.raises(SourceError):
        rasters.read_stack(spark, [*paths, f"file://{tmp_path}/s_20240109.tif"])
    flat = rasters.flat_bytes(z[0])
    assert np.allclose(rasters.from_flat(flat, "complex", 4), z[0], atol=1e-6)
    with pytest.raises(SourceError):
        rasters.from_flat(flat, "label", 7)
    with pytest.raises(UnwrapError):
        rasters.external_unwrap()
    with pytest.raises(CorrectionError):
        rasters.external_delays()


def test_raster_tables_prune_and_delays_add_up(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    cells = spark.range(600 * 40).select((F.col("id") / 40).cast("long").alias("row"), (F.col("id") % 40).alias("col"))
    deg = Grid(4326, (-118.0, 0.01, 0.0, 36.0, 0.0, -0.01), 600, 40)
    for n, name in enumerate(rasters.TOTAL):
        rasters.write_table(cells.withColumn("value", F.col("row") + n * 0.5), root, name, deg, {"unit": "m"})
    assert rasters.table_grid(spark, root, "wet_delay") == (deg, {"unit": "m"})
    window = rasters.read_table(spark, root, "wet_delay", Block(10, 12, 0, 40))
    assert window.count() == 80 and "PushedFilters: [IsNotNull(row), IsNotNull(col), GreaterThanOrEqual(row,10)" in window._jdf.queryExecution().toString()
    target = Grid(4326, (-117.9, 0.01, 0.0, 35.0, 0.0, -0.01), 2, 2)
    near = rasters.read_delay(spark, root, "total", target=target)
    assert near.count() == 24 or near.count() < 60
    assert near.where("row = 100").first()["value"] == 200.5
    rasters.write_table(cells.limit(10).withColumn("value", F.lit(1.0)).withColumn("height", F.col("col") * 100.0), root, "levels", deg)
    assert rasters.heights(spark, root, "levels") == [100.0 * c for c in range(10)]
    with pytest.raises(CorrectionError):
        rasters.read_delay(spark, root, "levels")
    assert rasters.read_delay(spark, root, "levels", 300.0).count() == 1


def test_ionex_and_granule_files(spark, tmp_path):
    from .test_corrections import IONEX

    (tmp_path / "x.ionex").write_text(IONEX)
    got = rasters.read_ionex(spark, f"file://{tmp_path}/x.ionex")
    assert got.count() == 12 and got.where("minute = 1440 AND lat = -10 AND lon = 20").first()["tec"] == 16.0
    one = '{"name": "a", "direction": "ascending", "burst": "t1_2_iw1", "start": "2024-01-01T00:00:01", "stop": "2024-01-01T00:00:02", "epoch": "2024-01-01T00:00:00", "range_m": 2.3, "interval_s": 0.002, "lon": 1, "lat": 2, "orbit": [{"t": 0, "px": 1, "py": 2, "pz": 3, "vx": 4, "vy": 5, "vz": 6}]}'
    (tmp_path / "g.json").write_text(one)
    assert rasters.read_granules(spark, f"file://{tmp_path}/g.json").first()["orbit"][0]["vz"] == 6
    (tmp_path / "bad.json").write_text(one.replace('"px": 1, ', ""))
    with pytest.raises(SourceError):
        rasters.read_granules(spark, f"file://{tmp_path}/bad.json")


def cube(n=11, size=(10, 9)):
    rng = np.random.default_rng(7)
    base = rng.normal(size=size) + 1j * rng.normal(size=size)
    return base * np.exp(1j * 0.3 * np.arange(n))[:, None, None] + 0.3 * (rng.normal(size=(n, *size)) + 1j * rng.normal(size=(n, *size)))


def long(spark, z, first=0):
    return spark.createDataFrame([(r, c, e + first, float(z[e, r, c].real), float(z[e, r, c].imag)) for e in range(len(z)) for r in range(z.shape[1]) for c in range(z.shape[2])], "row long, col long, epoch int, re double, im double")


def test_folds_and_streams_equal_a_rerun(spark, tmp_path):
    z, plan = cube(), q.Plan(4, 2)
    want = q.joined(q.run(z, plan, k.Linking())[0])

    def holds(series, version):
        pdf = series.history(version).toPandas()
        assert len(pdf) == z.size
        theta = want["theta"][pdf["epoch"], pdf["row"], pdf["col"]]
        assert np.abs(np.angle(np.exp(1j * (pdf["phase"] - theta)))).max() < 1e-6
        assert np.allclose(pdf["temp_coh"], want["temp_coh"][pdf["row"], pdf["col"]])

    a = Series(spark, f"file://{tmp_path}/a", (10, 9), plan, tile=12, ministacks=3)
    a.fold(long(spark, z[:5]), 0)
    a.fold(long(spark, z[5:], 5), 1)
    assert a.fold(long(spark, z[5:], 5), 1).count() == a.linked(2).count()  # repeated after success: nothing is done
    holds(a, 2)
    for bad in (long(spark, z[:1], 12), long(spark, z[:1], 3), long(spark, z[:0]), long(spark, np.pad(z[:1], ((0, 0), (0, 5), (0, 0))), 11), long(spark, z[:3], 11)):
        with pytest.raises(SourceError):
            a.fold(bad, 2)
    for n, cut in enumerate([(0, 6), (6, 7), (7, 11)]):
        long(spark, z[slice(*cut)], cut[0]).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    b = Series(spark, f"file://{tmp_path}/b", (10, 9), plan, tile=12, ministacks=3)
    b.stream(f"file://{tmp_path}/in", f"file://{tmp_path}/cp").awaitTermination(240)
    holds(b, 3)
    state = q.run(z[:6], plan, k.Linking())[1]
    again = unpack(pack(state))
    assert len(again.sealed) == 1 and (again.open == state.open).all() and unpack(pack(q.State())).open is None


def test_event_windows_in_batch_and_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value").coalesce(1).write.parquet(f"file://{tmp_path}/ev")
    batch = {tuple(r) for r in event_windows(spark.read.parquet(f"file://{tmp_path}/ev")).collect()}
    stream = event_windows(spark.readStream.schema("ts timestamp_ntz, event_type string, value double").parquet(f"file://{tmp_path}/ev"))
    stream.writeStream.format("memory").queryName("ev").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert {tuple(r) for r in spark.table("ev").collect()} == batch and batch


def test_a_run_recovers_the_motion(spark, tmp_path):
    rng, size, n = np.random.default_rng(2), (16, 14), 6
    y, x = np.mgrid[: size[0], : size[1]]
    rate = 0.05 * x + 0.02 * y  # radians an epoch
    base = rng.normal(size=size) + 1j * rng.normal(size=size)
    z = base * np.exp(1j * rate * np.arange(n)[:, None, None]) + 0.01 * (rng.normal(size=(n, *size)) + 1j * rng.normal(size=(n, *size)))
    samples = rasters.as_samples(long(spark, z), n)
    for method, net in (("L1", "{max_bandwidth: 2}"), ("L2", "{}")):
        cfg = config.parse(f"phase_linking: {{half_window: {{x: 1, y: 1}}, ministack_size: 10, shp_method: rect}}\ntimeseries_options: {{method: {method}, reference_point: [8, 7], write_velocity_uncertainty: true}}\ninterferogram_network: {net}")
        out = pipeline.run(samples, [12.0 * t for t in range(n)], cfg)
        assert out.reference == (8, 7) and len(out.pairs) == (9 if method == "L1" else 5)
        pdf = out.layers["velocity"].toPandas()
        scale = pipeline.DEFAULT_WAVELENGTH / (4 * math.pi) / 12 * 365.25
        want = (rate - rate[8, 7])[pdf["row"], pdf["col"]] * scale
        inner = (pdf["row"].between(2, 13) & pdf["col"].between(2, 11)).to_numpy()
        assert np.abs(pdf["value"] - want)[inner].max() < 0.02
    assert out.layers["displacement"].where("epoch = 0").agg(F.max(F.abs("value"))).first()[0] == 0
    assert out.layers["velocity_sigma"].count() == 224
    pipeline.emit(out, f"file://{tmp_path}/out", GRID)
    assert rasters.read_table(spark, f"file://{tmp_path}/out", "displacement").count() == 224 * 6
    assert rasters.table_grid(spark, f"file://{tmp_path}/out", "velocity")[1] == {"reference": "8,7"}
    auto = config.parse("phase_linking: {half_window: {x: 1, y: 1}, shp_method: rect}\ntimeseries_options: {method: L2, velocity_step_dates: ['2024-01-20'], velocity_seasonal: false, write_posterior_uncertainty: true}\ninterferogram_network: {max_bandwidth: 3}")
    from datetime import date

    more = pipeline.run(samples, [12.0 * t for t in range(n)], auto, date(2024, 1, 1))
    assert {"step_0", "posterior_variance", "loop_failures"} <= set(more.layers) and more.layers["loop_failures"].agg(F.max("value")).first()[0] == 0


def test_runs_that_cannot_work_are_refused():
    for text, error in (("unwrap_options: {unwrap_method: snaphu}", UnwrapError), ("output_options: {strides: {x: 2}}", ConfigError), ("timeseries_options: {method: L1, write_posterior_uncertainty: true}", ValueError)):
        with pytest.raises(error):
            pipeline.validate(config.parse(text), 5)
    with pytest.raises(ConfigError):
        pipeline.validate(config.parse(""), 1)
    cfg = config.parse("interferogram_network: {indexes: [[0, 1], [3, -1], [2, 1]], max_temporal_baseline: 12}")
    assert pipeline.network(cfg, [0, 12.0, 36, 48, 72]) == [(0, 1), (1, 2), (2, 3), (3, 4)]

"""Distributed linking against the kernels run on the whole grid."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.kernels import linking as k
from rasterloom.kernels import sequential
from rasterloom.operators import linking, stack
from rasterloom.sources.adapters import EPOCHS, c_stack

SF = "/root/testdata/sf0.001"


def cube_of(df, epochs=EPOCHS):
    rows = df.collect()
    shape = (max(r["row"] for r in rows) + 1, max(r["col"] for r in rows) + 1)
    out = np.full((epochs, *shape), np.nan, complex)
    for r in rows:
        z = np.array(r["z"])
        out[:, r["row"], r["col"]] = z[0 : 2 * epochs : 2] + 1j * z[1 : 2 * epochs : 2]
    return out


def layer(df, name, epochs):
    pdf = df.toPandas()
    out = np.full((epochs, pdf["row"].max() + 1, pdf["col"].max() + 1), np.nan)
    out[pdf["epoch"], pdf["row"], pdf["col"]] = pdf[name]
    return out


def test_sql_coherence_equals_the_kernel(spark):
    df = c_stack(spark, SF)
    c = k.coherence(cube_of(df, 5), (1, 1))
    got = stack.coherence(df, stack.grid_shape(df), 5).collect()
    assert len(got) == c.shape[0] * c.shape[1] * 15
    for r in got:
        assert complex(r["cre"], r["cim"]) == pytest.approx(c[r["row"], r["col"], r["i"], r["j"]], abs=1e-9)
    flat = c.reshape(-1, 5, 5)
    closures = np.array([r["closure"] for r in stack.closures(stack.coherence(df, stack.grid_shape(df), 5), 5).orderBy("row", "col", "k").collect()])
    assert np.allclose(closures.reshape(-1, 3), k.closure(flat))


@pytest.mark.parametrize("tile", [4, 7, None])
def test_tiled_sequence_equals_the_whole_grid(spark, tile):
    df, plan = c_stack(spark, SF), sequential.Plan(8, 4)
    want = sequential.joined(sequential.run(cube_of(df), plan, k.Linking())[0])
    got = linking.link_sequential(df, plan=plan, tile=tile)
    theta = layer(got, "phase", EPOCHS)
    assert np.allclose(np.angle(np.exp(1j * (theta - want["theta"]))), 0, atol=1e-6)
    assert np.allclose(layer(got, "temp_coh", EPOCHS)[0], want["temp_coh"], atol=1e-9)


def test_reference_epoch_and_missing_pixels(spark):
    df = c_stack(spark, SF).where("NOT (row = 2 AND col = 3)")
    got = linking.link(df, epochs=6, reference=2)
    assert got.where("epoch = 2").agg(F.max(F.abs("phase"))).first()[0] == 0
    cube = cube_of(df, 6)
    want, _ = k.estimate(k.coherence(cube, (1, 1)).reshape(-1, 6, 6), k.Linking(), 2)
    theta = layer(got, "phase", 6)
    d = np.angle(np.exp(1j * (theta - want.T.reshape(6, *cube.shape[1:]))))
    assert np.isnan(d[:, 2, 3]).all() and np.nanmax(np.abs(d)) < 1e-6


def test_tile_size_bounds_memory_and_fills_cores():
    assert linking.tile_size(32, (10_000, 10_000), 8) == 64
    assert linking.tile_size(100, (10_000, 10_000), 8) == 20
    assert linking.tile_size(32, (80, 25), 8) == 16


WINDOWED = ("avg_coherence_final", "avg_coherence_per_date", "bias_corrected", "bias_velocity", "box_sum", "closure_all", "coherence_full", "residual_closure", "temp_coh_all")
GRIDS = {"last row": "vec_id < 135", "gaps": "vec_id < 140 AND vec_id NOT IN (0, 26, 51, 60, 61, 62, 85, 86, 87, 139) AND vec_id % 11 <> 4", "two rows": "vec_id < 40"}


@pytest.fixture(scope="module", params=list(GRIDS))
def gapped(request, tmp_path_factory):
    folder = tmp_path_factory.mktemp("gapped")
    duckdb.sql(f"COPY (SELECT * FROM '{SF}/embeddings.parquet' WHERE {GRIDS[request.param]}) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", WINDOWED)
def test_grids_that_are_not_full_equal_the_sql(spark, gapped, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{gapped}/embeddings.parquet'")
    want = con.execute(stack.ORACLES[name])
    names, want = [c[0] for c in want.description], sorted(want.fetchall())
    assert sorted(tuple(r) for r in stack.QUERIES[name](spark, gapped).select(*names).collect()) == want and want

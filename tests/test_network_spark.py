"""Distributed unwrapping, components and inversion against the kernels on the whole grid."""

import numpy as np
import pytest

from rasterloom.errors import EngineError
from rasterloom.kernels import series as s
from rasterloom.kernels import unwrap as u
from rasterloom.operators import inversion, unwrapping


def layers(spark, psi, corr):
    rows = [(n, r, c, float(psi[n, r, c]), float(corr[r, c])) for n in range(len(psi)) for r in range(psi.shape[1]) for c in range(psi.shape[2])]
    return spark.createDataFrame(rows, "ifg int, row long, col long, psi double, corr double").repartition(3)


def grid(df, name, shape):
    pdf = df.toPandas()
    out = np.full(shape, np.nan)
    out[pdf["ifg"], pdf["row"], pdf["col"]] = pdf[name]
    return out


def scene(size=(24, 32)):
    rng = np.random.default_rng(9)
    y, x = np.mgrid[: size[0], : size[1]].astype(float)
    corr = np.where(np.abs(x - 15) < 3, 0.05, 0.8) * np.where((y > 18) & (x > 25), 0.1, 1.0)
    noise = rng.normal(0, 1, (3, *size)) * np.where(corr < 0.2, 1.5, 0.1)
    return u.wrap(0.5 * x + 0.3 * y + noise), corr


def test_tiles_of_the_cluster_equal_those_of_the_kernel(spark):
    psi, corr = scene()
    got = grid(unwrapping.unwrap_network(layers(spark, psi, corr), psi.shape[1:], tile=8), "unwrapped", psi.shape)
    for n in range(3):
        want = u.unwrap_tiled(psi[n], corr, (3, 4))
        assert np.allclose(u.wrap(got[n] - psi[n]), 0, atol=1e-9)
        d = np.round((got[n] - want) / u.TURN)
        for part in (slice(0, 12), slice(19, 32)):
            on = (corr >= u.MIN_CORR)[:, part]
            assert len(np.unique(d[:, part][on])) == 1


def test_components_over_tiles(spark):
    psi, corr = scene()
    want = u.label_regions(corr, min_share=0.01)
    got = unwrapping.component_labels(layers(spark, psi[:1], corr), corr.shape, tile=7, min_share=0.01)
    assert (grid(got, "component", (1, *corr.shape))[0] == want).all() and want.max() == 2


def test_small_tiles_and_missing_pixels(spark):
    psi, corr = scene((9, 9))
    ifgs = layers(spark, psi, corr).where("NOT (row = 3 AND col = 3)")
    got = unwrapping.unwrap_network(ifgs, (9, 9), tile=8, overlap=2)
    assert got.count() == 3 * 80


def test_inversion_on_arrow_batches(spark):
    pairs = inversion.bandwidth_pairs(4, 2)
    truth = np.random.default_rng(1).normal(size=(6, 3))
    full = np.concatenate([np.zeros((6, 1)), truth], 1)
    rows = [(n, 0, p, float(full[p, j] - full[p, i])) for n, (i, j) in enumerate(pairs) for p in range(6) if (n, p) != (1, 2)]
    ifgs = spark.createDataFrame(rows, "ifg int, row long, col long, phase double")
    pixels = inversion.by_pixel(ifgs, len(pairs), "phase")
    for method in ("l2", "l1"):
        for r in inversion.invert(pixels, pairs, method).collect():
            if method == "l1" and r["col"] == 2:
                assert np.isnan(r["series"]).all()
            else:
                assert np.allclose(r["series"], truth[r["col"]], atol=0.05 if method == "l1" else 1e-9)
    with pytest.raises(EngineError):
        inversion.invert(pixels, [(0, 2), (2, 3)])
    with pytest.raises(EngineError):
        inversion.invert(pixels, pairs, "l3")
    qc = {r["col"]: r for r in inversion.loop_qc(ifgs, pairs).collect()}
    assert qc[0]["evaluable"] == 2 and qc[2]["evaluable"] == 1 and all(r["bad"] == 0 for r in qc.values())
    bad = ifgs.selectExpr("ifg", "row", "col", "CASE WHEN ifg = 1 AND col = 4 THEN phase + 6.283185307179586 ELSE phase END AS phase")
    masked = inversion.loop_mask(bad, inversion.loop_qc(bad, pairs)).where("col = 4 AND phase IS NOT NULL")
    assert masked.count() == 0


def test_velocity_models_with_precisions(spark):
    days = [12.0 * k for k in range(40)]
    y = [0.02 * t + (1.0 if t >= 200 else 0.0) for t in days]
    df = spark.createDataFrame([(0, 0, y, [1.0] * 40), (0, 1, y, [None] * 39 + [1.0])], "row long, col long, series array<double>, w array<double>")
    got = {r["col"]: r for r in inversion.velocities(df, days, s.VelocityModel(steps=(200.0,)), "w").collect()}
    assert got[0]["velocity"] == pytest.approx(7.305) and got[0]["step_0"] == pytest.approx(1) and np.isnan(got[1]["velocity"])
    assert inversion.uncertainty_scale(0) == "crlb_bound" and inversion.uncertainty_scale(2) == "empirical"

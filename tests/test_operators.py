import duckdb
import numpy as np
import pytest

from rasterloom import catalogue
from rasterloom.kernels import linking as k
from rasterloom.operators import linking, timeseries
from rasterloom.plans import network

SF = "/root/testdata/sf0.001"
TABLES = ("events", "embeddings", "part")


def rows(frame):
    cols = sorted(frame.columns)
    return sorted((tuple("~" if v is None or v != v else v for v in r) for r in frame[cols].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, other = catalogue.QUERIES[name](spark, SF).toPandas(), con.execute(catalogue.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert list(map(repr, rows(mine))) == list(map(repr, rows(other)))


def test_trend_recovers_a_line(spark):
    data = [(1, t, 3.0 + 0.5 * t, 1) for t in range(20)] + [(2, 0, 1.0, 1)] + [(3, t, float("nan"), 1) for t in range(3)]
    got = {r["user_id"]: r for r in timeseries.trend(spark.createDataFrame(data, "user_id long, t int, y double, w long"), __import__("pyspark.sql.functions", fromlist=["col"]).col("w")).collect()}
    assert got[1]["velocity"] == pytest.approx(0.5 * 365.25) and got[1]["residual_rms"] == 0
    assert got[2]["velocity"] is None and 3 not in got


def test_triplets_close(spark):
    n = spark.createDataFrame([(d, d) for d in range(4)], "d int, k int")
    assert {tuple(r) for r in network.triplets(network.bandwidth(n, 2)).collect()} == {(0, 1, 2), (1, 2, 3)}


def test_blocks_reject_bad_input(spark):
    assert network.blocks(spark, 5, 5, 0, 0).count() == 0
    with pytest.raises(ValueError):
        network.blocks(spark, 5, 5, 2, 2)


def _stack(n=6, size=14, seed=7):
    rng = np.random.default_rng(seed)
    truth = 0.4 * np.arange(n)
    base = rng.normal(size=(size, size)) + 1j * rng.normal(size=(size, size))
    noise = rng.normal(size=(n, size, size)) + 1j * rng.normal(size=(n, size, size))
    return truth, base * np.exp(1j * truth)[:, None, None] + 0.05 * noise


def test_estimators_recover_phases():
    truth, z = _stack()
    c = k.coherence(z, (2, 2)).reshape(-1, 6, 6)
    for theta in (k.phases(k.emi(c)[0]), k.phases(k.evd(c))):
        assert np.abs(np.angle(np.exp(1j * (theta - truth)))).max() < 0.15
    assert k.temporal_coherence(c, k.phases(k.evd(c))).min() > 0.95


def test_window_sums_against_loops():
    x = np.random.default_rng(1).normal(size=(2, 5, 6))
    got = k.window_sums(x, (1, 2))
    for r in range(5):
        for c in range(6):
            assert np.allclose(got[:, r, c], x[:, max(0, r - 1) : r + 2, max(0, c - 2) : c + 3].sum((1, 2)))


def test_bound_degenerate_cases():
    m = np.stack([np.eye(3), np.ones((3, 3)), 0.7 * np.ones((3, 3)) + 0.3 * np.eye(3)]).astype(complex)
    s = k.bound(m, 9.0)
    assert (s[:, 0] == 0).all() and np.isfinite(s[2]).all() and (s[2, 1:] > 0).all()


def test_compress_keeps_phase_and_amplitude():
    truth, z = _stack()
    theta = np.broadcast_to(truth[:, None, None], z.shape)
    out = k.compress(z, theta)
    assert np.allclose(np.abs(out), np.abs(z).mean(0))


def test_tiled_equals_untiled(spark):
    from rasterloom.sources.adapters import c_stack

    stack = c_stack(spark, SF)
    key = ["row", "col", "epoch"]
    a = linking.link(stack).toPandas().sort_values(key).reset_index(drop=True)
    b = linking.link(stack, tile=5).toPandas().sort_values(key).reset_index(drop=True)
    assert (a[key] == b[key]).all().all()
    assert np.allclose(a["temp_coh"], b["temp_coh"], atol=1e-6)

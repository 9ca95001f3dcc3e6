"""Linking kernels: windows, neighbours, regularisation, ministacks and folds."""

import numpy as np
import pytest

from rasterloom.kernels import linking as k
from rasterloom.kernels import neighbours as shp
from rasterloom.kernels import sequential as q


def stack(n=10, size=(9, 8), seed=7, noise=0.3):
    rng = np.random.default_rng(seed)
    normal = lambda *s: (rng.normal(size=s) + 1j * rng.normal(size=s)) / np.sqrt(2)
    return normal(*size) * np.exp(1j * 0.3 * np.arange(n))[:, None, None] + noise * normal(n, *size)


@pytest.mark.parametrize("strides", [(1, 1), (2, 3)])
def test_coherence_against_loops_with_inward_windows_and_gaps(strides):
    z = stack(4)
    z[1, 2, 3] = np.nan
    got = k.coherence(z, (1, 2), strides)
    filled = np.where(np.isfinite(z), z, 0)
    assert got.shape == (9 // strides[0], 8 // strides[1], 4, 4)
    for r in range(got.shape[0]):
        for c in range(got.shape[1]):
            a = min(max(strides[0] // 2 + r * strides[0] - 1, 0), 9 - 3)
            b = min(max(strides[1] // 2 + c * strides[1] - 2, 0), 8 - 5)
            w = filled[:, a : a + 3, b : b + 5].reshape(4, -1)
            n = w @ w.conj().T
            p = np.sqrt(np.diag(n).real)
            assert np.allclose(got[r, c], n / np.outer(p, p))
    whole = np.ones((*got.shape[:2], 3, 5), bool)
    assert np.allclose(k.coherence(z, (1, 2), strides, whole), got)
    assert not k.coherence(z, (1, 2), strides, ~whole).any()
    with pytest.raises(ValueError):
        k.coherence(z, (5, 1))


def test_cholesky_pivots_tell_positive_definite():
    rng = np.random.default_rng(0)
    m = rng.normal(size=(200, 4, 4))
    m = m + m.transpose(0, 2, 1) + np.eye(4) * rng.uniform(0, 5, (200, 1, 1))
    assert (k.positive_definite(m) == (np.linalg.eigvalsh(m)[:, 0] > 0)).all()


def test_regularisation_and_fallback():
    c = np.ones((1, 3, 3), complex)  # singular
    _, ok = k.emi(c)
    assert not ok[0]
    _, ok = k.emi(c, beta=0.1)
    assert ok[0]
    assert k.magnitudes(np.full((1, 2, 2), 0.3 + 0j), cut=0.3).min() == 0.3 and k.magnitudes(np.full((1, 2, 2), 0.29 + 0j), cut=0.3).max() == 0


def test_glrt_and_ks_masks():
    rng = np.random.default_rng(3)
    amp = rng.rayleigh(1.0, (30, 7, 7))
    amp[:, :, 4:] *= 6
    mask = shp.glrt(amp.mean(0), amp.var(0), 30, (1, 2))
    assert not mask[3, 3, 1, 2] and mask[3, 1, 1, 2] and not mask[3, 3, 1, 4]
    # cut windows count from their first pixel: at column 0 the own place is window column 0
    assert not mask[3, 0, 1, 0] and mask[3, 0, 1, 1] and not mask[3, 0, 1, 3:].any()
    close = shp.ks(amp, (1, 2), alpha=0.05)
    assert not close[0].any() and not close[:, 1].any() and close[3, 2, 1, 1] and not close[3, 3, 1, 4]
    zero = np.zeros((3, 3))
    assert not shp.glrt(zero, zero, 3, (1, 1)).any()
    assert shp.critical_chi2(0.001) == pytest.approx(10.8276, abs=1e-3)
    x, y = np.array([[1.0, 1, 2]]), np.array([[1.0, 3, 3]])
    assert shp.largest_distance(x, y)[0] == pytest.approx(2 / 3)


def test_persistent_pixels_and_fill():
    amp = np.array([[[1.0, 1, np.nan, 0]], [[1.1, 3, 1, 0]], [[0.9, 9, 1, 0]]])
    mean, dispersion, flag = shp.persistent(amp, 0.25)
    assert flag.tolist() == [[1, 0, 255, 255]] and mean[0, 2] == 0
    assert shp.persistent(amp, 0.25, least=2)[2].tolist() == [[1, 0, 255, 255]]
    z = amp[:, :, :2] * np.exp(1j * np.array([0.0, 0.5, 1.0]))[:, None, None]
    theta, quality = shp.fill_persistent(np.zeros((3, 1, 1)), np.zeros((1, 1)), z, np.array([[1, 1]]), (1, 2), reference=1)
    assert theta[:, 0, 0] == pytest.approx([-0.5, 0, 0.5]) and quality[0, 0] == 1


def test_closure_average_compress_and_bias():
    z = stack(5, noise=0.0)
    c = k.coherence(z, (1, 1)).reshape(-1, 5, 5)
    assert np.allclose(k.closure(c), 0, atol=1e-9) and k.closure(c).shape[1] == 3
    assert np.allclose(k.average_coherence(c), 1)
    total, count = k.coherence_total(c, 2)
    assert np.allclose(total, 3) and (count == 3).all()
    theta = np.broadcast_to((0.3 * np.arange(5))[:, None, None], (5, 4, 4))
    assert k.compress(z, theta).shape == (9, 8)
    assert k.bias_rate(np.array([0.2, np.nan, 0.4])) == pytest.approx(0.15) and k.bias_rate(np.full(2, np.nan)) == 0
    assert k.remove_bias(np.zeros((3, 2)), 0.5)[:, 0].tolist() == [0, -0.5, -1]
    assert k.mean_abs_closure(np.array([-1.0, 3, np.nan])) == 2
    z[3] = np.nan
    assert k.empty_epochs(z) == [3]
    with pytest.raises(ValueError):
        k.link_stack(z, k.Linking())


@pytest.mark.parametrize("how", [k.Linking(closure=True, average=True), k.Linking(estimator="evd"), k.Linking(method="glrt", alpha=0.05, strides=(1, 2))])
@pytest.mark.parametrize("plan", [q.Plan(5, 10), q.Plan(4, 1, "first_per"), q.Plan(5, 2, "last_per")])
def test_folds_equal_a_run_over_all(how, plan):
    z = stack(13)
    whole, _ = q.run(z, plan, how)
    for cuts in ([5, 13], [10, 11, 12, 13], [7, 13], list(range(2, 14))):
        state, last = None, 0
        for cut in cuts:
            parts, state = q.run(z[last:cut], plan, how, state)
            last = cut
        a, b = q.joined(whole), q.joined(parts)
        assert a.keys() == b.keys()
        for name in a:
            assert np.allclose(a[name], b[name], equal_nan=True), name
    assert len(q.joined(whole)["theta"]) == 13
    with pytest.raises(ValueError):
        q.run(z[:0], plan, how, state)
    with pytest.raises(ValueError):
        q.run(z[:, :5], plan, how, state)


def test_ministacks_follow_the_phase_and_carry_layers():
    z = stack(10, noise=0.05)
    parts, state = q.run(z, q.Plan(5, 10), k.Linking())
    out = q.joined(parts)
    d = np.exp(1j * (out["theta"] - 0.3 * np.arange(10)[:, None, None]))
    assert np.abs(np.angle(d[1:] * d[:1].conj())).max() < 0.5
    assert out["compressed"].shape == (2, 9, 8) and state.open is None
    assert q.Plan(5, 2).batches(12) == [(0, 5, 0), (5, 5, 1), (10, 2, 2)]
    assert q.Plan(5, 10, "last_per").references(0) == (-1, -1) and q.Plan(5, 10, "first_per").references(3) == (0, 3)
    with pytest.raises(ValueError):
        q.Plan(1)

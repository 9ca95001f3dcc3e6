"""Series kernels against closed forms and plain numpy."""

import numpy as np
import pytest

from rasterloom.errors import EngineError
from rasterloom.kernels import series as s

PAIRS = [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]


def network(seed=11, pixels=40):
    rng = np.random.default_rng(seed)
    truth = np.cumsum(rng.normal(0, 1, (pixels, 3)), axis=1)
    full = np.concatenate([np.zeros((pixels, 1)), truth], axis=1)
    return truth, np.stack([full[:, j] - full[:, i] for i, j in PAIRS], axis=1), rng


def test_least_squares_against_lstsq_with_weights_and_gaps():
    truth, phase, rng = network()
    assert np.allclose(s.invert(phase, PAIRS)[0], truth)
    noisy, w = phase + rng.normal(0, 0.1, phase.shape), rng.uniform(0.5, 1, phase.shape)
    noisy[3, 1], w[4, 2] = np.nan, 0.0
    x, variance, rms = s.invert(noisy, PAIRS, w)
    design, dates = s.incidence(PAIRS)
    assert dates == [1, 2, 3]
    for k in (0, 3, 4, 7):
        ok = np.isfinite(noisy[k]) & (w[k] > 0)
        root = np.sqrt(w[k][ok])
        want = np.linalg.lstsq(design[ok] * root[:, None], noisy[k][ok] * root, rcond=None)[0]
        r = noisy[k][ok] - design[ok] @ want
        spare = ok.sum() - 3
        factor = max(1.0, (w[k][ok] * r * r).sum() / spare) if spare else 1.0
        assert np.allclose(x[k], want)
        assert np.allclose(variance[k], np.diag(np.linalg.inv(design[ok].T @ (w[k][ok][:, None] * design[ok]))) * factor)
        assert rms[k] == pytest.approx(np.sqrt((r * r).mean()))


def test_too_few_or_singular_pixels_are_missing():
    phase = np.array([[1.0, 2.0, np.nan, np.nan, np.nan], [np.nan, 1.0, 1.0, np.nan, np.nan], [1.0, 2.0, 1.0, np.nan, np.nan]])
    assert np.isnan(s.invert(phase, PAIRS)[0]).all()


def test_absolute_deviations_shrug_off_one_outlier():
    pairs = [(i, j) for i in range(5) for j in range(i + 1, 5)]
    full = np.array([0.0, 1, 3, 2, 5])
    phase = np.array([[full[j] - full[i] for i, j in pairs]])
    assert np.allclose(s.invert_l1(phase, pairs), full[1:], atol=1e-9)
    phase[0, 2] += 2 * np.pi
    assert np.abs(s.invert_l1(phase, pairs) - full[1:]).max() < np.abs(s.invert(phase, pairs)[0] - full[1:]).max()
    phase[0, 0] = np.nan
    assert np.isnan(s.invert_l1(phase, pairs)).all()


def test_rates_and_models():
    days = np.arange(0, 240, 12.0)
    y = 2 * days[None] + 1
    assert s.polyfit_rate(days, y) == pytest.approx([730.5])
    rng = np.random.default_rng(1)
    noisy, w = y + rng.normal(0, 3, y.shape), rng.uniform(0.2, 2, y.shape)
    assert s.polyfit_rate(days, noisy, w)[0] == pytest.approx(np.polyfit(days, noisy[0], 1, w=w[0])[0] * 365.25)
    long = np.arange(0, 1200, 12.0)
    turn = 2 * np.pi * long / 365.25
    signal = 0.01 * long + 0.4 * np.sin(turn) + 0.3 * np.cos(turn) + 1.5 * (long >= 500)
    got = s.fit_model(long, np.stack([signal, np.where(long < 50, signal, np.nan)]), None, s.VelocityModel(True, (500.0,)))
    assert got["velocity"][0] == pytest.approx(3.6525) and got["step_0"][0] == pytest.approx(1.5)
    assert got["seasonal_amplitude"][0] == pytest.approx(0.5)
    assert got["seasonal_peak_day"][0] == pytest.approx(np.arctan2(0.4, 0.3) * 365.25 / 2 / np.pi)
    assert np.isnan(got["velocity"][1]) and np.isnan(got["inflation"][1]) and np.isnan(got["residual_rms"][1])


def test_lag_one_inflation():
    rng = np.random.default_rng(5)
    r = np.zeros(20000)
    for k in range(1, len(r)):
        r[k] = 0.5 * r[k - 1] + rng.normal()
    assert s.lag_one(r[None])[0] == pytest.approx(np.sqrt(3), rel=0.05)
    assert s.lag_one(np.array([[1.0, -1, 1, -1], [1, np.nan, np.nan, 2]])).tolist() == [1.0, 1.0]
    assert np.isnan(s.lag_one(np.full((1, 3), np.nan))).all()


def test_loops_and_masking():
    pairs = [(0, 1), (1, 2), (0, 2), (2, 3), (1, 3)]
    assert s.triplets(pairs) == [(0, 1, 2), (1, 3, 4)]
    phase = np.array([[1.0, 2, 3, 1, 3], [1, 2, 3 + 2 * np.pi, 1, 3], [np.nan, 2, 3, np.nan, 3], [1, 2, 3 + np.pi, 1, np.nan]])
    bad, told, worst = s.loop_closure(phase, pairs)
    assert bad.tolist() == [0, 1, 0, 0] and told.tolist() == [2, 2, 0, 1]
    assert worst[:2] == pytest.approx([0, 1]) and np.isnan(worst[2]) and worst[3] == pytest.approx(0.5)
    masked = s.mask_failed(phase, bad)
    assert np.isnan(masked[1]).all() and not np.isnan(masked[0]).any()


def test_reference_point_and_precisions():
    q = np.array([[0.9, 0.1, 0.8, 0.8], [0.9, 0.1, 0.8, 0.8], [0.1, np.nan, 0.1, 0.1]])
    assert s.reference_point(q, 0.5) == (0, 2)
    assert s.reference_point(q, 0.95) is None
    assert s.reference_point(np.array([[0.9, 0.9, 0.9]]), 0.5) == (0, 1)
    sigma = np.array([[0.0, 1.0, 2.0], [0, np.nan, 1]])
    assert np.allclose(s.pair_precisions(sigma, [(0, 1), (1, 2)]), [[1, 0.2], [1, 1]])
    assert np.allclose(s.date_precisions(sigma), [[1e12, 1, 0.25], [1, 1, 1]])
    with pytest.raises(EngineError):
        s.check_uncertainty_options("L1", True, False, True)
    with pytest.raises(EngineError):
        s.check_uncertainty_options("l2", False, True, False)

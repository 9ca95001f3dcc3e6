"""Unwrapping kernels against brute force, truth fields and invariants."""

import heapq
import itertools
from types import SimpleNamespace

import numpy as np
import pytest

from rasterloom.errors import UnwrapError
from rasterloom.kernels import graphs
from rasterloom.kernels import unwrap as u
from rasterloom.kernels.graphs import components, spanning_offsets


def test_flow_cost_is_optimal_on_small_grids():
    rng = np.random.default_rng(2)
    for _ in range(12):
        psi, corr = rng.uniform(-np.pi, np.pi, (3, 3)), rng.uniform(0.1, 0.98, (3, 3))
        ax, ay = u.gradients(psi)
        r = u.residues(ax, ay)
        wx, wy = u.edge_costs(corr)
        best = None
        for k in itertools.product((-1, 0, 1), repeat=6):
            kx = np.array(k).reshape(3, 2)
            # with kx fixed each row of faces fixes ky up to its first column
            need = -(r + kx[:-1] - kx[1:])  # ky[:, 1:] - ky[:, :-1]
            cost = np.abs(kx * wx).sum()
            for row in range(2):
                paths = np.concatenate([[0], np.cumsum(need[row])])
                cost += min(int(np.abs((paths + c) * wy[row]).sum()) for c in range(-3, 4))
            best = cost if best is None else min(best, cost)
        kx, ky = u.face_flow(r, wx, wy)
        assert not (r + kx[:-1] + ky[:, 1:] - kx[1:] - ky[:, :-1]).any()
        assert np.abs(kx * wx).sum() + np.abs(ky * wy).sum() == best


@pytest.mark.parametrize("size", [24, 40])
def test_noise_keeps_wrapped_values_and_has_no_curl(size):
    rng = np.random.default_rng(size)
    psi, corr = rng.uniform(-np.pi, np.pi, (size, size)), rng.uniform(0, 1, (size, size))
    out = u.unwrap_grid(psi, corr)
    assert np.allclose(u.wrap(out - psi), 0, atol=1e-9)
    gx, gy = np.diff(out, axis=1), np.diff(out, axis=0)
    assert np.allclose(gx[:-1] + gy[:, 1:] - gx[1:] - gy[:, :-1], 0, atol=1e-9)


def fields():
    y, x = np.mgrid[:64, :64].astype(float)
    yield "smooth", 0.10 * x + 0.06 * y + 0.0015 * (x - 32) ** 2
    yield "steep", 0.90 * x + 0.70 * y


@pytest.mark.parametrize("name,truth", list(fields()))
def test_truth_is_recovered_globally_tiled_and_multiscale(name, truth):
    corr, psi = np.full(truth.shape, 0.9), u.wrap(truth)
    for out in (u.unwrap_grid(psi, corr), u.unwrap_tiled(psi, corr, (2, 3))):
        d = (out - truth) / u.TURN
        assert np.allclose(d, np.round(d.mean()), atol=1e-9)
    if name == "smooth":
        out, label = u.unwrap_multiscale(np.exp(1j * psi), corr)
        d = (out - truth) / u.TURN
        assert np.allclose(d, np.round(d.mean()), atol=1e-6) and (label == 1).all()


def test_tiled_agrees_with_global_per_component():
    rng = np.random.default_rng(4)
    y, x = np.mgrid[:96, :96].astype(float)
    corr = np.where(np.abs(y - 48) < 10, 0.25, 0.85)
    psi = u.wrap(0.2 * x + 0.1 * y + np.where(corr < 0.5, rng.normal(0, 1.2, x.shape), rng.normal(0, 0.15, x.shape)))
    a, b = u.unwrap_grid(psi, corr), u.unwrap_tiled(psi, corr, (2, 2))
    for part in (slice(0, 36), slice(60, 96)):
        d = np.round((a - b)[part] / u.TURN)
        assert (d != np.median(d)).mean() <= 0.005


def noise(shape, seed, top=0.6):
    rng = np.random.default_rng(seed)
    psi, corr = rng.uniform(-np.pi, np.pi, shape), rng.uniform(0, top, shape)
    return u.residues(*u.gradients(psi)), *u.edge_costs(corr)


def test_searches_along_the_level_settle_as_full_searches_do(monkeypatch):
    fields = [noise((3 + k % 9, 2 + k % 7), k, (0.6, 1.0)[k % 2]) for k in range(40)] + [noise((60, 8), 1), noise((8, 60), 2)]
    fields += [(np.random.default_rng(k).integers(-2, 3, r.shape), x, y) for k, (r, x, y) in enumerate(fields[:20])]
    near = [u.face_flow(*f) for f in fields]
    monkeypatch.setattr(graphs.Level, "next", lambda self: None)
    for f, (kx, ky) in zip(fields, near):
        x, y = u.face_flow(*f)
        assert np.array_equal(kx, x) and np.array_equal(ky, y)


def test_work_grows_with_the_grid_not_with_its_square(monkeypatch):
    pushed = [0]

    def counted(heap, item):
        pushed[0] += 1
        heapq.heappush(heap, item)

    monkeypatch.setattr(graphs, "heapq", SimpleNamespace(heappush=counted, heappop=heapq.heappop, heapify=heapq.heapify))
    each = []
    for high in (100, 400):
        pushed[0] = 0
        u.face_flow(*noise((high, 9), 3))
        each.append(pushed[0])
    assert each[1] < 6 * each[0]


def test_components_by_size_then_first_pixel():
    corr = np.array([[0.8, 0.8, 0.02, 0.8, 0.8, 0.8]] * 3)
    got = u.label_regions(corr, min_share=0)
    assert got[0].tolist() == [2, 2, 0, 1, 1, 1]
    assert u.label_regions(corr, min_share=0.45)[0].tolist() == [0, 0, 0, 1, 1, 1]
    label, size = components(np.array([[1, 0, 1], [1, 1, 1], [0, 0, 0], [1, 0, 1]], bool))
    assert label.tolist() == [[1, 0, 1], [1, 1, 1], [0, 0, 0], [2, 0, 3]] and size.tolist() == [0, 5, 1, 1]


def test_seams_prefer_the_smaller_cycle_count_on_ties():
    label = np.array([[1, 2], [1, 2]])
    value = np.array([[0.0, 0.0], [0.0, u.TURN]])
    assert u.seam_votes(np.zeros((2, 2)), np.ones((2, 2)), value, label) == [(1, 2, 0, 2.0)]
    assert spanning_offsets([1, 2, 3], [(1, 2, 1, 5.0), (2, 3, -2, 1.0), (1, 3, 9, 0.5)]) == {1: 0, 2: -1, 3: 1}


def test_small_parts():
    with pytest.raises(UnwrapError):
        u.unwrap_grid(np.zeros((1, 5)), np.zeros((1, 5)))
    with pytest.raises(UnwrapError):
        u.unwrap_grid(np.zeros((3, 5)), np.zeros((5, 3)))
    filled = u.fill_untrusted(np.array([[1.0, 9.0, 9.0]]), np.array([[0.9, 0.1, 0.1]]))
    assert filled.tolist() == [[1.0, 1.0, 1.0]]
    assert u.fill_untrusted(np.array([[1.0, 9.0]]), np.zeros((1, 2))).tolist() == [[1.0, 9.0]]
    assert u.upsample(np.array([[1, 2], [3, 4]]), (5, 4)).tolist()[-1] == [3, 3, 4, 4]
    z, c = u.downsample(np.array([[1 + 0j, 1j], [1, 1j]]), np.array([[1.0, 0.0], [1.0, 0.0]]), (2, 2))
    assert np.allclose(z, 1) and np.allclose(c, 1)
    wx, wy = u.edge_costs(np.array([[0.9, 0.9], [0.0, 1.0]]))
    assert wx.tolist() == [[42632], [10000]] and wy.tolist() == [[10000, 92564]]
    assert u.grid_edges((2, 2)) == [(0, 1), (0, 2), (1, 3), (2, 3)]
    w = u.feather((2, 4, 0, 2), (0, 6, 0, 2))
    assert np.allclose(w[:, 0], [1 / 3, 2 / 3, 1, 1, 1, 0.5])


def test_only_the_pairs_of_the_network_are_formed(spark):
    from rasterloom.operators.unwrapping import sample_network

    ifgs, _ = sample_network(spark, "/root/testdata/sf0.001", [(0, 1), (0, 3)])
    assert "sequence(0, 31" not in ifgs._jdf.queryExecution().analyzed().toString()
    assert {(r["ifg"], r["i"], r["j"]): r["count"] for r in ifgs.groupBy("ifg", "i", "j").count().collect()} == {(0, 0, 1): 500, (1, 0, 3): 500}

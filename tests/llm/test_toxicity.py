"""Segment search of the toxicity operator against brute force."""

import numpy as np
import pytest

from rasterloom.llm.toxicity import maximal_segments


def by_recursion(values, shift=0):
    """All maximal segments: the best one (the shortest of equals), then those on either side of it."""
    best = max(((sum(values[a:b]), a - b, -a, a, b) for a in range(len(values)) for b in range(a + 1, len(values) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    a, b = best[3:]
    return [*by_recursion(values[:a], shift), (a + shift, b - 1 + shift, best[0]), *by_recursion(values[b:], shift + b)]


@pytest.mark.parametrize("seed", range(60))
def test_segments_equal_recursion(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    at = np.flatnonzero(rng.random(n) < 0.4)
    gain = rng.random(len(at)) * 3 + 1e-3
    values = np.full(n, -1.0)
    values[at] = gain
    found = maximal_segments(at, gain)
    want = by_recursion(values.tolist())
    assert [x[:2] for x in found] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in found], [x[2] for x in want])


def test_long_sparse_text_is_linear():
    at = np.arange(0, 600_000, 3)
    assert len(maximal_segments(at, np.full(len(at), 0.5))) == len(at)

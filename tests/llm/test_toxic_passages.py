"""Later passages of forms that a document has shown before."""

import numpy as np
import pyarrow as pa
import pytest

from rasterloom.llm.toxicity import Model, Tokens, distinct_segments, maximal_segments
from rasterloom.llm.textkernels import groups

INSULTS = ["aab", "bbc", "ccd", "dde", "eef"]


def found(text):
    _, _, data, offsets = next(groups(pa.array([" ".join(INSULTS)])))
    model = Model(np.sort(Tokens(data, offsets).hashes()), np.full(5, 2.0), 1.0, 1e-3, 1.0, 0.0)
    (_, segments), = model.segments(pa.array([text]))
    return [(text[a:b], s) for a, b, s, e in segments if e < 0.05 and s > 3]


@pytest.mark.parametrize("gap", [5, 9, 40])
def test_a_second_passage_is_found(gap):
    passage = " ".join(INSULTS)
    assert found(f"{passage} {'xx ' * gap}{passage}") == [(passage, 10.0)] * 2


def test_a_dense_passage_after_lone_insults_is_found():
    passage = " ".join(INSULTS)
    assert found(" xx xx xx xx ".join(INSULTS) + " xx xx xx xx " + passage) == [(passage, 10.0)]
    assert found(f"aab xx {passage}") == [(passage, 10.0)]


def test_stutter_counts_once():
    assert found("aab " * 500) == [] and found("aab bbc " * 500) == [("aab bbc", 4.0)] * 500


@pytest.mark.parametrize("seed", range(20))
def test_no_segment_counts_a_form_twice_and_distinct_forms_are_maximal_segments(seed):
    rng = np.random.default_rng(seed)
    at = np.flatnonzero(rng.random(200) < 0.4)
    gain, form = rng.random(len(at)) * 3 + 1e-3, np.arange(len(at))
    assert distinct_segments(at, gain, form) == maximal_segments(at, gain)
    with_repeat = np.append(form[:-1], form[-2])  # the last form repeats: the general search runs
    same = [x[:2] for x in distinct_segments(at, gain, with_repeat) if x[1] < at[-3]]
    assert same == [x[:2] for x in maximal_segments(at[:-1], gain[:-1]) if x[1] < at[-3]]
    form = rng.integers(0, 8, len(at))
    last = -1
    for a, b, score in distinct_segments(at, np.choose(form, gain[:8]), form):
        inside = {f for p, f in zip(at, form) if a <= p <= b}
        assert a > last and score == pytest.approx(sum(gain[f] for f in inside) - (b - a + 1 - len(inside)))
        last = b

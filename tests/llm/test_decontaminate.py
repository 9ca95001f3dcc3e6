"""Copies of items with runs of slots, and words split alike by the sieve and the verifier."""

import sys

import pyarrow as pa
import pytest
from pyspark.sql import Row

from rasterloom.llm import decontaminate

NUMBERS = ["3", "7", "8", "12", "14", "21", "33", "40", "52", "61", "75", "90"]
NAMES = ["Ann", "Bob", "Cid", "Dora", "Eve", "Finn", "Gil", "Hal", "Ida", "Jon", "Kim", "Lea"]


def loaded(spark, *texts):
    return decontaminate.load(spark.createDataFrame([Row(item_id=k, text=t) for k, t in enumerate(texts)]))


@pytest.mark.parametrize("run", range(2, 13))
@pytest.mark.parametrize("values", [NUMBERS, NAMES])
def test_exact_copies_with_runs_of_slots_are_caught(spark, run, values):
    item = f"what is the median value of {', '.join(values[:run])} when all of them are sorted first?"
    other = f"what is the median value of {', '.join(values[::-1][:run])} when all of them are sorted first?"
    bench = loaded(spark, item)
    for text, changed in ((item, 0), (other, None)):
        found = decontaminate.found_in(bench, pa.array([f"some words before. {text} some words after."]))
        assert [m[0] for _, m in found] == [0]
        assert changed is None or found[0][1][1:] == (1.0, changed)


def test_any_white_space_splits_words(spark):
    item = "which planet of the solar system has the largest number of known moons today?"
    bench = loaded(spark, item)
    spaces = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()]
    texts = [item.replace(" ", c) for c in spaces]
    assert [d for d, _ in decontaminate.found_in(bench, pa.array(texts))] == list(range(len(spaces)))

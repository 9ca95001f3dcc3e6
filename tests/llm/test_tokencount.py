import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.llm import tokencount as t

ENC = t.Encoder(open(t.VOCABULARY, "rb").read())
CHARS = st.text(alphabet="ab 12'sretl.\n\t é!", max_size=400)


@settings(max_examples=150, deadline=None)
@given(CHARS, st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 6), st.text(alphabet="a 1's\n.", max_size=8)), max_size=6))
def test_edits_equal_a_full_recount(text, edits):
    doc = t.CountedText(text, ENC)
    assert doc.tokens == ENC.full(text)
    for at, length, new in edits:
        start = at % (len(doc.text) + 1)
        doc.edit(start, min(len(doc.text), start + length), new)
        assert doc.tokens == ENC.full(doc.text)


def test_long_text_re_encodes_little():
    rng = random.Random(3)
    text = " ".join(rng.choice(["the", "42", "naïve", "end.", "it's"]) for _ in range(20000))
    doc = t.CountedText(text, ENC)
    doc.encoded = 0
    for _ in range(30):
        at = rng.randrange(len(doc.text))
        doc.edit(at, min(len(doc.text), at + 5), " new words")
        assert doc.tokens == ENC.full(doc.text)
    assert doc.encoded < 30 * 20


def test_query_rows(spark):
    rows = [(1, "mail bob@example.com now"), (2, None), (2, ""), (None, "call +44 20 7946 0958")]
    got = {(r["id"], r["n_edits"], r["n_tokens_edited"]) for r in t.count_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, ENC.full("mail <redacted> now")), (2, 0, 0), (None, 1, ENC.full("call +<redacted>"))}


def test_empty_table(spark):
    assert t.count_edited(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("text", ["", " ", "\n\n", "'re", "a"])
def test_small_texts(text):
    doc = t.CountedText(text, ENC)
    doc.edit(0, len(text), "xyz 1")
    assert doc.tokens == ENC.full("xyz 1")

"""The language model against counts and formulas in plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import lm

rng = random.Random(3)
WORDS = [f"w{k}" for k in range(12_000)]  # more than any fixed vocabulary of 8192 words
TEXTS = [" ".join(WORDS[(17 * d + k) % len(WORDS)] for k in range(400)) for d in range(60)]
TEXTS += [" ".join(rng.choices(WORDS, k=300)) for _ in range(80)]
NEW = TEXTS[:3] + [" ".join(reversed(TEXTS[0].split())), "w1 unseen w2 w3", "", None]


def split(text):
    return [*(text or "").split(), None]


def plain(train, texts, hot):
    """``(tokens, known, base, score)`` of texts; ``hot`` tells which counts the dictionary holds."""
    words, pairs = Counter(), Counter()
    for t in train:
        w = split(t)
        words.update(w)
        pairs.update(zip([None, *w], w))
    whole = sum(words.values()) + len(words) + 1
    probes = lambda c: max(6, 16 - min(c.bit_length(), 15)) if hot(c) else 15
    false = 4 * sum(2.0 ** -probes(c) for c in words.values()) + 16
    back = false + lm.BACKOFF
    low = lambda c: 2 ** (c.bit_length() - 1) if c else 0
    high = lambda c: 2 ** c.bit_length() - 1 if c else 0
    out = []
    for t in texts:
        w, total = split(t), 0.0
        for a, b in zip([None, *w], w):
            n, c = words[a], words[b]
            p0 = ((c if hot(c) else low(c)) + 1) / (whole * (1 + 2.0**-10))
            context = n if hot(n) else high(n)
            together = min(low(pairs[a, b]), context, c if hot(c) else high(c))
            total += math.log10((together + back * p0) / (context * (1 + lm.EXCESS) + back + false) if context else p0)
        out.append((len(w), sum(words[x] > 0 for x in w), sum(math.log10((words[x] + 1) / whole) for x in w), total))
    return out


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def scored(spark):
    found = lm.train(frame(spark, TEXTS))
    got = {r["id"]: r for r in lm.score(frame(spark, NEW).selectExpr("*", "doc_id AS score", "text AS open"), *found).collect()}
    return [(got[k]["n_tokens"], got[k]["n_known"], got[k]["base_score"], got[k]["score"]) for k in range(len(NEW))], found[1]


def same(got, want):
    for g, w in zip(got, want):
        assert g[:2] == w[:2]
        assert g[2] == pytest.approx(w[2], rel=1e-9)
        assert g[3] == pytest.approx(w[3], rel=0.005, abs=0.05)  # false positives change few tokens


def test_scores_follow_the_formula(spark):
    got, model = scored(spark)
    same(got, plain(TEXTS, NEW, lambda c: c > 0))
    assert model.bloom.cutoff == 1


def test_words_outside_the_dictionary_come_from_the_filter(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT_WORDS", 3000)
    got, model = scored(spark)
    least = model.lex.counts.min()
    assert 0 < len(model.lex.keys) <= 3000
    same(got, plain(TEXTS, NEW, lambda c: c >= least))


@pytest.mark.parametrize("limit,hot", [(1 << 16, 1 << 19), (1 << 12, 3000), (0, 3000)])
def test_no_count_is_dropped_past_the_filter_bound(spark, monkeypatch, limit, hot):
    monkeypatch.setattr(lm, "MAX_FILTER_BYTES", limit)
    monkeypatch.setattr(lm, "HOT_WORDS", hot)
    monkeypatch.setattr(lm, "SHARD_BYTES", 1 << 16)
    got, model = scored(spark)
    assert model.bloom.cutoff > 1
    least = model.lex.counts.min()
    same(got, plain(TEXTS, NEW, lambda c: c >= least))


def test_workers_get_batches_bounded_in_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "m"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, docs = spark.conf.get(key), spark.range(0, 300, 1, 1).selectExpr("repeat(concat(id, ' '), 40000) AS text")
    got = lm.in_small_batches(docs.mapInArrow(sizes, "n long, m long"), "sizes").collect()
    assert sum(r["n"] for r in got) == 300 and sum(r["m"] for r in got) > 5 * lm.BATCH_BYTES
    assert max(r["m"] for r in got) < 1.1 * lm.BATCH_BYTES
    assert spark.conf.get(key) == before


@pytest.mark.parametrize("most,each", [(20_000, 1), (8, 5)])
def test_a_task_builds_its_even_share_of_the_shards(spark, monkeypatch, most, each):
    monkeypatch.setattr(lm, "SHARD_BYTES", 1 << 13)
    monkeypatch.setattr(lm, "MAX_TASKS", most, raising=False)
    docs = frame(spark, TEXTS)
    counts = lm.word_counts(docs)
    shards, bits = lm.build_filter(docs, counts, lm.lexicon(counts))
    held = {}
    for r in bits.select("shard", F.input_file_name().alias("file")).distinct().collect():
        held.setdefault(r["file"], set()).add(r["shard"])
    assert shards > 30 and set().union(*held.values()) == set(range(shards))
    assert max(map(len, held.values())) == -(-shards // min(max(8, shards), most)) <= each


@pytest.mark.parametrize("hot", [300, 1 << 19])
def test_every_context_sums_to_at_most_one(spark, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT_WORDS", hot)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    counts, model, _ = lm.train(docs)
    rows = counts.orderBy("c", "h").collect()
    h = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    unseen = np.array([12345], np.uint64)
    words = np.concatenate([h, unseen])
    exact, q = model.word_levels(words)
    assert q[-1] == 0 and exact[-1] == -1
    picked = np.unique(np.concatenate([np.linspace(0, len(h), 120, dtype=int), np.arange(len(h) - 30, len(h) + 1)]))
    for v in picked:
        pair_q = model.bloom.level(lm.bigram_key(np.full(len(words), words[v]), words, lm.word_class(exact)))
        p = 10 ** model.log10(pair_q, exact, q, np.full(len(words), exact[v]), np.full(len(words), q[v]))
        assert p.sum() <= 1.0 + 1e-9
        assert p.sum() > 0.2


def test_empty_tables_and_repeated_rows(spark):
    nothing = frame(spark, [])
    found = lm.train(nothing)
    assert lm.score(nothing, *found).count() == 0
    got = lm.score(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string"), *found).collect()
    assert sorted((str(r["id"]), r["n_tokens"], r["n_known"], r["score"]) for r in got) == sorted([("1", 3, 0, got[0]["score"]), ("1", 3, 0, got[0]["score"]), ("None", 1, 0, [r for r in got if r["id"] is None][0]["score"])])

"""Language, toxicity and quality models: held-out accuracy, plain formulas and edge rows."""

import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import langid, quality, toxicity, training
from rasterloom.llm.textkernels import groups
from rasterloom.llm.training import labelled_sample

SF = "/root/testdata/sf0.01"
EDGES = [(None, None), (7, ""), (7, ""), (8, "12 34 !"), (9, "word " * 60000), (None, "plain text")]
FEW = [(1, "a"), (2, "b"), (3, "a")]


def edges(spark, **more):
    return spark.createDataFrame(EDGES, "doc_id long, text string").selectExpr("*", "text AS score", "doc_id AS id", "text AS y", "doc_id AS segments")


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_languages_on_the_held_out_fold(spark):
    got = langid.query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) for r in got)
    told = [r for r in got if r["held_out"] and r["lang"] and len(r["text"] or "") > 40]
    assert len(told) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in told]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got) and all(r["lang_pred"] == "und" for r in got if not any(c.isalpha() for c in r["text"] or ""))


def test_codewords_are_apart_and_decoding_takes_the_nearest():
    for n in (1, 2, 4, 7, 9, 70):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n
        if 1 < n <= 9:
            assert min((code[i] != code[j]).sum() for i, j in itertools.combinations(range(n), 2)) >= 1
    code = langid.codewords(4)
    model = langid.Model(list("abcd"), code, np.zeros((1 << langid.BITS, code.shape[1]), np.float32), np.ones(code.shape[1]), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    for k in range(4):
        model.offset = np.where(code[k] == 1, 4.0, -4.0)
        model.offset[0] *= -1  # one wrong bit is corrected
        langs, scores, doubts = model.decode(pa.array(["some text", None, "77"]))
        assert langs == ["abcd"[k], "und", "und"] and scores[1:].tolist() == [0, 0] and not doubts[1:].any()
    model.offset = np.zeros(code.shape[1])
    langs, scores, doubts = model.decode(pa.array(["tie"]))
    assert langs == ["a"] and doubts[0] and scores[0] == pytest.approx(0.25)


def test_language_counts_against_plain_numpy(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES_AT_ONCE", 2)
    rng = random.Random(1)
    words = {"x": "aba cab", "y": "ddd eed", "z": "fgh ghi"}
    rows = [(k, " ".join(rng.choices(words[v].split(), k=5)), v) for k, v in enumerate("xyz" * 8)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, y string"), ["x", "y", "z"])
    counts = np.zeros((3, 1 << langid.BITS))
    for _, text, y in rows:
        for _, _, data, offsets in groups(pa.array([text])):
            for f, _ in langid.ngram_features(data, offsets):
                np.add.at(counts["xyz".index(y)], f, 1)
    share = (counts + langid.SMOOTHING) / (counts + langid.SMOOTHING).sum(1, keepdims=True)
    code = langid.codewords(3).astype(float)
    want = np.log(code.T @ share / code.sum(0)[:, None]) - np.log((1 - code).T @ share / (1 - code).sum(0)[:, None])
    assert np.allclose(model.weights, want.T, atol=1e-5)


def test_language_edge_rows(spark):
    docs = edges(spark).withColumn("lang", F.lit(None).cast("string"))
    none = langid.identify(docs, langid.train(docs)).collect()
    assert len(none) == len(EDGES) and {(r["lang_pred"], r["score"], r["ambiguous"]) for r in none} == {("und", 0.0, False)}
    one = docs.where("doc_id = 9").withColumn("lang", F.lit("en")).withColumn("doc_id", F.lit(4).cast("long"))
    got = {(r["id"], r["lang_pred"]) for r in langid.identify(docs, langid.train(one)).collect()}
    assert got == {(None, "und"), (7, "und"), (8, "und"), (9, "en"), (None, "en")}
    assert langid.identify(docs.limit(0), langid.train(one)).count() == 0


def test_more_languages_than_any_fixed_number(spark):
    rows = [(k, f"{chr(0x4E00 + k % 300) * 6}", f"l{k % 300:03d}") for k in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert len(model.languages) == 300
    got = langid.identify(docs, model).join(docs.selectExpr("doc_id AS id", "lang"), "id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.9


@pytest.mark.parametrize("few", [16, 1])
def test_labelled_sample_is_bounded_and_stratified(spark, monkeypatch, few):
    monkeypatch.setattr(training, "FEW_CLASSES", few)
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(300)] + [(5, 1), (None, 1), (6, None)], "doc_id long, y0 int")
    got = labelled_sample(docs, labels, "doc_id", "y0", [0, 1], 25).collect()
    assert sorted(r["y"] for r in got) == [0] * 25 + [1] * 25 and all(r["y"] == 1 for r in got if r["doc_id"] == 5)
    again = labelled_sample(docs.repartition(5), labels.repartition(7), "doc_id", "y0", [0, 1], 25).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in again}
    monkeypatch.setattr(training, "FEW_CLASSES", 17 - few)
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in labelled_sample(docs, labels, "doc_id", "y0", [0, 1], 25).collect()}


@pytest.mark.parametrize("module,modulus,remainder,label,at", [(toxicity, 3, 1, "toxic", 0.7), (quality, 5, 0, "quality", 0.3)])
def test_held_out_accuracy_and_fold(spark, module, modulus, remainder, label, at):
    labels = spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.max(label).alias("label"))
    got = module.query(spark, SF).join(labels, "doc_id", "left").collect()
    assert all(r["held_out"] == (fold(r["doc_id"], modulus) == remainder) and r["predicted"] == int(r["score"] >= at) and 0 <= r["score"] <= 1 for r in got)
    told = [(r["score"], r["label"]) for r in got if r["held_out"] and r["label"] is not None]
    pos, neg = [s for s, y in told if y == 1], [s for s, y in told if y == 0]
    area = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert area > 0.9, area


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_edge_rows_and_missing_classes(spark, module, label):
    docs = edges(spark)
    labels = spark.createDataFrame([(7, 1), (9, 0), (None, 1), (8, None)], f"doc_id long, {label} int")
    for given in (labels, labels.where(f"{label} = 0"), labels.limit(0)):
        model = module.train(docs, given)
        got = module.score(docs, model).collect()
        assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 for r in got)
        empty = {r["score"] for r in got if r["id"] == 7}
        assert len(empty) == 1
        assert module.score(docs.limit(0), model).count() == 0


def brute_segments(values):
    """All maximal-scoring segments by repeated search of the best segment on either side."""
    if not values:
        return []
    best = max(((sum(values[i : j + 1]), -(j - i), -i, i, j) for i in range(len(values)) for j in range(i, len(values))), default=None)
    if best is None or best[0] <= 0:
        return []
    _, _, _, i, j = best
    right = [(a + j + 1, b + j + 1) for a, b in brute_segments(values[j + 1 :])]
    return brute_segments(values[:i]) + [(i, j)] + right


def test_segments_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 14)
        hits = sorted(rng.sample(range(n), rng.randint(1, n)))
        gains = [rng.randint(1, 40) / 8 + k / 1024 for k in range(len(hits))]
        values = [-1.0] * n
        for p, g in zip(hits, gains):
            values[p] = g
        got = toxicity.maximal_segments(np.array(hits), np.array(gains))
        assert [(a, b) for a, b, _ in got] == brute_segments(values)
        for a, b, s in got:
            assert s == pytest.approx(sum(values[a : b + 1]))


def test_toxicity_query_finds_planted_passages(spark):
    rng = random.Random(9)
    common = [f"wort{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)]
    bad = ["grimlock", "vexhole", "snarkpit", "dreckling"]
    text = lambda toxic: " ".join(rng.choices(common, k=60) + (rng.sample(bad, k=4) if toxic else []) + rng.choices(common, k=60))
    rows = [(k, text(k % 3 == 0), int(k % 3 == 0)) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.select("doc_id", "toxic"))
    test = [(1, text(True)), (2, text(False)), (3, " ".join([text(True)] * 3)), (4, ""), (5, None)]
    got = {r["id"]: r for r in toxicity.score(spark.createDataFrame(test, "doc_id long, text string"), model).collect()}
    assert got[1]["score"] > 0.7 and got[3]["score"] > 0.7 and got[3]["n_segments"] == 3
    assert all(got[k]["score"] < 0.3 and got[k]["n_segments"] == 0 and got[k]["top_from"] is None for k in (2, 4, 5))
    a, b = got[1]["top_from"], got[1]["top_to"]
    assert set(test[0][1].encode()[a:b].decode().split()) <= set(bad)
    # evidence is the lower bound of the posterior log-odds of presence
    train = [(t, y) for k, t, y in rows if fold(k, 3) != 1]
    n = [sum(y == c for _, y in train) for c in (0, 1)]
    has = [sum("grimlock" in t for t, y in train if y == c) for c in (0, 1)]
    want = math.log((has[1] + 1) / (n[1] + 2)) - math.log((has[0] + 1) / (n[0] + 2)) - toxicity.BOUND * math.sqrt(1 / (has[1] + 1) + 1 / (has[0] + 1))
    for _, _, data, offsets in groups(pa.array(["grimlock"])):
        tokens = toxicity.Tokens(data, offsets)
        assert model.gain(tokens, tokens.hashes())[0] == pytest.approx(want)


def test_dual_coordinate_descent_against_a_plain_solver():
    rng = np.random.default_rng(3)
    rows = [rng.choice(40, size=rng.integers(3, 9), replace=False).astype(np.int32) for _ in range(60)]
    y = np.array([int((f < 12).sum() * 2 + rng.integers(0, 2) > (f >= 12).sum()) for f in rows])
    full = [f.astype(np.int32) for f in rows]
    sample = quality.Sample([quality.packed(f) for f in full])
    assert [f.tolist() for f in sample] == [f.tolist() for f in full]
    scale = quality.log_count_ratios(sample, y)
    counts = np.ones((2, 1 << quality.BITS))
    for f, c in zip(full, y):
        counts[c, f] += 1
    assert np.allclose(scale, np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum()))
    w, bias = quality.dual_coordinate_descent(sample, scale, y)
    x = np.zeros((60, 41))
    for k, f in enumerate(full):
        x[k, f], x[k, 40] = scale[f] / np.sqrt(len(f) + 1), 1
    sign, share = np.where(y == 1, 1.0, -1.0), [(y == c).sum() for c in (0, 1)]
    cap = np.array([quality.COST * 60 / (2 * share[c]) for c in y])
    primal = lambda v: 0.5 * v @ v + (cap * np.maximum(0, 1 - sign * (x @ v))).sum()
    own = np.concatenate([np.where(scale[:40] != 0, w[:40] / np.where(scale[:40] != 0, scale[:40], 1), 0), [bias]])
    v = np.zeros(41)
    best = primal(v)
    for t in range(1, 20001):  # subgradient descent
        v = v - (v - ((cap * sign * (sign * (x @ v) < 1))[:, None] * x).sum(0)) / (t + 20)
        best = min(best, primal(v))
    assert primal(own) <= best * 1.01
    dense = np.arange(0, 1 << quality.BITS, 3, dtype=np.int32)
    assert len(quality.packed(dense)) == (1 << quality.BITS) // 8 and (quality.Sample([quality.packed(dense)])[0] == dense).all()


@pytest.mark.parametrize("at_once,tables", [(64, []), (2, [2])])
def test_language_counts_are_written_only_if_read_again(spark, monkeypatch, at_once, tables):
    files, put = [], langid.written

    def counted(df, label):
        out = put(df, label)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(langid, "written", counted)
    monkeypatch.setattr(langid, "LANGUAGES_AT_ONCE", at_once)
    names = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    texts = {"x": "the quick brown fox", "y": "der schnelle braune Fuchs", "z": "le renard brun rapide"}
    rows = [(k, texts[y] + f" {k}", y) for k, y in enumerate("xyz" * 20)]
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, y string"), ["x", "y", "z"])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert files == tables
    assert model.decode(pa.array(list(texts.values())))[0] == list(texts)

"""The pipeline's run and its stages against plain Python on a whole small table, and edge rows of every stage."""

from fractions import Fraction

import corpus_pipeline as p
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import decontaminate, mixing, quality, simhash

from .test_corpus_operators import LOWER, plain_fingerprint

SF = "/root/testdata/sf0.001"


def components(rows):
    """Least id reachable over fingerprints of at most 4 differing bits."""
    fps = {d: plain_fingerprint(t) for d, t in rows}
    root = {d: d for d in fps}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in fps}


def holds_item(bench, text):
    return any(b.matches(text or "") for b in bench)


def expected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    # every text on its own, without Spark
    rows = [(d, t) for d, t in rows if model.score(pa.array([t], pa.string()))[0] >= quality.KEEP_AT]
    last = {}
    for d, t in rows:
        last[(t or "").translate(LOWER)] = max(d, last.get((t or "").translate(LOWER), d))
    rows = [(d, t) for d, t in rows if d in set(last.values())]
    least = components(rows)
    rows = [(d, t) for d, t in rows if least[d] == d]
    bench = decontaminate.Benchmark()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        bench.add(r["item_id"], r["text"])
    return sorted(d for d, t in rows if not holds_item([bench], t))


def test_run_against_plain_python(spark):
    got = p.run(spark, SF).collect()
    want = expected(spark)
    assert sorted(r["doc_id"] for r in got) == want and 0 < len(want) < 200
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(all(r[c] == docs[r["doc_id"]][c] for c in ("text", "lang", "source", "n_chars")) for r in got)
    # earliest deadline first with less than a block of deviation from the default weights
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + 1
    weights = {s: Fraction(w) for s, w in mixing.default_weights(sizes).items()}
    total = sum(weights.values())
    blocks = sorted({(r["slot"], r["source"], r["block"], r["release"], r["deadline"]) for r in got})
    done = dict.fromkeys(sizes, 0)
    assert len({b[0] for b in blocks}) == len(blocks) and len({(r["slot"], r["place"]) for r in got}) == len(got)
    for slot, source, block, release, due in blocks:
        share = weights[source] / total
        assert block == done[source] and release == block // share and due == -(-(block + 1) // share) and release <= slot < due
        done[source] += 1


def test_stages_keep_the_columns_and_handle_edge_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, dropped_id int, fingerprint string, mix_key int, kept int"
    rows = [(1, None, None, None, None, 1, "x", 1, 1), (2, "", "en", "a", 0, 1, "x", 1, 1), (2, "same words here again now", "en", "a", 1, 1, "x", 1, 1), (None, "same words here again now", "en", None, 1, 1, "x", 1, 1),
            (4, "long " * 40000, "en", "a", 1, 1, "x", 1, 1), (5, "Same Words here again now", "en", "b", 1, 1, "x", 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in p.STAGES:
        for given in (docs, docs.limit(0)):
            got = stage(spark, given, SF)
            assert got.columns[: len(docs.columns)] == docs.columns and (name == "mixing") == (len(got.columns) > len(docs.columns))
            kept = got.collect()
            assert len(kept) <= given.count()
            if name == "exact_dedup" and kept:
                assert sorted((r["doc_id"], (r["text"] or "")[:4]) for r in kept) == [(2, ""), (4, "long"), (5, "Same")]
            if name == "mixing" and kept:
                assert len(kept) == len(rows) and len({(r["slot"], r["place"]) for r in kept}) == len(rows)


def test_a_unique_text_is_not_lost_to_a_repeated_id(spark):
    x, other = "one two three four five six seven", "a quite different text of seven words"
    assert (plain_fingerprint(x) ^ plain_fingerprint(other)).bit_count() > 4
    docs = spark.createDataFrame([(0, x), (1, x), (1, other), (None, x)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(docs).collect()) == [(0, x), (1, other)]
    assert simhash.drop_near_duplicates(docs.where("doc_id = 0")).count() == 1 and simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_slots_do_not_change_between_runs(spark):
    rows = [(k % 7 if k % 3 else None, f"s{k % 2}", k) for k in range(90)]
    read = lambda n: {(r["n"], r["slot"], r["place"]) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, n int").repartition(n), block=4).collect()}
    assert read(1) == read(5) and len(read(3)) == 90


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_decontamination_against_every_window(spark, block_bytes):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    bench = decontaminate.load_blocks(items, block_bytes=block_bytes)
    assert (len(bench) > 1) == (block_bytes == 700)
    plain = decontaminate.Benchmark()
    for r in items.collect():
        plain.add(r["item_id"], r["text"])
    want = {(r["doc_id"], *m) for r in docs.collect() for m in plain.matches(r["text"] or "")}
    got = {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == want and len(want) >= 3
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()} - {w[0] for w in want}


def test_decontamination_edge_rows(spark):
    text = "which planet of the solar system has the largest number of known moons today?"
    items = spark.createDataFrame([(None, None), ("a", text), ("a", text), ("b", ""), ("c", "two words")], "item_id string, text string")
    docs = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (None, "x " + text), (5, "filler " * 50000 + text)], "doc_id long, text string").withColumn("item_id", F.lit(3))
    got = sorted((str(r["id"]), r["item_id"]) for r in decontaminate.contaminated(docs, decontaminate.load_blocks(items)).collect())
    assert got == sorted([("1", "a"), ("1", "a")] * 2 + [("None", "a")] * 2 + [("5", "a")] * 2)
    assert decontaminate.contaminated(docs, decontaminate.load_blocks(items.limit(0))).count() == 0
    assert decontaminate.contaminated(docs.limit(0), decontaminate.load_blocks(items)).count() == 0
    assert decontaminate.drop_contaminated(docs, decontaminate.load_blocks(items)).count() == 2

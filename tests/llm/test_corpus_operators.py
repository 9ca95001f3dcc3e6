import hashlib
import re
from fractions import Fraction

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from rasterloom.llm import catalogue, decontaminate, exact_dedup, licenses, mixing, simhash

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ROWS = [(1, "Same Text"), (2, "same text"), (3, None), (4, ""), (5, "É other"), (6, "é other"), (7, "x " * 30000), (None, "same text"), (2, "same text")]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    mine, other = catalogue.QUERIES[name](spark, SF).toPandas(), con.execute(catalogue.ORACLES[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(other.columns)
    tidy = lambda f: sorted((tuple("~" if v is None or v != v else v for v in r) for r in f[cols].astype(object).itertuples(index=False)), key=repr)
    assert tidy(mine) == tidy(other)


def test_exact_dedup_edge_rows(spark):
    got = exact_dedup.exact_dedup(docs_of(spark, ROWS).withColumn("kept", F.lit("clash")).withColumn("salt", F.lit(1))).collect()
    assert len(got) == len(ROWS)
    for r in got:
        norm = (r["text"] or "").translate(LOWER)
        same = [d for d, t in ROWS if (t or "").translate(LOWER) == norm]
        assert r["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()
        assert r["group_size"] == len(same) and r["keep_id"] == max(d for d in same if d is not None)
    assert sum(r["kept"] for r in got) == len({(t or "").translate(LOWER) for _, t in ROWS})


def test_exact_dedup_empty_table(spark):
    assert exact_dedup.exact_dedup(docs_of(spark, [])).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    n = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + n]).encode(), 42) for k in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    root = {d: d for d in fps}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = catalogue.QUERIES["op8_simhash"](spark, SF).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(d, f"{fps[d]:016x}", find(d)) for d in ids}


def test_licences_are_inherited_from_the_nearest_ancestor(spark):
    files = [
        ("LICENSE", "Released under the MIT License."), ("a/b/COPYING", "Licensed under the Apache License, Version 2.0."),
        ("a/x.py", "code"), ("a/b/c/y.py", None), ("z.py", ""), ("a/own.py", "# Licensed under CC BY-NC 4.0.\ncode"), (None, "code"),
    ]
    got = {r["p"]: (r["own_licence"], r["inherited_licence"], r["licence"]) for r in licenses.scan(spark.createDataFrame(files, "p string, t string"), "p", "t").collect()}
    assert got["a/x.py"] == (None, "MIT", "MIT") and got["z.py"] == (None, "MIT", "MIT")
    assert got["a/b/c/y.py"] == (None, "Apache-2.0", "Apache-2.0")
    assert got["a/own.py"] == ("CC-BY-NC-4.0", "MIT", "CC-BY-NC-4.0")
    assert got[None] == (None, None, None)


@pytest.mark.parametrize("each,parts", [(1_000_000, 1), (40, 3)])
def test_licences_of_directories_are_written_in_parts_by_input_size(spark, monkeypatch, each, parts):
    rows = [(f"d{k}/LICENSE", "Released under the MIT License.") for k in range(60)] + [(f"d{k}/sub/x.py", "code") for k in range(60)]
    tables, put = [], licenses.written
    monkeypatch.setattr(licenses, "written", lambda df, label: tables.append(put(df, label)) or tables[-1])
    monkeypatch.setattr(licenses, "FILES_A_PART", each, raising=False)
    names = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        got = licenses.scan(spark.createDataFrame(rows, "p string, t string"), "p", "t").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 120 and all(r["licence"] == "MIT" and r["inherited_from"] == r["p"].split("/")[0] for r in got)
    assert len(tables) == 1 and tables[0].count() == 120 and len(tables[0].inputFiles()) == parts


def test_licences_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "p string, t string"), "p", "t").count() == 0


@pytest.mark.parametrize("weights", [{"a": 1.0, "b": 1.0}, {"a": 5.0, "b": 3.0, "c": 0.01}, {str(k): 1 + k % 7 for k in range(40)}])
def test_schedule_stays_within_a_block_and_meets_deadlines(weights):
    slots = mixing.whole_slots(weights)
    plan = mixing.one_period(slots)
    assert sorted(p[4] for p in plan) == list(range(mixing.PERIOD))
    done = dict.fromkeys(slots, 0)
    for source, _, release, due, slot in sorted(plan, key=lambda p: p[4]):
        assert release <= slot < due
        done[source] += 1
        for s, n in slots.items():
            assert abs(done[s] - Fraction(n, mixing.PERIOD) * (slot + 1)) < 1


def test_mix_returns_every_row(spark):
    rows = [(k, ["a", "b", None][k % 3]) for k in range(200)] + [(5, "a"), (None, "b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string").withColumn("slot", F.lit(0))).collect()
    assert sorted(map(repr, ((r["doc_id"], r["source"]) for r in got))) == sorted(map(repr, rows))
    assert len({(r["slot"], r["place"]) for r in got}) == len(rows)
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string")).count() == 0


def test_reparameterised_questions_are_caught(spark):
    bench = spark.createDataFrame([(1, "A train leaves Paris and covers 120 km in 3 hours, so how many km does it cover in 5 hours at that speed?"), (2, None)], "item_id long, text string")
    docs = docs_of(spark, [
        (1, "Noise before. A train leaves Madrid and covers 300 km in 2 hours, so how many km does it cover in 7 hours at that speed? Noise."),
        (2, "a quite different text about trains that leave and cover some ground at speed"), (3, None), (4, ""),
    ])
    loaded = decontaminate.load(bench)
    assert {(r["id"], r["item_id"]) for r in decontaminate.contaminated(docs, loaded).collect()} == {(1, 1)}
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, loaded).collect()) == [2, 3, 4]


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = p.keep_distinct(spark, docs, SF).collect()
    last = {}
    for r in docs.collect():
        key = (r["text"] or "").translate(LOWER)
        last[key] = max(last.get(key, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in kept) == sorted(last.values())
    reps = p.keep_representatives(spark, docs, SF).collect()
    components = {r["component_id"] for r in catalogue.QUERIES["op8_simhash"](spark, SF).collect()}
    assert {r["doc_id"] for r in reps} == components and len(reps) == len(components)
    assert len(p.STAGES) == 5 and [n for n, _ in p.STAGES][-1] == "mixing"

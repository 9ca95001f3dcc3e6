"""The schedule against the unrounded target weights."""

from collections import Counter
from fractions import Fraction

import pytest

from rasterloom.llm import mixing, simhash


def holds(rows, shares, blocks):
    """Every block once and in its window, and every source within a block of its target while it has blocks."""
    assert len({r[4] for r in rows}) == len(rows) == sum(blocks.values())
    done = Counter()
    for source, k, release, due, slot in sorted(rows, key=lambda r: r[4]):
        w = shares[source]
        assert k == done[source] and release == k // w and due == -(-(k + 1) // w) and release <= slot < due
        done[source] += 1
        for s, n in blocks.items():
            if done[s] < n:
                assert abs(done[s] - shares[s] * (slot + 1)) < 1
    assert done == blocks


def test_schedule_follows_unrounded_weights():
    counts = {"big": 1_000_000} | {f"s{k}": 50_000 for k in range(20)}
    weights = mixing.default_weights(counts)
    total = sum(map(Fraction, weights.values()))
    blocks = {k: 4000 if k == "big" else 700 for k in counts}  # well past the 5300 slots after which rounded weights fail
    holds(list(mixing.schedule((k, n, weights[k]) for k, n in blocks.items())), {k: Fraction(w) / total for k, w in weights.items()}, blocks)


def mixed(spark, rows, **more):
    return mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), **more).collect()


def test_mix_follows_small_and_many_weights(spark):
    rows = [(k, "a" if k < 700 else "b" if k < 900 else "rare" if k < 910 else None) for k in range(1000)]
    weights = {"a": 3.0, "b": 1 / 3, "rare": 1e-5}
    got = mixed(spark, rows, weights=weights, block=4)
    assert sorted(r["doc_id"] for r in got) == list(range(1000))
    assert len({(r["slot"], r["place"]) for r in got}) == 1000
    total = sum(map(Fraction, weights.values()))
    found = {(r["source"], r["block"], r["release"], r["deadline"], r["slot"]) for r in got if r["source"]}
    holds(list(found), {k: Fraction(w) / total for k, w in weights.items()}, {"a": 175, "b": 50, "rare": 3})
    assert min(r["slot"] for r in got if r["source"] is None) > max(r["slot"] for r in got if r["source"])


def test_more_sources_than_a_period_all_get_their_share(spark):
    n = mixing.PERIOD + 60
    got = mixed(spark, [(k, f"s{k}") for k in range(n)])
    assert sorted(r["slot"] for r in got) == list(range(n))
    assert len(mixed(spark, [(1, "s1")], weights={f"s{k}": 1.0 for k in range(n)})) == 1


@pytest.mark.parametrize("module,most", [(mixing, 2), (simhash, 3)])
def test_small_tables_are_not_a_file_each_shuffle_partition(spark, monkeypatch, module, most):
    docs = spark.createDataFrame([(k, f"s{k % 30}", f"one two three {k // 3}") for k in range(600)], "doc_id long, source string, text string")
    files, put = {}, module.written

    def counted(df, label):
        out = put(df, label)
        files[label] = max(files.get(label, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(module, "written", counted)
    names = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        if module is mixing:
            assert len({(r["slot"], r["place"]) for r in mixing.mix(docs).collect()}) == 600
        else:
            assert {r["id"] - r["component_id"] for r in simhash.near_duplicates(docs).collect()} >= {0, 1, 2}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    dealt = {label: n for label, n in files.items() if label != "fingerprints" and not label.endswith("-edges")}
    assert dealt and max(dealt.values()) <= most

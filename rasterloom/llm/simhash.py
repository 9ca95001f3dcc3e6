"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two 32-bit segments.  Fingerprints within 4 bits agree in one segment up
to 2 bits, so the radius-1 Hamming balls (33 values) of that segment in both fingerprints
share a value.  Balls are enumerated and met in a table keyed by (segment, value); the
complete distance is verified for every match.

Large groups of near copies would fill a bucket with fingerprints that all link, so pairs
in a bucket are never expanded as such.  Work runs on distinct fingerprints.  Rounds link
each member of a bucket to that bucket's hub; components are contracted; only buckets that
still hold more than one component go on, and pairs are compared across components only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import forget, in_parts, table, unused, written

SEED = 42
SHINGLE = 4
MAX_DISTANCE = 4
HUB_ROUNDS = 2
BROADCAST_KEYS = 1_000_000  # keys of 8 bytes, some 30 MB as a hash table; more are joined by a shuffle
_CHUNK = 1 << 16


def _bit_counts(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None) -> int:
    """64-bit majority over the XXH64 of every word shingle, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(SHINGLE, len(words))
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops, total, counts, h = ends[width - 1 :].tolist(), len(words) - width + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, total, _CHUNK):
        counts += _bit_counts([h(joined[a:b], SEED) for a, b in zip(starts[k : k + _CHUNK], stops[k : k + _CHUNK])])
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, fp)``, ``fp`` as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, fp long")


def _segment(fp: Column, seg: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if seg else fp.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def buckets(fps: DataFrame) -> DataFrame:
    """``(key, fp)`` for the radius-1 ball of either segment; 66 rows a fingerprint."""
    ball = F.array(*[F.lit(0).cast("long")], *[F.lit(1 << k).cast("long") for k in range(32)])
    low = F.transform(ball, lambda m: _segment(F.col("fp"), 0).bitwiseXOR(m))
    high = F.transform(ball, lambda m: _segment(F.col("fp"), 1).bitwiseXOR(m).bitwiseOR(F.lit(1 << 32)))
    return fps.select("fp", F.explode(F.concat(low, high)).alias("key")).select("key", "fp")


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_DISTANCE


def components(edges: DataFrame, label: str) -> DataFrame:
    """``(fp, root)`` for every endpoint of ``edges (a, b)``, root the least of the component.

    Alternates large-star and small-star; every round is written to the shared folder.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = written(edges.where("a <> b").select(low.alias("a"), high.alias("b")).distinct(), f"{label}-edges")
    seen, rows = None, edges.count()
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours go to the least neighbour
        large = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), "m"), F.struct(F.col("b").alias("x"), "m"))).alias("e")).select(F.col("e.m").alias("a"), F.col("e.x").alias("b")).where("a <> b").distinct()
        before, edges = edges, written(in_parts(small, rows), f"{label}-star")
        forget(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("b").alias("fp"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("fp"), F.col("a").alias("root")).distinct())
        seen, rows = now, now[0]


def link_components(fps: DataFrame) -> DataFrame:
    """``(fp, root)`` of every distinct fingerprint that links to another."""
    # dealt anew first: a ball is 66 times its fingerprint, and the table of fingerprints has few files
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = fps.repartition(tasks, "fp").transform(buckets)
    shared = pairs.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
    rows = fps.count()
    shared = written(in_parts(shared, rows, again=True), "shared-buckets")
    # a bucket of two needs no members: its pair is (lo, hi)
    found = shared.select(F.col("lo").alias("a"), F.col("hi").alias("b")).where(_near("a", "b"))
    wanted = shared.where("n > 2").select("key")
    if wanted.count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    members = written(in_parts(pairs.join(wanted, "key"), rows, again=True), "large-buckets")
    roots = None
    for k in range(HUB_ROUNDS):
        hub = members.groupBy("key").agg(F.min_by("fp", F.xxhash64("fp", F.lit(k))).alias("hub"))
        found = found.union(members.join(hub, "key").select(F.col("hub").alias("a"), F.col("fp").alias("b")).where(_near("a", "b")))
        roots = components(found, f"hub{k}")
        found = roots.select(F.col("fp").alias("a"), F.col("root").alias("b"))
        rooted = members.select("key", "fp").join(roots, "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
        mixed = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
        members = written(in_parts(rooted.join(mixed, "key"), members.count()), "mixed-buckets")
    left = members.select("key", F.col("fp").alias("a"), F.col("root").alias("ra"))
    right = members.select("key", F.col("fp").alias("b"), F.col("root").alias("rb"))
    across = left.join(right, (left["key"] == right["key"]) & (F.col("ra") < F.col("rb")) & _near("a", "b"))
    return components(found.union(across.select("a", "b")), "final")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component_id)`` per row: the least id reachable over links of at most 4 bits.

    Rows with no words have fingerprint zero and link like any other; null text is empty.
    A null id is never the least unless its component has no other.  Repeated rows and ids keep one
    row each; ties of fingerprints are links of 0 bits.  Whole texts count, in chunks of shingles.  An empty
    table gives no rows.  Column names of the input do not matter beyond ``id_col`` and ``text_col``.
    """
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    rows = prints.count()
    distinct = written(in_parts(prints.groupBy("fp").agg(F.min("id").alias("least")), rows), "distinct-fingerprints")
    roots = written(in_parts(link_components(distinct.select("fp")), rows), "roots")
    named = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = written(in_parts(named.groupBy("root").agg(F.min("least").alias("component_id")), rows), "component-names")
    by_print = written(in_parts(named.join(least, "root").select("fp", "component_id"), rows), "print-components")
    return _spread_join(prints, by_print, rows)


def _spread_join(prints: DataFrame, by_print: DataFrame, rows: int) -> DataFrame:
    """Equi-join on ``fp`` of ``rows`` fingerprints, with the rows of very common ones dealt over salts."""
    limit = max(64, rows // 20_000)
    common = prints.groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("fp", F.ceil(F.col("n") / limit).cast("int").alias("salts"))
    common = written(in_parts(common, rows), "common-prints")
    # at most rows / limit <= 20,000 fingerprints are that common
    left = prints.join(F.broadcast(common), "fp", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1)).cast("long")).cast("int")).drop("salts")
    right = by_print.join(F.broadcast(common), "fp", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return left.join(right, ["fp", "salt"]).select("id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep the document of each component whose id is its least; other columns pass unchanged.

    Rows that repeat both id and fingerprint stay or go together.  An id that stands for several
    fingerprints is judged by each: a unique text is not lost to a copy that shares its id.  Null ids stay only
    in a component without any other id.
    """
    name, print_name = unused(docs, "dropped_id", "fingerprint")
    found = near_duplicates(docs, id_col, text_col)
    rows = docs.count()
    drop = found.where(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias(name), F.col("fp").alias(print_name)).distinct()
    drop = written(in_parts(drop, rows), "dropped-ids")
    several = found.groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select(F.col("id").alias(name))
    several = written(in_parts(several, rows), "ambiguous-ids")
    same = docs[id_col].eqNullSafe(drop[name])
    if several.isEmpty():  # ids are keys
        return docs.join(drop, same, "left_anti")
    ambiguous = docs[id_col].eqNullSafe(several[name])
    plain = docs.join(several, ambiguous, "left_anti")
    marked = _with_fingerprint(docs.join(several, ambiguous, "left_semi"), text_col, print_name)
    kept = marked.join(drop, marked[id_col].eqNullSafe(drop[name]) & (marked[print_name] == drop[print_name]), "left_anti")
    return plain.join(drop, plain[id_col].eqNullSafe(drop[name]), "left_anti").unionByName(kept.drop(print_name))


def _with_fingerprint(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(at)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

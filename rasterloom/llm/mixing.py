"""Mixing sources to target weights by Pfair scheduling.

Documents of a source form blocks; block k of a source of weight w is released at slot
floor(k / w) and due by slot ceil((k + 1) / w), with w an exact fraction.  Blocks go earliest
deadline first.  One task makes the schedule from a row per source and holds one number per
source, and writes a row per block; it is then spread over the buckets in which documents are
numbered.  At every slot each source is within one block of its fluid share as long as it still
has blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import in_parts, table, unused, written

PERIOD = 5040
BLOCK = 16  # documents
TEMPERATURE = 0.5  # default weights: document share to this power
BUCKET_ROWS = 4000
BATCH = 10_000  # blocks of the schedule written at once
FAR = 1 << 40  # sources without a weight start here, or after the last deadline


def whole_slots(weights: dict, period: int = PERIOD) -> dict:
    """Slots of each source in a period: largest remainders, at least one each."""
    weights = {k: w for k, w in weights.items() if w > 0}
    if not weights:
        return {}
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources do not fit a period of {period} slots")
    total = sum(weights.values())
    exact = {k: w / total * period for k, w in weights.items()}
    slots = {k: max(1, math.floor(x)) for k, x in exact.items()}
    order = sorted(exact, key=lambda k: (slots[k] - exact[k], str(k)))
    spare, at = period - sum(slots.values()), 0
    while spare > 0:
        slots[order[at % len(order)]] += 1
        spare, at = spare - 1, at + 1
    while spare < 0:
        most = max(slots, key=lambda k: (slots[k] - exact[k] if slots[k] > 1 else -math.inf, str(k)))
        slots[most] -= 1
        spare += 1
    return slots


def schedule(sources: Iterable[tuple], total: Fraction | None = None) -> Iterator[tuple]:
    """``(source, k, release, deadline, slot)`` of every block, earliest deadline first, from ``(source, blocks, weight)``.

    Weights count as exact shares of ``total``, their sum by default.  The state is one entry per source.
    """
    known = [(source, n, Fraction(w)) for source, n, w in sorted(sources, key=lambda x: str(x[0]))]
    total = sum((w for _, _, w in known), Fraction(0)) if total is None else total
    # per block of a source: up / down slots
    known = [(source, n, (total / w).numerator, (total / w).denominator) for source, n, w in known if n and w > 0]
    coming = [(0, order, 0) for order in range(len(known))]
    ready: list[tuple] = []
    slot = 0
    while coming or ready:
        if not ready:
            slot = max(slot, coming[0][0])
        while coming and coming[0][0] <= slot:
            release, order, k = heapq.heappop(coming)
            _, n, up, down = known[order]
            heapq.heappush(ready, (-((k + 1) * -up // down), order, k, release))
            if k + 1 < n:
                heapq.heappush(coming, ((k + 1) * up // down, order, k + 1))
        deadline, order, k, release = heapq.heappop(ready)
        yield known[order][0], k, release, deadline, slot
        slot += 1


def one_period(slots: dict, period: int | None = None) -> list[tuple]:
    """``(source, k, release, deadline, slot)`` of every block of one period, earliest deadline first."""
    return list(schedule(((source, a, a) for source, a in slots.items()), Fraction(period or sum(slots.values()))))


def default_weights(counts: dict) -> dict:
    """Share of documents to the power ``TEMPERATURE``."""
    return {k: n**TEMPERATURE for k, n in counts.items() if n}


def numbered(docs: DataFrame, id_col: str, key: str, block: int, plan: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with a dense 0-based number within each ``key`` in hash order of the row.

    A source is cut into hash buckets of about ``BUCKET_ROWS`` rows, counted, and offset by
    running sums over the counts, so no task ever holds a whole source unless its rows are equal in
    every column.  A third column has the ``plan`` (key, k, r, d, s) of
    the row's block; it comes with the bucket, so rows are shuffled once.
    """
    bucket, before, number, order, slots, own = unused(docs, "bucket", "before", "number", "order", "bucket_plan", "own_plan")
    sizes = docs.groupBy(key).agg(F.count("*").alias("n"))
    most, sources = sizes.agg(F.max("n"), F.count("*")).first()
    buckets = max(1, math.ceil((most or 1) / BUCKET_ROWS))
    # rows that repeat an id (or have none) are told apart by their other columns; equal rows are interchangeable
    others = [c for c in docs.columns if c not in (id_col, key)]
    h = F.xxhash64(F.col(id_col), *others)
    spread = F.floor((F.shiftrightunsigned(h, 33).cast("double") / float(1 << 31)) * buckets).cast("long")
    docs = docs.withColumn(order, h).withColumn(bucket, spread)
    counts = written(in_parts(docs.groupBy(key, bucket).agg(F.count("*").alias("n")), sources * buckets), "source-buckets")
    earlier = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, bucket, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before), "n")
    spans = offsets.select(key, bucket, before, F.explode(F.sequence(F.floor(F.col(before) / block).cast("long"), F.floor((F.col(before) + F.col("n") - 1) / block).cast("long"))).alias("k"))
    # about BUCKET_ROWS / block entries each
    offsets = spans.join(plan, [key, "k"]).groupBy(key, bucket, before).agg(F.array_sort(F.collect_list(F.struct("k", "r", "d", "s"))).alias(slots))
    within = Window.partitionBy(key, bucket).orderBy(order, F.col(id_col), F.xxhash64(F.lit(1), *others) if others else F.lit(0))
    ranked = docs.withColumn(number, F.row_number().over(within) - 1)
    joined = ranked.join(offsets, [key, bucket]).withColumn(number, (F.col(number) + F.col(before)).cast("long"))
    at = F.floor(F.col(number) / block) - F.floor(F.col(before) / block) + 1
    return joined.withColumn(own, F.element_at(slots, at.cast("int"))).drop(bucket, before, order, slots), number, own


def block_plan(counts: DataFrame, key: str, weights: dict | None, block: int) -> DataFrame:
    """The written schedule ``(key, k, r, d, s)`` of sources ``(key, n)``, with default weights where none are given."""
    total = None if weights is None else sum((Fraction(w) for w in weights.values() if w > 0), Fraction(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((k, n) for b in batches for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        target = default_weights(dict(rows)) if weights is None else weights
        blocks = {k: -(-n // block) for k, n in rows}

        def every() -> Iterator[tuple]:
            last = 0
            for row in schedule(((k, n, target[k]) for k, n in blocks.items() if target.get(k, 0) > 0), total):
                last = max(last, row[3])
                yield row
            slot = max(FAR, last)
            for source, n in blocks.items():
                if not target.get(source, 0) > 0:
                    yield from ((source, k, slot + k, slot + k + 1, slot + k) for k in range(n))
                    slot += n

        held: list[tuple] = []
        for row in every():
            held.append(row)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held)], names=[key, "k", "r", "d", "s"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held)], names=[key, "k", "r", "d", "s"])

    return written(counts.select(key, "n").repartition(1).mapInArrow(run, f"`{key}` string, k long, r long, d long, s long"), "block-plan")


def mix(docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """``docs`` with ``block, release, deadline, slot, place`` added: read by ``slot`` then ``place``.

    ``weights`` maps source values (None for null) to relative targets; sources it leaves out
    follow every scheduled one, one block after another in slots past the schedule's end.  Every
    row is returned.  A source without rows left leaves its slots empty.

    Only ids and sources decide, texts pass as they are.  A null source is one of its own; null and
    repeated ids are ordered by their other columns, so a run over the same rows gives the same slots (rows
    equal in every column trade places).  Ties of deadlines go to the first source by name.  An empty table
    gives no rows; columns named like the added ones are replaced.
    """
    added = ("block", "release", "deadline", "slot", "place")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in added))
    key = unused(docs, "mix_key")[0]
    keyed = docs.withColumn(key, F.when(F.col(source_col).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string"))))
    counts = keyed.groupBy(key).agg(F.count("*").alias("n"))
    named = {None if x is None else str(x): w for x, w in weights.items()} if weights else None
    target = None if named is None else {"null" if x is None else f"={x}": w for x, w in named.items()}
    rows, number, own = numbered(keyed, id_col, key, block, block_plan(counts, key, target, block))
    out = {"block": F.col(f"{own}.k"), "release": F.col(f"{own}.r"), "deadline": F.col(f"{own}.d"), "slot": F.col(f"{own}.s"), "place": (F.col(number) % block).cast("int")}
    return rows.withColumns(out).select(*docs.columns, *added)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))

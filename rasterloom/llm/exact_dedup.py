"""Exact dedup: two Bloom passes find hashes that may repeat; only their rows shuffle.

Pass 1 counts, per bit position of a Bloom filter, how many rows set it, and keeps the
positions set at least twice, packed as 4 KB bitmaps.  Pass 2 probes those bitmaps:
a row with a position that was set once cannot have an equal and passes straight through.
Flagged rows are grouped by SHA-256, so false positives of the filter cost a shuffle and
never change the result.  Everything is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import ascii_lower, table, unused, written

SEGMENT_BITS = 15  # bitmap_construct_agg packs 2**15 bits
MAX_FILTER_BITS = 30  # 128 MB is the most that is ever broadcast
BITS_PER_ROW = 16
MAX_HOT_GROUPS = 20_000


def _bit(bitmap: Column, position: Column) -> Column:
    """Bit ``position`` (0..2**15-1) of a 4 KB bitmap; a missing bitmap has no bit set."""
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(position, 3).cast("int") + 1, 1)), 16, 10)
    return F.coalesce(F.pmod(F.floor(byte.cast("int") / F.pow(F.lit(2), position.bitwiseAND(7))), F.lit(2)) == 1, F.lit(False))


def repeated_filter(hashes: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """From one ``h`` per row: bitmaps ``(seg, bits)`` of the positions set twice or more, and log2 of the size."""
    width = min(MAX_FILTER_BITS, max(SEGMENT_BITS + 1, math.ceil(math.log2(max(rows, 1) * BITS_PER_ROW))))
    first, second = positions(F.col("h"), width)
    twice = hashes.select(F.explode(F.array(first, second)).alias("pos")).groupBy("pos").agg(F.count("*").alias("n")).where("n >= 2")
    low = F.col("pos").bitwiseAND((1 << SEGMENT_BITS) - 1)
    bitmaps = twice.groupBy(F.shiftright("pos", SEGMENT_BITS).alias("seg")).agg(F.bitmap_construct_agg(low).alias("bits"))
    return bitmaps, width


def positions(h: Column, width: int) -> tuple[Column, Column]:
    mask = F.lit((1 << width) - 1).cast("long")
    return h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``keep_id, group_size, kept, text_sha256`` added, one row per input row.

    Texts are equal when identical after lower-casing A-Z; null equals empty.  The largest id
    of a group stays; a null id is smaller than any other.  Of rows that repeat both id and
    text one is kept.  Input columns of the same names are replaced.
    """
    added = ("keep_id", "group_size", "kept", "text_sha256")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in added and c not in (id_col, text_col)))
    p1, p2, s1, s2, b1, b2, salt, salts, sha, top, rank = unused(docs, "p1", "p2", "s1", "s2", "b1", "b2", "salt", "salts", "sha", "n_top", "rank")
    rows = docs.count()
    norm = ascii_lower(F.col(text_col))
    bitmaps, width = repeated_filter(docs.select(F.xxhash64(norm).alias("h")), rows)
    bitmaps = written(bitmaps, "repeated-filter")  # at most 2**(width - 15) rows of 4 KB
    h = unused(docs, "h")[0]
    first, second = positions(F.col(h), width)
    low = (1 << SEGMENT_BITS) - 1
    probed = (
        docs.withColumn(sha, F.sha2(norm, 256))
        .withColumn(h, F.xxhash64(norm))
        .withColumns({p1: first.bitwiseAND(low), s1: F.shiftright(first, SEGMENT_BITS), p2: second.bitwiseAND(low), s2: F.shiftright(second, SEGMENT_BITS)})
        .join(F.broadcast(bitmaps.select(F.col("seg").alias(s1), F.col("bits").alias(b1))), s1, "left")
        .join(F.broadcast(bitmaps.select(F.col("seg").alias(s2), F.col("bits").alias(b2))), s2, "left")
    )
    maybe = _bit(F.col(b1), F.col(p1)) & _bit(F.col(b2), F.col(p2))
    keep = [*docs.columns, sha]
    single, flagged = probed.where(~maybe).select(*keep), probed.where(maybe).select(*keep)

    per_id = flagged.groupBy(sha, F.col(id_col).alias("id")).agg(F.count("*").alias("n"))
    hot = max(64, math.ceil(rows / MAX_HOT_GROUPS))
    groups = per_id.groupBy(sha).agg(F.sum("n").alias("group_size"), F.max(F.struct("id", "n")).alias("last"))
    groups = written(groups.select(sha, "group_size", F.col("last.id").alias("keep_id"), F.col("last.n").alias(top), F.ceil(F.col("group_size") / hot).cast("int").alias(salts)), "copy-groups")
    # groups larger than `hot` rows: at most rows / hot <= MAX_HOT_GROUPS of them
    dealt = flagged.join(F.broadcast(groups.where(F.col(salts) > 1).select(sha, salts)), sha, "left").withColumn(
        salt, F.pmod(F.xxhash64(F.col(id_col)), F.coalesce(F.col(salts), F.lit(1)).cast("long")).cast("int")
    )
    spread = groups.withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(salts) - 1))).drop(salts)
    joined = dealt.drop(salts).join(spread, [sha, salt])
    same = Window.partitionBy(sha, salt, id_col).orderBy(F.lit(1))
    joined = joined.withColumn(rank, F.row_number().over(same))
    is_kept = F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col(rank) == 1)
    out = [*docs.columns, "keep_id", "group_size", "kept", F.col(sha).alias("text_sha256")]
    return single.withColumns({"keep_id": F.col(id_col), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)}).select(*out).unionByName(
        joined.withColumn("kept", is_kept).select(*out)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM n
"""

"""Helpers that the corpus operators share: tables, written intermediates, text expressions."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import session

SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
ROWS_A_PART = 4000  # of a small written table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    return session.written(df, label)


def in_parts(df: DataFrame, rows: int, again: bool = False) -> DataFrame:
    """``df`` in a part for each ``ROWS_A_PART`` of ``rows`` rows where that is fewer than it has, for a table about to be written.

    A shuffle partition would be a file each, however few its rows.  Parts are merged where the last stage
    is light; ``again`` deals the rows out once more and keeps the tasks that make them.
    """
    parts = max(1, math.ceil(rows / ROWS_A_PART))
    if not again:
        return df.coalesce(parts)
    return df.repartition(parts) if parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def forget(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that no later plan reads."""
    session.forget(df)


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z and nothing else changes; null counts as empty.

    ``lower`` agrees with that on ASCII-only text and has a fast path there.
    """
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(
        F.translate(t, string.ascii_uppercase, string.ascii_lowercase)
    )


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text decides the fold; a null id counts as held out by no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, so added columns never clash."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out

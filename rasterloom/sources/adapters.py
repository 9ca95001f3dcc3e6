"""Raster views of the driver's tables.

E-cube: one real series per user (pixel row user_id div 15, col user_id mod 15, epoch = days since
2024-01-01).  C-cube: one complex stack per vector (row vec_id div 25, col vec_id mod 25,
32 epochs from interleaved real and imaginary parts).  N-days: distinct event days.
Each has a DataFrame form and the SQL that an oracle uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN = "2024-01-01"
E_COLS, C_COLS, EPOCHS = 15, 25, 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(ts: Column) -> Column:
    return F.datediff(F.to_date(ts), F.lit(ORIGIN).cast("date"))


def e_cube(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """``(user_id, t, y, w)``: mean and number of the values of a user-day, per extra key ``by``."""
    events = table(spark, sf_dir, "events").select("user_id", day(F.col("ts")).alias("t"), "value", *by)
    return events.groupBy("user_id", "t", *by).agg(F.avg("value").alias("y"), F.count("value").alias("w"))


def grid(user_id: str = "user_id", cols: int = E_COLS) -> tuple[Column, Column]:
    return F.floor(F.col(user_id) / cols).cast("bigint").alias("row"), F.pmod(F.col(user_id), F.lit(cols)).cast("bigint").alias("col")


def c_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row, col, z)``, ``z`` an array of 64 doubles."""
    return table(spark, sf_dir, "embeddings").select(*grid("vec_id", C_COLS), F.col("embedding").cast("array<double>").alias("z"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(d, k)``: distinct event days and their 0-based rank.  At most one row a calendar day."""
    from pyspark.sql.window import Window

    found = table(spark, sf_dir, "events").select(day(F.col("ts")).alias("d")).where("d IS NOT NULL").distinct()
    return found.select("d", (F.row_number().over(Window.orderBy("d")) - 1).cast("int").alias("k"))


E_CUBE_SQL = f"""e AS (SELECT user_id, CAST(date_diff('day', DATE '{ORIGIN}', CAST(ts AS DATE)) AS INT) AS t,
  avg(value) AS y, count(value) AS w FROM events GROUP BY ALL)"""
C_STACK_SQL = f"""c AS (SELECT CAST(vec_id // {C_COLS} AS BIGINT) AS "row", CAST(vec_id % {C_COLS} AS BIGINT) AS col,
  CAST(embedding AS DOUBLE[]) AS z FROM embeddings)"""
DAYS_SQL = f"""n AS (SELECT d, CAST(row_number() OVER (ORDER BY d) - 1 AS INT) AS k FROM (
  SELECT DISTINCT CAST(date_diff('day', DATE '{ORIGIN}', CAST(ts AS DATE)) AS INT) AS d FROM events WHERE ts IS NOT NULL))"""

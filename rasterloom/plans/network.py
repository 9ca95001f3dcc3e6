"""Planning over small metadata: acquisition pairs, triplets, incidence, ministacks, blocks, tiles.

Pair generators meet on equal ranks or days (offsets are enumerated), never by a range condition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.sources.adapters import DAYS_SQL, ORIGIN, days, table

BANDWIDTH, BASELINE, REFERENCE = 2, 4, 0
STACK, CAP = 5, 10
EXPLICIT = [(0, 3), (5, 2), (2, 5), (-1, 0), (4, 999), (7, 7)]


def single_reference(n: DataFrame, reference: int = REFERENCE) -> DataFrame:
    """(min, max) of the reference rank and every other."""
    return n.where(F.col("k") != reference).select(F.least("k", F.lit(reference)).alias("i"), F.greatest("k", F.lit(reference)).alias("j"))


def bandwidth(n: DataFrame, width: int = BANDWIDTH) -> DataFrame:
    ahead = n.select(F.col("k").alias("i"), F.explode(F.sequence(F.col("k") + 1, F.col("k") + width)).alias("j"))
    return ahead.join(n.select(F.col("k").alias("j")), "j").select("i", "j")


def baseline(n: DataFrame, most: int = BASELINE) -> DataFrame:
    """Pairs at most ``most`` days apart."""
    ahead = n.select(F.col("k").alias("i"), F.explode(F.sequence(F.col("d") + 1, F.col("d") + most)).alias("d"))
    return ahead.join(n.select("d", F.col("k").alias("j")), "d").select("i", "j")


def network(n: DataFrame) -> DataFrame:
    """Union of the generators, sorted and distinct."""
    return single_reference(n).union(bandwidth(n)).union(baseline(n)).distinct()


def explicit(n: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """Pairs of ranks as given, negative ones from the end; a rank that does not exist gives no pair."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b")) for i, j in pairs]))
    x = n.groupBy().agg(F.count("*").cast("int").alias("n")).select("n", each.alias("p"))
    at = lambda c: F.when(F.col(c) < 0, F.col(c) + F.col("n")).otherwise(F.col(c))
    x = x.select("n", at("p.a").alias("a"), at("p.b").alias("b")).where("a <> b AND least(a, b) >= 0 AND greatest(a, b) < n")
    return x.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct()


def triplets(pairs: DataFrame) -> DataFrame:
    """Closed triangles (i, j), (j, k), (i, k)."""
    ij, jk, ik = pairs.toDF("i", "j"), pairs.toDF("j", "k"), pairs.toDF("i", "k")
    return ij.join(jk, "j").join(ik, ["i", "k"]).select("i", "j", "k")


def incidence(pairs: DataFrame) -> DataFrame:
    """Long incidence matrix: -1 at i, +1 at j; the lowest used date has no column."""
    ends = pairs.select("i", "j", F.explode(F.array(F.struct(F.col("i").alias("date"), F.lit(-1).alias("sign")), F.struct(F.col("j").alias("date"), F.lit(1).alias("sign")))).alias("e"))
    ends = ends.select("i", "j", "e.date", "e.sign")
    low = pairs.agg(F.min("i").alias("low"))
    return ends.join(F.broadcast(low), ends["date"] != F.col("low")).select("i", "j", "date", "sign")  # one row is broadcast


def ministacks(n: DataFrame, size: int = STACK, cap: int = CAP) -> DataFrame:
    """Batches of ``size`` acquisitions; each earlier batch leaves a compressed layer, at most ``cap`` are used.

    References (output, compressed) per plan: always_first (0, 0), first (0, n_compressed), last (n_compressed - 1, -1);
    a plan without compressed layers yet has output 0 under ``last``.
    """
    if size < 2:
        raise ValueError("a ministack holds at least two acquisitions")
    batches = n.groupBy(F.floor(F.col("k") / size).cast("int").alias("batch")).agg(F.count("*").alias("num_real"), F.min("k").alias("first"))
    comp = F.least("batch", F.lit(cap))
    return batches.select(
        "batch", "num_real", "first", comp.alias("num_compressed"), F.lit(0).alias("always_first_ref"), comp.alias("first_compressed_ref"), F.greatest(comp - 1, F.lit(0)).alias("last_output_ref")
    )


def ministack_references(n: DataFrame, size: int = STACK, cap: int = CAP, output: int = 0, sealed: int = 0) -> DataFrame:
    """Output and compression reference of every ministack under each plan, after ``sealed`` earlier ones; -1 is the last epoch."""
    if size < 2:
        raise ValueError("a ministack holds at least two acquisitions")
    batch = F.floor(F.col("k") / size).cast("int")
    g = n.groupBy(batch.alias("batch")).agg(F.count("*").alias("num_real"))
    comp = F.least(F.col("batch") + sealed, F.lit(cap))
    plans = F.explode(F.array(*[F.struct(F.lit(p).alias("plan"), o.alias("o"), c.alias("c")) for p, o, c in (("always_first", F.lit(output), F.lit(output)), ("first_per", F.lit(output), comp), ("last_per", comp - 1, F.lit(-1)))]))
    return g.select((F.col("batch") + sealed).alias("batch"), "num_real", comp.alias("num_compressed"), plans.alias("p")).select("batch", "num_real", "num_compressed", "p.plan", F.col("p.o").alias("output_ref"), F.col("p.c").alias("compressed_ref"))


def blocks(spark: SparkSession, rows: int, cols: int, size: int, overlap: int) -> DataFrame:
    """Blocks of an array; a step is shortened by ``overlap`` only while another block follows."""
    if size <= 0:
        return spark.range(0).select(*(F.lit(0).alias(c) for c in ("r0", "r1", "c0", "c1")))
    if overlap >= size:
        raise ValueError("overlap must be smaller than the block")
    step = size - overlap

    def axis(n: int, a: str, b: str) -> DataFrame:
        last = max(0, -(-(n - size) // step)) if n > size else 0
        k = spark.range(last + 1)
        return k.select((F.col("id") * step).cast("int").alias(a), F.least(F.col("id") * step + size, F.lit(n)).cast("int").alias(b), F.lit(0).alias("one"))

    return axis(rows, "r0", "r1").join(axis(cols, "c0", "c1"), "one").select("r0", "r1", "c0", "c1")


def _on_days(build):
    return lambda spark, sf_dir: build(days(spark, sf_dir))


def burst_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per group token: the part of a name between '_' that starts with T and holds -IW, else "single"."""
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("SLC_"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("T"), F.col("p_size").cast("string"), F.lit("-IW2_"))).otherwise(""), F.lit("20240101")).alias("name"))
    token = F.try_element_at(F.filter(F.split("name", "_"), lambda x: x.startswith("T") & x.contains("-IW")), F.lit(1))
    return names.groupBy(F.coalesce(token, F.lit("single")).alias("burst")).agg(F.count("*").alias("n"))


def decimal_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since the first acquisition in input order, per event type (input order: event_id)."""
    first = F.min_by("ts", "event_id")
    events = table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    return events.groupBy("event_type").agg(F.datediff(F.to_date(F.max("ts")), F.to_date(first)).alias("last_day"), F.datediff(F.to_date(F.max_by("ts", "event_id")), F.to_date(first)).alias("final_day"))


QUERIES = {
    "net_single_ref": _on_days(single_reference),
    "net_bandwidth": _on_days(bandwidth),
    "net_baseline": _on_days(baseline),
    "net_union": _on_days(network),
    "triplets": _on_days(lambda n: triplets(network(n))),
    "incidence": _on_days(lambda n: incidence(network(n))),
    "ministack_plan": _on_days(ministacks),
    "ministack_references": _on_days(ministack_references),
    "ministack_resume": _on_days(lambda n: ministack_references(n, 4, 6, 1, 3)),
    "net_explicit": _on_days(lambda n: explicit(n, EXPLICIT)),
    "iter_blocks": lambda spark, sf_dir: blocks(spark, 100, 64, 24, 4),
    "burst_group": burst_group,
    "decimal_days": decimal_days,
}

_PAIRS = f"""WITH {DAYS_SQL},
p AS (SELECT a.k AS i, b.k AS j FROM n a JOIN n b ON a.k < b.k
  AND (a.k = {REFERENCE} OR b.k - a.k <= {BANDWIDTH} OR b.d - a.d <= {BASELINE}))"""
ORACLES = {
    "net_single_ref": f"WITH {DAYS_SQL} SELECT CAST({REFERENCE} AS INT) AS i, k AS j FROM n WHERE k > {REFERENCE}",
    "net_bandwidth": f"WITH {DAYS_SQL} SELECT a.k AS i, b.k AS j FROM n a JOIN n b ON b.k - a.k BETWEEN 1 AND {BANDWIDTH}",
    "net_baseline": f"WITH {DAYS_SQL} SELECT a.k AS i, b.k AS j FROM n a JOIN n b ON b.d - a.d BETWEEN 1 AND {BASELINE}",
    "net_union": f"{_PAIRS} SELECT i, j FROM p",
    "triplets": f"{_PAIRS} SELECT x.i, x.j, y.j AS k FROM p x JOIN p y ON x.j = y.i WHERE EXISTS (SELECT 1 FROM p z WHERE z.i = x.i AND z.j = y.j)",
    "incidence": f"""{_PAIRS} SELECT i, j, i AS date, CAST(-1 AS INT) AS sign FROM p WHERE i > (SELECT min(i) FROM p)
  UNION ALL SELECT i, j, j, CAST(1 AS INT) FROM p WHERE j > (SELECT min(i) FROM p)""",
    "ministack_plan": f"""WITH {DAYS_SQL} SELECT CAST(k // {STACK} AS INT) AS batch, count(*) AS num_real, min(k) AS first,
  CAST(least(k // {STACK}, {CAP}) AS INT) AS num_compressed, CAST(0 AS INT) AS always_first_ref,
  CAST(least(k // {STACK}, {CAP}) AS INT) AS first_compressed_ref, CAST(greatest(least(k // {STACK}, {CAP}) - 1, 0) AS INT) AS last_output_ref
  FROM n GROUP BY k // {STACK}""",
    "iter_blocks": """SELECT CAST(r * 20 AS INT) AS r0, CAST(least(r * 20 + 24, 100) AS INT) AS r1, CAST(c * 20 AS INT) AS c0, CAST(least(c * 20 + 24, 64) AS INT) AS c1
  FROM range(0, 4 + 1) a(r), range(0, 2 + 1) b(c) WHERE r * 20 + 4 < 100 AND c * 20 + 4 < 64""",
    "burst_group": """SELECT CASE WHEN p_size % 3 = 0 THEN 'T' || p_size || '-IW2' ELSE 'single' END AS burst, count(*) AS n FROM part GROUP BY 1""",
    "decimal_days": """SELECT event_type, CAST(date_diff('day', CAST(arg_min(ts, event_id) AS DATE), CAST(max(ts) AS DATE)) AS INT) AS last_day,
  CAST(date_diff('day', CAST(arg_min(ts, event_id) AS DATE), CAST(arg_max(ts, event_id) AS DATE)) AS INT) AS final_day FROM events GROUP BY 1""",
    "ministack_references": f"""WITH {DAYS_SQL}, g AS (SELECT CAST(k // 5 AS INT) AS b, count(*) AS num_real FROM n GROUP BY 1), h AS (SELECT CAST(b + 0 AS INT) AS batch, num_real, CAST(least(b + 0, 10) AS INT) AS num_compressed FROM g)
SELECT batch, num_real, num_compressed, p AS plan, CAST(CASE WHEN p = 'last_per' THEN num_compressed - 1 ELSE 0 END AS INT) AS output_ref,
 CAST(CASE p WHEN 'always_first' THEN 0 WHEN 'first_per' THEN num_compressed ELSE -1 END AS INT) AS compressed_ref FROM h, (VALUES ('always_first'), ('first_per'), ('last_per')) t(p)""",
    "ministack_resume": f"""WITH {DAYS_SQL}, g AS (SELECT CAST(k // 4 AS INT) AS b, count(*) AS num_real FROM n GROUP BY 1), h AS (SELECT CAST(b + 3 AS INT) AS batch, num_real, CAST(least(b + 3, 6) AS INT) AS num_compressed FROM g)
SELECT batch, num_real, num_compressed, p AS plan, CAST(CASE WHEN p = 'last_per' THEN num_compressed - 1 ELSE 1 END AS INT) AS output_ref,
 CAST(CASE p WHEN 'always_first' THEN 1 WHEN 'first_per' THEN num_compressed ELSE -1 END AS INT) AS compressed_ref FROM h, (VALUES ('always_first'), ('first_per'), ('last_per')) t(p)""",
    "net_explicit": f"""WITH {DAYS_SQL}, m AS (SELECT CAST(count(*) AS INT) AS m FROM n) SELECT CAST(0 AS INT) AS i, CAST(3 AS INT) AS j FROM m UNION ALL SELECT 2, 5 FROM m UNION ALL SELECT 0, m - 1 FROM m""",
}

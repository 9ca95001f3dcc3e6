"""Per-pixel series on the real cube: trends and their uncertainty, reference subtraction, selection, mosaics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.sources.adapters import E_COLS, E_CUBE_SQL, ORIGIN, day, e_cube, grid, table

YEAR = 365.25
REFERENCE_PIXEL = 0
DISPERSION, MIN_COUNT = 0.25, 15
WAVELENGTH = 0.055465763
CHI2 = 3.841459


def r6(x: Column, name: str) -> Column:
    return (F.round(x, 6) + F.lit(0.0)).alias(name)


def trend(cube: DataFrame, weight: Column) -> DataFrame:
    """``(user_id, n_valid, velocity, sigma, inflation, residual_rms)`` of a weighted line per pixel.

    Valid samples have a finite value and positive weight.  The slope is per year; sigma grows with
    the residual variance where that exceeds one, inflation is that of a lag-1 process.  Pixels
    with fewer than two distinct epochs have null estimates, the inflation too.
    """
    pixel = Window.partitionBy("user_id")
    v = cube.select("user_id", F.col("t").cast("double").alias("t"), "y", weight.cast("double").alias("w")).where("w > 0 AND y IS NOT NULL AND NOT isnan(y)")
    s = v.withColumns({"sw": F.sum("w").over(pixel), "sx": F.sum(F.col("w") * F.col("t")).over(pixel), "sxx": F.sum(F.col("w") * F.col("t") * F.col("t")).over(pixel), "sy": F.sum(F.col("w") * F.col("y")).over(pixel), "sxy": F.sum(F.col("w") * F.col("t") * F.col("y")).over(pixel)})
    s = s.withColumn("det", F.expr("sw * sxx - sx * sx")).withColumn("slope", F.expr("(sw * sxy - sx * sy) / nullif(det, 0)"))
    s = s.withColumn("r", F.expr("y - (sy - slope * sx) / sw - slope * t"))
    s = s.withColumn("rc", F.col("r") - F.avg("r").over(pixel)).withColumn("before", F.lag("rc").over(pixel.orderBy("t")))
    g = s.groupBy("user_id").agg(
        F.count("*").alias("n"), F.max("slope").alias("slope"), F.max("sw").alias("sw"), F.max("det").alias("det"), F.sum(F.expr("w * r * r")).alias("wsse"),
        F.sum(F.expr("r * r")).alias("rss"), F.sum(F.expr("rc * before")).alias("cross"), F.sum(F.expr("rc * rc")).alias("own"),
    )
    g = g.withColumn("rho", F.expr("case when own is null then null when n < 3 or own <= 0 then 0.0d else least(greatest(cross / nullif(own, 0), 0.0d), 0.98d) end"))
    factor = F.expr("case when n > 2 then greatest(1.0d, wsse / nullif(n - 2, 0)) else 1.0d end")
    return g.select(
        "user_id", F.col("n").alias("n_valid"), r6(F.col("slope") * YEAR, "velocity"), r6(F.sqrt(factor * F.expr("sw / nullif(det, 0)")) * YEAR, "sigma"),
        r6(F.expr("sqrt((1 + rho) / (1 - rho))"), "inflation"), r6(F.expr("sqrt(rss / n)"), "residual_rms"),
    )


def reference_subtract(cube: DataFrame, pixel: int = REFERENCE_PIXEL) -> DataFrame:
    """Values less the reference pixel's at the same epoch; epochs it lacks are dropped."""
    reference = cube.where(F.col("user_id") == pixel).select("t", F.col("y").alias("y0"))
    return cube.join(F.broadcast(reference), "t").select("user_id", "t", (F.col("y") - F.col("y0")).alias("y"), "w")  # one row an epoch is broadcast


def persistent(cube: DataFrame, threshold: float = DISPERSION, least: int = MIN_COUNT) -> DataFrame:
    """Amplitude mean, dispersion and flag: 1 under the threshold, 0 over it, 255 with too few samples."""
    g = cube.groupBy("user_id").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s"), F.count("y").alias("n"))
    spread = F.when(F.col("n") < least, F.lit(0.0)).otherwise(F.expr("s / nullif(m, 0)"))
    flag = F.when(F.col("n") < least, 255).otherwise(F.when(F.round(spread, 6) < threshold, 1).otherwise(0))
    return g.select("user_id", r6(F.col("m"), "mean"), r6(spread, "dispersion"), flag.cast("int").alias("flag"))


def homogeneous(cube: DataFrame, critical: float = CHI2) -> DataFrame:
    """Neighbours in the 3x3 window whose amplitude scale passes the likelihood-ratio test, per pixel."""
    p = cube.groupBy(*grid()).agg(F.avg("y").alias("m"), F.var_pop("y").alias("v"), F.count("y").alias("n"))
    p = p.select("row", "col", "n", F.expr("(v + m * m) / 2").alias("s")).where("s > 0")
    near = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    asked = p.select("row", "col", "n", "s", F.explode(near).alias("o")).select("row", "col", "n", "s", (F.col("row") + F.col("o.dr")).alias("r2"), (F.col("col") + F.col("o.dc")).alias("c2"))
    other = p.select(F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("s").alias("s2"))
    test = F.expr(f"round(n * (2 * ln((s + s2) / 2) - ln(s) - ln(s2)), 6) < {critical}d")
    return asked.join(other, ["r2", "c2"]).groupBy("row", "col").agg(F.count("*").alias("n_neighbours"), F.sum(F.when(test, 1).otherwise(0)).cast("bigint").alias("n_kept"))


def mosaic(cube: DataFrame, order: str) -> DataFrame:
    """Per cell the last finite value in ``order``, and the mean of all."""
    finite = cube.where("y IS NOT NULL AND NOT isnan(y)")
    return finite.groupBy("user_id", "t").agg(r6(F.max_by("y", order), "last"), r6(F.avg("y"), "mean"), F.count("*").alias("n_layers"))


def uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the full pixel by day grid without a sample: an anti-join on equal keys."""
    seen = table(spark, sf_dir, "events").select("user_id", day(F.col("ts")).alias("t")).distinct()
    span = seen.agg(F.min("t").alias("a"), F.max("t").alias("b")).withColumn("one", F.lit(1))
    users = seen.select("user_id", F.lit(1).alias("one")).distinct()
    full = users.join(F.broadcast(span), "one").where("a IS NOT NULL").select("user_id", F.explode(F.sequence("a", "b")).alias("t"))  # one row is broadcast
    return full.join(seen, ["user_id", "t"], "left_anti")


def units(cube: DataFrame) -> DataFrame:
    """Phase to displacement: times -wavelength / 4 pi."""
    return cube.select("user_id", "t", (F.round(F.col("y") * F.lit(-WAVELENGTH / (4 * math.pi)), 9) + F.lit(0.0)).alias("displacement"))


def moving_stats(cube: DataFrame, half: int = 3) -> DataFrame:
    """Mean and count of the samples within ``half`` epochs, by epoch value so that gaps count as gaps."""
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-half, half)
    return cube.select("user_id", "t", r6(F.avg("y").over(w), "mean"), F.count("y").over(w).alias("n"))


def circular(cube: DataFrame) -> DataFrame:
    """Mean heading of angles in degrees, with its resultant length."""
    a = F.radians("y")
    g = cube.groupBy("user_id").agg(F.avg(F.sin(a)).alias("s"), F.avg(F.cos(a)).alias("c"))
    return g.select("user_id", r6(F.degrees(F.atan2("s", "c")), "heading"), r6(F.sqrt(F.expr("s * s + c * c")), "resultant"))


def _on_cube(build):
    return lambda spark, sf_dir: build(e_cube(spark, sf_dir))


QUERIES = {
    "velocity_linear": _on_cube(lambda c: trend(c, F.lit(1))),
    "velocity_neff": _on_cube(lambda c: trend(c, F.col("w"))),
    "velocity_referenced": _on_cube(lambda c: trend(reference_subtract(c), F.col("w")).where(F.col("user_id") != REFERENCE_PIXEL)),
    "reference_subtract": _on_cube(lambda c: reference_subtract(c).select("user_id", "t", r6(F.col("y"), "y"))),
    "ps_select": _on_cube(persistent),
    "shp_glrt_count": _on_cube(homogeneous),
    "mosaic_last_finite": lambda spark, sf_dir: mosaic(e_cube(spark, sf_dir, "event_type"), "event_type"),
    "coverage_anti": uncovered,
    "scale_units": _on_cube(units),
    "window_stats": _on_cube(moving_stats),
    "circular_heading": _on_cube(circular),
}


def _trend_sql(ctes: str, source: str, weight: str, where: str = "") -> str:
    return f"""WITH {ctes}, v AS (SELECT user_id, CAST(t AS DOUBLE) AS t, y, CAST({weight} AS DOUBLE) AS w FROM {source}),
g AS (SELECT user_id, count(*) AS n, sum(w) AS sw, sum(w*t) AS sx, sum(w*t*t) AS sxx, sum(w*y) AS sy, sum(w*t*y) AS sxy FROM v GROUP BY user_id),
l AS (SELECT *, sw*sxx - sx*sx AS det, (sw*sxy - sx*sy) / nullif(sw*sxx - sx*sx, 0) AS slope FROM g),
r AS (SELECT v.user_id, v.t, v.w, y - (sy - slope*sx)/sw - slope*v.t AS r FROM v JOIN l USING (user_id)),
q AS (SELECT *, r - avg(r) OVER (PARTITION BY user_id) AS rc FROM r),
b AS (SELECT *, lag(rc) OVER (PARTITION BY user_id ORDER BY t) AS rb FROM q),
a AS (SELECT user_id, sum(w*r*r) AS wsse, sum(r*r) AS rss, sum(rc*rb) AS cr, sum(rc*rc) AS own FROM b GROUP BY user_id),
f AS (SELECT *, CASE WHEN n < 3 OR own <= 0 THEN 0.0 ELSE least(greatest(cr/own, 0.0), 0.98) END AS rho FROM l JOIN a USING (user_id))
SELECT user_id, n AS n_valid, round(slope*{YEAR}, 6) + 0.0 AS velocity,
 round(sqrt(CASE WHEN n > 2 THEN greatest(1.0, wsse/(n-2)) ELSE 1.0 END * sw/nullif(det, 0))*{YEAR}, 6) + 0.0 AS sigma,
 round(sqrt((1+rho)/(1-rho)), 6) + 0.0 AS inflation, round(sqrt(rss/n), 6) + 0.0 AS residual_rms FROM f {where}"""


_REFERENCED = f"{E_CUBE_SQL}, d AS (SELECT e.user_id, e.t, e.y - o.y AS y, e.w FROM e JOIN e o ON o.t = e.t AND o.user_id = {REFERENCE_PIXEL})"
ORACLES = {
    "velocity_linear": _trend_sql(E_CUBE_SQL, "e", "1"),
    "velocity_neff": _trend_sql(E_CUBE_SQL, "e", "w"),
    "velocity_referenced": _trend_sql(_REFERENCED, "d", "w", f"WHERE user_id <> {REFERENCE_PIXEL}"),
    "reference_subtract": f"WITH {_REFERENCED} SELECT user_id, t, round(y, 6) + 0.0 AS y FROM d",
    "ps_select": f"""WITH {E_CUBE_SQL}, g AS (SELECT user_id, avg(y) AS m, stddev_pop(y) AS s, count(y) AS n FROM e GROUP BY 1),
h AS (SELECT *, CASE WHEN n < {MIN_COUNT} THEN 0.0 ELSE s / nullif(m, 0) END AS x FROM g)
SELECT user_id, round(m, 6) + 0.0 AS mean, round(x, 6) + 0.0 AS dispersion,
 CAST(CASE WHEN n < {MIN_COUNT} THEN 255 WHEN round(x, 6) < {DISPERSION} THEN 1 ELSE 0 END AS INT) AS flag FROM h""",
    "shp_glrt_count": f"""WITH {E_CUBE_SQL}, p AS (SELECT user_id // {E_COLS} AS r, user_id % {E_COLS} AS c, count(y) AS n, (var_pop(y) + avg(y) * avg(y)) / 2 AS s
 FROM e GROUP BY user_id HAVING (var_pop(y) + avg(y) * avg(y)) > 0)
SELECT CAST(a.r AS BIGINT) AS "row", CAST(a.c AS BIGINT) AS col, count(*) AS n_neighbours,
 CAST(sum(CASE WHEN round(a.n * (2 * ln((a.s + b.s) / 2) - ln(a.s) - ln(b.s)), 6) < {CHI2} THEN 1 ELSE 0 END) AS BIGINT) AS n_kept
FROM p a JOIN p b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) GROUP BY a.r, a.c""",
    "mosaic_last_finite": f"""WITH e AS (SELECT user_id, CAST(date_diff('day', DATE '{ORIGIN}', CAST(ts AS DATE)) AS INT) AS t, event_type, avg(value) AS y FROM events GROUP BY ALL)
SELECT user_id, t, round(arg_max(y, event_type), 6) + 0.0 AS last, round(avg(y), 6) + 0.0 AS mean, count(*) AS n_layers FROM e GROUP BY user_id, t""",
    "coverage_anti": f"""WITH {E_CUBE_SQL}, s AS (SELECT min(t) AS a, max(t) AS b FROM e)
SELECT u.user_id, CAST(x.t AS INT) AS t FROM (SELECT DISTINCT user_id FROM e) u, s, range(0, 400) x(t)
WHERE x.t BETWEEN s.a AND s.b AND NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = u.user_id AND e.t = x.t)""",
    "scale_units": f"WITH {E_CUBE_SQL} SELECT user_id, t, round(y * (-{WAVELENGTH} / (4 * pi())), 9) + 0.0 AS displacement FROM e",
    "window_stats": f"""WITH {E_CUBE_SQL} SELECT a.user_id, a.t, round(avg(b.y), 6) + 0.0 AS mean, count(b.y) AS n
FROM e a JOIN e b ON a.user_id = b.user_id AND b.t BETWEEN a.t - 3 AND a.t + 3 GROUP BY 1, 2""",
    "circular_heading": f"""WITH {E_CUBE_SQL}, g AS (SELECT user_id, avg(sin(radians(y))) AS s, avg(cos(radians(y))) AS c FROM e GROUP BY 1)
SELECT user_id, round(degrees(atan2(s, c)), 6) + 0.0 AS heading, round(sqrt(s * s + c * c), 6) + 0.0 AS resultant FROM g""",
}

"""Windowed complex algebra on the vector stack: coherence pairs, closure, quality, interferograms.

Windows are separable: a range frame along columns, then one along rows, so a pixel is never
copied to its neighbours; only windows that lie fully inside the grid are returned.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.sources.adapters import C_STACK_SQL, c_stack

PAIRS = [(0, 1), (0, 2), (1, 2), (2, 3)]
HALF = 1


def r6(x: Column, name: str) -> Column:
    return (F.round(x, 6) + F.lit(0.0)).alias(name)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def part(epoch: Column | int, imaginary: int) -> Column:
    k = F.lit(epoch) if isinstance(epoch, int) else epoch
    return F.element_at("z", (2 * k + 1 + imaginary).cast("int"))


def products(stack: DataFrame, pairs: list[tuple[int, int]] = PAIRS) -> DataFrame:
    """``(row, col, i, j, re, im, pi, pj)``: z_i times conj(z_j) and both powers; non-finite parts count as 0."""
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])
    ends = stack.select("row", "col", "z", F.explode(each).alias("p"))
    a, b, c, d = (F.nanvl(F.coalesce(part(F.col(f"p.{e}"), k), F.lit(0.0)), F.lit(0.0)) for e in ("i", "j") for k in (0, 1))
    return ends.select("row", "col", "p.i", "p.j", (a * c + b * d).alias("re"), (b * c - a * d).alias("im"), (a * a + b * b).alias("pi"), (c * c + d * d).alias("pj"))


def box(df: DataFrame, values: list[str], keys: list[str], half: int = HALF) -> DataFrame:
    """Sums of ``values`` over (2 half + 1)-square windows fully inside the grid."""
    across = Window.partitionBy(*keys, "row").orderBy("col").rangeBetween(-half, half)
    down = Window.partitionBy(*keys, "col").orderBy("row").rangeBetween(-half, half)
    df = df.select(*keys, "row", "col", *[F.sum(v).over(across).alias(v) for v in values], F.count("*").over(across).alias("n"))
    df = df.select(*keys, "row", "col", *[F.sum(v).over(down).alias(v) for v in values], F.sum("n").over(down).alias("n"))
    return df.where(F.col("n") == (2 * half + 1) ** 2).drop("n")


def coherence(stack: DataFrame) -> DataFrame:
    """``(row, col, i, j, cre, cim)``; 0 where the product of amplitudes is at most 1e-6."""
    s = box(products(stack), ["re", "im", "pi", "pj"], ["i", "j"])
    scale = F.sqrt(F.greatest("pi", F.lit(0.0))) * F.sqrt(F.greatest("pj", F.lit(0.0)))
    return s.select("row", "col", "i", "j", *[F.when(scale > 1e-6, F.col(x) / scale).otherwise(0.0).alias(f"c{x}") for x in ("re", "im")])


def coherence_pairs(stack: DataFrame) -> DataFrame:
    return coherence(stack).select("row", "col", "i", "j", r6(F.col("cre"), "re"), r6(F.col("cim"), "im"))


def average_coherence(stack: DataFrame) -> DataFrame:
    """Mean magnitude over the pairs, per pixel: partial sums combine before the shuffle."""
    return coherence(stack).groupBy("row", "col").agg(r6(F.avg(F.sqrt(F.expr("cre * cre + cim * cim"))), "avg_coherence"))


def closure(stack: DataFrame) -> DataFrame:
    """Phase of C01 C12 conj(C02): one pivoting aggregation, no self join."""
    pick = lambda i, j, x: F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col(x)))
    g = coherence(stack).groupBy("row", "col").agg(*[pick(i, j, x).alias(f"{x}{i}{j}") for i, j in ((0, 1), (1, 2), (0, 2)) for x in ("cre", "cim")])
    re, im = F.expr("cre01 * cre12 - cim01 * cim12"), F.expr("cre01 * cim12 + cim01 * cre12")
    return g.select("row", "col", r6(F.atan2(im * F.col("cre02") - re * F.col("cim02"), re * F.col("cre02") + im * F.col("cim02")), "closure"))


def temporal_coherence(stack: DataFrame) -> DataFrame:
    """Agreement of the pair phases with each pixel's own phases: |mean exp(j (arg C_ij - (theta_i - theta_j)))|."""
    angle = F.array(*[F.atan2(part(k, 1), part(k, 0)) for k in range(4)])
    own = stack.select("row", "col", angle.alias("theta"))
    pairs = coherence(stack).groupBy("row", "col").agg(F.collect_list(F.struct("i", "j", F.atan2("cim", "cre").alias("a"))).alias("ps"))  # len(PAIRS) entries
    x = own.join(pairs, ["row", "col"]).select("row", "col", F.explode(F.expr("transform(ps, p -> p.a - (theta[p.i] - theta[p.j]))")).alias("d"))
    g = x.groupBy("row", "col").agg(F.avg(F.cos("d")).alias("c"), F.avg(F.sin("d")).alias("s"))
    return g.select("row", "col", r6(F.sqrt(F.expr("c * c + s * s")), "temp_coh"))


def interferogram(stack: DataFrame, i: int = 0, j: int = 1) -> DataFrame:
    p = products(stack, [(i, j)])
    return p.select("row", "col", F.atan2("im", "re").alias("phase"), F.sqrt(F.expr("re * re + im * im")).alias("amplitude"))


def wrap(x: Column) -> Column:
    return x - 2 * math.pi * F.round(x / (2 * math.pi))


def gradients(stack: DataFrame) -> DataFrame:
    """Wrapped differences to the right and lower neighbour of the phase; null at the far edges."""
    p = interferogram(stack)
    step = lambda a, b: F.when(F.lead(a).over(Window.partitionBy(b).orderBy(a)) == F.col(a) + 1, F.lead("phase").over(Window.partitionBy(b).orderBy(a)))
    return p.select("row", "col", wrap(step("col", "row") - F.col("phase")).alias("right"), wrap(step("row", "col") - F.col("phase")).alias("down"))


def residues(stack: DataFrame) -> DataFrame:
    """Turns around each 2x2 cell, named by its upper left pixel."""
    g = gradients(stack)
    below = F.when(F.lead("row").over(Window.partitionBy("col").orderBy("row")) == F.col("row") + 1, F.lead("right").over(Window.partitionBy("col").orderBy("row")))
    beside = F.when(F.lead("col").over(Window.partitionBy("row").orderBy("col")) == F.col("col") + 1, F.lead("down").over(Window.partitionBy("row").orderBy("col")))
    turns = F.round((F.col("right") + beside - below - F.col("down")) / (2 * math.pi)).cast("int")
    return g.select("row", "col", turns.alias("residue")).where("residue IS NOT NULL")


def downsample(stack: DataFrame, by: int = 2) -> DataFrame:
    """Amplitude-weighted phase of ``by``-square blocks; partial blocks are dropped."""
    p = products(stack, [(0, 1)])
    g = p.groupBy(F.floor(F.col("row") / by).alias("row"), F.floor(F.col("col") / by).alias("col")).agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.count("*").alias("n"))
    return g.where(F.col("n") == by * by).select("row", "col", r6(F.atan2("im", "re"), "phase"))


def _on_stack(build):
    return lambda spark, sf_dir: build(c_stack(spark, sf_dir))


QUERIES = {
    "coherence_pairs": _on_stack(coherence_pairs),
    "avg_coherence": _on_stack(average_coherence),
    "closure_phase": _on_stack(closure),
    "temp_coh_given_phase": _on_stack(temporal_coherence),
    "form_ifg": _on_stack(lambda s: interferogram(s).select("row", "col", r6(F.col("phase"), "phase"), r6(F.col("amplitude"), "amplitude"))),
    "gradients": _on_stack(lambda s: gradients(s).select("row", "col", r6(F.col("right"), "right_step"), r6(F.col("down"), "down_step"))),
    "residues": _on_stack(residues),
    "downsample_weighted": _on_stack(downsample),
}

_PAIR_ROWS = ", ".join(f"({i}, {j})" for i, j in PAIRS)
_PRODUCTS = f"""{C_STACK_SQL}, pr(i, j) AS (VALUES {_PAIR_ROWS}),
x AS (SELECT "row", col, i, j, z[2*i+1] AS a, z[2*i+2] AS b, z[2*j+1] AS c, z[2*j+2] AS d FROM c, pr),
m AS (SELECT "row", col, i, j, a*c+b*d AS re, b*c-a*d AS im, a*a+b*b AS pi, c*c+d*d AS pj FROM x)"""
_COHERENCE = f"""{_PRODUCTS}, s AS (SELECT o."row", o.col, o.i, o.j, sum(q.re) AS re, sum(q.im) AS im, sqrt(sum(q.pi)) * sqrt(sum(q.pj)) AS sc
 FROM m o JOIN m q ON o.i = q.i AND o.j = q.j AND q."row" BETWEEN o."row" - 1 AND o."row" + 1 AND q.col BETWEEN o.col - 1 AND o.col + 1
 GROUP BY o."row", o.col, o.i, o.j HAVING count(*) = 9),
h AS (SELECT "row", col, i, j, CASE WHEN sc > 1e-6 THEN re / sc ELSE 0.0 END AS cre, CASE WHEN sc > 1e-6 THEN im / sc ELSE 0.0 END AS cim FROM s)"""
_PHASE = f"""{_PRODUCTS}, f AS (SELECT "row", col, atan2(im, re) AS phase, sqrt(re*re+im*im) AS amplitude, re, im FROM m WHERE i = 0 AND j = 1)"""
_GRADIENTS = f"""{_PHASE}, u AS (SELECT f."row", f.col, r.phase - f.phase AS dr, d.phase - f.phase AS dd FROM f
 LEFT JOIN f r ON r."row" = f."row" AND r.col = f.col + 1 LEFT JOIN f d ON d."row" = f."row" + 1 AND d.col = f.col),
gr AS (SELECT "row", col, dr - 2*pi()*round(dr/(2*pi())) AS "right", dd - 2*pi()*round(dd/(2*pi())) AS down FROM u)"""
ORACLES = {
    "coherence_pairs": f"""WITH {_COHERENCE} SELECT "row", col, i, j, round(cre, 6) + 0.0 AS re, round(cim, 6) + 0.0 AS im FROM h""",
    "avg_coherence": f"""WITH {_COHERENCE} SELECT "row", col, round(avg(sqrt(cre*cre + cim*cim)), 6) + 0.0 AS avg_coherence FROM h GROUP BY 1, 2""",
    "closure_phase": f"""WITH {_COHERENCE}, k AS (SELECT a."row", a.col, a.cre*b.cre - a.cim*b.cim AS re, a.cre*b.cim + a.cim*b.cre AS im, g.cre AS gr, g.cim AS gi
 FROM h a JOIN h b USING ("row", col) JOIN h g USING ("row", col) WHERE a.i=0 AND a.j=1 AND b.i=1 AND b.j=2 AND g.i=0 AND g.j=2)
SELECT "row", col, round(atan2(im*gr - re*gi, re*gr + im*gi), 6) + 0.0 AS closure FROM k""",
    "temp_coh_given_phase": f"""WITH {_COHERENCE}, d AS (SELECT h."row", h.col, atan2(cim, cre) - (atan2(b, a) - atan2(x.d, x.c)) AS d
 FROM h JOIN x USING ("row", col, i, j))
SELECT "row", col, round(sqrt(avg(cos(d))*avg(cos(d)) + avg(sin(d))*avg(sin(d))), 6) + 0.0 AS temp_coh FROM d GROUP BY 1, 2""",
    "form_ifg": f"""WITH {_PHASE} SELECT "row", col, round(phase, 6) + 0.0 AS phase, round(amplitude, 6) + 0.0 AS amplitude FROM f""",
    "gradients": f"""WITH {_GRADIENTS} SELECT "row", col, round("right", 6) + 0.0 AS right_step, round(down, 6) + 0.0 AS down_step FROM gr""",
    "residues": f"""WITH {_GRADIENTS} SELECT a."row", a.col, CAST(round((a."right" + b.down - c."right" - a.down) / (2*pi())) AS INT) AS residue
 FROM gr a JOIN gr b ON b."row" = a."row" AND b.col = a.col + 1 JOIN gr c ON c."row" = a."row" + 1 AND c.col = a.col
 WHERE a."right" IS NOT NULL AND b.down IS NOT NULL AND c."right" IS NOT NULL AND a.down IS NOT NULL""",
    "downsample_weighted": f"""WITH {_PHASE} SELECT CAST("row" // 2 AS BIGINT) AS "row", CAST(col // 2 AS BIGINT) AS col, round(atan2(sum(im), sum(re)), 6) + 0.0 AS phase
 FROM f GROUP BY "row" // 2, col // 2 HAVING count(*) = 4""",
}

"""Whole-stack coherence statistics over all epoch pairs, with full-size windows that shift inward at borders.

A border pixel's window is that of the nearest place whose window lies inside, so windows are summed
there only and their results go to the pixels that use them.  Sums are separable: columns, then rows.
Pixels that are missing, as in a last row that is not full, add nothing and get no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.sources.adapters import C_STACK_SQL, EPOCHS, c_stack

from .coherence import part, r6

HALF = 1


def grid_shape(stack: DataFrame) -> tuple[int, int]:
    """Rows and columns of a grid that starts at (0, 0): one aggregate of two numbers."""
    found = stack.agg(F.max("row"), F.max("col")).first()
    return (found[0] or 0) + 1, (found[1] or 0) + 1


def pair_products(places: DataFrame, epochs: int = EPOCHS, pairs: list[tuple[int, int]] | None = None) -> DataFrame:
    """``(row, col, users, i, j, re, im, pi, pj)`` for ``pairs``, all i <= j by default."""
    listed = F.expr(f"flatten(transform(sequence(0, {epochs - 1}), i -> transform(sequence(i, {epochs - 1}), j -> named_struct('i', i, 'j', j))))")
    if pairs is not None:
        listed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])
    ends = places.select("row", "col", "users", "z", F.explode(listed).alias("p"))
    a, b, c, d = (F.nanvl(F.coalesce(part(F.col(f"p.{e}"), k), F.lit(0.0)), F.lit(0.0)) for e in ("i", "j") for k in (0, 1))
    return ends.select("row", "col", "users", "p.i", "p.j", (a * c + b * d).alias("re"), (b * c - a * d).alias("im"), (a * a + b * b).alias("pi"), (c * c + d * d).alias("pj"))


def places(stack: DataFrame, shape: tuple[int, int], half: int = HALF) -> DataFrame:
    """``(row, col, z, users)``: the pixels and the missing places that their windows pass through, there without samples.

    ``users`` numbers the pixels whose window is the one around the place, by their offset from it.  A pixel is
    copied to the places of its own row only, before any pair is formed.
    """

    def inner(x: Column, n: int) -> Column:
        return F.least(F.greatest(x, F.lit(half)), F.lit(n - 1 - half))

    r, c = F.col("row"), F.col("col")
    wr, wc = inner(r, shape[0]), inner(c, shape[1])
    no_sample, no_user = F.lit(None).cast(stack.schema["z"].dataType).alias("z"), F.lit(None).cast("int").alias("user")
    along = stack.select("row", F.explode(F.sequence(inner(c - half, shape[1]), inner(c + half, shape[1]))).alias("col"), no_sample, no_user)
    used = stack.select(wr.alias("row"), wc.alias("col"), no_sample, ((r - wr + half) * (2 * half + 1) + c - wc + half).cast("int").alias("user"))
    every = stack.select("row", "col", "z", no_user).unionByName(along).unionByName(used)
    return every.groupBy("row", "col").agg(F.first("z", True).alias("z"), F.collect_list("user").alias("users"))  # at most a window of users


def window_sums(df: DataFrame, values: list[str], keys: list[str], half: int = HALF) -> DataFrame:
    """``(keys, row, col, values)`` of every pixel: sums over its window, from rows of :func:`places`."""
    across = Window.partitionBy(*keys, "row").orderBy("col").rangeBetween(-half, half)
    down = Window.partitionBy(*keys, "col").orderBy("row").rangeBetween(-half, half)
    df = df.select(*keys, "row", "col", "users", *[F.sum(v).over(across).alias(v) for v in values])
    df = df.select(*keys, "row", "col", "users", *[F.sum(v).over(down).alias(v) for v in values])
    df = df.select(*keys, F.col("row").alias("wr"), F.col("col").alias("wc"), *values, F.explode("users").alias("user"))
    side = 2 * half + 1
    return df.select(*keys, (F.col("wr") + F.floor(F.col("user") / side) - half).alias("row"), (F.col("wc") + F.col("user") % side - half).alias("col"), *values)


def coherence(stack: DataFrame, shape: tuple[int, int], epochs: int = EPOCHS, half: int = HALF, pairs: list[tuple[int, int]] | None = None) -> DataFrame:
    """``(row, col, i, j, cre, cim)`` for ``pairs`` (all i <= j by default) and every pixel; 0 where the product of amplitudes is at most 1e-6."""
    s = window_sums(pair_products(places(stack, shape, half), epochs, pairs), ["re", "im", "pi", "pj"], ["i", "j"], half)
    scale = F.sqrt(F.greatest("pi", F.lit(0.0))) * F.sqrt(F.greatest("pj", F.lit(0.0)))
    return s.select("row", "col", "i", "j", *[F.when(scale > 1e-6, F.col(x) / scale).otherwise(0.0).alias(f"c{x}") for x in ("re", "im")])


def average_per_date(c: DataFrame) -> DataFrame:
    """``(row, col, epoch, avg_coherence)``: mean of |C| along an epoch's row, its own entry included."""
    size = F.sqrt(F.expr("cre * cre + cim * cim"))
    both = F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j")))
    return c.select("row", "col", both.alias("epoch"), size.alias("x")).groupBy("row", "col", "epoch").agg(F.avg("x").alias("avg_coherence"))


def partial_coherence(averages: DataFrame, first: int = 0) -> DataFrame:
    """Sum and count of the finite averages of epochs ``first`` on; layers of several runs add up."""
    x = averages.where((F.col("epoch") >= first) & F.col("avg_coherence").isNotNull() & ~F.isnan("avg_coherence"))
    return x.groupBy("row", "col").agg(F.sum("avg_coherence").alias("total"), F.count("*").alias("n"))


def final_coherence(parts: DataFrame) -> DataFrame:
    return parts.groupBy("row", "col").agg(r6(F.sum("total") / F.nullif(F.sum("n"), F.lit(0)), "coherence"))


def closures(c: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """``(row, col, k, closure)``: phase of C[k,k+1] C[k+1,k+2] conj(C[k,k+2]); an entry goes to each of its triplets, no self join."""
    step = F.col("j") - F.col("i")
    roles = F.when(step == 1, F.array(F.struct(F.col("i").alias("k"), F.lit("a").alias("role")), F.struct((F.col("i") - 1).alias("k"), F.lit("b").alias("role")))).otherwise(
        F.array(F.struct(F.col("i").alias("k"), F.lit("s").alias("role")))
    )
    x = c.where(step.between(1, 2)).select("row", "col", F.explode(roles).alias("t"), "cre", "cim").select("row", "col", "t.k", "t.role", "cre", "cim").where(f"k between 0 and {epochs - 3}")
    pick = lambda role, v: F.max(F.when(F.col("role") == role, F.col(v)))
    g = x.groupBy("row", "col", "k").agg(*[pick(role, v).alias(f"{v}_{role}") for role in "abs" for v in ("cre", "cim")])
    re, im = F.expr("cre_a * cre_b - cim_a * cim_b"), F.expr("cre_a * cim_b + cim_a * cre_b")
    return g.select("row", "col", "k", F.atan2(im * F.col("cre_s") - re * F.col("cim_s"), re * F.col("cre_s") + im * F.col("cim_s")).alias("closure"))


def bias_rates(found: DataFrame) -> DataFrame:
    """Half the mean finite closure per pixel (0 without any) and the mean size of closures."""
    ok = F.col("closure").isNotNull() & ~F.isnan("closure")
    half = F.coalesce(F.avg(F.when(ok, F.col("closure"))), F.lit(0.0)) / 2
    return found.groupBy("row", "col").agg(half.alias("rate"), F.coalesce(F.avg(F.when(ok, F.abs("closure"))), F.lit(0.0)).alias("mean_abs"))


def own_phases(stack: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """``(row, col, epoch, phase)`` of the samples themselves."""
    each = F.posexplode(F.array(*[F.atan2(part(k, 1), part(k, 0)) for k in range(epochs)]))
    return stack.select("row", "col", each.alias("epoch", "phase"))


def temporal_coherence(c: DataFrame, phases: DataFrame) -> DataFrame:
    """|mean over i < j of exp(j (arg C_ij - (theta_i - theta_j)))|; entries that are not finite count as 0."""
    theta = phases.groupBy("row", "col").agg(F.map_from_entries(F.collect_list(F.struct("epoch", "phase"))).alias("theta"))  # one entry an epoch
    x = c.where("i < j").join(theta, ["row", "col"]).select("row", "col", (F.atan2("cim", "cre") - (F.col("theta")[F.col("i")] - F.col("theta")[F.col("j")])).alias("d"))
    zero = lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))
    g = x.groupBy("row", "col").agg(F.avg(zero(F.cos("d"))).alias("a"), F.avg(zero(F.sin("d"))).alias("b"))
    return g.select("row", "col", r6(F.sqrt(F.expr("a * a + b * b")), "temp_coh"))


def remove_bias(phases: DataFrame, rates: DataFrame) -> DataFrame:
    """Phases less epoch times the pixel's bias rate, as unit phasors."""
    turned = phases.join(rates.select("row", "col", "rate"), ["row", "col"]).withColumn("p", F.col("phase") - F.col("epoch") * F.col("rate"))
    return turned.select("row", "col", "epoch", r6(F.cos("p"), "re"), r6(F.sin("p"), "im"))


def compress(stack: DataFrame, first: int = 0, epochs: int = EPOCHS) -> DataFrame:
    """Mean amplitude with the phase of the sum of z conj(theta), theta being the block phases of 2x2 upsampled cells."""
    e = stack.select("row", "col", F.posexplode(F.array(*[F.struct(part(k, 0).alias("re"), part(k, 1).alias("im")) for k in range(epochs)])).alias("epoch", "z")).select("row", "col", "epoch", "z.*")
    e = e.where(F.col("epoch") >= first)
    cell = [F.floor(F.col(x) / 2).alias(f"b{x}") for x in ("row", "col")]
    block = e.groupBy(*cell, "epoch").agg(F.atan2(F.sum("im"), F.sum("re")).alias("theta"))
    j = e.select("*", *cell).join(block, ["brow", "bcol", "epoch"])
    turn = j.select("row", "col", F.sqrt(F.expr("re * re + im * im")).alias("amp"), F.expr("re * cos(theta) + im * sin(theta)").alias("x"), F.expr("im * cos(theta) - re * sin(theta)").alias("y"))
    g = turn.groupBy("row", "col").agg(F.avg("amp").alias("amp"), F.atan2(F.sum("y"), F.sum("x")).alias("phase"))
    return g.where("phase <> 0").select("row", "col", r6(F.col("amp"), "amplitude"), r6(F.col("phase"), "phase"))


def empty_epochs(stack: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Per epoch whether any sample is finite."""
    each = F.posexplode(F.array(*[part(k, 0).isNotNull() & ~F.isnan(part(k, 0)) & part(k, 1).isNotNull() & ~F.isnan(part(k, 1)) for k in range(epochs)]))
    return stack.select(each.alias("epoch", "ok")).groupBy("epoch").agg(F.max("ok").alias("usable"), F.sum(F.col("ok").cast("long")).alias("n"))


def box_sum(stack: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Power of epoch 0 over full windows."""
    p = places(stack, shape).select("row", "col", "users", (part(0, 0) * part(0, 0) + part(0, 1) * part(0, 1)).alias("power"), F.lit(0).alias("one"))
    return window_sums(p, ["power"], ["one"]).select("row", "col", r6(F.col("power"), "power"))


def _on(build, whole: bool = True):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        stack = c_stack(spark, sf_dir)
        return build(coherence(stack, grid_shape(stack)), stack) if whole else build(stack)

    return query


QUERIES = {
    "coherence_full": _on(lambda c, s: c.select("row", "col", "i", "j", r6(F.col("cre"), "re"), r6(F.col("cim"), "im"))),
    "avg_coherence_per_date": _on(lambda c, s: average_per_date(c).select("row", "col", "epoch", r6(F.col("avg_coherence"), "avg_coherence"))),
    "avg_coherence_final": _on(lambda c, s: final_coherence(partial_coherence(average_per_date(c), 1))),
    "closure_all": _on(lambda c, s: closures(c).select("row", "col", "k", r6(F.col("closure"), "closure"))),
    "bias_velocity": _on(lambda c, s: bias_rates(closures(c)).select("row", "col", r6(F.col("rate"), "rate"), r6(F.col("mean_abs"), "mean_abs"))),
    "bias_corrected": _on(lambda c, s: remove_bias(own_phases(s), bias_rates(closures(c)))),
    "residual_closure": _on(lambda c, s: closures(c).join(bias_rates(closures(c)), ["row", "col"]).select("row", "col", "k", r6(F.col("closure") - 2 * F.col("rate"), "residual"))),
    "temp_coh_all": _on(lambda c, s: temporal_coherence(c, own_phases(s))),
    "compress_phase": _on(compress, False),
    "empty_epochs": _on(empty_epochs, False),
    "box_sum": _on(lambda s: box_sum(s, grid_shape(s)), False),
}

_BASE = f"""{C_STACK_SQL}, g AS (SELECT max("row") + 1 AS nr, max(col) + 1 AS nc FROM c),
ep AS (SELECT "row", col, CAST(i AS INT) AS i, z[2*i+1] AS a, z[2*i+2] AS b FROM c, range({EPOCHS}) t(i)),
o AS (SELECT "row", col, least(greatest("row", {HALF}), nr - 1 - {HALF}) AS wr, least(greatest(col, {HALF}), nc - 1 - {HALF}) AS wc FROM c, g)"""
_COHERENCE = f"""{_BASE}, m AS (SELECT x."row", x.col, x.i, y.i AS j, x.a*y.a + x.b*y.b AS re, x.b*y.a - x.a*y.b AS im, x.a*x.a + x.b*x.b AS pi, y.a*y.a + y.b*y.b AS pj
 FROM ep x JOIN ep y ON x."row" = y."row" AND x.col = y.col AND x.i <= y.i),
s AS (SELECT o."row", o.col, i, j, sum(re) AS re, sum(im) AS im, sqrt(sum(pi)) * sqrt(sum(pj)) AS sc
 FROM o JOIN m ON m."row" BETWEEN wr - {HALF} AND wr + {HALF} AND m.col BETWEEN wc - {HALF} AND wc + {HALF} GROUP BY o."row", o.col, i, j),
h AS (SELECT "row", col, i, j, CASE WHEN sc > 1e-6 THEN re / sc ELSE 0.0 END AS cre, CASE WHEN sc > 1e-6 THEN im / sc ELSE 0.0 END AS cim FROM s)"""
_AVERAGE = f"""{_COHERENCE}, av AS (SELECT "row", col, epoch, avg(x) AS a FROM (SELECT "row", col, i AS epoch, sqrt(cre*cre + cim*cim) AS x FROM h
 UNION ALL SELECT "row", col, j, sqrt(cre*cre + cim*cim) FROM h WHERE i < j) GROUP BY ALL)"""
_CLOSURE = f"""{_COHERENCE}, k3 AS (SELECT a."row", a.col, a.i AS k, a.cre*b.cre - a.cim*b.cim AS re, a.cre*b.cim + a.cim*b.cre AS im, s.cre AS sr, s.cim AS si
 FROM h a JOIN h b ON a."row" = b."row" AND a.col = b.col AND b.i = a.i + 1 AND b.j = a.i + 2 AND a.j = a.i + 1
 JOIN h s ON a."row" = s."row" AND a.col = s.col AND s.i = a.i AND s.j = a.i + 2),
cl AS (SELECT "row", col, k, atan2(im*sr - re*si, re*sr + im*si) AS x FROM k3),
bi AS (SELECT "row", col, avg(x) / 2 AS rate, avg(abs(x)) AS ma FROM cl GROUP BY ALL)"""
ORACLES = {
    "coherence_full": f"""WITH {_COHERENCE} SELECT "row", col, i, j, round(cre, 6) + 0.0 AS re, round(cim, 6) + 0.0 AS im FROM h""",
    "avg_coherence_per_date": f"""WITH {_AVERAGE} SELECT "row", col, epoch, round(a, 6) + 0.0 AS avg_coherence FROM av""",
    "avg_coherence_final": f"""WITH {_AVERAGE} SELECT "row", col, round(sum(a) / count(*), 6) + 0.0 AS coherence FROM av WHERE epoch >= 1 GROUP BY ALL""",
    "closure_all": f"""WITH {_CLOSURE} SELECT "row", col, k, round(x, 6) + 0.0 AS closure FROM cl""",
    "bias_velocity": f"""WITH {_CLOSURE} SELECT "row", col, round(rate, 6) + 0.0 AS rate, round(ma, 6) + 0.0 AS mean_abs FROM bi""",
    "bias_corrected": f"""WITH {_CLOSURE} SELECT "row", col, i AS epoch, round(cos(atan2(b, a) - i * rate), 6) + 0.0 AS re, round(sin(atan2(b, a) - i * rate), 6) + 0.0 AS im
 FROM ep JOIN bi USING ("row", col)""",
    "residual_closure": f"""WITH {_CLOSURE} SELECT "row", col, k, round(x - 2 * rate, 6) + 0.0 AS residual FROM cl JOIN bi USING ("row", col)""",
    "temp_coh_all": f"""WITH {_COHERENCE}, d AS (SELECT h."row", h.col, atan2(cim, cre) - (atan2(x.b, x.a) - atan2(y.b, y.a)) AS d FROM h
 JOIN ep x ON x."row" = h."row" AND x.col = h.col AND x.i = h.i JOIN ep y ON y."row" = h."row" AND y.col = h.col AND y.i = h.j WHERE h.i < h.j)
SELECT "row", col, round(sqrt(pow(avg(cos(d)), 2) + pow(avg(sin(d)), 2)), 6) + 0.0 AS temp_coh FROM d GROUP BY ALL""",
    "compress_phase": f"""WITH {_BASE}, bl AS (SELECT "row" // 2 AS br, col // 2 AS bc, i, atan2(sum(b), sum(a)) AS th FROM ep GROUP BY ALL),
t AS (SELECT "row", col, sqrt(a*a + b*b) AS amp, a*cos(th) + b*sin(th) AS x, b*cos(th) - a*sin(th) AS y FROM ep JOIN bl ON br = "row" // 2 AND bc = col // 2 AND bl.i = ep.i)
SELECT "row", col, round(avg(amp), 6) + 0.0 AS amplitude, round(atan2(sum(y), sum(x)), 6) + 0.0 AS phase FROM t GROUP BY ALL HAVING atan2(sum(y), sum(x)) <> 0""",
    "empty_epochs": f"""WITH {_BASE} SELECT i AS epoch, bool_or(isfinite(a) AND isfinite(b)) AS usable, CAST(count(*) FILTER (WHERE isfinite(a) AND isfinite(b)) AS BIGINT) AS n FROM ep GROUP BY i""",
    "box_sum": f"""WITH {_BASE} SELECT o."row", o.col, round(sum(a*a + b*b), 6) + 0.0 AS power FROM o JOIN ep ON ep.i = 0 AND ep."row" BETWEEN wr - {HALF} AND wr + {HALF}
 AND ep.col BETWEEN wc - {HALF} AND wc + {HALF} GROUP BY o."row", o.col""",
}

"""Mosaics of bursts, seam levelling, masks and selection of steady pixels, as joins and aggregations."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.errors import StitchError
from rasterloom.kernels import neighbours as shp
from rasterloom.sources.adapters import C_STACK_SQL, E_CUBE_SQL, EPOCHS, ORIGIN, c_stack, e_cube

from .coherence import once, part, r6
from .linking import tile_cube, tile_size, tile_window, to_tiles
from .stack import grid_shape

SEAM_COHERENCE, SEAM_PIXELS = 0.5, 4


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def paste(layers: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Per cell the last finite value in ``order``: bursts cover one another, gaps show what lies below."""
    return layers.where(finite(F.col(value))).groupBy(*keys).agg(F.max_by(value, order).alias(value))


def rotation(frame: DataFrame, burst: DataFrame) -> DataFrame:
    """``(epoch, angle, n)``: mean turn from a burst to the frame over their shared steady pixels.

    Both hold ``(row, col, epoch, re, im, quality)``; a shared pixel counts with quality of at least
    ``SEAM_COHERENCE`` on both sides and finite samples other than zero.
    """
    good = f"quality >= {SEAM_COHERENCE} AND NOT isnan(quality) AND NOT isnan(re) AND NOT isnan(im) AND re * re + im * im > 0"
    a = frame.where(good).select("row", "col", "epoch", F.col("re").alias("a"), F.col("im").alias("b"))
    c = burst.where(good).select("row", "col", "epoch", F.col("re").alias("c"), F.col("im").alias("d"))
    size = F.sqrt(F.expr("(a * a + b * b) * (c * c + d * d)"))
    g = a.join(c, ["row", "col", "epoch"]).groupBy("epoch").agg(F.sum(F.expr("a * c + b * d") / size).alias("x"), F.sum(F.expr("b * c - a * d") / size).alias("y"), F.count("*").alias("n"))
    return g.select("epoch", F.atan2("y", "x").alias("angle"), F.when(F.expr("x * x + y * y > 0"), F.col("n")).otherwise(0).alias("n"))


def turned(burst: DataFrame, turns: DataFrame) -> DataFrame:
    j = burst.join(F.broadcast(turns.select("epoch", "angle")), "epoch")  # one row an epoch is broadcast
    return j.select("row", "col", "epoch", F.expr("re * cos(angle) - im * sin(angle)").alias("re"), F.expr("re * sin(angle) + im * cos(angle)").alias("im"), "quality")


def stitch(bursts: list[DataFrame], epochs: int) -> DataFrame:
    """Bursts one after another on the phase datum of those before, later ones on top.

    Each holds ``(row, col, epoch, re, im, quality)`` in the frame's pixels.  Few bursts are folded on the
    driver; only one number an epoch reaches it, cubes never do.
    """
    out = bursts[0]
    for n, burst in enumerate(bursts[1:], 1):
        turns = rotation(out, burst)
        found = {r["epoch"]: r["n"] for r in turns.collect()}  # one row an epoch
        for t in range(epochs):
            if found.get(t, 0) < SEAM_PIXELS:
                raise StitchError(n, t, found.get(t, 0), SEAM_PIXELS)
        both = out.withColumn("order", F.lit(0)).unionByName(turned(burst, turns).withColumn("order", F.lit(1)))
        best = both.where(finite(F.col("re")) & finite(F.col("im"))).groupBy("row", "col", "epoch").agg(F.max_by(F.struct("re", "im", "quality"), "order").alias("z"))
        out = best.select("row", "col", "epoch", "z.re", "z.im", "z.quality")
    return out


def mean_of_finite(layers: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean over layers where a value is finite, null where none is."""
    return layers.groupBy(*keys).agg(F.avg(F.when(finite(F.col(value)), F.col(value))).alias(value))


def validity(layers: DataFrame, valid: DataFrame, rate: DataFrame, columns: list[str], labels: list[str] = ()) -> DataFrame:
    """Blank ``columns`` (and set ``labels`` to 0) where a pixel is not valid or its rate is missing."""
    ok = valid.join(rate, ["row", "col"], "left").select("row", "col", (F.col("valid") & finite(F.col("velocity"))).alias("_ok"))
    j = layers.join(ok, ["row", "col"], "left")
    return j.withColumns({c: F.when(F.col("_ok"), F.col(c)) for c in columns} | {c: F.when(F.col("_ok"), F.col(c)).otherwise(0) for c in labels}).drop("_ok")


def phase_mask(phasors: DataFrame, mask: DataFrame) -> DataFrame:
    """Phasors are 0 where the mask is."""
    j = phasors.join(mask, ["row", "col"], "left")
    return j.withColumns({c: F.when(F.col("keep") == 0, 0.0).otherwise(F.col(c)) for c in ("re", "im")}).drop("keep")


def analysis_correlation(quality: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Coherence cut to 0..1, 0 where it is missing or masked."""
    cut = F.when(finite(F.col("quality")), F.least(F.greatest("quality", F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    out = quality.select("row", "col", cut.alias("corr"))
    return out if mask is None else out.join(mask, ["row", "col"], "left").select("row", "col", F.when(F.col("keep") == 0, 0.0).otherwise(F.col("corr")).alias("corr"))


def coverage(stack: DataFrame, tile: int) -> DataFrame:
    """Per tile its pixels, those with every epoch finite, and whether it can be linked."""
    whole = F.forall("z", lambda x: x.isNotNull() & ~F.isnan(x))
    g = stack.groupBy(F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc")).agg(F.count("*").alias("pixels"), F.sum(whole.cast("long")).alias("complete"))
    return g.withColumn("linked", F.col("complete") > 0)


def scale(outputs: DataFrame, wavelength: float) -> DataFrame:
    """Radians to metres: rates and series signed, variances squared, deviations absolute."""
    k = -wavelength / (4 * math.pi)
    return outputs.withColumns({"value": F.col("value") * k, "variance": F.col("variance") * k * k, "sigma": F.abs(F.col("sigma") * k)})


def neighbours(stack: DataFrame, shape: tuple[int, int], method: str = "ks", half: tuple[int, int] = (1, 1), alpha: float = 0.05, epochs: int = EPOCHS, tile: int | None = None) -> DataFrame:
    """``(row, col, places)``: numbers of the window places whose pixels behave alike, by either test; a task holds a tile."""
    tile = tile or max(tile_size(1, shape, stack.sparkSession.sparkContext.defaultParallelism), 4 * max(half))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at = (key[0].as_py(), key[1].as_py())
        window = tile_window(tile, at, half, shape)
        cube, rows, cols = tile_cube(table, epochs, window)
        amplitude = abs(cube)
        mask = shp.ks(amplitude, half, alpha=alpha) if method == "ks" else shp.glrt(amplitude.mean(axis=0), amplitude.var(axis=0), epochs, half, alpha=alpha)
        core = (rows // tile == at[0]) & (cols // tile == at[1])
        rows, cols = rows[core], cols[core]
        own = mask[rows - window[0], cols - window[2]].reshape(len(rows), -1)
        return pa.table({"row": pa.array(rows), "col": pa.array(cols), "places": pa.array([m.nonzero()[0].astype("int32") for m in own], pa.list_(pa.int32()))})

    return to_tiles(stack.select("row", "col", F.slice("z", 1, 2 * epochs).alias("z")), tile, half, shape).groupBy("tr", "tc").applyInArrow(run, "row long, col long, places array<int>")


def fill_persistent(stack: DataFrame, threshold: float, by: tuple[int, int] = (2, 2), reference: int = 0, epochs: int = EPOCHS) -> DataFrame:
    """``(row, col, epoch, phase)`` of each output cell's brightest steady pixel, the last of equals, against ``reference``."""
    amp = F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda k: F.sqrt(F.pow(F.element_at("z", 2 * k + 1), 2) + F.pow(F.element_at("z", 2 * k + 2), 2)))
    mean = once(amp, lambda a: F.struct(a.alias("amp"), (F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / epochs).alias("mean")))

    def spread(v: Column) -> Column:
        size = F.aggregate(v["amp"], F.lit(0.0), lambda s, x: s + (x - v["mean"]) * (x - v["mean"])) / epochs
        return F.when(v["mean"] > 0, F.struct(v["mean"].alias("mean"), (F.sqrt(size) / v["mean"]).alias("spread")))

    # an exploded column is worked out once a pixel; as a plain one it would be at each use, for every epoch within
    p = stack.select("row", "col", "z", F.explode(F.array(once(mean, spread))).alias("q")).select("row", "col", "z", "q.mean", "q.spread")
    steady = p.where((F.col("mean") > 0) & (F.round("spread", 9) < threshold) & (F.col("spread") > 0))
    best = steady.groupBy(F.floor(F.col("row") / by[0]).alias("orow"), F.floor(F.col("col") / by[1]).alias("ocol")).agg(F.max_by("z", F.struct(F.round("mean", 9), "row", "col")).alias("z"))
    theta = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda k: F.atan2(F.element_at("z", 2 * k + 2), F.element_at("z", 2 * k + 1))))
    first = F.atan2(part(reference, 1), part(reference, 0))
    return best.select(F.col("orow").alias("row"), F.col("ocol").alias("col"), first.alias("t0"), theta.alias("epoch", "t")).select("row", "col", "epoch", (F.col("t") - F.col("t0")).alias("phase"))


def select_persistent(cube: DataFrame, threshold: float = 0.25, least: int = 15) -> DataFrame:
    """``(user_id, mean, dispersion, flag)`` of finite samples: too few of them, or a mean of 0, give 0, 0 and 255."""
    y = F.when(finite(F.col("y")), F.col("y"))
    g = cube.groupBy("user_id").agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.stddev_pop(y).alias("s"))
    enough = (F.col("n") >= least) & (F.col("m") != 0)
    d = F.when(enough, F.col("s") / F.nullif("m", F.lit(0.0))).otherwise(0.0)
    flag = F.when(F.round(d, 9) == 0, 255).when(d < threshold, 1).otherwise(0).cast("int")
    return g.select("user_id", r6(F.when(F.col("n") >= least, F.col("m")).otherwise(0.0), "mean"), r6(d, "dispersion"), flag.alias("flag"))


def _bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phasors of each event type's cube, with the number of its samples as quality."""
    e = e_cube(spark, sf_dir, "event_type")
    return e.select("event_type", F.col("user_id").alias("row"), F.lit(0).alias("col"), F.col("t").alias("epoch"), F.cos("y").alias("re"), F.sin("y").alias("im"), (F.col("w") / 2).alias("quality"))


def _levelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bursts(spark, sf_dir)
    found = rotation(b.where("event_type = 'click'"), b.where("event_type = 'view'"))
    return found.select("epoch", r6(F.col("angle"), "angle"), "n")


def _mask(stack: DataFrame) -> DataFrame:
    return stack.select("row", "col", F.when(part(0, 0) > 0, 1).otherwise(0).alias("keep"))


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = c_stack(spark, sf_dir)
    found = validity(s.select("row", "col", part(2, 0).alias("value"), (F.col("row") + 1).alias("component")), s.select("row", "col", (part(0, 0) > 0).alias("valid")), s.select("row", "col", F.when(part(1, 0) > 0, part(1, 1)).alias("velocity")), ["value"], ["component"])
    return found.select("row", "col", r6(F.col("value"), "value"), "component")


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scale(e_cube(spark, sf_dir).select("user_id", "t", F.col("y").alias("value"), F.col("w").cast("double").alias("variance"), F.col("y").alias("sigma")), WAVELENGTH)
    return found.select("user_id", "t", *[(F.round(c, 9) + 0.0).alias(c) for c in ("value", "variance", "sigma")])


WAVELENGTH = 0.05546576
QUERIES = {
    "ps_select_finite": lambda spark, sf_dir: select_persistent(e_cube(spark, sf_dir)),
    "ps_fill_argmax": lambda spark, sf_dir: fill_persistent(c_stack(spark, sf_dir), 0.6).select("row", "col", "epoch", r6(F.cos("phase"), "re"), r6(F.sin("phase"), "im")),
    "shp_ks": lambda spark, sf_dir: (lambda s: neighbours(s, grid_shape(s)))(c_stack(spark, sf_dir)),
    "shp_glrt_mask": lambda spark, sf_dir: (lambda s: neighbours(s, grid_shape(s), "glrt"))(c_stack(spark, sf_dir)),
    "level_offsets": _levelled,
    "nan_mean_stitch": lambda spark, sf_dir: mean_of_finite(e_cube(spark, sf_dir, "event_type"), ["user_id", "t"], "y").select("user_id", "t", r6(F.col("y"), "y")),
    "paste_last": lambda spark, sf_dir: paste(e_cube(spark, sf_dir, "event_type"), ["user_id", "t"], "y", "event_type").select("user_id", "t", r6(F.col("y"), "y")),
    "mask_apply": _masked,
    "phase_mask": lambda spark, sf_dir: (lambda s: phase_mask(s.select("row", "col", r6(part(1, 0), "re"), r6(part(1, 1), "im")), _mask(s)))(c_stack(spark, sf_dir)),
    "analysis_correlation": lambda spark, sf_dir: (lambda s: analysis_correlation(s.select("row", "col", (part(1, 0) * 5).alias("quality")), _mask(s)).select("row", "col", r6(F.col("corr"), "corr")))(c_stack(spark, sf_dir)),
    "input_coverage": lambda spark, sf_dir: coverage(c_stack(spark, sf_dir), 8),
    "scale_outputs": _scaled,
}

_TYPED = f"""e AS (SELECT user_id, CAST(date_diff('day', DATE '{ORIGIN}', CAST(ts AS DATE)) AS INT) AS t, event_type, avg(value) AS y, count(value) AS w FROM events GROUP BY ALL)"""
_K = f"(-{WAVELENGTH} / (4 * pi()))"
ORACLES = {
    "ps_select_finite": f"""WITH {E_CUBE_SQL}, g AS (SELECT user_id, count(y) AS n, avg(y) AS m, stddev_pop(y) AS s FROM e WHERE isfinite(y) GROUP BY 1),
d AS (SELECT *, CASE WHEN n >= 15 AND m <> 0 THEN s / m ELSE 0.0 END AS d FROM g)
SELECT user_id, CASE WHEN n >= 15 THEN round(m, 6) + 0.0 ELSE 0.0 END AS mean, round(d, 6) + 0.0 AS dispersion, CAST(CASE WHEN round(d, 9) = 0 THEN 255 WHEN d < 0.25 THEN 1 ELSE 0 END AS INT) AS flag FROM d""",
    "ps_fill_argmax": f"""WITH {C_STACK_SQL}, a AS (SELECT "row", col, CAST(i AS INT) AS i, z[2*i+1] AS re, z[2*i+2] AS im, sqrt(z[2*i+1]*z[2*i+1] + z[2*i+2]*z[2*i+2]) AS amp FROM c, range({EPOCHS}) t(i)),
p AS (SELECT "row", col, avg(amp) AS m, stddev_pop(amp) / avg(amp) AS d FROM a GROUP BY ALL),
b AS (SELECT *, "row" // 2 AS br, col // 2 AS bc FROM p WHERE round(d, 9) < 0.6 AND d > 0 QUALIFY row_number() OVER (PARTITION BY "row" // 2, col // 2 ORDER BY round(m, 9) DESC, "row" DESC, col DESC) = 1)
SELECT CAST(br AS BIGINT) AS "row", CAST(bc AS BIGINT) AS col, a.i AS epoch, round(cos(atan2(a.im, a.re) - atan2(o.im, o.re)), 6) + 0.0 AS re, round(sin(atan2(a.im, a.re) - atan2(o.im, o.re)), 6) + 0.0 AS im
 FROM b JOIN a ON a."row" = b."row" AND a.col = b.col JOIN a o ON o."row" = b."row" AND o.col = b.col AND o.i = 0""",
    "level_offsets": f"""WITH {_TYPED}, j AS (SELECT a.t AS epoch, a.y - b.y AS d FROM e a JOIN e b ON a.user_id = b.user_id AND a.t = b.t WHERE a.event_type = 'click' AND b.event_type = 'view' AND a.w >= 1 AND b.w >= 1)
SELECT epoch, round(atan2(sum(sin(d)), sum(cos(d))), 6) + 0.0 AS angle, count(*) AS n FROM j GROUP BY 1""",
    "nan_mean_stitch": f"WITH {_TYPED} SELECT user_id, t, round(avg(y) FILTER (isfinite(y)), 6) + 0.0 AS y FROM e GROUP BY ALL",
    "paste_last": f"WITH {_TYPED} SELECT user_id, t, round(arg_max(y, event_type), 6) + 0.0 AS y FROM e WHERE isfinite(y) GROUP BY ALL",
    "mask_apply": f"""WITH {C_STACK_SQL} SELECT "row", col, CASE WHEN z[1] > 0 AND z[3] > 0 THEN round(z[5], 6) + 0.0 END AS value, CASE WHEN z[1] > 0 AND z[3] > 0 THEN "row" + 1 ELSE 0 END AS component FROM c""",
    "phase_mask": f"""WITH {C_STACK_SQL} SELECT "row", col, CASE WHEN z[1] > 0 THEN round(z[3], 6) + 0.0 ELSE 0.0 END AS re, CASE WHEN z[1] > 0 THEN round(z[4], 6) + 0.0 ELSE 0.0 END AS im FROM c""",
    "analysis_correlation": f"""WITH {C_STACK_SQL} SELECT "row", col, CASE WHEN z[1] > 0 THEN round(least(greatest(z[3] * 5, 0.0), 1.0), 6) + 0.0 ELSE 0.0 END AS corr FROM c""",
    "input_coverage": f"""WITH {C_STACK_SQL} SELECT CAST("row" // 8 AS BIGINT) AS tr, CAST(col // 8 AS BIGINT) AS tc, count(*) AS pixels, count(*) AS complete, true AS linked FROM c GROUP BY ALL""",
    "scale_outputs": f"""WITH {E_CUBE_SQL} SELECT user_id, t, round(y * {_K}, 9) + 0.0 AS value, round(w * {_K} * {_K}, 9) + 0.0 AS variance, round(abs(y * {_K}), 9) + 0.0 AS sigma FROM e""",
}

"""From a network of interferograms to a series: loops, masks, inversion, precisions, reference, rates.

Pixels become rows with one array over the network; the kernels then run on Arrow batches of pixels with no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.errors import EngineError
from rasterloom.kernels import series as s
from rasterloom.session import written
from rasterloom.sources.adapters import C_STACK_SQL, E_CUBE_SQL, EPOCHS, c_stack, e_cube

from .coherence import part, r6
from .stack import grid_shape
from .unwrapping import TURN, form_network, sample_phases, unwrap_network

PAIRS3 = [(0, 1), (0, 2), (1, 2)]


def bandwidth_pairs(epochs: int, width: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(epochs) for j in range(i + 1, min(i + width, epochs - 1) + 1)]


def by_pixel(ifgs: DataFrame, n: int, *values: str) -> DataFrame:
    """``(row, col, values...)``: an array of ``n`` entries each, null where an interferogram has no value."""
    found = ifgs.groupBy("row", "col").agg(*[F.map_from_entries(F.collect_list(F.struct("ifg", v))).alias(v) for v in values])  # n entries
    return found.select("row", "col", *[F.transform(F.sequence(F.lit(0), F.lit(n - 1)), _entry(v)).alias(v) for v in values])


def _entry(v: str):
    return lambda k: F.try_element_at(F.col(v), k)


def matrix(column: pa.Array, n: int) -> np.ndarray:
    """(row, n) numbers of an array column; null is not a number."""
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)


def _pixels(df: DataFrame, kernel, names: list[str], schema: str) -> DataFrame:
    """``kernel`` maps matrices of array columns ``names`` to arrays per output column; row and col pass."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            given = [matrix(batch.column(c), len(batch.column(c)[0])) for c in names]
            out = [pa.array(list(x) if x.ndim == 2 else x) for x in kernel(*given)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("col"), *out], names=["row", "col", *[f.split()[0] for f in schema.split(", ")]])

    return df.select("row", "col", *names).mapInArrow(run, f"row long, col long, {schema}")


def invert(pixels: DataFrame, pairs: list[tuple[int, int]], method: str = "l2", weight: str | None = None) -> DataFrame:
    """``(row, col, series, variance, rms)`` from an array ``phase`` per pixel; the first used date is left out.

    ``l1`` knows no weights, variance or gaps: a missing value makes the pixel missing.  Unused dates are refused,
    since a series must have every date.
    """
    used = sorted({d for p in pairs for d in p})
    if used != list(range(len(used))):
        raise EngineError("the network leaves dates without a pair")
    if method == "l1":
        return _pixels(pixels, lambda y: (s.invert_l1(y, pairs), np.full((len(y), len(used) - 1), np.nan), np.full(len(y), np.nan)), ["phase"], "series array<double>, variance array<double>, rms double")
    if method != "l2":
        raise EngineError(f"unknown inversion {method!r}")
    names = ["phase"] + ([weight] if weight else [])
    return _pixels(pixels, lambda y, *w: s.invert(y, pairs, *w), names, "series array<double>, variance array<double>, rms double")


def loop_qc(ifgs: DataFrame, pairs: list[tuple[int, int]], tolerance: float = 0.5) -> DataFrame:
    """``(row, col, bad, evaluable, worst)``: loops that fail to close, loops that can be told, the worst in cycles (null without any)."""
    loops = F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(t, "abc")]) for t in s.triplets(pairs)])
    p = by_pixel(ifgs, len(pairs), "phase")
    x = p.select("row", "col", "phase", F.explode_outer(loops).alias("t"))
    cycles = F.abs(F.col("phase")[F.col("t.a")] + F.col("phase")[F.col("t.b")] - F.col("phase")[F.col("t.c")]) / TURN
    x = x.select("row", "col", F.when(~F.isnan(cycles), cycles).alias("x"))
    return x.groupBy("row", "col").agg(F.sum(F.when(F.col("x") > tolerance, 1).otherwise(0)).cast("bigint").alias("bad"), F.count("x").alias("evaluable"), r6(F.max("x"), "worst"))


def loop_mask(ifgs: DataFrame, qc: DataFrame) -> DataFrame:
    """No interferogram keeps its value at a pixel where a loop failed."""
    return ifgs.join(qc.select("row", "col", "bad"), ["row", "col"], "left").withColumn("phase", F.when(F.coalesce("bad", F.lit(0)) == 0, F.col("phase"))).drop("bad")


def precisions(sigmas: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """``(row, col, valid, by_pair, by_date)`` from an array ``sigma`` per pixel: 1 / variance, 1 everywhere where a deviation is missing."""
    valid = F.forall("sigma", lambda x: x.isNotNull() & ~F.isnan(x))
    one = lambda x: F.when(F.col("valid"), x).otherwise(1.0)
    p = sigmas.select("row", "col", "sigma", valid.alias("valid"))
    of_pair = F.array(*[one(1 / F.greatest(F.expr(f"sigma[{i}] * sigma[{i}] + sigma[{j}] * sigma[{j}]"), F.lit(1e-12))) for i, j in pairs])
    return p.select("row", "col", "valid", of_pair.alias("by_pair"), F.transform("sigma", lambda x: one(1 / F.greatest(x * x, F.lit(1e-12)))).alias("by_date"))


def clear_unbounded(layer: DataFrame, valid: DataFrame, *columns: str) -> DataFrame:
    """Blank ``columns`` where the deviations are not usable."""
    j = layer.join(valid.select("row", "col", "valid"), ["row", "col"], "left")
    return j.withColumns({c: F.when(F.col("valid"), F.col(c)) for c in columns}).drop("valid")


def reference_variance(variances: DataFrame, point: tuple[int, int]) -> DataFrame:
    """Variances plus the reference pixel's of the same epoch; the reference itself has none."""
    here = (F.col("row") == point[0]) & (F.col("col") == point[1])
    base = variances.where(here).select("epoch", F.col("variance").alias("base"))
    return variances.join(F.broadcast(base), "epoch", "left").select("row", "col", "epoch", F.when(here, 0.0).otherwise(F.col("variance") + F.col("base")).alias("variance"))  # one row an epoch is broadcast


def with_reference_epoch(series: DataFrame) -> DataFrame:
    """A zero at epoch 0 ahead of epochs 1.. of ``(row, col, epoch, value)``."""
    zero = series.select("row", "col").distinct().select("row", "col", F.lit(0).alias("epoch"), F.lit(0.0).alias("value"))
    return series.select("row", "col", "epoch", "value").unionByName(zero)


def uncertainty_scale(spare: int) -> str:
    """How deviations were scaled: by the bound alone without spare observations."""
    return "empirical" if spare > 0 else "crlb_bound"


def velocities(series: DataFrame, days: list[float], model: s.VelocityModel = s.VelocityModel(), precision: str | None = None) -> DataFrame:
    """Rates and model terms per pixel from arrays ``series`` (and precisions)."""
    t = np.asarray(days, float)
    names = list(s.fit_model(t, np.zeros((1, len(t))), None, model))

    def kernel(y, *p):
        return list(s.fit_model(t, y, p[0] if p else None, model).values())

    return _pixels(series, kernel, ["series"] + ([precision] if precision else []), ", ".join(f"{n} double" for n in names))


def reference_point(quality: DataFrame, threshold: float = 0.2) -> DataFrame:
    """``(row, col)`` of the automatic reference: the grid's quality layer in one task, a few bytes a pixel."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows, cols = table.column("row").to_numpy(), table.column("col").to_numpy()
        q = np.full((rows.max() + 1, cols.max() + 1), np.nan)
        q[rows, cols] = table.column("quality").to_numpy(zero_copy_only=False).astype(float)
        at = s.reference_point(q, threshold)
        return pa.table({"row": pa.array([at[0]] if at else [], pa.int64()), "col": pa.array([at[1]] if at else [], pa.int64())})

    return quality.select("row", "col", "quality", F.lit(0).alias("layer")).groupBy("layer").applyInArrow(run, "row long, col long")


def weighted_rate(cube: DataFrame) -> DataFrame:
    """``(user_id, velocity)``: slope a year where weights multiply residuals, so count squared; a missing value gives none."""
    w = F.col("w") * F.col("w")
    bad = F.max((F.col("y").isNull() | F.isnan("y")).cast("int"))
    g = cube.groupBy("user_id").agg(bad.alias("bad"), *[F.sum(e).alias(n) for n, e in (("sw", w), ("sx", w * F.col("t")), ("sxx", w * F.col("t") * F.col("t")), ("sy", w * F.col("y")), ("sxy", w * F.col("t") * F.col("y")))])
    slope = F.expr("(sw * sxy - sx * sy) / nullif(sw * sxx - sx * sx, 0)") * s.YEAR
    return g.select("user_id", r6(F.when(F.col("bad") == 0, slope), "velocity"))


def _raw_network(spark: SparkSession, sf_dir: str, pairs: list[tuple[int, int]]) -> DataFrame:
    """Wrapped interferograms taken as they are: loops close up to whole cycles."""
    return form_network(sample_phases(c_stack(spark, sf_dir)), pairs).select("ifg", "row", "col", F.col("psi").alias("phase"))


def _unwrapped(spark: SparkSession, sf_dir: str, pairs: list[tuple[int, int]]) -> DataFrame:
    stack = c_stack(spark, sf_dir)
    ifgs = form_network(sample_phases(stack), pairs).withColumn("corr", F.lit(0.9))
    return unwrap_network(ifgs, grid_shape(stack)).withColumnRenamed("unwrapped", "phase")


BAND = bandwidth_pairs(8, 2)


def _inverted(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return invert(by_pixel(_unwrapped(spark, sf_dir, BAND), len(BAND), "phase"), BAND, method)

    return query


def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted least squares of three dates; the weight of a pair is the product of both amplitudes."""
    stack = c_stack(spark, sf_dir)
    amp = [F.sqrt(part(k, 0) * part(k, 0) + part(k, 1) * part(k, 1)) for k in range(3)]
    pairs = F.array(*[F.struct(F.lit(n).alias("ifg"), amp[i].__mul__(amp[j]).alias("w")) for n, (i, j) in enumerate(PAIRS3)])
    weights = stack.select("row", "col", F.explode(pairs).alias("p")).select("row", "col", "p.*")
    pixels = by_pixel(_raw_network(spark, sf_dir, PAIRS3).join(weights, ["row", "col", "ifg"]), 3, "phase", "w")
    found = invert(pixels, PAIRS3, "l2", "w")
    # spare = 1
    return found.select("row", "col", r6(F.col("series")[0], "x1"), r6(F.col("series")[1], "x2"), r6(F.col("variance")[0], "v1"), r6(F.col("variance")[1], "v2"), r6(F.col("rms"), "rms"))


def _sigmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    amp = lambda k: F.sqrt(part(k, 0) * part(k, 0) + part(k, 1) * part(k, 1))
    gap = F.when((F.col("row") + F.col("col")) % 5 == 0, F.lit(None).cast("double"))
    return c_stack(spark, sf_dir).select("row", "col", F.array(amp(0), amp(1), F.when(gap.isNull() & ((F.col("row") + F.col("col")) % 5 == 0), gap).otherwise(amp(2))).alias("sigma"))


def _precisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = precisions(_sigmas(spark, sf_dir), PAIRS3)
    return p.select("row", "col", "valid", *[r6(F.col("by_pair")[k], f"pair_{k}") for k in range(3)], *[r6(F.col("by_date")[k], f"date_{k}") for k in range(3)])


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasonal and step model of the phase series of every pixel, a sample every 12 days."""
    return velocities(sample_phases(c_stack(spark, sf_dir)).withColumnRenamed("theta", "series"), [12.0 * k for k in range(EPOCHS)], s.VelocityModel(True, (180.0,)))


def _variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e_cube(spark, sf_dir).select(F.floor(F.col("user_id") / 15).alias("row"), F.pmod("user_id", F.lit(15)).alias("col"), F.col("t").alias("epoch"), F.abs("y").alias("variance"))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c_stack(spark, sf_dir).select("row", "col", F.abs(part(0, 0)).alias("quality"))


QUERIES = {
    "loop_qc": lambda spark, sf_dir: loop_qc(_raw_network(spark, sf_dir, bandwidth_pairs(EPOCHS, 2)), bandwidth_pairs(EPOCHS, 2)),
    "loop_mask": lambda spark, sf_dir: (lambda i: loop_mask(i, loop_qc(i, BAND)).select("ifg", "row", "col", r6(F.col("phase"), "phase")))(_raw_network(spark, sf_dir, BAND)),
    "l2_three_dates": _three,
    "precisions": _precisions,
    "reference_variance": lambda spark, sf_dir: reference_variance(_variances(spark, sf_dir), (0, 0)).select("row", "col", "epoch", r6(F.col("variance"), "variance")),
    "series_with_reference": lambda spark, sf_dir: with_reference_epoch(_variances(spark, sf_dir).where("epoch > 0").withColumnRenamed("variance", "value")).select("row", "col", "epoch", r6(F.col("value"), "value")),
    "velocity_weighted": lambda spark, sf_dir: weighted_rate(e_cube(spark, sf_dir)),
    "l2_network": _inverted("l2"),
    "l1_admm": _inverted("l1"),
    "velocity_model": _models,
    "reference_point": lambda spark, sf_dir: reference_point(_quality(spark, sf_dir)),
}

_WRAP = lambda x: f"(({x}) - 2*pi()*round(({x})/(2*pi())))"
_THETA = f"""{C_STACK_SQL}, th AS (SELECT "row", col, CAST(i AS INT) AS i, atan2(z[2*i+2], z[2*i+1]) AS t, sqrt(z[2*i+1]*z[2*i+1] + z[2*i+2]*z[2*i+2]) AS amp FROM c, range({EPOCHS}) x(i))"""


def _pairs_sql(epochs: int, width: int) -> str:
    return f"""ph AS (SELECT a."row", a.col, a.i, b.i AS j, {_WRAP("a.t - b.t")} AS p, a.amp * b.amp AS w FROM th a JOIN th b ON a."row" = b."row" AND a.col = b.col
 AND b.i - a.i BETWEEN 1 AND {width} AND b.i < {epochs})"""


_LOOPS = """lp AS (SELECT x."row", x.col, abs(x.p + y.p - z.p) / (2*pi()) AS k FROM ph x JOIN ph y ON x."row" = y."row" AND x.col = y.col AND x.j = y.i
 JOIN ph z ON x."row" = z."row" AND x.col = z.col AND z.i = x.i AND z.j = y.j),
qc AS (SELECT "row", col, CAST(sum(CASE WHEN k > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS bad, count(k) AS evaluable, max(k) AS worst FROM lp GROUP BY ALL)"""
_NUMBERS = ", ".join(f"({n}, {i}, {j})" for n, (i, j) in enumerate(BAND))
_VARIANCE = f"""{E_CUBE_SQL}, v AS (SELECT CAST(user_id // 15 AS BIGINT) AS "row", CAST(user_id % 15 AS BIGINT) AS col, t AS epoch, abs(y) AS variance FROM e)"""
_SIGMA = f"""{_THETA}, sg AS (SELECT "row", col, i, CASE WHEN i = 2 AND ("row" + col) % 5 = 0 THEN NULL ELSE amp END AS s FROM th WHERE i < 3),
ok AS (SELECT "row", col, ("row" + col) % 5 <> 0 AS valid, max(s) FILTER (i = 0) AS s0, max(s) FILTER (i = 1) AS s1, max(s) FILTER (i = 2) AS s2 FROM sg GROUP BY ALL)"""
_ONE = lambda x: f"round(CASE WHEN valid THEN 1 / greatest({x}, 1e-12) ELSE 1.0 END, 6) + 0.0"
ORACLES = {
    "loop_qc": f"""WITH {_THETA}, {_pairs_sql(EPOCHS, 2)}, {_LOOPS} SELECT "row", col, bad, evaluable, round(worst, 6) + 0.0 AS worst FROM qc""",
    "loop_mask": f"""WITH {_THETA}, {_pairs_sql(8, 2)}, {_LOOPS}, nb(ifg, i, j) AS (VALUES {_NUMBERS})
SELECT CAST(nb.ifg AS INT) AS ifg, ph."row", ph.col, CASE WHEN bad = 0 THEN round(p, 6) + 0.0 END AS phase FROM ph JOIN nb USING (i, j) JOIN qc ON qc."row" = ph."row" AND qc.col = ph.col""",
    "l2_three_dates": f"""WITH {_THETA}, {_pairs_sql(3, 2)},
y AS (SELECT "row", col, max(p) FILTER (i=0 AND j=1) AS a, max(p) FILTER (i=0 AND j=2) AS b, max(p) FILTER (i=1 AND j=2) AS d, max(w) FILTER (i=0 AND j=1) AS wa, max(w) FILTER (i=0 AND j=2) AS wb, max(w) FILTER (i=1 AND j=2) AS wd FROM ph GROUP BY ALL),
n AS (SELECT *, wa + wd AS n11, wb + wd AS n22, -wd AS n12, wa*a - wd*d AS b1, wb*b + wd*d AS b2 FROM y),
x AS (SELECT *, n11*n22 - n12*n12 AS det, (n22*b1 - n12*b2) / (n11*n22 - n12*n12) AS x1, (n11*b2 - n12*b1) / (n11*n22 - n12*n12) AS x2 FROM n),
r AS (SELECT *, a - x1 AS ra, b - x2 AS rb, d - (x2 - x1) AS rd FROM x),
f AS (SELECT *, greatest(1.0, wa*ra*ra + wb*rb*rb + wd*rd*rd) AS k FROM r)
SELECT "row", col, round(x1, 6) + 0.0 AS x1, round(x2, 6) + 0.0 AS x2, round(n22/det*k, 6) + 0.0 AS v1, round(n11/det*k, 6) + 0.0 AS v2, round(sqrt((ra*ra + rb*rb + rd*rd)/3), 6) + 0.0 AS rms FROM f""",
    "precisions": f"""WITH {_SIGMA} SELECT "row", col, valid, {_ONE("s0*s0 + s1*s1")} AS pair_0, {_ONE("s0*s0 + s2*s2")} AS pair_1, {_ONE("s1*s1 + s2*s2")} AS pair_2,
 {_ONE("s0*s0")} AS date_0, {_ONE("s1*s1")} AS date_1, {_ONE("s2*s2")} AS date_2 FROM ok""",
    "reference_variance": f"""WITH {_VARIANCE} SELECT v."row", v.col, v.epoch, CASE WHEN v."row" = 0 AND v.col = 0 THEN 0.0 ELSE round(v.variance + o.variance, 6) + 0.0 END AS variance
 FROM v LEFT JOIN (SELECT epoch, variance FROM v WHERE "row" = 0 AND col = 0) o ON o.epoch = v.epoch""",
    "series_with_reference": f"""WITH {_VARIANCE}, p AS (SELECT * FROM v WHERE epoch > 0) SELECT "row", col, epoch, round(variance, 6) + 0.0 AS value FROM p
 UNION ALL SELECT DISTINCT "row", col, CAST(0 AS INT), 0.0 FROM p""",
    "velocity_weighted": f"""WITH {E_CUBE_SQL}, g AS (SELECT user_id, sum(w*w) AS sw, sum(w*w*t) AS sx, sum(w*w*t*t) AS sxx, sum(w*w*y) AS sy, sum(w*w*t*y) AS sxy FROM e GROUP BY 1)
SELECT user_id, round((sw*sxy - sx*sy) / nullif(sw*sxx - sx*sx, 0) * {s.YEAR}, 6) + 0.0 AS velocity FROM g""",
}

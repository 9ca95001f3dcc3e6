"""Path delays and viewing geometry as column expressions and joins; FFT filters one raster to a task."""

from __future__ import annotations

import math
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.errors import CorrectionError
from rasterloom.kernels import delays as k
from rasterloom.sources.adapters import C_STACK_SQL, E_CUBE_SQL, c_stack, e_cube, table

from .coherence import part, r6
from .stack import grid_shape

WAVELENGTH, FREQUENCY, INCIDENCE = 0.05546576, 5.405e9, 37.0


def _corners(*axes: tuple[Column, int]) -> Column:
    """Array of (place per axis, weight) of the grid points around fractional places, clamped to the axes."""
    found = F.array(F.struct(F.lit(1.0).alias("w")))
    for n, (at, size) in enumerate(axes):
        at = F.least(F.greatest(at, F.lit(0.0)), F.lit(float(size - 1)))
        low = F.least(F.floor(at), F.lit(max(size - 2, 0))).cast("long")
        own = F.array(*[F.struct((low + d).alias("p"), w.alias("v")) for d, w in ((0, 1 - (at - low)), (1, at - low))])
        found = F.flatten(F.transform(found, _crossed(own, n)))
    return F.filter(found, lambda c: c["w"] > 0)


def _crossed(own: Column, n: int):
    return lambda a: F.transform(own, lambda b: F.struct(*[a[f"a{i}"].alias(f"a{i}") for i in range(n)], b["p"].alias(f"a{n}"), (a["w"] * b["v"]).alias("w")))


def interpolated(points: DataFrame, keys: list[str], axes: list[tuple[Column, int]], grid: DataFrame, names: list[str], value: str) -> DataFrame:
    """``keys`` and ``value`` of the regular grid at each point: linear along every axis, clamped at the ends.

    A point asks for the grid points around it in one equi-join; a missing grid value makes it missing.
    """
    asked = points.select(*keys, F.explode(_corners(*axes)).alias("c")).select(*keys, *[F.col(f"c.a{i}").alias(n) for i, n in enumerate(names)], "c.w")
    j = asked.join(grid.select(*names, value), names, "left")
    return j.groupBy(*keys).agg(F.when(F.count(value) == F.count("*"), F.sum(F.col("w") * F.col(value))).alias(value))


def resample(grid: DataFrame, shape: tuple[int, int], cells: DataFrame, src_gt: tuple, dst_gt: tuple) -> DataFrame:
    """``(row, col, value)`` of a grid at the centres of other cells, in one reference system."""
    x, y = dst_gt[0] + (F.col("col") + 0.5) * dst_gt[1], dst_gt[3] + (F.col("row") + 0.5) * dst_gt[5]
    axes = [((y - src_gt[3]) / src_gt[5] - 0.5, shape[0]), ((x - src_gt[0]) / src_gt[1] - 0.5, shape[1])]
    return interpolated(cells, ["row", "col"], axes, grid.select(F.col("row").alias("sr"), F.col("col").alias("sc"), "value"), ["sr", "sc"], "value")


def ionosphere_delay(tec: Column, incidence_deg: Column, frequency: float) -> Column:
    """Range delay in metres of a vertical content on a thin shell."""
    scale = k.IONOSPHERE * 1e16 / frequency**2
    return tec * scale / F.cos(F.asin(F.sin(F.radians(incidence_deg)) / (1 + tec * scale)))


def up_component(east: Column, north: Column) -> Column:
    return F.sqrt(F.greatest(1 - east * east - north * north, F.lit(0.0)))


def at_heights(height: Column, levels: list[float], planes: Column) -> Column:
    """Linear in height over an array of level values, extended beyond the ends; a missing height takes the first."""
    if len(levels) == 1:
        return planes[0]
    up = F.lit(len(levels) - 1)
    for n in range(len(levels) - 1, 0, -1):
        up = F.when(height <= levels[n], n).otherwise(up)
    z = F.array(*map(F.lit, map(float, levels)))
    w = (height - z[up - 1]) / (z[up] - z[up - 1])
    return F.when(height.isNull() | F.isnan(height), planes[0]).otherwise(planes[up - 1] * (1 - w) + planes[up] * w)


def subtract_delay(series: DataFrame, delays: DataFrame, keys: list[str], wavelength: float) -> DataFrame:
    """``(keys, epoch, value)`` in radians less the delay (metres) against the first epoch's."""
    if not wavelength > 0:
        raise CorrectionError("a positive wavelength is needed")
    first = delays.where("epoch = 0").select(*keys, F.col("delay").alias("d0"))
    j = series.join(delays, [*keys, "epoch"]).join(first, keys)
    return j.select(*keys, "epoch", (F.col("value") + (F.col("delay") - F.col("d0")) * (4 * math.pi / wavelength)).alias("value"))


def sum_layers(*layers: Column) -> Column:
    """Sum of the layers that have a value, null if none has."""
    some = F.coalesce(*layers)
    return F.when(some.isNotNull(), sum((F.coalesce(x, F.lit(0.0)) for x in layers), F.lit(0.0)))


def incidence_stats(geometry: DataFrame) -> DataFrame:
    """Mean, population deviation, least and greatest incidence in degrees."""
    x = geometry.select(F.degrees(F.acos(up_component(F.col("east"), F.col("north")))).alias("i")).where("i IS NOT NULL AND NOT isnan(i)")
    return x.agg(r6(F.avg("i"), "mean_deg"), r6(F.stddev_pop("i"), "std_deg"), r6(F.min("i"), "min_deg"), r6(F.max("i"), "max_deg"))


def mosaic_geometry(layers: DataFrame) -> DataFrame:
    """``(row, col, east, north, up, apart)`` from ``(granule, row, col, east, north)``: the first granule that covers a pixel.

    (0, 0) and missing values cover nothing; ``apart`` is the largest angle in degrees to later granules.
    """
    valid = layers.where("(east <> 0 OR north <> 0) AND NOT isnan(east) AND NOT isnan(north)").withColumn("up", up_component(F.col("east"), F.col("north")))
    g = valid.groupBy("row", "col").agg(F.array_sort(F.collect_list(F.struct("granule", "east", "north", "up"))).alias("g"))  # granules at one pixel
    a = F.col("g")[0]
    turn = F.transform("g", lambda b: F.degrees(F.acos(F.least(F.greatest(a["east"] * b["east"] + a["north"] * b["north"] + a["up"] * b["up"], F.lit(-1.0)), F.lit(1.0)))))
    return g.select("row", "col", a["east"].alias("east"), a["north"].alias("north"), a["up"].alias("up"), F.array_max(F.slice(turn, F.lit(2), F.greatest(F.size("g") - 1, F.lit(1)))).alias("apart"))


def check_geometry(found: DataFrame, pixels: int) -> DataFrame:
    """Refuses pixels without geometry and granules that disagree in the upper median of their overlap."""
    row = found.agg(F.count("*").alias("n"), F.count("apart").alias("shared"), F.expr("percentile_disc(0.5) within group (order by -apart)").alias("m")).first()
    if row["n"] < pixels:
        raise CorrectionError(f"{pixels - row['n']} pixels have no viewing geometry")
    if row["shared"] >= k.LEAST_OVERLAP and -row["m"] > k.OVERLAP_GATE:
        raise CorrectionError(f"geometry granules differ by {-row['m']:.3f} degrees where they overlap")
    return found


def require_finite(grid: DataFrame, value: str = "value") -> DataFrame:
    if grid.where(F.col(value).isNull() | F.isnan(value)).limit(1).count():
        raise CorrectionError("the delay grid has missing values inside the frame")
    return grid


def tide_delay(cells: DataFrame, at: datetime) -> DataFrame:
    """``cells`` (lon, lat in degrees; east, north, up of the view) with ``tide_delay`` in metres; Moon and Sun are found once on the driver."""
    lon, lat = F.radians("lon"), F.radians("lat")
    n = k.ELLIPSOID_A / F.sqrt(1 - k.ELLIPSOID_E2 * F.sin(lat) * F.sin(lat))
    s = [n * F.cos(lat) * F.cos(lon), n * F.cos(lat) * F.sin(lon), n * (1 - k.ELLIPSOID_E2) * F.sin(lat)]
    cells = cells.withColumn("_s", F.array(*s)).withColumn("_s", F.transform("_s", lambda v: v / F.sqrt(F.aggregate("_s", F.lit(0.0), lambda a, b: a + b * b))))
    total = [F.lit(0.0)] * 3
    for d, scale in k.bodies(at):
        c = sum((F.col("_s")[i] * float(d[i]) for i in range(3)), F.lit(0.0))
        total = [t + scale * (k.LOVE * (3 * c * c - 1) / 2 * F.col("_s")[i] + 3 * k.SHIDA * c * (float(d[i]) - c * F.col("_s")[i])) for i, t in enumerate(total)]
    cells = cells.withColumn("_t", F.array(*total))
    x, y, z = (F.col("_t")[i] for i in range(3))
    out = x * F.cos(lon) + y * F.sin(lon)
    enu = (y * F.cos(lon) - x * F.sin(lon), z * F.cos(lat) - out * F.sin(lat), out * F.cos(lat) + z * F.sin(lat))
    toward = sum((e * F.col(c) for e, c in zip(enu, ("east", "north", "up"))), F.lit(0.0))
    return cells.withColumn("tide_delay", -toward).drop("_s", "_t")


def lonlat(cells: DataFrame, corners: list[tuple[float, float]], shape: tuple[int, int]) -> DataFrame:
    """``cells`` with lon and lat between the corner pixels."""
    fy, fx = (F.col(c) / max(n - 1, 1) for c, n in zip(("row", "col"), shape))

    def mix(a: int) -> Column:
        ul, ur, ll, lr = (p[a] for p in corners)
        return (ul + fx * (ur - ul)) * (1 - fy) + (ll + fx * (lr - ll)) * fy

    return cells.withColumns({"lon": mix(0), "lat": mix(1)})


def filtered(rasters: DataFrame, kernel, shape: tuple[int, int]) -> DataFrame:
    """``(layer, row, col, re, im)`` through a whole-raster kernel, one raster to a task."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        rows, cols = t.column("row").to_numpy(), t.column("col").to_numpy()
        z = np.full(shape, np.nan, complex)
        z[rows, cols] = t.column("re").to_numpy() + 1j * t.column("im").to_numpy()
        out = np.asarray(kernel(z)).astype(complex)[rows, cols]
        return pa.table({"layer": t.column("layer"), "row": t.column("row"), "col": t.column("col"), "re": pa.array(out.real), "im": pa.array(out.imag)})

    return rasters.groupBy("layer").applyInArrow(run, rasters.select("layer", "row", "col", "re", "im").schema)


def _geometry(stack: DataFrame) -> DataFrame:
    return stack.select("row", "col", (part(0, 0) / 2).alias("east"), (part(0, 1) / 2).alias("north"))


def _grid(stack: DataFrame) -> DataFrame:
    return stack.select("row", "col", part(0, 0).alias("value"))


SRC_GT, DST_GT = (0.0, 10.0, 0.0, 1000.0, 0.0, -10.0), (3.0, 7.0, 0.0, 996.0, 0.0, -6.0)


def _resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = c_stack(spark, sf_dir)
    return resample(_grid(stack), grid_shape(stack), stack.select("row", "col"), SRC_GT, DST_GT).select("row", "col", r6(F.col("value"), "value"))


def _tec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content at a place and time of every supplier, from a map per day of a 15-wide grid."""
    cube = e_cube(spark, sf_dir).select(F.col("t").cast("long").alias("m"), F.pmod("user_id", F.lit(15)).alias("x"), "y").groupBy("m", "x").agg(F.avg("y").alias("tec"))
    days = cube.agg(F.max("m")).first()[0]
    n = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").select("s_suppkey", (F.pmod(n * 977, F.lit(86400)) / 86400.0 * (days + 2) - 1).alias("at"), (F.pmod(n * 31, F.lit(160)) / 10.0 - 0.5).alias("lon"))
    return interpolated(points, ["s_suppkey"], [(F.col("at"), days + 1), (F.col("lon"), 15)], cube, ["m", "x"], "tec").select("s_suppkey", r6(F.col("tec"), "tec"))


def _iono(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _geometry(c_stack(spark, sf_dir)).withColumn("inc", F.degrees(F.acos(up_component(F.col("east"), F.col("north")))))
    tec = F.col("row") + 5.0
    return g.select("row", "col", r6(F.col("inc"), "incidence"), (F.round(ionosphere_delay(tec, F.col("inc"), FREQUENCY), 9) + 0.0).alias("delay"))


LEVELS = [-1.0, 0.0, 0.5, 2.0]


def _terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delay at a height between four levels, slanted by the view's cosine."""
    planes = F.array(*[part(n, 0) for n in range(4)])
    s = c_stack(spark, sf_dir).select("row", "col", at_heights(part(5, 0) * 5, LEVELS, planes).alias("v"), up_component(part(0, 0) / 2, part(0, 1) / 2).alias("up"))
    return s.select("row", "col", r6(F.col("v"), "zenith"), r6(F.col("v") / F.col("up"), "slant"))


def _corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = e_cube(spark, sf_dir).select("user_id", F.col("t").alias("epoch"), F.col("y").alias("value"), (F.col("w") / 1000).alias("delay"))
    out = subtract_delay(cube.select("user_id", "epoch", "value"), cube.select("user_id", "epoch", "delay"), ["user_id"], WAVELENGTH)
    return out.select("user_id", "epoch", r6(F.col("value"), "value"))


def _summed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.when(part(0, 0) > 0, part(0, 0)), F.when(part(1, 0) > 0, part(1, 0))
    return c_stack(spark, sf_dir).select("row", "col", r6(sum_layers(a, b), "delay"))


def _mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three granules of which each covers the pixels whose sample is positive."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("granule"), F.when(part(n, 0) > 0, part(n, 0) / 2).otherwise(0.0).alias("east"), F.when(part(n, 0) > 0, part(n, 1) / 2).otherwise(0.0).alias("north")) for n in range(3)]))
    layers = c_stack(spark, sf_dir).select("row", "col", each.alias("g")).select("g.granule", "row", "col", "g.east", "g.north")
    return mosaic_geometry(layers).select("row", "col", r6(F.col("east"), "east"), r6(F.col("north"), "north"), r6(F.col("up"), "up"), r6(F.coalesce("apart", F.lit(-1.0)), "apart"))


CORNERS = [(-118.0, 35.0), (-117.0, 35.1), (-118.1, 34.0), (-117.1, 34.1)]


def _tide(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = c_stack(spark, sf_dir)
    cells = _geometry(stack).withColumn("up", up_component(F.col("east"), F.col("north")))
    found = tide_delay(lonlat(cells, CORNERS, grid_shape(stack)), datetime(2024, 1, 15, 6, 30))
    return found.select("row", "col", r6(F.col("lon"), "lon"), r6(F.col("lat"), "lat"), (F.round("tide_delay", 9) + 0.0).alias("tide_delay"))


def _layers(stack: DataFrame) -> DataFrame:
    return stack.select(F.lit(0).alias("layer"), "row", "col", part(0, 0).alias("re"), part(0, 1).alias("im"))


def _filter(kernel):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        stack = c_stack(spark, sf_dir)
        return filtered(_layers(stack), kernel, grid_shape(stack))

    return query


QUERIES = {
    "bilinear_resample": _resampled,
    "tec_interpolated": _tec,
    "iono_delay": _iono,
    "terrain_interp": _terrain,
    "subtract_delay": _corrected,
    "sum_layers": _summed,
    "los_stats": lambda spark, sf_dir: incidence_stats(_geometry(c_stack(spark, sf_dir))),
    "los_mosaic": _mosaic,
    "tide_grid": _tide,
    "long_wavelength": _filter(lambda z: k.high_pass(z.real, 40.0, 10.0)),
    "goldstein": _filter(lambda z: k.goldstein(z, 0.5, 8)),
}

_TIDE_BODIES = k.bodies(datetime(2024, 1, 15, 6, 30))
_C = [" + ".join(f"s{i} * ({float(d[i])!r})" for i in range(3)) for d, _ in _TIDE_BODIES]
_T = [" + ".join(f"({s!r}) * ({k.LOVE} * (3*c{b}*c{b} - 1)/2 * s{i} + 3*{k.SHIDA}*c{b} * (({float(d[i])!r}) - c{b}*s{i}))" for b, (d, s) in enumerate(_TIDE_BODIES)) for i in range(3)]
_MIX = lambda a: f"({CORNERS[0][a]} + fx * ({CORNERS[1][a] - CORNERS[0][a]!r})) * (1 - fy) + ({CORNERS[2][a]} + fx * ({CORNERS[3][a] - CORNERS[2][a]!r})) * fy"
_UP = "sqrt(greatest(1 - e*e - n*n, 0.0))"
ORACLES = {
    "bilinear_resample": f"""WITH {C_STACK_SQL}, g AS (SELECT max("row") + 1 AS nr, max(col) + 1 AS nc FROM c),
p AS (SELECT "row", col, least(greatest((({DST_GT[3]} + ("row" + 0.5) * ({DST_GT[5]})) - {SRC_GT[3]}) / ({SRC_GT[5]}) - 0.5, 0.0), nr - 1.0) AS fr,
 least(greatest((({DST_GT[0]} + (col + 0.5) * {DST_GT[1]}) - {SRC_GT[0]}) / {SRC_GT[1]} - 0.5, 0.0), nc - 1.0) AS fc, nr, nc FROM c, g),
q AS (SELECT *, CAST(floor(fr) AS BIGINT) AS r0, CAST(floor(fc) AS BIGINT) AS c0 FROM p),
v AS (SELECT q."row", q.col, fr - r0 AS a, fc - c0 AS b, w.z[1] AS v00, x.z[1] AS v01, y.z[1] AS v10, z.z[1] AS v11 FROM q
 JOIN c w ON w."row" = r0 AND w.col = c0 JOIN c x ON x."row" = r0 AND x.col = least(c0 + 1, nc - 1) JOIN c y ON y."row" = least(r0 + 1, nr - 1) AND y.col = c0
 JOIN c z ON z."row" = least(r0 + 1, nr - 1) AND z.col = least(c0 + 1, nc - 1))
SELECT "row", col, round((v00*(1-b) + v01*b)*(1-a) + (v10*(1-b) + v11*b)*a, 6) + 0.0 AS value FROM v""",
    "tec_interpolated": f"""WITH {E_CUBE_SQL}, m AS (SELECT t, user_id % 15 AS x, avg(y) AS tec FROM e GROUP BY ALL), g AS (SELECT max(t) AS d FROM m),
p AS (SELECT s_suppkey, least(greatest(((s_suppkey * 977) % 86400) / 86400.0 * (d + 2) - 1, 0.0), d) AS a, least(greatest(((s_suppkey * 31) % 160) / 10.0 - 0.5, 0.0), 14.0) AS o, d FROM supplier, g),
q AS (SELECT *, CAST(least(floor(a), d - 1) AS BIGINT) AS i, CAST(least(floor(o), 13) AS BIGINT) AS j FROM p),
k AS (SELECT s_suppkey, i + u AS t, j + v AS x, (CASE WHEN u = 0 THEN 1 - (a - i) ELSE a - i END) * (CASE WHEN v = 0 THEN 1 - (o - j) ELSE o - j END) AS w FROM q, range(2) r(u), range(2) s(v)),
f AS (SELECT s_suppkey, count(*) AS n, count(tec) AS h, sum(w * tec) AS s FROM (SELECT * FROM k WHERE w > 0) k LEFT JOIN m USING (t, x) GROUP BY 1)
SELECT s_suppkey, CASE WHEN n = h THEN round(s, 6) + 0.0 END AS tec FROM f""",
    "iono_delay": f"""WITH {C_STACK_SQL}, g AS (SELECT "row", col, z[1]/2 AS e, z[2]/2 AS n FROM c), i AS (SELECT "row", col, acos({_UP}) AS inc, ("row" + 5.0) * {k.IONOSPHERE * 1e16 / FREQUENCY**2!r} AS d FROM g)
SELECT "row", col, round(degrees(inc), 6) + 0.0 AS incidence, round(d / cos(asin(sin(inc) / (1 + d))), 9) + 0.0 AS delay FROM i""",
    "terrain_interp": f"""WITH {C_STACK_SQL}, h AS (SELECT "row", col, z[11]*5 AS h, z[1] AS p0, z[3] AS p1, z[5] AS p2, z[7] AS p3, z[1]/2 AS e, z[2]/2 AS n FROM c),
v AS (SELECT "row", col, {_UP} AS up, CASE WHEN h <= 0.0 THEN p0 + (p1 - p0) * (h + 1) WHEN h <= 0.5 THEN p1 + (p2 - p1) * h / 0.5 ELSE p2 + (p3 - p2) * (h - 0.5) / 1.5 END AS v FROM h)
SELECT "row", col, round(v, 6) + 0.0 AS zenith, round(v / up, 6) + 0.0 AS slant FROM v""",
    "subtract_delay": f"""WITH {E_CUBE_SQL} SELECT a.user_id, a.t AS epoch, round(a.y - ((a.w - b.w) / 1000.0) * (-4*pi()/{WAVELENGTH}), 6) + 0.0 AS value FROM e a JOIN e b ON a.user_id = b.user_id AND b.t = 0""",
    "sum_layers": f"""WITH {C_STACK_SQL} SELECT "row", col, CASE WHEN z[1] > 0 OR z[3] > 0 THEN round(greatest(z[1], 0.0) + greatest(z[3], 0.0), 6) + 0.0 END AS delay FROM c""",
    "los_stats": f"""WITH {C_STACK_SQL}, g AS (SELECT z[1]/2 AS e, z[2]/2 AS n FROM c), i AS (SELECT degrees(acos({_UP})) AS i FROM g)
SELECT round(avg(i), 6) + 0.0 AS mean_deg, round(stddev_pop(i), 6) + 0.0 AS std_deg, round(min(i), 6) + 0.0 AS min_deg, round(max(i), 6) + 0.0 AS max_deg FROM i""",
    "los_mosaic": f"""WITH {C_STACK_SQL}, l AS (SELECT "row", col, g, z[2*g+1]/2 AS e, z[2*g+2]/2 AS n FROM c, range(3) t(g) WHERE z[2*g+1] > 0), u AS (SELECT *, {_UP} AS u FROM l),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY "row", col ORDER BY g) = 1),
a AS (SELECT f."row", f.col, max(degrees(acos(least(greatest(f.e*u.e + f.n*u.n + f.u*u.u, -1.0), 1.0)))) AS apart FROM f JOIN u ON f."row" = u."row" AND f.col = u.col AND u.g > f.g GROUP BY ALL)
SELECT f."row", f.col, round(e, 6) + 0.0 AS east, round(n, 6) + 0.0 AS north, round(u, 6) + 0.0 AS up, round(coalesce(apart, -1.0), 6) + 0.0 AS apart FROM f LEFT JOIN a ON a."row" = f."row" AND a.col = f.col""",
    "tide_grid": f"""WITH {C_STACK_SQL}, g AS (SELECT max("row") AS nr, max(col) AS nc FROM c), f AS (SELECT "row", col, "row" / greatest(nr, 1) AS fy, col / greatest(nc, 1) AS fx, z[1]/2 AS e, z[2]/2 AS n FROM c, g),
l AS (SELECT *, {_UP} AS u, {_MIX(0)} AS lon, {_MIX(1)} AS lat FROM f), r AS (SELECT *, radians(lon) AS lo, radians(lat) AS la, {k.ELLIPSOID_A} / sqrt(1 - {k.ELLIPSOID_E2}*sin(radians(lat))*sin(radians(lat))) AS nn FROM l),
x AS (SELECT *, nn*cos(la)*cos(lo) AS x0, nn*cos(la)*sin(lo) AS x1, nn*(1 - {k.ELLIPSOID_E2})*sin(la) AS x2 FROM r),
s AS (SELECT *, x0/sqrt(x0*x0+x1*x1+x2*x2) AS s0, x1/sqrt(x0*x0+x1*x1+x2*x2) AS s1, x2/sqrt(x0*x0+x1*x1+x2*x2) AS s2 FROM x), k AS (SELECT *, {_C[0]} AS c0, {_C[1]} AS c1 FROM s),
t AS (SELECT *, {_T[0]} AS tx, {_T[1]} AS ty, {_T[2]} AS tz FROM k)
SELECT "row", col, round(lon, 6) + 0.0 AS lon, round(lat, 6) + 0.0 AS lat, round(-((ty*cos(lo) - tx*sin(lo))*e + (tz*cos(la) - (tx*cos(lo) + ty*sin(lo))*sin(la))*n + ((tx*cos(lo) + ty*sin(lo))*cos(la) + tz*sin(la))*u), 9) + 0.0 AS tide_delay FROM t""",
}

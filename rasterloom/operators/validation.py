"""Scoring of a series against stations: alignment, window samples, metrics, intervals, pairs of stations, calibration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.errors import EngineError, SourceError
from rasterloom.session import written
from rasterloom.sources.adapters import E_CUBE_SQL, ORIGIN, c_stack, e_cube, table

from .coherence import part, r6

Z90, NOMINAL = 1.6448536269514722, 0.9  # fixed values
LEVELS = {"68": (0.68, 1.0), "90": (0.90, Z90), "95": (0.95, 1.959963984540054)}
EARTH_KM = 6371.0088
LEAST_CELLS, LEAST_GATED, LEAST_BURSTS, LEAST_EPOCHS = 200, 300, 5, 3


def parse_tenv3(lines: DataFrame) -> DataFrame:
    """Station records from text lines ``(value)`` of 23 columns; a heading and empty lines are skipped.

    Whole and fractional metres are added up.  A line of another width, a value that is no finite
    number, a repeated date or a second station fails the read.
    """
    words = F.split(F.trim("value"), r"\s+")
    rows = lines.where("trim(value) <> '' AND lower(trim(value)) NOT LIKE 'site %'").select(words.alias("w"))
    num = lambda k: F.expr(f"try_cast(w[{k}] AS double)")
    when = F.try_to_timestamp(F.concat(F.substring(F.col("w")[1], 1, 2), F.initcap(F.substring(F.col("w")[1], 3, 3)), F.substring(F.col("w")[1], 6, 2)), F.lit("yyMMMdd")).cast("date")
    bad = (F.size("w") != 23) | when.isNull() | F.exists(F.slice("w", 3, 21), lambda x: x.try_cast("double").isNull() | F.isnan(x.try_cast("double")) | (F.abs(x.try_cast("double")) == float("inf")))
    found = rows.select(
        F.col("w")[0].alias("station"), when.alias("date"), (num(7) + num(8)).alias("east_m"), (num(9) + num(10)).alias("north_m"), (num(11) + num(12)).alias("up_m"),
        num(14).alias("sigma_e_m"), num(15).alias("sigma_n_m"), num(16).alias("sigma_u_m"), num(20).alias("latitude"), num(21).alias("longitude"), num(22).alias("height_m"), bad.alias("bad"))
    told = found.agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("int")).alias("bad"), F.count_distinct("date").alias("dates"), F.count_distinct("station").alias("stations")).first()
    if not told["n"]:
        raise SourceError("the station series holds no rows")
    if told["bad"]:
        raise SourceError(f"{told['bad']} lines of the station series are malformed")
    if told["dates"] != told["n"]:
        raise SourceError("the station series repeats a date")
    if told["stations"] != 1:
        raise SourceError("the station series mixes stations")
    return found.drop("bad").orderBy("date")


def align(records: DataFrame, dates: DataFrame, keys: list[str], values: list[str], max_gap: int) -> DataFrame:
    """``(keys, t, values, kind)`` of every asked ``t``: the record of that day, or a linear mix of the nearest around it.

    Null where a side is missing or they are over ``max_gap`` days apart.  Records and asked days are sorted
    together once; last and next records come from windows, not from a range join.
    """
    r = records.select(*keys, "t", F.struct("t", *values).alias("r"), F.lit(False).alias("asked"))
    a = dates.select(*keys, "t", F.lit(None).cast(r.schema["r"].dataType).alias("r"), F.lit(True).alias("asked"))
    both = r.unionByName(a)
    order = Window.partitionBy(*keys).orderBy("t", F.col("asked").cast("int"))
    after = Window.partitionBy(*keys).orderBy(F.desc("t"), F.col("asked").cast("int"))
    x = both.withColumns({"lo": F.last("r", True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "hi": F.last("r", True).over(after.rowsBetween(Window.unboundedPreceding, 0))}).where("asked")
    exact = F.coalesce(F.col("lo.t") == F.col("t"), F.lit(False))
    span = F.col("hi.t") - F.col("lo.t")
    near = F.coalesce(span <= max_gap, F.lit(False))
    w = (F.col("t") - F.col("lo.t")) / F.nullif(span, F.lit(0))
    out = [F.when(exact, F.col(f"lo.{v}")).when(near, F.col(f"lo.{v}") + w * (F.col(f"hi.{v}") - F.col(f"lo.{v}"))).alias(v) for v in values]
    return x.select(*keys, "t", *out, F.when(exact, "exact").when(near, "interpolated").alias("kind"))


def align_all(records: DataFrame, dates: DataFrame, keys: list[str], values: list[str], max_gap: int) -> DataFrame:
    """Like :func:`align`, refused if a day has no value."""
    found = align(records, dates, keys, values, max_gap)
    if found.where("kind IS NULL").limit(1).count():
        raise EngineError("a date lies outside the series or in too long a gap")
    return found


def project(east: Column, north: Column, up: Column, los: tuple[float, float, float]) -> Column:
    """Component along a unit vector."""
    if not all(map(math.isfinite, los)) or abs(math.hypot(*los) - 1) > 1e-5:
        raise EngineError(f"{los} is not a unit vector")
    return east * los[0] + north * los[1] + up * los[2]


def station_series(aligned: DataFrame, los: tuple[float, float, float], key: str = "station") -> DataFrame:
    """``(key, t, los_mm, sigma_mm)`` against each station's first date: its own deviation is zero there."""
    by = Window.partitionBy(key).orderBy("t")
    d = [F.col(c) - F.first(c).over(by) for c in ("east_m", "north_m", "up_m")]
    var = sum(((F.col(c) * v) * (F.col(c) * v) for c, v in zip(("sigma_e_m", "sigma_n_m", "sigma_u_m"), los)), F.lit(0.0))
    x = aligned.select(key, "t", (project(*d, los) * 1000).alias("los_mm"), var.alias("v"), F.first(var).over(by).alias("v0"), F.row_number().over(by).alias("k"))
    return x.select(key, "t", "los_mm", F.when(F.col("k") == 1, 0.0).otherwise(F.sqrt(F.col("v") + F.col("v0")) * 1000).alias("sigma_mm"))


def spatial_difference(primary: DataFrame, control: DataFrame, value: str) -> DataFrame:
    """Difference of two stations' series on the days that both have."""
    return primary.join(control.withColumnRenamed(value, "_c"), "t").select("t", (F.col(value) - F.col("_c")).alias(value))


def window_sample(raster: DataFrame, stations: DataFrame, size: int, least: float, shape: tuple[int, int]) -> DataFrame:
    """``(station, mean, std, n)`` of the finite pixels in the odd ``size``-square window around each station.

    Null when the window leaves the raster or has too small a finite share.  A station asks for its pixels in an equi-join.
    """
    if size <= 0 or size % 2 == 0 or not 0 < least <= 1:
        raise EngineError("a window is odd and its finite share in (0, 1]")
    h = size // 2
    reach = lambda c: F.explode(F.sequence(F.col(c) - h, F.col(c) + h))
    inside = (F.col("srow") >= h) & (F.col("scol") >= h) & (F.col("srow") + h < shape[0]) & (F.col("scol") + h < shape[1])
    s = stations.select("station", F.col("row").alias("srow"), F.col("col").alias("scol"))
    asked = s.withColumn("ok", inside).withColumn("row", reach("srow")).withColumn("col", reach("scol"))
    v = F.when(~F.isnan("value"), F.col("value"))
    g = asked.join(raster.select("row", "col", "value"), ["row", "col"], "left").groupBy("station").agg(F.min("ok").alias("ok"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n"))
    good = F.col("ok") & (F.col("n") >= math.ceil(size * size * least))
    return g.select("station", F.when(good, F.col("mean")).alias("mean"), F.when(good, F.col("std")).alias("std"), F.when(F.col("ok"), F.col("n")).otherwise(0).alias("n"))


def tls(sxx: Column, syy: Column, sxy: Column) -> Column:
    """Slope of the first principal axis from central sums; null where it stands upright."""
    d = syy - sxx
    return F.when(F.abs(sxy) > 1e-12, (d + F.sqrt(d * d + 4 * sxy * sxy)) / (2 * F.nullif(sxy, F.lit(0.0)))).when(sxx > syy, 0.0)


def fit_metrics(pairs: DataFrame, key: str) -> DataFrame:
    """Errors, correlation, both slopes and endpoint agreement of ``estimate`` against ``truth`` over ``t``; null under three epochs."""
    r = F.col("estimate") - F.col("truth")
    last = F.max_by(F.struct("truth", "estimate"), "t")
    n = F.count("*")
    g = pairs.groupBy(key).agg(
        n.alias("n"), F.avg(F.abs(r)).alias("mae"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg("truth").alias("mx"), F.avg("estimate").alias("my"), F.var_pop("truth").alias("vx"), F.var_pop("estimate").alias("vy"),
        F.covar_pop("truth", "estimate").alias("cxy"), last.alias("end"))
    g = g.where(F.col("n") >= LEAST_EPOCHS)
    ols = F.col("cxy") / F.nullif("vx", F.lit(0.0))
    slope = tls(F.col("vx"), F.col("vy"), F.col("cxy"))
    same = (F.signum("end.truth") == F.signum("end.estimate")) & (F.col("end.truth") != 0)
    return g.select(key, "n", "mae", "rmse", (F.col("cxy") / F.nullif(F.sqrt(F.col("vx") * F.col("vy")), F.lit(0.0))).alias("correlation"), ols.alias("ols_slope"), (F.col("my") - ols * F.col("mx")).alias("ols_intercept"),
                    slope.alias("tls_slope"), (F.col("my") - slope * F.col("mx")).alias("tls_intercept"), (F.col("end.estimate") - F.col("end.truth")).alias("endpoint_residual"), same.alias("sign_agrees"))


def interval_scores(residuals: DataFrame, keys: list[str], levels: dict[str, tuple[float, float]] = LEVELS) -> DataFrame:
    """Coverage, width and interval score of ``residual`` under ``sigma`` per key and level; unusable deviations abstain."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.lit(p).alias("nominal"), F.lit(z).alias("z")) for n, (p, z) in levels.items()]))
    x = residuals.select(*keys, "residual", "sigma", each.alias("l")).select(*keys, "residual", "sigma", "l.*")
    ok = F.col("residual").isNotNull() & ~F.isnan("residual") & F.col("sigma").isNotNull() & ~F.isnan("sigma") & (F.col("sigma") > 0) & (F.col("sigma") < float("inf"))
    half, out = F.col("z") * F.col("sigma"), F.abs("residual") - F.col("z") * F.col("sigma")
    score = 2 * half + F.greatest(out, F.lit(0.0)) * 2 / (1 - F.col("nominal"))
    hit = F.when(ok, (out <= 0).cast("double"))
    g = x.groupBy(*keys, "level", "nominal").agg(F.count(F.when(ok, 1)).alias("evaluated"), F.count("*").alias("n"), F.avg(hit).alias("coverage"), F.avg(F.when(ok, 2 * half)).alias("width"), F.avg(F.when(ok, score)).alias("score"))
    return g.select(*keys, "level", "evaluated", (F.col("n") - F.col("evaluated")).alias("abstained"), "coverage", F.abs(F.col("coverage") - F.col("nominal")).alias("coverage_error"), "width", "score")


def burst_scale(residuals: DataFrame, key: str) -> DataFrame:
    """Factor per burst under which the nominal share of its residuals lies inside: a higher order statistic, null under three epochs."""
    ok = residuals.where("residual IS NOT NULL AND NOT isnan(residual) AND sigma > 0 AND NOT isnan(sigma)")
    ratio = ok.select(key, (F.abs("residual") / (Z90 * F.col("sigma"))).alias("r"))
    rank = Window.partitionBy(key).orderBy("r")
    x = ratio.select(key, "r", (F.row_number().over(rank) - 1).alias("k"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    return x.where((F.col("n") >= LEAST_EPOCHS) & (F.col("k") == F.ceil(F.round(NOMINAL * (F.col("n") - 1), 9)))).select(key, F.col("r").alias("scale"))


def middle_scales(each: DataFrame) -> DataFrame:
    """``(method, n, m0, m1, m2)`` of ``(method, scale)``: the number of scales and those in order about the middle, ``m1`` being the lower median.

    Only scales between two percentiles near the middle are put in order, each value once with its number of rows.
    """
    near = each.groupBy("method").agg(F.count("*").alias("n"), F.percentile_approx("scale", [0.49, 0.51], 10000).alias("q"))
    wide = F.col("n") >= 1000  # below that all of them
    x = each.join(F.broadcast(near), "method").withColumn("side", F.when(wide & (F.col("scale") < F.col("q")[0]), -1).when(wide & (F.col("scale") > F.col("q")[1]), 1).otherwise(0))
    below = x.groupBy("method").agg(F.min("n").alias("n"), F.count(F.when(F.col("side") < 0, 1)).alias("below"))
    runs = x.where("side = 0").groupBy("method", "scale").agg(F.count("*").alias("rows")).join(F.broadcast(below), "method")
    runs = runs.withColumn("end", F.col("below") + F.sum("rows").over(Window.partitionBy("method").orderBy("scale")))
    at = lambda p: F.max(F.when((p >= F.col("end") - F.col("rows")) & (p < F.col("end")), F.col("scale")))
    low = F.floor((F.col("n") - 1) / 2)
    return runs.groupBy("method", "n").agg(*[at(low + k - 1).alias(f"m{k}") for k in range(3)])


def cohort_score(residuals: DataFrame) -> DataFrame:
    """Per held-out burst the method and scale that the other bursts choose, and scores without and with them.

    Rows are ``(burst, method, residual, sigma)``.  Fewer than five bursts are not evaluable and give no rows.
    """
    own = interval_scores(residuals, ["burst", "method"], {"90": LEVELS["90"]}).select("burst", "method", "score", "coverage_error")
    bursts = own.select("burst").distinct()
    if bursts.limit(LEAST_BURSTS).count() < LEAST_BURSTS:
        return own.select("burst", "method", F.lit(None).cast("double").alias("scale"), "score", F.lit(None).cast("double").alias("calibrated_score")).limit(0)
    # leave-one-out means come from totals, not from a join of bursts with bursts
    total = own.groupBy("method").agg(F.sum("score").alias("s"), F.count("score").alias("n"))
    train = own.join(F.broadcast(total), "method").select("burst", "method", ((F.col("s") - F.col("score")) / (F.col("n") - 1)).alias("m"))
    base = train.groupBy("burst").agg(F.min_by("method", F.struct("m", "method")).alias("method"))
    each = written(burst_scale(residuals.withColumn("key", F.struct("method", "burst")), "key").select("key.method", "key.burst", "scale"), "burst-scales")
    held = base.join(F.broadcast(middle_scales(each)), "method").join(each.withColumnRenamed("scale", "own"), ["burst", "method"], "left")
    without = lambda p: F.when(F.col("own") > F.col(f"m{p}"), F.col(f"m{p}")).otherwise(F.col(f"m{p + 1}"))
    odd = F.col("n") % 2 == 1
    rest = F.when(odd, (without(0) + without(1)) / 2).otherwise(without(1))
    median = F.when(F.col("own").isNotNull(), rest).otherwise((F.col("m1") + F.when(odd, F.col("m1")).otherwise(F.col("m2"))) / 2)
    chosen = held.select("burst", "method", median.alias("scale"))
    scaled = residuals.join(chosen, ["burst", "method"]).withColumn("sigma", F.col("sigma") * F.col("scale"))
    after = interval_scores(scaled, ["burst", "method"], {"90": LEVELS["90"]}).select("burst", "method", F.col("score").alias("calibrated_score"))
    return chosen.join(own.select("burst", "method", "score"), ["burst", "method"]).join(after, ["burst", "method"])


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b))


def station_pairs(stations: DataFrame, least_km: float, most_km: float) -> DataFrame:
    """``(a, b, km)`` of stations ``(id, lat, lon)`` that far apart: their places meet in cells of at least ``most_km``, never all with all.

    Cells are bands of latitude and parts of a band, as wide as needed where they are narrowest; neighbours are
    asked for by replicating one side, across the date line too.  Stations of one place share its distances; they
    join the pairs of places last, by shuffles: the pairs are many times the stations, and no side is broadcast.
    """
    step = math.degrees(most_km / EARTH_KM)
    band = lambda lat: F.floor((lat + 90) / step).cast("int")
    edge = F.least(F.greatest(F.abs(F.col("y") * step - 90), F.abs((F.col("y") + 1) * step - 90)) + step, F.lit(89.9))
    parts = F.greatest(F.floor(360 * F.cos(F.radians(edge)) / (step * 1.05)), F.lit(1)).cast("int")
    cell = F.least(F.floor((F.col("lon") + 180) / 360 * F.col("p")), F.col("p") - 1).cast("int")
    places = stations.select("lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL").distinct()
    s = places.select("lat", "lon", band(F.col("lat")).alias("y")).withColumn("p", parts).withColumn("x", cell)
    asked = places.select(F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.col("lon"), F.explode(F.sequence(band(F.col("lat")) - 1, band(F.col("lat")) + 1)).alias("y")).withColumn("p", parts).withColumn("x0", cell)
    near = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(F.col("x0") + d, F.col("p"))))
    asked = asked.select("lat1", "lon1", "y", F.explode(near).alias("x"))
    j = asked.join(s.hint("merge"), ["y", "x"]).where("lat1 < lat OR lat1 = lat AND lon1 <= lon")
    j = j.select("lat1", "lon1", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat"), F.col("lon")).alias("km")).where(F.col("km").between(least_km, most_km))
    one, two = (stations.select(F.col("id").alias(f"id{k}"), F.col("lat").alias(f"lat{k}"), F.col("lon").alias(f"lon{k}")) for k in (1, 2))
    j = j.join(one.hint("merge"), ["lat1", "lon1"]).join(two.hint("merge"), ["lat2", "lon2"])
    j = j.where("id1 < id2 OR id1 > id2 AND (lat1 <> lat2 OR lon1 <> lon2)")  # one place meets itself from both sides
    return j.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"), "km")


def compare_field(cells: DataFrame) -> DataFrame:
    """Residual of two demeaned fields ``(a, b)`` over common finite cells, with the sign on which they agree."""
    x = cells.where("a IS NOT NULL AND b IS NOT NULL AND NOT isnan(a) AND NOT isnan(b)").withColumn("_one", F.lit(1))
    m = x.groupBy("_one").agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.corr("a", "b").alias("corr"))
    j = x.join(F.broadcast(m), "_one")  # one row
    sign = F.when(F.col("corr") >= 0, 1.0).otherwise(-1.0)
    r = F.col("b") - F.col("mb") - sign * (F.col("a") - F.col("ma"))
    return j.agg(F.count("*").alias("n"), F.first("corr").alias("corr"), F.first(sign).alias("sign"), F.sqrt(F.avg(r * r)).alias("rms"), F.max(F.abs(r)).alias("largest"), (F.max("a") - F.min("a")).alias("span"))


def affine_fit(cells: DataFrame) -> dict[str, float] | None:
    """``y = scale a + bx X + by Y + c`` over common finite cells of ``(a, y, x_m, y_m)``, and the correlation without both planes.

    Sums of products are one aggregation; the 4 x 4 system is solved on the driver.  None under 200 cells.
    """
    import numpy as np

    x = cells.where("a IS NOT NULL AND y IS NOT NULL AND NOT isnan(a) AND NOT isnan(y)")
    names = ["a", "x_m", "y_m", "one", "y"]
    x = x.withColumn("one", F.lit(1.0))
    row = x.agg(F.count("*").alias("n"), *[F.sum(F.col(p) * F.col(q)).alias(f"{p}.{q}") for i, p in enumerate(names) for q in names[i:]]).first()
    if row["n"] < LEAST_CELLS:
        return None
    m = np.array([[row[f"{p}.{q}"] if names.index(p) <= names.index(q) else row[f"{q}.{p}"] for q in names] for p in names])
    scale, bx, by, c = np.linalg.solve(m[:4, :4], m[:4, 4])
    # what the plane leaves of both fields
    plane, both = [1, 2, 3], [0, 4]
    left = m[np.ix_(both, both)] - m[np.ix_(both, plane)] @ np.linalg.solve(m[np.ix_(plane, plane)], m[np.ix_(plane, both)])
    sse = m[4, 4] - np.array([scale, bx, by, c]) @ m[:4, 4]
    return {"n": row["n"], "scale": scale, "bx": bx, "by": by, "c": c, "sign": 1.0 if scale >= 0 else -1.0, "pattern_corr": left[0, 1] / math.sqrt(left[0, 0] * left[1, 1]), "rms": math.sqrt(max(sse, 0) / row["n"])}


def scale_by_gate(cells: DataFrame, gates: tuple[float, ...] = (0.0, 0.6, 0.8, 0.9), least: int = LEAST_GATED) -> DataFrame:
    """Agreement of rates ``a`` (reference) and ``b`` over cells of quality above each gate; gates with few cells are left out."""
    each = F.explode(F.array(*map(F.lit, gates)))
    x = cells.where("a IS NOT NULL AND b IS NOT NULL AND NOT isnan(a) AND NOT isnan(b)").select("a", "b", "quality", each.alias("gate")).where("quality > gate")
    g = x.groupBy("gate").agg(F.count("*").alias("n"), F.corr("a", "b").alias("corr"), F.covar_pop("a", "b").alias("cab"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb")).where(F.col("n") >= least)
    return g.select("gate", "n", "corr", (F.col("cab") / F.nullif("vb", F.lit(0.0))).alias("ols_slope"), tls(F.col("vb"), F.col("va"), F.col("cab")).alias("tls_slope"), F.sqrt("va").alias("std_a"), F.sqrt("vb").alias("std_b"))


def zero_pixel(series: DataFrame, quality: DataFrame) -> DataFrame:
    """``(row, col, candidates)``: of pixels that are zero at every epoch the one of most quality, the first of equals."""
    zero = series.groupBy("row", "col").agg(F.max(F.when(F.col("value").isNull() | F.isnan("value"), F.lit(1.0)).otherwise(F.abs("value"))).alias("m")).where("m <= 1e-12")
    q = F.when(F.col("quality").isNull() | F.isnan("quality"), F.lit(float("-inf"))).otherwise(F.col("quality"))
    j = zero.join(quality, ["row", "col"], "left").select("row", "col", q.alias("q"))
    return j.agg(F.max_by(F.struct("row", "col"), F.struct("q", -F.col("row"), -F.col("col"))).alias("p"), F.count("*").alias("candidates")).where("candidates > 0").select("p.row", "p.col", "candidates")


def _two_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of two event types of a user on shared days: one stands for the station, one for the estimate."""
    e = e_cube(spark, sf_dir, "event_type")
    a, b = (e.where(F.col("event_type") == t).select("user_id", "t", F.col("y").alias(n), F.col("w").alias(f"w_{n}")) for t, n in (("click", "truth"), ("view", "estimate")))
    return a.join(b, ["user_id", "t"])


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _two_types(spark, sf_dir).withColumn("residual", F.col("estimate") - F.col("truth"))
    return x.select(F.col("user_id").alias("burst"), F.explode(F.array(F.struct(F.lit("crlb_only").alias("method"), (F.col("w_truth") * 20.0).alias("sigma")), F.struct(F.lit("posterior_only").alias("method"), (F.col("w_estimate") * 40.0).alias("sigma")))).alias("m"), "residual").select("burst", "m.method", "residual", "m.sigma")


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = e_cube(spark, sf_dir)
    asked = table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("t"))
    found = align(cube.select("user_id", "t", "y"), asked, ["user_id"], ["y"], 2)
    return found.select("user_id", "t", r6(F.col("y"), "y"), F.coalesce("kind", F.lit("none")).alias("kind"))


def _stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(n.alias("id"), (30 + F.pmod(n * 37, F.lit(101)) * 0.05).alias("lat"), (-120 + F.pmod(n * 53, F.lit(103)) * 0.06).alias("lon"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .stack import grid_shape

    s = c_stack(spark, sf_dir)
    shape = grid_shape(s)
    stations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station"), F.pmod(F.col("s_suppkey") * 3, F.lit(shape[0])).alias("row"), F.pmod(F.col("s_suppkey") * 5, F.lit(shape[1])).alias("col"))
    raster = s.select("row", "col", F.when(F.col("row") % 4 != 0, part(0, 0)).alias("value"))
    found = window_sample(raster, stations, 3, 0.6, shape)
    return found.select("station", r6(F.col("mean"), "mean"), r6(F.col("std"), "std"), "n")


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c_stack(spark, sf_dir).select("row", "col", part(0, 0).alias("a"), F.when(F.col("col") != 3, 0.5 * part(0, 0) + 0.1 * part(1, 0)).alias("b"), F.abs(part(2, 0) * 4).alias("quality"))


def _gnss(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = e_cube(spark, sf_dir).select(F.col("user_id").alias("station"), "t", F.col("y").alias("east_m"), (F.col("y") / 2).alias("north_m"), (F.col("w") * 1.0).alias("up_m"), (F.col("w") / 10).alias("sigma_e_m"), (F.col("w") / 20).alias("sigma_n_m"), F.lit(0.3).alias("sigma_u_m"))
    return station_series(e, LOS).select("station", "t", r6(F.col("los_mm"), "los_mm"), r6(F.col("sigma_mm"), "sigma_mm"))


LOS = (0.6, 0.0, 0.8)
_SCORES = ("coverage", "coverage_error", "width", "score")
_FIT = ("mae", "rmse", "correlation", "ols_slope", "ols_intercept", "tls_slope", "tls_intercept", "endpoint_residual")
QUERIES = {
    "gnss_align": _aligned,
    "gnss_los": _gnss,
    "station_window": _windows,
    "fit_metrics": lambda spark, sf_dir: fit_metrics(_two_types(spark, sf_dir), "user_id").select("user_id", "n", *[r6(F.col(c), c) for c in _FIT], "sign_agrees"),
    "interval_score": lambda spark, sf_dir: interval_scores(_residuals(spark, sf_dir), ["burst", "method"]).select("burst", "method", "level", "evaluated", "abstained", *[(F.round(c, 8) + 0.0).alias(c) for c in _SCORES]),  # no halves to round there
    "burst_scale": lambda spark, sf_dir: burst_scale(_residuals(spark, sf_dir).where("method = 'crlb_only'"), "burst").select("burst", r6(F.col("scale"), "scale")),
    "cohort_score": lambda spark, sf_dir: cohort_score(_residuals(spark, sf_dir)).select("burst", "method", *[r6(F.col(c), c) for c in ("scale", "score", "calibrated_score")]),
    "haversine_pairs": lambda spark, sf_dir: station_pairs(_stations(spark, sf_dir), 1.0, 30.0).select("a", "b", r6(F.col("km"), "km")),
    "compare_field": lambda spark, sf_dir: compare_field(_fields(spark, sf_dir)).select("n", *[r6(F.col(c), c) for c in ("corr", "sign", "rms", "largest", "span")]),
    "velocity_scale": lambda spark, sf_dir: scale_by_gate(_fields(spark, sf_dir), least=30).select("gate", "n", *[r6(F.col(c), c) for c in ("corr", "ols_slope", "tls_slope", "std_a", "std_b")]),
    "zero_pixel": lambda spark, sf_dir: (lambda f: zero_pixel(f.select("row", "col", F.when(F.col("col") == 4, 0.0).otherwise(F.col("a")).alias("value")), f.select("row", "col", "quality")))(_fields(spark, sf_dir)),
}

_TWO = f"""e AS (SELECT user_id, CAST(date_diff('day', DATE '{ORIGIN}', CAST(ts AS DATE)) AS INT) AS t, event_type, avg(value) AS y, count(value) AS w FROM events GROUP BY ALL),
p AS (SELECT a.user_id, a.t, a.y AS truth, b.y AS estimate, a.w AS wt, b.w AS we FROM e a JOIN e b ON a.user_id = b.user_id AND a.t = b.t AND a.event_type = 'click' AND b.event_type = 'view')"""
_RES = f"""{_TWO}, r AS (SELECT user_id AS burst, 'crlb_only' AS method, estimate - truth AS residual, wt * 20.0 AS sigma FROM p UNION ALL SELECT user_id, 'posterior_only', estimate - truth, we * 40.0 FROM p)"""
_TLS = lambda x, y, c: f"CASE WHEN abs({c}) > 1e-12 THEN ({y} - {x} + sqrt(pow({y} - {x}, 2) + 4*{c}*{c})) / (2*{c}) WHEN {x} > {y} THEN 0.0 END"
_R = lambda *names: ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)
_SCORED = lambda source, levels: f"SELECT burst, method, level, count(*) AS evaluated, avg(CASE WHEN abs(residual) <= z*sigma THEN 1.0 ELSE 0.0 END) AS coverage, avg(2*z*sigma) AS width, avg(2*z*sigma + greatest(abs(residual) - z*sigma, 0)*2/(1-nominal)) AS score, min(nominal) AS nominal FROM {source}, (VALUES {levels}) l(level, nominal, z) GROUP BY burst, method, level"
_ALL = ", ".join(f"('{n}', {p}, {z})" for n, (p, z) in LEVELS.items())
_FIELDS = """c AS (SELECT vec_id // 25 AS "row", vec_id % 25 AS col, CAST(embedding AS DOUBLE[]) AS z FROM embeddings),
f AS (SELECT "row", col, z[1] AS a, CASE WHEN col <> 3 THEN 0.5*z[1] + 0.1*z[3] END AS b, abs(z[5]*4) AS quality FROM c)"""
ORACLES = {
    "gnss_align": f"""WITH {E_CUBE_SQL}, q AS (SELECT user_id, CAST(t AS INT) AS t FROM (SELECT DISTINCT user_id FROM e), range(30) x(t)),
b AS (SELECT q.user_id, q.t, max(e.t) AS lo FROM q LEFT JOIN e ON e.user_id = q.user_id AND e.t <= q.t GROUP BY ALL), h AS (SELECT b.*, x.hi FROM b JOIN (SELECT q.user_id, q.t, min(e.t) AS hi FROM q LEFT JOIN e ON e.user_id = q.user_id AND e.t >= q.t GROUP BY ALL) x USING (user_id, t)),
v AS (SELECT h.*, a.y AS ya, c.y AS yc FROM h LEFT JOIN e a ON a.user_id = h.user_id AND a.t = lo LEFT JOIN e c ON c.user_id = h.user_id AND c.t = hi)
SELECT user_id, t, CASE WHEN lo = t THEN round(ya, 6) + 0.0 WHEN hi - lo <= 2 THEN round(ya + (t - lo) / (hi - lo) * (yc - ya), 6) + 0.0 END AS y,
 CASE WHEN lo = t THEN 'exact' WHEN hi - lo <= 2 THEN 'interpolated' ELSE 'none' END AS kind FROM v""",
    "gnss_los": f"""WITH {E_CUBE_SQL}, x AS (SELECT user_id AS station, t, y, w, first_value(y) OVER o AS y0, first_value(w) OVER o AS w0, row_number() OVER o AS k FROM e WINDOW o AS (PARTITION BY user_id ORDER BY t))
SELECT station, t, round(((y - y0)*0.6 + (w - w0)*0.8)*1000, 6) + 0.0 AS los_mm, CASE WHEN k = 1 THEN 0.0 ELSE round(sqrt(pow(w/10.0*0.6, 2) + pow(0.3*0.8, 2) + pow(w0/10.0*0.6, 2) + pow(0.3*0.8, 2))*1000, 6) + 0.0 END AS sigma_mm FROM x""",
    "station_window": """WITH c AS (SELECT vec_id // 25 AS r, vec_id % 25 AS c, CAST(embedding AS DOUBLE[])[1] AS v FROM embeddings), g AS (SELECT max(r) + 1 AS nr, max(c) + 1 AS nc FROM c),
s AS (SELECT s_suppkey AS station, (s_suppkey*3) % nr AS r, (s_suppkey*5) % nc AS c, nr, nc FROM supplier, g), x AS (SELECT *, r >= 1 AND c >= 1 AND r + 1 < nr AND c + 1 < nc AS ok FROM s),
j AS (SELECT station, ok, CASE WHEN c.r % 4 <> 0 THEN v END AS v FROM x JOIN c ON c.r BETWEEN x.r - 1 AND x.r + 1 AND c.c BETWEEN x.c - 1 AND x.c + 1), a AS (SELECT station, ok, count(v) AS n, avg(v) AS m, stddev_pop(v) AS d FROM j GROUP BY ALL)
SELECT station, CASE WHEN ok AND n >= 6 THEN round(m, 6) + 0.0 END AS mean, CASE WHEN ok AND n >= 6 THEN round(d, 6) + 0.0 END AS std, CASE WHEN ok THEN n ELSE 0 END AS n FROM a""",
    "fit_metrics": f"""WITH {_TWO}, g AS (SELECT user_id, count(*) AS n, avg(abs(estimate-truth)) AS mae, sqrt(avg(pow(estimate-truth, 2))) AS rmse, avg(truth) AS mx, avg(estimate) AS my, var_pop(truth) AS vx, var_pop(estimate) AS vy,
 avg(truth*estimate) - avg(truth)*avg(estimate) AS cxy, arg_max(truth, t) AS te, arg_max(estimate, t) AS ee FROM p GROUP BY 1 HAVING count(*) >= 3),
m AS (SELECT *, cxy/sqrt(vx*vy) AS correlation, cxy/vx AS ols_slope, my - cxy/vx*mx AS ols_intercept, {_TLS("vx", "vy", "cxy")} AS tls_slope, ee - te AS endpoint_residual FROM g), k AS (SELECT *, my - tls_slope*mx AS tls_intercept FROM m)
SELECT user_id, n, {_R(*_FIT)}, sign(te) = sign(ee) AND te <> 0 AS sign_agrees FROM k""",
    "interval_score": f"""WITH {_RES}, s AS ({_SCORED("r", _ALL)}) SELECT burst, method, level, evaluated, CAST(0 AS BIGINT) AS abstained, round(coverage, 8) + 0.0 AS coverage, round(abs(coverage - nominal), 8) + 0.0 AS coverage_error, round(width, 8) + 0.0 AS width, round(score, 8) + 0.0 AS score FROM s""",
    "burst_scale": f"""WITH {_RES}, q AS (SELECT burst, abs(residual) / ({Z90} * sigma) AS v, row_number() OVER (PARTITION BY burst ORDER BY abs(residual) / ({Z90} * sigma)) - 1 AS k, count(*) OVER (PARTITION BY burst) AS n FROM r WHERE method = 'crlb_only')
SELECT burst, round(v, 6) + 0.0 AS scale FROM q WHERE n >= 3 AND k = ceil(round({NOMINAL} * (n - 1), 9))""",
    "haversine_pairs": f"""WITH s AS (SELECT c_custkey AS id, 30 + ((c_custkey * 37) % 101) * 0.05 AS lat, -120 + ((c_custkey * 53) % 103) * 0.06 AS lon FROM customer),
d AS (SELECT a.id AS a, b.id AS b, 2*{EARTH_KM}*asin(sqrt(pow(sin(radians(b.lat-a.lat)/2), 2) + cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2), 2))) AS km FROM s a JOIN s b ON a.id < b.id)
SELECT a, b, round(km, 6) + 0.0 AS km FROM d WHERE km BETWEEN 1 AND 30""",
    "compare_field": f"""WITH {_FIELDS}, x AS (SELECT a, b FROM f WHERE b IS NOT NULL), m AS (SELECT avg(a) AS ma, avg(b) AS mb, corr(a, b) AS corr FROM x), r AS (SELECT a, corr, CASE WHEN corr >= 0 THEN 1.0 ELSE -1.0 END AS sign, b - mb - (CASE WHEN corr >= 0 THEN 1.0 ELSE -1.0 END)*(a - ma) AS r FROM x, m)
SELECT count(*) AS n, round(min(corr), 6) + 0.0 AS corr, CAST(min(sign) AS DOUBLE) AS sign, round(sqrt(avg(r*r)), 6) + 0.0 AS rms, round(max(abs(r)), 6) + 0.0 AS largest, round(max(a) - min(a), 6) + 0.0 AS span FROM r""",
    "velocity_scale": f"""WITH {_FIELDS}, x AS (SELECT CAST(gate AS DOUBLE) AS gate, a, b FROM f, (VALUES (0.0), (0.6), (0.8), (0.9)) g(gate) WHERE b IS NOT NULL AND quality > gate),
g AS (SELECT gate, count(*) AS n, corr(a, b) AS corr, covar_pop(a, b) AS cab, var_pop(a) AS va, var_pop(b) AS vb FROM x GROUP BY 1 HAVING count(*) >= 30), h AS (SELECT gate, n, corr, cab/vb AS ols_slope, {_TLS("vb", "va", "cab")} AS tls_slope, sqrt(va) AS std_a, sqrt(vb) AS std_b FROM g)
SELECT gate, n, {_R("corr", "ols_slope", "tls_slope", "std_a", "std_b")} FROM h""",
    "zero_pixel": f"""WITH {_FIELDS}, z AS (SELECT "row", col, quality FROM f WHERE col = 4 OR a = 0) SELECT "row", col, (SELECT count(*) FROM z) AS candidates FROM z ORDER BY quality DESC, "row", col LIMIT 1""",
}

"""Where a run's geometry comes from: agreement of granules, orbit interpolation, headings, spacings and one JSON document.

A granule is a row ``(name, direction, burst, start, stop, epoch, range_m, interval_s, lon, lat, orbit)``; ``orbit``
is an array of ``(t, px, py, pz, vx, vy, vz)`` with seconds after ``epoch``.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.kernels.delays import ELLIPSOID_A
from rasterloom.sources.adapters import table

from .coherence import once, r6

ELLIPSOID_B = 6356752.314245179
HEADING_GATE, RANGE_GATE, AZIMUTH_GATE, TIME_GATE, INCIDENCE_GATE = 1.0, 1e-6, 0.1, 60.0, 3.0  # fixed values
ORBIT = "array<struct<t:double,px:double,py:double,pz:double,vx:double,vy:double,vz:double>>"
GRANULE = f"name string, direction string, burst string, start timestamp_ntz, stop timestamp_ntz, epoch timestamp_ntz, range_m double, interval_s double, lon double, lat double, orbit {ORBIT}"


def track(burst: Column) -> Column:
    """First part of a burst's name, without case and with one separator."""
    return F.element_at(F.split(F.replace(F.lower(F.trim(burst)), F.lit("-"), F.lit("_")), "_"), 1)


def directions(granules: DataFrame, *keys: str) -> DataFrame:
    """``(keys, direction)``: the pass that all granules name, null if they differ or name another word."""
    one = F.collect_set(F.lower("direction"))  # a handful of words
    found = granules.groupBy(*keys).agg(one.alias("d"), F.count("*").alias("n"), F.count("direction").alias("m"))
    good = (F.size("d") == 1) & F.array_contains(F.array(F.lit("ascending"), F.lit("descending")), F.col("d")[0]) & (F.col("n") == F.col("m"))
    return found.select(*keys, F.when(good, F.col("d")[0]).alias("direction"))


def mismatched(statics: DataFrame, granules: DataFrame) -> DataFrame:
    """Static granules whose pass or track none of the stack's granules has."""
    s = statics.select("*", F.lower("direction").alias("_d"), track(F.col("burst")).alias("_t"))
    d, t = granules.select(F.lower("direction").alias("_d")).distinct(), granules.select(track(F.col("burst")).alias("_t")).distinct()
    return s.join(d, "_d", "left_anti").unionByName(s.join(t, "_t", "left_anti")).drop("_d", "_t").distinct()


def state_at(at: Column, orbit: str = "orbit") -> Column:
    """Orbit state at a time, linear between the vectors around it; null outside their span or with fewer than two.

    The place in the orbit and its two vectors are found once a row, not once a component.
    """
    inside = (F.size(orbit) >= 2) & (at >= F.col(orbit)[0]["t"]) & (at <= F.element_at(orbit, -1)["t"])
    ahead = F.size(F.filter(orbit, lambda v: v["t"] < at))
    around = once(F.least(F.greatest(ahead, F.lit(1)), F.size(orbit) - 1), lambda hi: F.struct(F.col(orbit)[hi - 1].alias("a"), F.col(orbit)[hi].alias("b"), at.alias("at")))

    def mixed(x: Column) -> Column:
        a, b = x["a"], x["b"]
        w = F.when(b["t"] > a["t"], (x["at"] - a["t"]) / (b["t"] - a["t"])).otherwise(0.0)
        return F.struct(*[(a[c] + w * (b[c] - a[c])).alias(c) for c in ("px", "py", "pz", "vx", "vy", "vz")])

    return F.when(inside, once(around, mixed))


def seconds(x: Column) -> Column:
    return F.unix_micros(x.cast("timestamp")) / 1e6


def granule_geometry(granules: DataFrame) -> DataFrame:
    """``(name, heading, azimuth_m, time_of_day)`` at mid-acquisition; null where the orbit does not reach it."""
    mid = (seconds(F.col("start")) + seconds(F.col("stop"))) / 2
    s = granules.withColumn("_mid", mid).withColumn("_at", F.col("_mid") - seconds(F.col("epoch")))
    s = s.select("*", F.explode(F.array(state_at(F.col("_at")))).alias("_s"))  # one row each: a column would be worked out again at every use
    lon, lat = F.radians("lon"), F.radians("lat")
    v = [F.col(f"_s.v{c}") for c in "xyz"]
    p = [F.col(f"_s.p{c}") for c in "xyz"]
    east, north = v[1] * F.cos(lon) - v[0] * F.sin(lon), v[2] * F.cos(lat) - F.sin(lat) * (v[0] * F.cos(lon) + v[1] * F.sin(lon))
    a, b = ELLIPSOID_A, ELLIPSOID_B
    radius = F.sqrt((F.pow(a * a * F.cos(lat), 2) + F.pow(b * b * F.sin(lat), 2)) / (F.pow(a * F.cos(lat), 2) + F.pow(b * F.sin(lat), 2)))
    norm = lambda x: F.sqrt(x[0] * x[0] + x[1] * x[1] + x[2] * x[2])
    return s.select(*granules.columns, F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0)).alias("heading"), (F.col("interval_s") * norm(v) * radius / norm(p)).alias("azimuth_m"),
                    F.when(F.col("_s").isNotNull(), F.pmod(F.col("_mid"), F.lit(86400.0))).alias("time_of_day"))


def agreed(found: DataFrame, *keys: str) -> DataFrame:
    """Values on which granules agree within the gates, null where they do not or where one has none."""
    rad = F.radians("heading")
    by = Window.partitionBy(*keys)
    mean = F.pmod(F.degrees(F.atan2(F.sum(F.sin(rad)).over(by), F.sum(F.cos(rad)).over(by))), F.lit(360.0))
    x = found.withColumns({"_h": mean, "_a": F.avg("azimuth_m").over(by), "_t": F.avg("time_of_day").over(by)})
    x = x.withColumn("_d", F.abs(F.pmod(F.col("heading") - F.col("_h") + 540, F.lit(360.0)) - 180))
    g = x.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("heading").alias("m"), F.first("_h").alias("h"), F.max("_d").alias("hd"), F.first("_a").alias("a"), F.max(F.abs(F.col("azimuth_m") - F.col("_a"))).alias("ad"),
        F.first("_t").alias("t"), F.max(F.abs(F.col("time_of_day") - F.col("_t"))).alias("td"), F.min("range_m").alias("r0"), F.max("range_m").alias("r1"), F.count(F.when(~F.isnan("range_m"), 1)).alias("rn"))
    whole = F.col("n") == F.col("m")
    return g.select(
        *keys, F.when(whole & (F.col("hd") <= HEADING_GATE), F.col("h")).alias("heading_deg"), F.when(whole & (F.col("ad") <= AZIMUTH_GATE) & (F.col("a") > 0), F.col("a")).alias("azimuth_spacing_m"),
        F.when(whole & (F.col("td") <= TIME_GATE), F.col("t")).alias("time_of_day_s"),
        F.when((F.col("n") == F.col("rn")) & (F.col("r0") > 0) & (F.col("r1") - F.col("r0") <= RANGE_GATE), F.col("r0")).alias("range_spacing_m"))


def assemble(granules: DataFrame, incidence: DataFrame, statics: DataFrame | None = None) -> DataFrame:
    """One row: every value or null, which are sourced or absent, and whether the geometry is complete enough to decompose motion."""
    values = agreed(granule_geometry(granules).withColumn("one", F.lit(1)), "one").join(directions(granules.withColumn("one", F.lit(1)), "one"), "one")
    wrong = F.lit(0) if statics is None else None
    inc = incidence.select(F.lit(1).alias("one"), "mean_deg", "std_deg", "min_deg", "max_deg")
    out = values.join(inc, "one", "left")
    if wrong is None:
        out = out.join(mismatched(statics, granules).agg(F.count("*").alias("wrong")).withColumn("one", F.lit(1)), "one")
        wrong = F.col("wrong")
    for c in ("mean_deg", "std_deg", "min_deg", "max_deg"):
        out = out.withColumn(c, F.when(wrong == 0, F.col(c)))
    complete = F.col("direction").isNotNull() & F.col("heading_deg").isNotNull() & F.col("time_of_day_s").isNotNull() & F.coalesce(F.col("std_deg") <= INCIDENCE_GATE, F.lit(False))
    fields = ["direction", "heading_deg", "azimuth_spacing_m", "time_of_day_s", "range_spacing_m", "mean_deg"]
    state = F.create_map(*[x for f in fields for x in (F.lit(f), F.when(F.col(f).isNotNull(), "sourced").otherwise("absent"))])
    return out.select(*fields, "std_deg", "min_deg", "max_deg", state.alias("fields"), complete.alias("complete"))


def document(found: DataFrame) -> str:
    """The row as readable JSON."""
    return json.dumps(json.loads(found.select(F.to_json(F.struct("*"))).first()[0]), indent=2, sort_keys=True)


def write(found: DataFrame, path: str) -> None:
    """One JSON file in a folder, over any earlier one."""
    found.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def _granules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A granule per customer of a few nations, with a circular orbit sampled every 10 s."""
    n = F.col("c_custkey")
    angle = lambda t: (t + F.pmod(n, F.lit(7)) * 0.01) * 0.001
    radius, speed = 7.07e6, 7500.0
    orbit = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.struct(
        (i * 10.0).alias("t"), (radius * F.cos(angle(i * 10.0))).alias("px"), F.lit(1000.0).alias("py"), (radius * F.sin(angle(i * 10.0))).alias("pz"),
        (-speed * F.sin(angle(i * 10.0))).alias("vx"), F.lit(-900.0).alias("vy"), (speed * F.cos(angle(i * 10.0))).alias("vz")))
    base = F.lit("2024-01-15 06:30:00").cast("timestamp_ntz")
    shift = lambda s: F.timestamp_add("MICROSECOND", (s * 1e6).cast("long"), base)
    c = table(spark, sf_dir, "customer")
    return c.select(
        "c_nationkey", F.concat(F.lit("g"), n.cast("string")).alias("name"), F.when(F.pmod(n, F.lit(97)) == 0, "Descending").when(F.pmod(n, F.lit(2)) == 0, "ASCENDING").otherwise("ascending").alias("direction"),
        F.concat(F.lit("T"), F.col("c_nationkey").cast("string"), F.lit("-"), n.cast("string"), F.lit("-IW2")).alias("burst"), shift(F.pmod(n, F.lit(5)) * 1.0 + 20).alias("start"), shift(F.pmod(n, F.lit(5)) * 1.0 + 23).alias("stop"), base.alias("epoch"),
        F.when(F.pmod(n, F.lit(11)) == 0, 2.4).otherwise(2.329562).alias("range_m"), F.lit(0.00205).alias("interval_s"), (F.pmod(n, F.lit(3)) * 0.1).alias("lon"), (1.5 + F.pmod(n, F.lit(4)) * 0.1).alias("lat"), orbit.alias("orbit"))


def _track_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _granules(spark, sf_dir)
    return mismatched(g.where("c_nationkey >= 20"), g.where("c_nationkey < 22")).select("name", "burst")


QUERIES = {
    "orbit_unanimity": lambda spark, sf_dir: directions(_granules(spark, sf_dir), "c_nationkey"),
    "track_mismatch": _track_mismatch,
    "interp_state": lambda spark, sf_dir: granule_geometry(_granules(spark, sf_dir)).select("name", r6(F.col("heading"), "heading"), r6(F.col("azimuth_m"), "azimuth_m"), r6(F.col("time_of_day"), "time_of_day")),
    "granule_agreement": lambda spark, sf_dir: agreed(granule_geometry(_granules(spark, sf_dir)), "c_nationkey").select("c_nationkey", *[r6(F.col(c), c) for c in ("heading_deg", "azimuth_spacing_m", "time_of_day_s", "range_spacing_m")]),
}

_G = """g AS (SELECT *, 'g' || c_custkey AS name, CASE WHEN c_custkey % 97 = 0 THEN 'descending' ELSE 'ascending' END AS dir, 'T' || c_nationkey || '-' || c_custkey || '-IW2' AS burst,
 c_custkey % 5 + 21.5 AS mid, (c_custkey % 7) * 0.01 AS ph, CASE WHEN c_custkey % 11 = 0 THEN 2.4 ELSE 2.329562 END AS range_m, radians((c_custkey % 3) * 0.1) AS lo, radians(1.5 + (c_custkey % 4) * 0.1) AS la FROM customer),
w AS (SELECT *, 20.0 AS t0, (mid - 20) / 10 AS f FROM g),
s AS (SELECT *, 7.07e6*cos((20+ph)*0.001)*(1-f) + 7.07e6*cos((30+ph)*0.001)*f AS px, 1000.0 AS py, 7.07e6*sin((20+ph)*0.001)*(1-f) + 7.07e6*sin((30+ph)*0.001)*f AS pz,
 -7500*sin((20+ph)*0.001)*(1-f) - 7500*sin((30+ph)*0.001)*f AS vx, -900.0 AS vy, 7500*cos((20+ph)*0.001)*(1-f) + 7500*cos((30+ph)*0.001)*f AS vz FROM w),
h AS (SELECT *, degrees(atan2(vy*cos(lo) - vx*sin(lo), vz*cos(la) - sin(la)*(vx*cos(lo) + vy*sin(lo)))) AS hd0, """ + f"sqrt((pow({ELLIPSOID_A**2}*cos(la), 2) + pow({ELLIPSOID_B**2!r}*sin(la), 2)) / (pow({ELLIPSOID_A}*cos(la), 2) + pow({ELLIPSOID_B}*sin(la), 2))) AS re FROM s)," + """
q AS (SELECT *, hd0 - 360*floor(hd0/360) AS heading, 0.00205*sqrt(vx*vx+vy*vy+vz*vz)*re/sqrt(px*px+py*py+pz*pz) AS azimuth_m, 23400.0 + mid AS time_of_day FROM h)"""
ORACLES = {
    "orbit_unanimity": f"WITH {_G} SELECT c_nationkey, CASE WHEN count(DISTINCT dir) = 1 THEN min(dir) END AS direction FROM g GROUP BY 1",
    "track_mismatch": f"WITH {_G} SELECT name, burst FROM g WHERE c_nationkey >= 20 AND (c_nationkey NOT IN (SELECT c_nationkey FROM g WHERE c_nationkey < 22) OR dir NOT IN (SELECT dir FROM g WHERE c_nationkey < 22))",
    "interp_state": f"WITH {_G} SELECT name, round(heading, 6) + 0.0 AS heading, round(azimuth_m, 6) + 0.0 AS azimuth_m, round(time_of_day, 6) + 0.0 AS time_of_day FROM q",
    "granule_agreement": f"""WITH {_G}, m AS (SELECT c_nationkey, degrees(atan2(sum(sin(radians(heading))), sum(cos(radians(heading))))) AS h0, avg(azimuth_m) AS a, avg(time_of_day) AS t FROM q GROUP BY 1),
n AS (SELECT c_nationkey, h0 - 360*floor(h0/360) AS h, a, t FROM m),
d AS (SELECT q.c_nationkey, n.h, n.a, n.t, abs((heading - h + 540) - 360*floor((heading - h + 540)/360) - 180) AS hd, abs(azimuth_m - a) AS ad, abs(time_of_day - t) AS td, range_m FROM q JOIN n USING (c_nationkey))
SELECT c_nationkey, CASE WHEN max(hd) <= 1 THEN round(min(h), 6) + 0.0 END AS heading_deg, CASE WHEN max(ad) <= 0.1 THEN round(min(a), 6) + 0.0 END AS azimuth_spacing_m,
 CASE WHEN max(td) <= 60 THEN round(min(t), 6) + 0.0 END AS time_of_day_s, CASE WHEN max(range_m) - min(range_m) <= 1e-6 THEN round(min(range_m), 6) + 0.0 END AS range_spacing_m FROM d GROUP BY 1""",
}

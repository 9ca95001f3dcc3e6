"""Unwrapping of an interferogram network: tiles are solved apart, whole cycles per region make them agree.

A task solves one tile of one interferogram.  Neighbouring tiles meet in an equi-join of the pixels
along region borders; the graph of regions, a few rows a tile, is solved per interferogram.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.kernels import unwrap as u
from rasterloom.kernels.graphs import Forest, components, spanning_offsets
from rasterloom.session import written
from rasterloom.sources.adapters import C_STACK_SQL, EPOCHS, c_stack

from .coherence import part, r6, wrap
from .linking import tile_window, to_tiles
from .stack import coherence, grid_shape

TILE = 64
TURN = 2 * math.pi


def form_network(phases: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """``(ifg, i, j, row, col, psi)``: phase of the earlier epoch against the later, from ``(row, col, theta)``."""
    each = F.array(*[F.struct(F.lit(n).alias("ifg"), F.lit(i).alias("i"), F.lit(j).alias("j")) for n, (i, j) in enumerate(pairs)])
    x = phases.select("row", "col", "theta", F.explode(each).alias("p"))
    return x.select("p.ifg", "p.i", "p.j", "row", "col", wrap(F.col("theta")[F.col("p.i")] - F.col("theta")[F.col("p.j")]).alias("psi"))


def edge_costs(quality: DataFrame) -> DataFrame:
    """``(row, col, right_cost, down_cost)`` from ``(row, col, corr)``: integer precision of the edges, 0 where there is none."""

    def cost(other: Column) -> Column:
        g = F.least(F.greatest((F.col("corr") + other) / 2, F.lit(0.0)), F.lit(u.COHERENCE_CEILING))
        return F.when(other.isNull(), 0).otherwise(F.round(F.greatest(g * g / (1 - g * g), F.lit(u.COST_FLOOR)) * u.COST_SCALE)).cast("bigint")

    beside, below = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    return quality.select("row", "col", cost(F.lead("corr").over(beside)).alias("right_cost"), cost(F.lead("corr").over(below)).alias("down_cost"))


def solve_tiles(ifgs: DataFrame, shape: tuple[int, int], tile: int = TILE, overlap: int = u.OVERLAP, min_corr: float = u.MIN_CORR, regrow: int = u.REGROW) -> DataFrame:
    """Each tile's own unwrapped core, with region, the region whose cycles apply, and whether the pixel may touch another region.

    A region is named by its first pixel's number in the grid, plus one; 0 is none.
    """
    halo = (overlap, overlap)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ifg, at = key[0].as_py(), (key[1].as_py(), key[2].as_py())
        r0, r1, c0, c1 = tile_window(tile, at, halo, shape)
        rows, cols = table.column("row").to_numpy() - r0, table.column("col").to_numpy() - c0
        psi, corr, here = np.zeros((r1 - r0, c1 - c0)), np.zeros((r1 - r0, c1 - c0)), np.zeros((r1 - r0, c1 - c0), bool)
        psi[rows, cols] = np.nan_to_num(table.column("psi").to_numpy(zero_copy_only=False).astype(float))
        corr[rows, cols] = np.nan_to_num(table.column("corr").to_numpy(zero_copy_only=False).astype(float))
        here[rows, cols] = True
        value = u.unwrap_grid(psi, corr) if min(psi.shape) >= 2 else psi
        a, b = at[0] * tile - r0, at[1] * tile - c0
        core = (slice(a, min(a + tile, r1 - r0)), slice(b, min(b + tile, c1 - c0)))
        psi, corr, value, here = psi[core], corr[core], value[core], here[core]
        label, size = components(here & (corr >= min_corr))
        number = (np.arange(psi.shape[0])[:, None] + at[0] * tile) * shape[1] + np.arange(psi.shape[1])[None] + at[1] * tile + 1
        first = np.full(len(size), np.iinfo(np.int64).max)
        np.minimum.at(first, label.ravel(), number.ravel())
        first[0] = 0
        top = int(first[1 + np.argmax(size[1:])]) if len(size) > 1 else 0
        region = first[u.grow(label, regrow)]
        edge = np.zeros(region.shape, bool)
        edge[[0, -1]] = edge[:, [0, -1]] = True
        for p, q in (((slice(None, -1), slice(None)), (slice(1, None), slice(None))), ((slice(None), slice(None, -1)), (slice(None), slice(1, None)))):
            other = region[p] != region[q]
            edge[p] |= other
            edge[q] |= other
        r, c = np.nonzero(here)
        pick = lambda x: pa.array(x[r, c])
        return pa.table({
            "ifg": pa.array(np.full(len(r), ifg), pa.int32()), "row": pa.array(r + at[0] * tile), "col": pa.array(c + at[1] * tile), "psi": pick(psi), "corr": pick(corr), "value": pick(value),
            "region": pick(region), "anchor": pick(np.where(region > 0, region, top)), "edge": pick(edge & (region > 0)),
        })

    x = to_tiles(ifgs.select("ifg", "row", "col", "psi", "corr"), tile, halo, shape)
    return x.groupBy("ifg", "tr", "tc").applyInArrow(run, "ifg int, row long, col long, psi double, corr double, value double, region long, anchor long, edge boolean")


def touching(pixels: DataFrame, *values: str) -> DataFrame:
    """Pairs of a pixel and its right or lower neighbour: columns of both, those of the neighbour with suffix 2."""
    near = F.explode(F.array(F.struct((F.col("row") + 1).alias("r"), F.col("col").alias("c")), F.struct(F.col("row").alias("r"), (F.col("col") + 1).alias("c"))))
    left = pixels.select("ifg", *values, near.alias("n")).select("ifg", *values, "n.r", "n.c")
    right = pixels.select("ifg", F.col("row").alias("r"), F.col("col").alias("c"), *[F.col(v).alias(f"{v}2") for v in values])
    return left.join(right, ["ifg", "r", "c"])


def seam_votes(pixels: DataFrame) -> DataFrame:
    """``(ifg, lo, hi, diff, weight)`` per pair of touching regions: the difference of cycles (lo less hi) with most coherence, then least, then smaller; and all votes' weight."""
    p = touching(pixels, "psi", "corr", "value", "region").where("region <> 0 AND region2 <> 0 AND region <> region2")
    d = F.round((F.col("value2") - F.col("value") - wrap(F.col("psi2") - F.col("psi"))) / TURN).cast("bigint")
    ahead = F.col("region") < F.col("region2")
    votes = p.select("ifg", F.least("region", "region2").alias("lo"), F.greatest("region", "region2").alias("hi"), F.when(ahead, d).otherwise(-d).alias("diff"), F.least("corr", "corr2").alias("w"))
    votes = votes.groupBy("ifg", "lo", "hi", "diff").agg(F.sum("w").alias("w"))
    best = F.max_by("diff", F.struct("w", -F.abs("diff"), -F.col("diff")))
    return votes.groupBy("ifg", "lo", "hi").agg(best.alias("diff"), F.sum("w").alias("weight"))


def region_offsets(votes: DataFrame) -> DataFrame:
    """``(ifg, anchor, cycles)`` along each interferogram's heaviest forest; a task holds one interferogram's graph of regions."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        edges = list(zip(*(table.column(c).to_pylist() for c in ("lo", "hi", "diff", "weight"))))
        found = spanning_offsets(list({x for e in edges for x in e[:2]}), edges)
        return pa.table({"ifg": pa.array([key[0].as_py()] * len(found), pa.int32()), "anchor": pa.array(list(found), pa.int64()), "cycles": pa.array(list(found.values()), pa.int64())})

    return votes.groupBy("ifg").applyInArrow(run, "ifg int, anchor long, cycles long")


def unwrap_network(ifgs: DataFrame, shape: tuple[int, int], tile: int = TILE, overlap: int = u.OVERLAP) -> DataFrame:
    """``(ifg, row, col, unwrapped, corr)`` from ``(ifg, row, col, psi, corr)``; missing phases count as 0 of no coherence."""
    solved = written(solve_tiles(ifgs, shape, tile, overlap), "unwrapped-tiles")
    offsets = region_offsets(seam_votes(solved.where("edge")))
    return solved.join(offsets, ["ifg", "anchor"], "left").select("ifg", "row", "col", (F.col("value") + TURN * F.coalesce("cycles", F.lit(0))).alias("unwrapped"), "corr")


def component_labels(quality: DataFrame, shape: tuple[int, int], tile: int = TILE, min_corr: float = u.MIN_CORR, min_share: float = u.MIN_SHARE) -> DataFrame:
    """``(ifg, row, col, component)`` from ``(ifg, row, col, corr)``: 1 is the largest coherent 4-connected set, 0 the rest.

    Tiles label their own pixels; labels that touch over a border are joined as a small graph; sizes
    and ranks are aggregates.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at = (key[1].as_py(), key[2].as_py())
        r0, r1, c0, c1 = tile_window(tile, at, (0, 0), shape)
        rows, cols = table.column("row").to_numpy() - r0, table.column("col").to_numpy() - c0
        keep = np.zeros((r1 - r0, c1 - c0), bool)
        corr = np.nan_to_num(table.column("corr").to_numpy(zero_copy_only=False).astype(float))
        keep[rows, cols] = corr >= min_corr
        label, size = components(keep)
        number = (np.arange(r0, r1)[:, None] * shape[1] + np.arange(c0, c1)[None] + 1).ravel()
        first = np.full(len(size), np.iinfo(np.int64).max)
        np.minimum.at(first, label.ravel(), number)
        first[0] = 0
        border = (rows == 0) | (cols == 0) | (rows == r1 - r0 - 1) | (cols == c1 - c0 - 1)
        return pa.table({"ifg": pa.array(np.full(len(rows), key[0].as_py()), pa.int32()), "row": pa.array(rows + r0), "col": pa.array(cols + c0), "region": pa.array(first[label[rows, cols]]), "edge": pa.array(border)})

    def join(key: tuple, table: pa.Table) -> pa.Table:
        a, b = (table.column(c).to_numpy() for c in ("region", "region2"))
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(names))
        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
            forest.join(x, y)
        roots = np.array([forest.root(k) for k in range(len(names))])
        least = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(least, roots, names)
        return pa.table({"ifg": pa.array(np.full(len(names), key[0].as_py()), pa.int32()), "region": pa.array(names), "root": pa.array(least[roots])})

    cells = quality.select("ifg", "row", "col", "corr", F.floor(F.col("row") / tile).cast("int").alias("tr"), F.floor(F.col("col") / tile).cast("int").alias("tc"))
    local = written(cells.groupBy("ifg", "tr", "tc").applyInArrow(run, "ifg int, row long, col long, region long, edge boolean"), "tile-components")
    seams = touching(local.where("edge AND region <> 0"), "region").where("region <> region2").select("ifg", "region", "region2").distinct()
    roots = seams.groupBy("ifg").applyInArrow(join, "ifg int, region long, root long")
    sizes = local.groupBy("ifg", "region").agg(F.count("*").alias("n")).join(roots, ["ifg", "region"], "left").withColumn("root", F.coalesce("root", "region"))
    whole = sizes.where("region <> 0").groupBy("ifg", "root").agg(F.sum("n").alias("n")).where(F.col("n") >= math.ceil(min_share * shape[0] * shape[1]))
    rank = F.row_number().over(Window.partitionBy("ifg").orderBy(F.desc("n"), "root"))  # components of one interferogram
    named = sizes.select("ifg", "region", "root").join(whole.select("ifg", "root", rank.alias("component")), ["ifg", "root"]).select("ifg", "region", "component")
    return local.join(named, ["ifg", "region"], "left").select("ifg", "row", "col", F.coalesce("component", F.lit(0)).cast("int").alias("component"))


def downsample(ifgs: DataFrame, by: tuple[int, int] = (2, 2)) -> DataFrame:
    """``(ifg, row, col, re, im, corr)``: coherence-weighted mean phasor of whole blocks and its length, from ``(ifg, row, col, psi, corr)``."""
    w = F.col("corr")
    g = ifgs.groupBy("ifg", F.floor(F.col("row") / by[0]).alias("row"), F.floor(F.col("col") / by[1]).alias("col")).agg(
        F.sum(w * F.cos("psi")).alias("x"), F.sum(w * F.sin("psi")).alias("y"), F.greatest(F.sum(w), F.lit(1e-12)).alias("w"), F.count("*").alias("n"))
    return g.where(F.col("n") == by[0] * by[1]).select("ifg", "row", "col", (F.col("x") / F.col("w")).alias("re"), (F.col("y") / F.col("w")).alias("im"), (F.sqrt(F.expr("x * x + y * y")) / F.col("w")).alias("corr"))


def integrate(pixels: DataFrame) -> DataFrame:
    """``(row, col, value)``: sums of wrapped steps down the first column and along rows from ``(row, col, psi)``.

    Running sums need a line at a time: a task holds one raster row, the first column is one more.
    """
    along = Window.partitionBy("row").orderBy("col")
    steps = pixels.withColumn("step", F.coalesce(wrap(F.col("psi") - F.lag("psi").over(along)), F.lit(0.0))).withColumn("run", F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    first = pixels.where("col = 0").select("row", F.col("psi").alias("p0"), F.lit(0).alias("one"))
    down = Window.partitionBy("one").orderBy("row")
    start = first.withColumn("s", F.coalesce(wrap(F.col("p0") - F.lag("p0").over(down)), F.col("p0"))).select("row", F.sum("s").over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("base"))
    return steps.join(start, "row").select("row", "col", (F.col("base") + F.col("run")).alias("value"))


def multiscale(ifgs: DataFrame, shape: tuple[int, int], by: tuple[int, int] = (3, 3), parts: tuple[int, int] = (2, 2), overlap: tuple[int, int] = (16, 16)) -> DataFrame:
    """Coarse-anchored unwrapping; one interferogram to a task, so for grids that fit one."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows, cols = table.column("row").to_numpy(), table.column("col").to_numpy()
        z, corr = np.zeros(shape, complex), np.zeros(shape)
        z[rows, cols] = np.exp(1j * table.column("psi").to_numpy())
        corr[rows, cols] = table.column("corr").to_numpy()
        value, label = u.unwrap_multiscale(z, corr, by, parts, overlap)
        return pa.table({"ifg": pa.array(np.full(len(rows), key[0].as_py()), pa.int32()), "row": pa.array(rows), "col": pa.array(cols), "unwrapped": pa.array(value[rows, cols]), "component": pa.array(label[rows, cols].astype(np.int32))})

    return ifgs.groupBy("ifg").applyInArrow(run, "ifg int, row long, col long, unwrapped double, component int")


def sample_phases(stack: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    return stack.select("row", "col", F.array(*[F.atan2(part(k, 1), part(k, 0)) for k in range(epochs)]).alias("theta"))


def sample_network(spark: SparkSession, sf_dir: str, pairs: list[tuple[int, int]] | None = None) -> tuple[DataFrame, tuple[int, int]]:
    """Interferograms of the sample stack with the coherence of their pair: every epoch against the first by default."""
    stack = c_stack(spark, sf_dir)
    shape, pairs = grid_shape(stack), pairs or [(0, k) for k in range(1, EPOCHS)]
    size = coherence(stack, shape, pairs=pairs).select("row", "col", "i", "j", F.sqrt(F.expr("cre * cre + cim * cim")).alias("corr"))
    return form_network(sample_phases(stack), pairs).join(size, ["row", "col", "i", "j"]), shape


def _network(build, pairs: list[tuple[int, int]] | None = None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ifgs, shape = sample_network(spark, sf_dir, pairs)
        return build(ifgs, shape)

    return query


def _blocks(stack: DataFrame) -> DataFrame:
    """Interferogram (0, 1) cut into 8-pixel blocks whose values are whole cycles apart."""
    p = form_network(sample_phases(stack), [(0, 1)])
    block = F.floor(F.col("row") / 8) * 1000 + F.floor(F.col("col") / 8) + 1
    return p.select("ifg", "row", "col", "psi", F.abs(F.cos("psi")).alias("corr"), (F.col("psi") + TURN * F.pmod(block, F.lit(3))).alias("value"), block.cast("long").alias("region"))


QUERIES = {
    "form_network": lambda spark, sf_dir: form_network(sample_phases(c_stack(spark, sf_dir)), [(0, k) for k in range(1, EPOCHS)]).select("ifg", "i", "j", "row", "col", r6(F.cos("psi"), "re"), r6(F.sin("psi"), "im")),
    "edge_costs": lambda spark, sf_dir: edge_costs(c_stack(spark, sf_dir).select("row", "col", F.abs(part(0, 0)).alias("corr"))),
    "seam_votes": lambda spark, sf_dir: seam_votes(_blocks(c_stack(spark, sf_dir))).select("lo", "hi", "diff", r6(F.col("weight"), "weight")),
    "downsample_coherent": lambda spark, sf_dir: downsample(_blocks(c_stack(spark, sf_dir))).select("row", "col", r6(F.col("re"), "re"), r6(F.col("im"), "im"), r6(F.col("corr"), "corr")),
    "integrate": lambda spark, sf_dir: integrate(_blocks(c_stack(spark, sf_dir))).select("row", "col", r6(F.col("value"), "value")),
    "unwrap_network": _network(unwrap_network),
    "unwrap_tiled": _network(lambda ifgs, shape: unwrap_network(ifgs, shape, 8, 4)),
    "unwrap_multiscale": _network(lambda ifgs, shape: multiscale(ifgs, shape, (2, 2), (1, 2), (4, 4)), [(0, k) for k in range(1, 5)]),
    "conncomp": _network(lambda ifgs, shape: component_labels(ifgs.withColumn("corr", F.round("corr", 6)), shape, 8, 0.4)),
}

_PSI = f"""{C_STACK_SQL}, th AS (SELECT "row", col, CAST(i AS INT) AS i, atan2(z[2*i+2], z[2*i+1]) AS t FROM c, range({EPOCHS}) x(i))"""
_BLOCKS = f"""{_PSI}, w AS (SELECT a."row", a.col, a.t - b.t AS d FROM th a JOIN th b ON a."row" = b."row" AND a.col = b.col WHERE a.i = 0 AND b.i = 1),
p AS (SELECT "row", col, d - 2*pi()*round(d/(2*pi())) AS psi, CAST("row" // 8 * 1000 + col // 8 + 1 AS BIGINT) AS region FROM w),
b AS (SELECT *, abs(cos(psi)) AS corr, psi + 2*pi()*(region % 3) AS value FROM p)"""
ORACLES = {
    "form_network": f"""WITH {_PSI} SELECT CAST(b.i - 1 AS INT) AS ifg, a.i AS i, b.i AS j, a."row", a.col, round(cos(a.t - b.t), 6) + 0.0 AS re, round(sin(a.t - b.t), 6) + 0.0 AS im
 FROM th a JOIN th b ON a."row" = b."row" AND a.col = b.col AND a.i = 0 AND b.i > 0""",
    "edge_costs": f"""WITH {C_STACK_SQL}, q AS (SELECT "row", col, abs(z[1]) AS k FROM c),
e AS (SELECT q."row", q.col, least((q.k + r.k)/2, {u.COHERENCE_CEILING}) AS gr, least((q.k + d.k)/2, {u.COHERENCE_CEILING}) AS gd, r.k AS rk, d.k AS dk
 FROM q LEFT JOIN q r ON r."row" = q."row" AND r.col = q.col + 1 LEFT JOIN q d ON d."row" = q."row" + 1 AND d.col = q.col)
SELECT "row", col, CASE WHEN rk IS NOT NULL THEN CAST(round(greatest(gr*gr/(1-gr*gr), 1.0) * 10000) AS BIGINT) ELSE 0 END AS right_cost,
 CASE WHEN dk IS NOT NULL THEN CAST(round(greatest(gd*gd/(1-gd*gd), 1.0) * 10000) AS BIGINT) ELSE 0 END AS down_cost FROM e""",
    "seam_votes": f"""WITH {_BLOCKS}, pr AS (SELECT x.region AS r, y.region AS s, round((y.value - x.value - ((y.psi - x.psi) - 2*pi()*round((y.psi - x.psi)/(2*pi())))) / (2*pi())) AS d, least(x.corr, y.corr) AS w
 FROM b x JOIN b y ON (y."row" = x."row" + 1 AND y.col = x.col) OR (y."row" = x."row" AND y.col = x.col + 1) WHERE x.region <> y.region),
v AS (SELECT least(r, s) AS lo, greatest(r, s) AS hi, CAST(CASE WHEN r < s THEN d ELSE -d END AS BIGINT) AS diff, sum(w) AS w FROM pr GROUP BY ALL)
SELECT lo, hi, diff, round(total, 6) + 0.0 AS weight FROM (SELECT *, sum(w) OVER (PARTITION BY lo, hi) AS total, row_number() OVER (PARTITION BY lo, hi ORDER BY w DESC, abs(diff), diff) AS k FROM v) WHERE k = 1""",
    "downsample_coherent": f"""WITH {_BLOCKS}, g AS (SELECT CAST("row" // 2 AS BIGINT) AS "row", CAST(col // 2 AS BIGINT) AS col, sum(corr*cos(psi)) AS x, sum(corr*sin(psi)) AS y, greatest(sum(corr), 1e-12) AS w FROM b GROUP BY ALL HAVING count(*) = 4)
SELECT "row", col, round(x/w, 6) + 0.0 AS re, round(y/w, 6) + 0.0 AS im, round(sqrt(x*x + y*y)/w, 6) + 0.0 AS corr FROM g""",
    "integrate": f"""WITH {_BLOCKS}, l AS (SELECT "row", col, psi, psi - lag(psi) OVER (PARTITION BY "row" ORDER BY col) AS dx FROM b),
r AS (SELECT "row", col, sum(CASE WHEN dx IS NULL THEN 0 ELSE dx - 2*pi()*round(dx/(2*pi())) END) OVER (PARTITION BY "row" ORDER BY col) AS run FROM l),
f AS (SELECT "row", psi, psi - lag(psi) OVER (ORDER BY "row") AS dy FROM b WHERE col = 0),
s AS (SELECT "row", sum(CASE WHEN dy IS NULL THEN psi ELSE dy - 2*pi()*round(dy/(2*pi())) END) OVER (ORDER BY "row") AS base FROM f)
SELECT r."row", col, round(base + run, 6) + 0.0 AS value FROM r JOIN s ON r."row" = s."row\"""",
}

"""Phase linking per tile: pixels go to tiles with a halo, one Arrow-batched kernel call per tile.

The only shuffle is by tile; a task holds one tile and its halo, of a size set by the epochs and
whatever the raster's.  The kernel returns core pixels only, so tiles never overlap in the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.kernels import linking as k
from rasterloom.kernels import sequential
from rasterloom.sources.adapters import EPOCHS, c_stack

from .stack import grid_shape

MATRIX_BYTES = 64 << 20  # of coherence matrices in a task
LEAST_TILE = 8


def tile_size(epochs: int, shape: tuple[int, int], tasks: int) -> int:
    """Side of a tile: bounded by the matrices a task may hold, small enough to give every core a tile."""
    most = int(math.sqrt(MATRIX_BYTES / (16 * epochs * epochs)))
    return max(LEAST_TILE, min(most, math.ceil(math.sqrt(shape[0] * shape[1] / max(tasks, 1)))))


def to_tiles(stack: DataFrame, tile: int, halo: tuple[int, int], shape: tuple[int, int]) -> DataFrame:
    """Each pixel once per tile whose halo holds it: ``(tr, tc, row, col, ...)``."""

    def span(x: str, h: int, n: int) -> Column:
        return F.explode(F.sequence(F.greatest(F.floor((F.col(x) - h) / tile), F.lit(0)).cast("int"), F.least(F.floor((F.col(x) + h) / tile), F.lit((n - 1) // tile)).cast("int")))

    return stack.withColumn("tr", span("row", halo[0], shape[0])).withColumn("tc", span("col", halo[1], shape[1]))


def tile_window(tile: int, at: tuple[int, int], halo: tuple[int, int], shape: tuple[int, int]) -> tuple[int, int, int, int]:
    """Rows and columns of a tile and its halo inside the grid."""
    return tuple(x for t, h, n in zip(at, halo, shape) for x in (max(t * tile - h, 0), min((t + 1) * tile + h, n)))


def tile_cube(table: pa.Table, epochs: int, window: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(epoch, row, col) samples of a tile, not a number where a pixel is missing; and the pixels' rows and columns."""
    rows, cols = table.column("row").to_numpy(), table.column("col").to_numpy()
    z = table.column("z").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * epochs)
    cube = np.full((epochs, window[1] - window[0], window[3] - window[2]), np.nan, complex)
    cube[:, rows - window[0], cols - window[2]] = (z[:, 0::2] + 1j * z[:, 1::2]).T
    return cube, rows, cols


def _long(columns: dict[str, np.ndarray]) -> pa.Table:
    return pa.table({name: pa.array(x) for name, x in columns.items()})


def link(
    stack: DataFrame, epochs: int = EPOCHS, half: tuple[int, int] = (1, 1), estimator: str = "emi", tile: int | None = None,
    beta: float = 0.0, cut: float = 0.0, reference: int = 0, shape: tuple[int, int] | None = None,
) -> DataFrame:
    """``(row, col, epoch, phase, sigma, temp_coh, positive)`` of the first ``epochs`` epochs.

    ``phase`` is relative to epoch ``reference``; windows shift inward at the grid's border and missing
    pixels count as zero.  ``positive`` tells whether the full estimator applied or its fallback.
    """
    how = k.Linking(half=half, estimator=estimator, beta=beta, cut=cut)
    shape = shape or grid_shape(stack)
    tile = tile or tile_size(epochs, shape, stack.sparkSession.sparkContext.defaultParallelism)
    halo = (2 * half[0], 2 * half[1])  # a window shifted inward reaches that far

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at = (key[0].as_py(), key[1].as_py())
        window = tile_window(tile, at, halo, shape)
        cube, rows, cols = tile_cube(table, epochs, window)
        core = (rows // tile == at[0]) & (cols // tile == at[1])
        rows, cols = rows[core], cols[core]
        cov = k.coherence(cube, half)[rows - window[0], cols - window[2]]
        theta, ok = k.estimate(cov, how, reference)
        sigma, quality = k.bound(cov, how.looks, reference, beta, cut), k.temporal_coherence(cov, theta)
        rep = lambda x: np.repeat(x, epochs)
        return _long({"row": rep(rows), "col": rep(cols), "epoch": np.tile(np.arange(epochs, dtype=np.int32), len(rows)), "phase": theta.ravel(), "sigma": sigma.ravel(), "temp_coh": rep(quality), "positive": rep(ok)})

    sliced = stack.select("row", "col", F.slice("z", 1, 2 * epochs).alias("z"))
    return to_tiles(sliced, tile, halo, shape).groupBy("tr", "tc").applyInArrow(run, "row long, col long, epoch int, phase double, sigma double, temp_coh double, positive boolean")


def link_sequential(
    stack: DataFrame, epochs: int = EPOCHS, plan: sequential.Plan = sequential.Plan(), how: k.Linking = k.Linking(), tile: int | None = None, shape: tuple[int, int] | None = None,
) -> DataFrame:
    """``(row, col, epoch, phase, sigma, temp_coh)`` by ministacks; the whole fold of a tile runs in one task, with no shuffle between ministacks.

    A compressed layer depends on its neighbours' windows, so the halo is one window per ministack.
    """
    if how.strides != (1, 1):
        raise ValueError("tiles are linked at full resolution")
    shape = shape or grid_shape(stack)
    depth = -(-epochs // plan.size)
    halo = tuple(2 * h + (depth - 1) * (h + 1) for h in how.half)
    tile = tile or max(tile_size(min(epochs, plan.size + plan.cap), shape, stack.sparkSession.sparkContext.defaultParallelism), 2 * max(halo))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at = (key[0].as_py(), key[1].as_py())
        window = tile_window(tile, at, halo, shape)
        cube, rows, cols = tile_cube(table, epochs, window)
        core = (rows // tile == at[0]) & (cols // tile == at[1])
        rows, cols = rows[core], cols[core]
        found = sequential.joined(sequential.run(cube, plan, how)[0])
        pick = lambda x: x[:, rows - window[0], cols - window[2]].T.ravel()
        rep = lambda x: np.repeat(x, epochs)
        sigma = pick(found["sigma"]) if how.crlb else np.full(len(rows) * epochs, np.nan)
        return _long({"row": rep(rows), "col": rep(cols), "epoch": np.tile(np.arange(epochs, dtype=np.int32), len(rows)), "phase": pick(found["theta"]), "sigma": sigma, "temp_coh": rep(found["temp_coh"][rows - window[0], cols - window[2]])})

    sliced = stack.select("row", "col", F.slice("z", 1, 2 * epochs).alias("z"))
    return to_tiles(sliced, tile, halo, shape).groupBy("tr", "tc").applyInArrow(run, "row long, col long, epoch int, phase double, sigma double, temp_coh double")


QUERIES = {
    "link_emi": lambda spark, sf_dir: link(c_stack(spark, sf_dir)),
    "link_evd": lambda spark, sf_dir: link(c_stack(spark, sf_dir), estimator="evd"),
    "link_tiled": lambda spark, sf_dir: link(c_stack(spark, sf_dir), tile=8),
    "link_regularized": lambda spark, sf_dir: link(c_stack(spark, sf_dir), beta=0.1, cut=0.05),
    "link_sequential": lambda spark, sf_dir: link_sequential(c_stack(spark, sf_dir), plan=sequential.Plan(size=8, cap=4)),
    "link_shp": lambda spark, sf_dir: link_sequential(c_stack(spark, sf_dir), plan=sequential.Plan(size=16, cap=4), how=k.Linking(method="glrt", alpha=0.05)),
}

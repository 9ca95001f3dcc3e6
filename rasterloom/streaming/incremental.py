"""New epochs folded into a linked series: state per tile in versioned Parquet tables, so a fold can be repeated safely.

Sealed ministacks are never linked again; a fold's result equals that of a run over all epochs.  Epochs must
come in order and without gaps, on one grid.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.errors import SourceError
from rasterloom.kernels import linking as k
from rasterloom.kernels import sequential as q
from rasterloom.operators.linking import tile_window, to_tiles
from rasterloom.sources.rasters import as_samples

RESULT = "tr int, tc int, state binary, row long, col long, epoch int, phase double, sigma double, temp_coh double"


def pack(state: q.State) -> bytes:
    out = {f"{n}.{name}": x for n, products in enumerate(state.sealed) for name, x in products.items()}
    if state.open is not None:
        out["open"] = state.open
    buffer = io.BytesIO()
    np.savez(buffer, **out)
    return buffer.getvalue()


def unpack(data: bytes) -> q.State:
    with np.load(io.BytesIO(data)) as z:
        sealed: dict[int, dict[str, np.ndarray]] = {}
        for key in z.files:
            if key != "open":
                n, name = key.split(".", 1)
                sealed.setdefault(int(n), {})[name] = z[key]
        return q.State([sealed[n] for n in sorted(sealed)], z["open"] if "open" in z.files else None)


@dataclass
class Series:
    """A series kept in ``folder``: ``state/v=N`` after N folds and ``linked/v=N`` with what fold N changed."""

    spark: SparkSession
    folder: str
    shape: tuple[int, int]
    plan: q.Plan = q.Plan()
    how: k.Linking = k.Linking()
    tile: int = 64
    ministacks: int = 4  # most that a series will have: sets how far a tile must see

    @property
    def halo(self) -> tuple[int, int]:
        return tuple(2 * h + (self.ministacks - 1) * (h + 1) for h in self.how.half)

    def exists(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def state(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/state/v={version}")

    def linked(self, version: int) -> DataFrame:
        """``(row, col, epoch, phase, sigma, temp_coh)`` of the epochs that a fold linked."""
        return self.spark.read.parquet(f"{self.folder}/linked/v={version}")

    def fold(self, stack: DataFrame, version: int) -> DataFrame:
        """Fold epochs ``(row, col, epoch, re, im)`` into version ``version``, which makes version + 1; a finished fold is not repeated."""
        done = f"{self.folder}/linked/v={version + 1}"
        if self.exists(done):
            return self.linked(version + 1)
        prior = self.state(version) if version else None
        before = prior.agg(F.max("epochs")).first()[0] if prior is not None else 0
        new = sorted(r[0] for r in stack.select("epoch").distinct().collect())  # a few epochs
        if not new:
            raise SourceError("no new epochs")
        if new != list(range(before, before + len(new))):
            raise SourceError(f"epochs {new} do not follow the {before} known ones")
        span = stack.agg(F.max("row"), F.max("col"), F.min("row"), F.min("col")).first()
        if span[0] >= self.shape[0] or span[1] >= self.shape[1] or span[2] < 0 or span[3] < 0:
            raise SourceError("new epochs have another grid")
        if before + len(new) > self.ministacks * self.plan.size:
            raise SourceError(f"the series was planned for {self.ministacks} ministacks")
        n, tile, halo, shape, plan, how = len(new), self.tile, self.halo, self.shape, self.plan, self.how

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            at = (key[0].as_py(), key[1].as_py())
            window = tile_window(tile, at, halo, shape)
            cube = np.full((n, window[1] - window[0], window[3] - window[2]), np.nan, complex)
            rows, cols = left.column("row").to_numpy(), left.column("col").to_numpy()
            z = left.column("z").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * n)
            cube[:, rows - window[0], cols - window[2]] = (z[:, 0::2] + 1j * z[:, 1::2]).T
            state = unpack(right.column("state")[0].as_py()) if right.num_rows else None
            products, state = q.run(cube, plan, how, state)
            found = q.joined(products)
            first = before - before % plan.size  # epochs of sealed ministacks have not changed
            core = (rows // tile == at[0]) & (cols // tile == at[1])
            rows, cols = rows[core], cols[core]
            epochs = np.arange(first, before + n, dtype=np.int32)
            pick = lambda x: x[first:, rows - window[0], cols - window[2]].T.ravel()
            rep = lambda x: np.repeat(x, len(epochs))
            size = len(rows) * len(epochs)
            out = {
                "tr": pa.array([at[0]] * (size + 1), pa.int32()), "tc": pa.array([at[1]] * (size + 1), pa.int32()), "state": pa.array([pack(state)] + [None] * size, pa.binary()),
                "row": rep(rows), "col": rep(cols), "epoch": np.tile(epochs, len(rows)), "phase": pick(found["theta"]), "sigma": pick(found["sigma"]) if how.crlb else np.full(size, np.nan),
                "temp_coh": rep(found["temp_coh"][rows - window[0], cols - window[2]]),
            }
            kinds = {"row": pa.int64(), "col": pa.int64(), "epoch": pa.int32(), "phase": pa.float64(), "sigma": pa.float64(), "temp_coh": pa.float64()}
            return pa.table({c: x if isinstance(x, pa.Array) else pa.concat_arrays([pa.nulls(1, kinds[c]), pa.array(x, kinds[c])]) for c, x in out.items()})

        moved = as_samples(stack.withColumn("epoch", (F.col("epoch") - before).cast("int")), n)
        tiles = to_tiles(moved, tile, halo, shape).groupBy("tr", "tc")
        kept = (prior.select("tr", "tc", "state") if prior is not None else self.spark.createDataFrame([], "tr int, tc int, state binary")).groupBy("tr", "tc")
        work = f"{self.folder}/work/v={version + 1}"
        tiles.cogroup(kept).applyInArrow(run, RESULT).write.mode("overwrite").parquet(work)
        found = self.spark.read.parquet(work)
        found.where("state IS NOT NULL").select("tr", "tc", "state", F.lit(before + n).alias("epochs")).write.mode("overwrite").parquet(f"{self.folder}/state/v={version + 1}")
        # written last: its presence means the fold is whole
        found.where("state IS NULL").select("row", "col", "epoch", "phase", "sigma", "temp_coh").write.mode("overwrite").parquet(done)
        return self.linked(version + 1)

    def history(self, version: int) -> DataFrame:
        """The series after fold ``version``: for every epoch the last fold that linked it, and the last quality."""
        parts = [self.linked(v).withColumn("v", F.lit(v)) for v in range(1, version + 1)]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        last = every.groupBy("row", "col", "epoch").agg(F.max_by(F.struct("phase", "sigma"), "v").alias("x"))
        return last.select("row", "col", "epoch", "x.*").join(self.linked(version).select("row", "col", "temp_coh").distinct(), ["row", "col"])

    def stream(self, source: str, checkpoint: str, files_per_fold: int = 1):
        """Fold every Parquet file of epochs in ``source``, oldest first, and stop; a restart goes on where it ended."""
        schema = "row long, col long, epoch int, re double, im double"
        new = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_fold).option("latestFirst", "false").parquet(source)

        def step(batch: DataFrame, batch_id: int) -> None:
            self.fold(batch, batch_id)

        return new.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "2 days", width: str = "7 days") -> DataFrame:
    """Counts and means per type and time window, with a watermark when ``events`` is a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    g = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "mean")

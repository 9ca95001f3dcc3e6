"""Rasters and complex stacks as tables: GeoTIFF files through Spark's readers, Parquet tables clustered by tile, metadata sidecars.

Files are read by Spark itself, so any store it knows will do.  HDF5 and netCDF need libraries that are
not part of the engine; their contents enter as GeoTIFF or as raster tables.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.errors import CorrectionError, SourceError, UnwrapError
from rasterloom.kernels import delays
from rasterloom.plans.blocks import Block, Grid, parse_date

from . import geotiff

HEADER_BYTES = 1 << 16
MOST_FILE_BYTES = 1 << 30
TILE = 256
ALIGNED = 1e-6
TOTAL = ("hydrostatic_delay", "wet_delay")  # fixed values: layers whose sum is the whole delay


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths)


def read_header(spark: SparkSession, path: str) -> geotiff.Raster:
    """Shape, number kind, grid and metadata of a file; only its first bytes reach the driver."""
    row = _files(spark, path).select(F.substring("content", 1, HEADER_BYTES).alias("c")).first()
    if row is None:
        raise SourceError(f"no file {path!r}")
    return geotiff.header(bytes(row["c"]))


def read_raster(spark: SparkSession, paths: str | list[str], window: Block | None = None) -> DataFrame:
    """``(path, row, col, value)`` of the files' samples, nodata as null; complex files have ``re`` and ``im`` instead of ``value``.

    A task decodes one file and unpacks only the tiles that meet the window; rows and columns stay the file's own.
    """
    first = read_header(spark, [paths] if isinstance(paths, str) else paths[:1])
    is_complex = first.kind.kind == "c"
    at = (window.r0, window.r1, window.c0, window.c1) if window else None

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                h = geotiff.header(data)
                if (h.kind.kind == "c") != is_complex:
                    raise SourceError(f"{path} holds another kind of samples")
                x = geotiff.decode(data, at)
                for r in range(0, max(len(x), 1), TILE):
                    part = x[r : r + TILE]
                    rows, cols = np.indices(part.shape).reshape(2, -1)
                    keys = [pa.array([path] * part.size, pa.string()), pa.array(rows + r + (at[0] if at else 0), pa.int64()), pa.array(cols + (at[2] if at else 0), pa.int64())]
                    if is_complex:
                        values = [pa.array(part.real.ravel().astype(float)), pa.array(part.imag.ravel().astype(float))]
                    else:
                        v = part.ravel().astype(float)
                        values = [pa.array(v, mask=np.zeros(len(v), bool) if h.nodata is None else (np.isnan(v) if np.isnan(h.nodata) else v == h.nodata))]
                    yield pa.RecordBatch.from_arrays(keys + values, names=["path", "row", "col", *(["re", "im"] if is_complex else ["value"])])

    schema = "path string, row long, col long, " + ("re double, im double" if is_complex else "value double")
    return _files(spark, paths).select("path", "content").mapInArrow(run, schema)


def read_stack(spark: SparkSession, paths: list[str], window: Block | None = None, pattern: str = "%Y%m%d") -> DataFrame:
    """``(epoch, row, col, re, im)``: files in the order of their dates, all of one shape."""
    order = sorted(paths, key=lambda p: parse_date(p, pattern))
    shapes = {(h.rows, h.cols) for h in (read_header(spark, p) for p in order)}
    if len(shapes) != 1:
        raise SourceError(f"the files differ in shape: {sorted(shapes)}")
    names = spark.createDataFrame([(p.rsplit("/", 1)[-1], k) for k, p in enumerate(order)], "name string, epoch int")
    found = read_raster(spark, order, window).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return found.join(F.broadcast(names), "name").select("epoch", "row", "col", "re", "im")  # one row a file is broadcast


def as_samples(stack: DataFrame, epochs: int) -> DataFrame:
    """``(row, col, z)`` with real and imaginary parts in turn, not a number where an epoch is missing: the form that linking takes."""
    m = stack.groupBy("row", "col").agg(F.map_from_entries(F.collect_list(F.struct("epoch", F.struct("re", "im").alias("z")))).alias("m"))  # one entry an epoch
    part = lambda k, c: F.coalesce(F.try_element_at("m", F.lit(k))[c], F.lit(float("nan")))
    return m.select("row", "col", F.array(*[part(k, c) for k in range(epochs) for c in ("re", "im")]).alias("z"))


def check_aligned(source: Grid | None, target: Grid) -> tuple[int, int]:
    """Row and column of the target's first pixel in the source, which must share system, posting and pixel edges and cover it."""
    if source is None or source.epsg == 0:
        raise SourceError("the raster has no georeference")
    if source.epsg != target.epsg:
        raise SourceError(f"the raster is in EPSG:{source.epsg}, not EPSG:{target.epsg}")
    if abs(source.gt[1] - target.gt[1]) > ALIGNED or abs(source.gt[5] - target.gt[5]) > ALIGNED:
        raise SourceError("the raster has another posting")
    off = ((target.gt[3] - source.gt[3]) / source.gt[5], (target.gt[0] - source.gt[0]) / source.gt[1])
    if any(abs(x - round(x)) > ALIGNED for x in off):
        raise SourceError("the raster's pixels do not line up")
    return round(off[0]), round(off[1])


def read_aligned(spark: SparkSession, path: str, target: Grid, default: float = 0.0) -> DataFrame:
    """``(row, col, value)`` in the target's pixels; nodata counts as ``default``.  The raster must cover the target."""
    h = read_header(spark, path)
    r, c = check_aligned(h.grid, target)
    if r < 0 or c < 0 or r + target.rows > h.rows or c + target.cols > h.cols:
        raise SourceError("the raster does not cover the grid")
    found = read_raster(spark, path, Block(r, r + target.rows, c, c + target.cols))
    return found.select((F.col("row") - r).alias("row"), (F.col("col") - c).alias("col"), F.coalesce("value", F.lit(default)).alias("value"))


def overlap_window(source: Grid, target: Grid) -> Block | None:
    """Source pixels that the target needs, None where they do not meet."""
    r, c = check_aligned(source, target)
    return Block(r, r + target.rows, c, c + target.cols).common(Block(0, source.rows, 0, source.cols))


def read_los(spark: SparkSession, east: str, north: str, target: Grid | None = None) -> DataFrame | None:
    """``(row, col, east, north)`` of two aligned files, on the target's pixels if one is given; None where they do not meet it."""
    a, b = read_header(spark, east), read_header(spark, north)
    if a.grid != b.grid:
        raise SourceError("east and north lie on different grids")
    window = None
    if target is not None:
        window = overlap_window(a.grid, target)
        if window is None:
            return None
    r, c = check_aligned(a.grid, target) if target is not None else (0, 0)
    layer = lambda p, name: read_raster(spark, p, window).select((F.col("row") - r).alias("row"), (F.col("col") - c).alias("col"), F.col("value").alias(name))
    return layer(east, "east").join(layer(north, "north"), ["row", "col"])


def write_raster(df: DataFrame, path: str, shape: tuple[int, int], grid: Grid | None = None, kind: str = "f4", metadata: dict[str, str] | None = None, nodata: float | None = None) -> None:
    """``(row, col, value)`` (or ``re, im``) as one file, over any earlier one; larger rasters go to :func:`write_table`."""
    if shape[0] * shape[1] * np.dtype(kind).itemsize > MOST_FILE_BYTES:
        raise SourceError("the raster is too large for one file; write a raster table")
    is_complex = np.dtype(kind).kind == "c"

    def run(key: tuple, table: pa.Table) -> pa.Table:
        out = np.full(shape, 0 if nodata is None else nodata, kind)
        at = (table.column("row").to_numpy(), table.column("col").to_numpy())
        if is_complex:
            out[at] = table.column("re").to_numpy() + 1j * table.column("im").to_numpy()
        else:
            v = table.column("value").to_numpy(zero_copy_only=False).astype(float)
            out[at] = np.where(np.isnan(v), (np.nan if np.dtype(kind).kind == "f" else 0) if nodata is None else nodata, v)
        return pa.table({"content": pa.array([geotiff.encode(out, grid, metadata, nodata)], pa.binary())})

    names = ["re", "im"] if is_complex else ["value"]
    row = df.select("row", "col", *names, F.lit(0).alias("layer")).groupBy("layer").applyInArrow(run, "content binary").first()
    content = bytes(row["content"]) if row else geotiff.encode(np.full(shape, 0 if nodata is None else nodata, kind), grid, metadata, nodata)
    _write_bytes(df.sparkSession, path, content)


def _write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(content)
    finally:
        stream.close()


def write_table(df: DataFrame, path: str, layer: str, grid: Grid | None = None, metadata: dict[str, str] | None = None, tile: int = TILE) -> None:
    """A raster (or a cube with ``epoch``) as a Parquet table under ``layer=...``, clustered by tile so that a window reads few row groups."""
    keyed = df.withColumns({"tr": F.floor(F.col("row") / tile).cast("int"), "tc": F.floor(F.col("col") / tile).cast("int")})
    tasks = max(1, df.sparkSession.sparkContext.defaultParallelism)
    keyed.repartitionByRange(tasks, "tr", "tc").sortWithinPartitions("tr", "tc", "row", "col").drop("tr", "tc").write.mode("overwrite").parquet(f"{path}/layer={layer}")
    about = {"metadata": metadata or {}, "grid": None if grid is None else {"epsg": grid.epsg, "gt": list(grid.gt), "rows": grid.rows, "cols": grid.cols}}
    _write_bytes(df.sparkSession, f"{path}/about-{layer}.json", json.dumps(about, sort_keys=True).encode())


def read_table(spark: SparkSession, path: str, layer: str, window: Block | None = None) -> DataFrame:
    """Rows of a layer; the window reaches the Parquet scan."""
    found = spark.read.parquet(f"{path}/layer={layer}")
    return found if window is None else found.where(F.col("row").between(window.r0, window.r1 - 1) & F.col("col").between(window.c0, window.c1 - 1))


def table_grid(spark: SparkSession, path: str, layer: str) -> tuple[Grid | None, dict[str, str]]:
    about = json.loads(spark.read.text(f"{path}/about-{layer}.json", wholetext=True).first()[0])
    g = about["grid"]
    return (Grid(g["epsg"], tuple(g["gt"]), g["rows"], g["cols"]) if g else None), about["metadata"]


def write_outputs(layers: dict[str, DataFrame], path: str, grid: Grid | None = None, metadata: dict[str, str] | None = None) -> None:
    """Every layer of a run, over an earlier run's."""
    for name, df in layers.items():
        write_table(df, path, name, grid, metadata)


def read_granules(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Identification, burst and orbit metadata from JSON sidecars, one object a file; a file without an orbit or a name fails the read."""
    from rasterloom.operators.provenance import GRANULE

    found = spark.read.schema(GRANULE).json(paths, multiLine=True)
    bad = found.where("name IS NULL OR direction IS NULL OR burst IS NULL OR orbit IS NULL OR exists(orbit, v -> v.t IS NULL OR v.px IS NULL OR v.vx IS NULL)").limit(1).count()
    if bad:
        raise SourceError("a granule lacks its identification or its orbit")
    return found


def heights(spark: SparkSession, path: str, layer: str) -> list[float]:
    """Levels of a delay table, ascending; none if it has no ``height``."""
    found = read_table(spark, path, layer)
    return sorted(r[0] for r in found.select("height").distinct().collect()) if "height" in found.columns else []  # a few hundred levels


def read_delay(spark: SparkSession, path: str, layer: str, level: float | None = None, target: Grid | None = None) -> DataFrame:
    """``(row, col, value)`` of a delay layer at one level; ``total`` adds the two parts of the delay, which must share a grid.

    With ``target`` only the pixels that its bilinear values need are read.  A layer with levels is refused without one.
    """
    if layer == "total":
        grids = [table_grid(spark, path, x)[0] for x in TOTAL]
        if grids[0] != grids[1]:
            raise CorrectionError("the parts of the delay lie on different grids")
        a, b = (read_delay(spark, path, x, level, target) for x in TOTAL)
        return a.join(b.withColumnRenamed("value", "_b"), ["row", "col"]).select("row", "col", (F.col("value") + F.col("_b")).alias("value"))
    levels = heights(spark, path, layer)
    if levels and level is None:
        raise CorrectionError(f"{layer} has {len(levels)} height levels; a terrain model is needed")
    found = read_table(spark, path, layer)
    if target is not None:
        grid, _ = table_grid(spark, path, layer)
        if grid is None:
            raise CorrectionError("the delay has no georeference")
        from rasterloom.geo import transform_bounds

        r0, r1, c0, c1 = delays.source_window(grid.gt, grid.shape, transform_bounds(target.bounds(), target.epsg, grid.epsg))
        found = read_table(spark, path, layer, Block(r0, r1, c0, c1))
    if levels:
        found = found.where(F.col("height") == level)
    return found.select("row", "col", "value")


def read_ionex(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, minute, lat, lon, tec)`` of the maps in text files."""

    def run(batches):
        for batch in batches:
            for path, text in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                m = delays.parse_ionex(text)
                t, y, x = np.meshgrid(m.minutes, m.lats, m.lons, indexing="ij")
                yield pa.RecordBatch.from_arrays([pa.array([path] * m.tec.size), *(pa.array(v.ravel()) for v in (t, y, x, m.tec))], names=["path", "minute", "lat", "lon", "tec"])

    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), "value").mapInArrow(run, "path string, minute double, lat double, lon double, tec double")


def stage(spark: SparkSession, paths: list[str], folder: str) -> list[str]:
    """Copies of the files in a folder, in the order given, from any store that Spark reads to any other."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for k, p in enumerate(paths):
        src, dst = jvm.org.apache.hadoop.fs.Path(p), jvm.org.apache.hadoop.fs.Path(f"{folder}/{k:05d}-{p.rsplit('/', 1)[-1]}")
        if not src.getFileSystem(conf).exists(src):
            raise SourceError(f"no file {p!r}")
        jvm.org.apache.hadoop.fs.FileUtil.copy(src.getFileSystem(conf), src, dst.getFileSystem(conf), dst, False, conf)
        out.append(dst.toString())
    return out


def flat_bytes(array: np.ndarray) -> bytes:
    """Little-endian samples row by row: complex of 8 bytes, floats of 4, labels of 4."""
    return array.astype({"c": "<c8", "f": "<f4"}.get(array.dtype.kind, "<u4")).tobytes()


def from_flat(data: bytes, kind: str, cols: int) -> np.ndarray:
    found = np.frombuffer(data, {"complex": "<c8", "float": "<f4", "label": "<u4"}[kind])
    if cols <= 0 or found.size % cols:
        raise SourceError(f"{found.size} samples are no rows of {cols}")
    return found.reshape(-1, cols)


def external_unwrap(*_: object, **__: object) -> None:
    raise UnwrapError("external unwrapping programs are not run; use the native solver")


def external_delays(*_: object, **__: object) -> None:
    raise CorrectionError("external delay programs are not run; give delay tables")

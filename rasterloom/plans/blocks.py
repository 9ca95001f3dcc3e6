"""Planning of blocks, tiles, frames and areas of interest: metadata only, on the driver; relational forms where tables feed them."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.errors import BoundsError, ConfigError, SourceError
from rasterloom.sources.adapters import table

POSTING_TOLERANCE = 1e-6
LEAST_TARGET, LEAST_OVERLAP = 2, 4  # pixels per axis of an area; shared pixels of several bursts
MULTISCALE_OVERLAP = 16
NATIVE_TILE, AUTO_TILE = 64, 512


@dataclass(frozen=True)
class Block:
    """Half-open rows and columns."""

    r0: int
    r1: int
    c0: int
    c1: int

    @property
    def shape(self) -> tuple[int, int]:
        return self.r1 - self.r0, self.c1 - self.c0

    def times(self, by: tuple[int, int]) -> Block:
        return Block(self.r0 * by[0], self.r1 * by[0], self.c0 * by[1], self.c1 * by[1])

    def moved(self, rows: int, cols: int) -> Block:
        return Block(self.r0 + rows, self.r1 + rows, self.c0 + cols, self.c1 + cols)

    def grown(self, by: tuple[int, int], shape: tuple[int, int]) -> Block:
        return Block(max(self.r0 - by[0], 0), min(self.r1 + by[0], shape[0]), max(self.c0 - by[1], 0), min(self.c1 + by[1], shape[1]))

    def common(self, other: Block) -> Block | None:
        b = Block(max(self.r0, other.r0), min(self.r1, other.r1), max(self.c0, other.c0), min(self.c1, other.c1))
        return b if b.r0 < b.r1 and b.c0 < b.c1 else None


def starts(first: int, size: int, overlap: int, last: int) -> list[int]:
    """Starts along an axis; a step is shortened by the overlap only while another block follows."""
    out = []
    while first < last:
        out.append(first)
        first += size
        first -= overlap if first < last else 0
    return out


def iter_blocks(shape: tuple[int, int], block: tuple[int, int], overlap: tuple[int, int] = (0, 0), start: tuple[int, int] = (0, 0), margin: tuple[int, int] = (0, 0)) -> list[Block]:
    """Blocks of an array from ``start`` up to its end less ``margin``; none for a block of no size."""
    if 0 in block:
        return []
    if any(o >= b for o, b in zip(overlap, block)):
        raise ConfigError("overlap must be smaller than the block")
    last = [max(n - m, 0) for n, m in zip(shape, margin)]
    rows, cols = (starts(start[a], block[a], overlap[a], last[a]) for a in (0, 1))
    return [Block(r, min(r + block[0], last[0]), c, min(c + block[1], last[1])) for r in rows for c in cols]


def out_shape(shape: tuple[int, int], strides: tuple[int, int]) -> tuple[int, int]:
    return shape[0] // strides[0], shape[1] // strides[1]


@dataclass(frozen=True)
class StridedBlock:
    """Output block, trim of a kernel's output, padded and plain input block, trim at full resolution."""

    out: Block
    trim: tuple[int, int]
    padded: Block
    plain: Block

    @property
    def full_trim(self) -> Block:
        return Block(self.plain.r0 - self.padded.r0, self.plain.r1 - self.padded.r0, self.plain.c0 - self.padded.c0, self.plain.c1 - self.padded.c0)


def strided_blocks(shape: tuple[int, int], block: tuple[int, int], strides: tuple[int, int], half: tuple[int, int]) -> list[StridedBlock]:
    """Blocks of the output grid without its border, which no whole window serves, with the input that each needs."""
    margin = tuple(round(h / s) for h, s in zip(half, strides))  # halves go to the even number
    pad = tuple(s * m for s, m in zip(strides, margin))
    out = []
    for b in iter_blocks(out_shape(shape, strides), out_shape(block, strides), (0, 0), margin, margin):
        plain = b.times(strides)
        out.append(StridedBlock(b, margin, Block(max(plain.r0 - pad[0], 0), plain.r1 + pad[0], max(plain.c0 - pad[1], 0), plain.c1 + pad[1]), plain))
    return out


@dataclass(frozen=True)
class TilePlan:
    """Input to read, output to write, and where that output starts in the tile's own."""

    read: Block
    out: Block
    local: tuple[int, int]


def axis_window(o0: int, o1: int, stride: int, half: int, depth: int, n: int) -> tuple[int, int, int]:
    """Read range for outputs ``o0:o1`` when ``depth`` windows depend on each other; ends are multiples of the stride."""
    win = 2 * half + 1
    origin = lambda g: min(max(stride // 2 + g * stride - half, 0), n - win)
    extra = max(depth - 1, 0) * (half + stride)
    start = max(origin(o0) - extra, 0) // stride * stride
    stop = max(origin(o1 - 1) + win + extra, stride * o1)
    return start, min(-(-stop // stride) * stride, n // stride * stride), o0 - start // stride


def plan_tiles(shape: tuple[int, int], strides: tuple[int, int], half: tuple[int, int], depth: int, block: tuple[int, int]) -> list[TilePlan]:
    """Tiles that cover the output grid once."""
    out = []
    for b in iter_blocks(out_shape(shape, strides), (max(block[0], 1), max(block[1], 1))):
        r = axis_window(b.r0, b.r1, strides[0], half[0], depth, shape[0])
        c = axis_window(b.c0, b.c1, strides[1], half[1], depth, shape[1])
        out.append(TilePlan(Block(r[0], r[1], c[0], c[1]), b, (r[2], c[2])))
    return out


def unwrap_tiles(shape: tuple[int, int], auto: bool = False, cores: int = 1) -> tuple[int, int]:
    """Tiles per axis: of some 64 pixels, or with ``auto`` of 512 and no more than there are cores."""
    if auto:
        return tuple(max(1, min(n // AUTO_TILE, cores)) for n in shape)
    return tuple(max(1, n // NATIVE_TILE) for n in shape)


@dataclass(frozen=True)
class Grid:
    """A georeferenced grid, north up: ``gt`` holds x of the left edge, pixel width, 0, y of the top edge, 0, minus pixel height."""

    epsg: int
    gt: tuple[float, float, float, float, float, float]
    rows: int
    cols: int

    @property
    def shape(self) -> tuple[int, int]:
        return self.rows, self.cols

    def bounds(self, b: Block | None = None) -> tuple[float, float, float, float]:
        """Left, bottom, right, top."""
        b = b or Block(0, self.rows, 0, self.cols)
        return self.gt[0] + b.c0 * self.gt[1], self.gt[3] + b.r1 * self.gt[5], self.gt[0] + b.c1 * self.gt[1], self.gt[3] + b.r0 * self.gt[5]

    def part(self, b: Block, strides: tuple[int, int] = (1, 1)) -> Grid:
        """Grid of a block, decimated by ``strides``."""
        gt = self.gt
        shape = out_shape(b.shape, strides)
        return Grid(self.epsg, (gt[0] + b.c0 * gt[1], gt[1] * strides[1], 0.0, gt[3] + b.r0 * gt[5], 0.0, gt[5] * strides[0]), *shape)


def require_grid(grid: Grid | None) -> Grid:
    """A source without a georeference is refused."""
    if grid is None or grid.epsg == 0:
        raise SourceError("the source has no georeference")
    return grid


def frame_grid(bursts: list[Grid]) -> Grid:
    """The union of bursts of one posting, system and alignment."""
    if not bursts:
        raise BoundsError("no bursts")
    a = bursts[0]
    dx, dy = a.gt[1], a.gt[5]
    for b in bursts:
        off = ((b.gt[0] - a.gt[0]) / dx, (b.gt[3] - a.gt[3]) / dy)
        if abs(b.gt[1] - dx) >= POSTING_TOLERANCE or abs(b.gt[5] - dy) >= POSTING_TOLERANCE or b.epsg != a.epsg:
            raise BoundsError("bursts differ in posting or reference system")
        if any(abs(x - round(x)) >= POSTING_TOLERANCE for x in off):
            raise BoundsError("burst origins are not aligned to one pixel grid")
    x0, y1 = min(b.gt[0] for b in bursts), max(b.gt[3] for b in bursts)
    x1, y0 = max(b.gt[0] + b.cols * dx for b in bursts), min(b.gt[3] + b.rows * dy for b in bursts)
    return Grid(a.epsg, (x0, dx, 0.0, y1, 0.0, dy), round((y0 - y1) / dy), round((x1 - x0) / dx))


def burst_offset(frame: Grid, burst: Grid) -> tuple[int, int]:
    """Row and column of a burst's first pixel in the frame."""
    return round((burst.gt[3] - frame.gt[3]) / frame.gt[5]), round((burst.gt[0] - frame.gt[0]) / frame.gt[1])


def snapped_block(bounds: tuple[float, float, float, float], frame: Grid) -> Block:
    """Smallest block of whole pixels that holds the bounds, inside the frame."""
    left, bottom, right, top = bounds
    gt = frame.gt
    clip = lambda x, n: int(min(max(x, 0), n))
    b = Block(clip(math.floor((top - gt[3]) / gt[5]), frame.rows), clip(math.ceil((bottom - gt[3]) / gt[5]), frame.rows), clip(math.floor((left - gt[0]) / gt[1]), frame.cols), clip(math.ceil((right - gt[0]) / gt[1]), frame.cols))
    if b.r0 >= b.r1 or b.c0 >= b.c1:
        raise BoundsError("the area does not meet the frame")
    return b


def analysis_halo(strides: tuple[int, int], half: tuple[int, int], epochs: int, ministack: int, overlap: tuple[int, int] = (0, 0), radius: int = 0) -> tuple[int, int]:
    """Output pixels beyond an area on which its results depend."""
    depth = -(-epochs // max(ministack, 1))
    return tuple(-(-(h + max(depth - 1, 0) * (h + s)) // s) + o + radius for h, s, o in zip(half, strides, overlap))


def burst_windows(bursts: list[Grid], frame: Grid, analysis: Block, strides: tuple[int, int] = (1, 1)) -> list[Block | None]:
    """Each burst's full-resolution pixels inside the analysis block, None for a burst that has none."""
    out = []
    for b in bursts:
        r, c = burst_offset(frame, b)
        found = analysis.common(Block(r, r + b.rows, c, c + b.cols))
        out.append(found and found.moved(-r, -c).times(strides))
    return out


def validate_coverage(bursts: list[Grid], frame: Grid, analysis: Block) -> int:
    """Number of pixels that several bursts share; refuses uncovered pixels and too small an overlap.

    Counts rectangles between all their edges, so the cost does not depend on the number of pixels.
    """
    parts = []
    for b in bursts:
        r, c = burst_offset(frame, b)
        found = analysis.common(Block(r, r + b.rows, c, c + b.cols))
        parts += [found] if found else []
    rows = sorted({analysis.r0, analysis.r1, *(x for p in parts for x in (p.r0, p.r1))})
    cols = sorted({analysis.c0, analysis.c1, *(x for p in parts for x in (p.c0, p.c1))})
    bare = shared = 0
    for r0, r1 in zip(rows, rows[1:]):
        for c0, c1 in zip(cols, cols[1:]):
            n = sum(p.r0 <= r0 and r1 <= p.r1 and p.c0 <= c0 and c1 <= p.c1 for p in parts)
            bare += (r1 - r0) * (c1 - c0) * (n == 0)
            shared += (r1 - r0) * (c1 - c0) * (n > 1)
    if bare:
        raise BoundsError(f"{bare} pixels of the area are not covered")
    if len(parts) > 1 and shared < LEAST_OVERLAP:
        raise BoundsError(f"bursts share {shared} pixels of the area")
    return shared


@dataclass(frozen=True)
class AreaPlan:
    target: Block
    analysis: Block
    windows: list[Block | None]
    frame: Grid

    @property
    def target_in_analysis(self) -> Block:
        return self.target.moved(-self.analysis.r0, -self.analysis.c0)


def plan_bounds(bounds: tuple[float, float, float, float] | None, epsg: int, bursts: list[Grid], halo: tuple[int, int], strides: tuple[int, int] = (1, 1), output_epsg: int | None = None) -> AreaPlan | None:
    """What to read and compute for an area, None for the whole frame."""
    from rasterloom.geo import transform_bounds

    if bounds is None:
        return None
    frame = frame_grid(bursts)
    if frame.epsg == 0 or frame.gt[1] <= 0 or frame.gt[5] >= 0 or frame.gt[2] or frame.gt[4]:
        raise BoundsError("the frame needs a reference system and a north-up grid")
    if output_epsg is not None and output_epsg != frame.epsg:
        raise BoundsError("output in another reference system is not supported")
    target = snapped_block(transform_bounds(bounds, epsg, frame.epsg), frame)
    if min(target.shape) < LEAST_TARGET:
        raise BoundsError(f"area of {target.shape} pixels is too small")
    analysis = target.grown(halo, frame.shape)
    validate_coverage(bursts, frame, analysis)
    return AreaPlan(target, analysis, burst_windows(bursts, frame, analysis, strides), frame)


def analysis_reference(point: tuple[int, int] | None, analysis: Block | None) -> tuple[int, int] | None:
    """A configured frame pixel in the analysis block's own numbering."""
    if point is None or analysis is None:
        return point
    if not (analysis.r0 <= point[0] < analysis.r1 and analysis.c0 <= point[1] < analysis.c1):
        raise BoundsError(f"reference pixel {point} lies outside the analysis block")
    return point[0] - analysis.r0, point[1] - analysis.c0


def parse_date(name: str, pattern: str = "%Y%m%d") -> date:
    """The date in the first part of a file's name, of the pattern's width, that parses."""
    base = name.rsplit("/", 1)[-1]
    width = len(datetime(2000, 12, 25).strftime(pattern))
    for k in range(len(base) - width + 1):
        if not re.fullmatch(r"\s.*|.*\s", base[k : k + width]):
            try:
                return datetime.strptime(base[k : k + width], pattern).date()
            except ValueError:
                continue
    raise SourceError(f"no date like {pattern!r} in {base!r}")


def decimal_days(names: list[str], pattern: str = "%Y%m%d") -> list[float]:
    """Days since the first file in the order given."""
    if not names:
        raise SourceError("no input files")
    found = [parse_date(n, pattern) for n in names]
    return [float((d - found[0]).days) for d in found]


def step_days(dates: list[str], first: date) -> tuple[float, ...]:
    """Days of steps ``YYYY-MM-DD`` after the first acquisition."""
    try:
        return tuple(float((date.fromisoformat(d) - first).days) for d in dates)
    except ValueError as e:
        raise ConfigError(f"step date: {e}") from e


def blocks_table(spark: SparkSession, plan: list[Block]) -> DataFrame:
    return spark.createDataFrame([(b.r0, b.r1, b.c0, b.c1) for b in plan], "r0 int, r1 int, c0 int, c1 int")


def _footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle per supplier on a 30 m grid: the frame and offset queries' bursts."""
    n = F.col("s_suppkey").cast("bigint")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_nationkey", (500000 + 30 * F.pmod(n * 7, F.lit(40))).cast("double").alias("x0"), (4000000 - 30 * F.pmod(n * 11, F.lit(30))).cast("double").alias("y1"),
        (20 + F.pmod(n, F.lit(9))).alias("rows"), (25 + F.pmod(n, F.lit(7))).alias("cols"))


def frames(bursts: DataFrame, key: str, posting: float = 30.0) -> DataFrame:
    """Union frame per ``key`` of rectangles ``(x0, y1, rows, cols)``: one aggregation."""
    g = bursts.groupBy(key).agg(F.min("x0").alias("fx0"), F.max("y1").alias("fy1"), F.max(F.col("x0") + F.col("cols") * posting).alias("fx1"), F.min(F.col("y1") - F.col("rows") * posting).alias("fy0"))
    return g.select(key, "fx0", "fy1", F.round((F.col("fy1") - F.col("fy0")) / posting).cast("bigint").alias("frame_rows"), F.round((F.col("fx1") - F.col("fx0")) / posting).cast("bigint").alias("frame_cols"))


def offsets(bursts: DataFrame, key: str, posting: float = 30.0) -> DataFrame:
    """Each rectangle's first row and column in its frame."""
    j = bursts.join(frames(bursts, key, posting), key)
    return j.select("s_suppkey", F.round((F.col("fy1") - F.col("y1")) / posting).cast("bigint").alias("row_off"), F.round((F.col("x0") - F.col("fx0")) / posting).cast("bigint").alias("col_off"))


AREA = (500205.0, 3999330.0, 500895.0, 3999790.0)  # left, bottom, right, top


def area_snap(bursts: DataFrame, key: str, posting: float = 30.0) -> DataFrame:
    """The area's block of whole pixels per frame, clamped; frames that it misses are left out."""
    f = frames(bursts, key, posting)
    clip = lambda x, n: F.least(F.greatest(x, F.lit(0)), F.col(n)).cast("bigint")
    s = f.select(key, clip(F.floor((F.col("fy1") - AREA[3]) / posting), "frame_rows").alias("r0"), clip(F.ceil((F.col("fy1") - AREA[1]) / posting), "frame_rows").alias("r1"),
                 clip(F.floor((AREA[0] - F.col("fx0")) / posting), "frame_cols").alias("c0"), clip(F.ceil((AREA[2] - F.col("fx0")) / posting), "frame_cols").alias("c1"))
    return s.where("r0 < r1 AND c0 < c1")


def rect_intersect(bursts: DataFrame, key: str, posting: float = 30.0) -> DataFrame:
    """Each rectangle's part inside its frame's area, in the rectangle's own pixels."""
    j = bursts.join(offsets(bursts, key, posting), "s_suppkey").join(area_snap(bursts, key, posting), key)
    lo = lambda a, b: F.greatest(F.col(a), F.col(b)) - F.col(b)
    hi = lambda a, b, n: F.least(F.col(a), F.col(b) + F.col(n)) - F.col(b)
    out = j.select("s_suppkey", lo("r0", "row_off").alias("wr0"), hi("r1", "row_off", "rows").alias("wr1"), lo("c0", "col_off").alias("wc0"), hi("c1", "col_off", "cols").alias("wc1"))
    return out.where("wr0 < wr1 AND wc0 < wc1")


def dates_in_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates scanned out of names and days since the first file in input order, per source of orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.concat(F.lit("/d/x7_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_v1.h5")).alias("name"))
    digits = F.regexp_extract(F.element_at(F.split("name", "/"), -1), r"(\d{8})", 1)
    d = o.select("o_orderkey", "o_orderpriority", F.try_to_date(digits, "yyyyMMdd").alias("d"))
    first = d.groupBy("o_orderpriority").agg(F.min_by("d", "o_orderkey").alias("first"))
    return d.join(F.broadcast(first), "o_orderpriority").select("o_orderkey", F.datediff("d", "first").cast("double").alias("days"))  # one row a priority is broadcast


def _of_suppliers(build):
    return lambda spark, sf_dir: build(_footprints(spark, sf_dir), "s_nationkey")


QUERIES = {
    "blocks_margin": lambda spark, sf_dir: blocks_table(spark, iter_blocks((100, 64), (24, 20), (4, 2), (3, 5), (2, 1))),
    "strided_blocks": lambda spark, sf_dir: blocks_table(spark, [b.padded for b in strided_blocks((100, 96), (32, 32), (2, 3), (5, 7))]),
    "plan_tiles": lambda spark, sf_dir: blocks_table(spark, [t.read for t in plan_tiles((100, 96), (2, 3), (5, 7), 2, (16, 16))]),
    "frame_grid": _of_suppliers(frames),
    "burst_offset": _of_suppliers(offsets),
    "aoi_snap": _of_suppliers(area_snap),
    "rect_intersect": _of_suppliers(rect_intersect),
    "date_parse": dates_in_names,
}

_FOOT = """b AS (SELECT s_suppkey, s_nationkey, CAST(500000 + 30 * ((s_suppkey * 7) % 40) AS DOUBLE) AS x0, CAST(4000000 - 30 * ((s_suppkey * 11) % 30) AS DOUBLE) AS y1, 20 + s_suppkey % 9 AS rows, 25 + s_suppkey % 7 AS cols FROM supplier),
f AS (SELECT s_nationkey, min(x0) AS fx0, max(y1) AS fy1, CAST(round((max(y1) - min(y1 - rows*30.0)) / 30.0) AS BIGINT) AS frame_rows, CAST(round((max(x0 + cols*30.0) - min(x0)) / 30.0) AS BIGINT) AS frame_cols FROM b GROUP BY 1),
o AS (SELECT s_suppkey, CAST(round((fy1 - y1) / 30.0) AS BIGINT) AS row_off, CAST(round((x0 - fx0) / 30.0) AS BIGINT) AS col_off FROM b JOIN f USING (s_nationkey))"""
_SNAP = f"""{_FOOT}, sn AS (SELECT s_nationkey, CAST(least(greatest(floor((fy1 - {AREA[3]}) / 30.0), 0), frame_rows) AS BIGINT) AS r0, CAST(least(greatest(ceil((fy1 - {AREA[1]}) / 30.0), 0), frame_rows) AS BIGINT) AS r1,
 CAST(least(greatest(floor(({AREA[0]} - fx0) / 30.0), 0), frame_cols) AS BIGINT) AS c0, CAST(least(greatest(ceil(({AREA[2]} - fx0) / 30.0), 0), frame_cols) AS BIGINT) AS c1 FROM f)"""
ORACLES = {
    "blocks_margin": """WITH RECURSIVE r(s) AS (SELECT 3 UNION ALL SELECT CASE WHEN s + 24 < 98 THEN s + 20 ELSE s + 24 END FROM r WHERE CASE WHEN s + 24 < 98 THEN s + 20 ELSE s + 24 END < 98),
c(s) AS (SELECT 5 UNION ALL SELECT CASE WHEN s + 20 < 63 THEN s + 18 ELSE s + 20 END FROM c WHERE CASE WHEN s + 20 < 63 THEN s + 18 ELSE s + 20 END < 63)
SELECT CAST(r.s AS INT) AS r0, CAST(least(r.s + 24, 98) AS INT) AS r1, CAST(c.s AS INT) AS c0, CAST(least(c.s + 20, 63) AS INT) AS c1 FROM r, c""",
    # output grid 50 x 32 in blocks of 16 x 10, border round(5/2) = 2 and round(7/3) = 2, padding 4 and 6
    "strided_blocks": """SELECT CAST(greatest(2*a - 4, 0) AS INT) AS r0, CAST(2*least(a + 16, 48) + 4 AS INT) AS r1, CAST(greatest(3*b - 6, 0) AS INT) AS c0, CAST(3*least(b + 10, 30) + 6 AS INT) AS c1
FROM (SELECT 2 + 16*k AS a FROM range(0, 3) t(k)) x, (SELECT 2 + 10*k AS b FROM range(0, 3) t(k)) y WHERE a < 48 AND b < 30""",
    "plan_tiles": """WITH a AS (SELECT 16*k AS o0, least(16*k + 16, 50) AS o1 FROM range(0, 4) t(k)), b AS (SELECT 16*k AS o0, least(16*k + 16, 32) AS o1 FROM range(0, 2) t(k)),
r AS (SELECT greatest(least(greatest(1 + o0*2 - 5, 0), 89) - 7, 0) // 2 * 2 AS r0, least((greatest(least(greatest(1 + (o1-1)*2 - 5, 0), 89) + 18, 2*o1) + 1) // 2 * 2, 100) AS r1 FROM a),
c AS (SELECT greatest(least(greatest(1 + o0*3 - 7, 0), 81) - 10, 0) // 3 * 3 AS c0, least((greatest(least(greatest(1 + (o1-1)*3 - 7, 0), 81) + 25, 3*o1) + 2) // 3 * 3, 96) AS c1 FROM b)
SELECT CAST(r0 AS INT) AS r0, CAST(r1 AS INT) AS r1, CAST(c0 AS INT) AS c0, CAST(c1 AS INT) AS c1 FROM r, c""",
    "frame_grid": f"WITH {_FOOT} SELECT * FROM f",
    "burst_offset": f"WITH {_FOOT} SELECT * FROM o",
    "aoi_snap": f"WITH {_SNAP} SELECT * FROM sn WHERE r0 < r1 AND c0 < c1",
    "rect_intersect": f"""WITH {_SNAP}, w AS (SELECT s_suppkey, greatest(r0, row_off) - row_off AS wr0, least(r1, row_off + rows) - row_off AS wr1, greatest(c0, col_off) - col_off AS wc0, least(c1, col_off + cols) - col_off AS wc1
 FROM b JOIN o USING (s_suppkey) JOIN sn USING (s_nationkey) WHERE r0 < r1 AND c0 < c1) SELECT * FROM w WHERE wr0 < wr1 AND wc0 < wc1""",
    "date_parse": """WITH f AS (SELECT o_orderpriority, arg_min(CAST(o_orderdate AS DATE), o_orderkey) AS first FROM orders GROUP BY 1)
SELECT o_orderkey, CAST(date_diff('day', first, CAST(o_orderdate AS DATE)) AS DOUBLE) AS days FROM orders JOIN f USING (o_orderpriority)""",
}

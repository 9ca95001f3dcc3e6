"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question re-asked with other
values keeps its template.  Windows of template tokens are hash-joined against the windows
of the benchmark (a stated query set); matches must line up on one diagonal, cover most of
the item, and fill its slots consistently: one item value always maps to one text value.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import table
from .textkernels import Words, groups, mix

WINDOW = 5
COVERAGE = 0.6  # share of an item's template windows that must match along a diagonal
SLACK = 3  # tokens by which matching parts may shift (insertions, deletions)
BLOCK_BYTES = 4 << 20  # of benchmark text that is broadcast together; as an index some fifty times that

# fixed values: unit words that count as a unit right after a number
UNITS = frozenset(
    "% $ € £ km m cm mm mi mile miles ft foot feet inch inches kg g mg lb lbs pound pounds oz ton tons l ml litre litres liter liters "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents percent degree degrees mph kmh k kb mb gb".split()
)
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million half".split())
_NUMBER = re.compile(r"[-+$€£]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th|%)?")
_NUMBER_UNIT = re.compile(r"([-+$€£]?\d+(?:[.,]\d+)*)([a-z%]{1,3})")
_EDGE = "\"'`()[]{}<>.,;:!?*#&|$%"
NUM, NAME, UNIT = "\x01num", "\x01name", "\x01unit"


def canonical(text: str) -> tuple[list[str], list[str]]:
    """Template tokens and the surface they stand for (equal but for slots).

    A name is a capitalised word that does not open a sentence; words are compared without
    case and edge punctuation.  Pure punctuation vanishes.
    """
    tokens, surface, opens, after_number = [], [], True, False
    for raw in text.split():
        word = raw.strip(_EDGE)
        low = word.lower()
        if not low:
            if raw.strip("$%€£") == "" and after_number:
                tokens.append(UNIT), surface.append(raw)
            opens = opens or raw[-1] in ".!?"
            continue
        joined = _NUMBER_UNIT.fullmatch(low)
        if _NUMBER.fullmatch(low) or low in NUMBER_WORDS:
            tokens.append(NUM), surface.append(low)
            after_number = True
        elif joined and joined[2] in UNITS:
            tokens += [NUM, UNIT]
            surface += [joined[1], joined[2]]
            after_number = False
        elif after_number and low in UNITS:
            tokens.append(UNIT), surface.append(low)
            after_number = False
        else:
            after_number = False
            if word[0].isupper() and not opens and not word.isupper():
                tokens.append(NAME), surface.append(low)
            else:
                tokens.append(low), surface.append(low)
        opens = raw[-1] in ".!?" or raw.endswith(("\n", ":"))
    return tokens, surface


def windows(tokens: list[str]) -> list[tuple[str, ...]]:
    """All windows of ``WINDOW`` tokens; a shorter item is one window of its own."""
    if not tokens:
        return []
    return [tuple(tokens[k : k + WINDOW]) for k in range(max(1, len(tokens) - WINDOW + 1))]


@dataclass
class Benchmark:
    """The items, indexed by the hash of their windows."""

    kind: str = "long"  # of the item ids
    items: list[tuple] = field(default_factory=list)  # (item id, tokens, surface)
    index: dict[tuple, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    anchors: np.ndarray | None = None

    def add(self, item_id, text: str | None) -> None:
        tokens, surface = canonical(text or "")
        at = len(self.items)
        self.items.append((item_id, tokens, surface))
        for k, w in enumerate(windows(tokens)):
            self.index[w].append((at, k))

    def matches(self, text: str) -> list[tuple]:
        """``(item id, share of windows, consistent slots, changed slots, exact tokens)`` of contained items."""
        tokens, surface = canonical(text)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        short = [n for n in {len(t) for _, t, _ in self.items} if 0 < n < WINDOW]
        for size in (WINDOW, *short):
            for p in range(len(tokens) - size + 1):
                for item, k in self.index.get(tuple(tokens[p : p + size]), ()):
                    hits[item].append((p, k))
        out = []
        for item, found in hits.items():
            best = self._align(item, found, tokens, surface)
            if best:
                out.append(best)
        return out

    def _align(self, item: int, found: list[tuple[int, int]], tokens: list[str], surface: list[str]) -> tuple | None:
        item_id, own, own_surface = self.items[item]
        total = max(1, len(own) - WINDOW + 1)
        by_diagonal: dict[int, set[int]] = defaultdict(set)
        place: dict[tuple[int, int], int] = {}
        for p, k in found:
            by_diagonal[p - k].add(k)
            place[p - k, k] = p
        best = None
        for diagonal in by_diagonal:
            # equal windows of a run of slots match on several diagonals: the central one goes first, then the nearest
            near = {k: d for d in sorted(range(diagonal - SLACK, diagonal + SLACK + 1), key=lambda d: -abs(d - diagonal)) for k in by_diagonal.get(d, ())}
            share = len(near) / total
            if share < COVERAGE or (best and share <= best[1]):
                continue
            maps: dict[tuple[str, str], Counter] = defaultdict(Counter)
            changed = 0
            for k, d in near.items():
                for j in range(min(WINDOW, len(own))):
                    if own[k + j][0] == "\x01":
                        maps[own[k + j], own_surface[k + j]][surface[k + d + j]] += 1
            consistent = all(len(c) == 1 for c in maps.values())
            changed = sum(next(iter(c)) != key[1] for key, c in maps.items())
            if consistent:
                best = (item_id, share, changed)
        return best


def load(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Benchmark:
    """A query set that is small enough to be one block; null texts hold nothing."""
    rows = benchmark.select(id_col, text_col)
    out, got = Benchmark(rows.schema[0].dataType.simpleString()), rows.toArrow()
    for item_id, text in zip(*(got[c].to_pylist() for c in (0, 1))):
        out.add(item_id, text)
    out.anchors = _anchors([t for _, t, _ in out.items])
    return out


def load_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> list[Benchmark]:
    """The stated query set in hash blocks of about ``block_bytes`` of text, as many as it takes; every text is held against every block."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(size / block_bytes))
    if blocks == 1:
        return [load(benchmark, id_col, text_col)]
    part = F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks))
    return [load(benchmark.where(part == k), id_col, text_col) for k in range(blocks)]


def _runs(tokens: list[str], n: int) -> list[int]:
    """Starts of ``n`` plain (not slot) tokens in a row."""
    plain = [t[0] != "\x01" for t in tokens]
    return [k for k in range(len(tokens) - n + 1) if all(plain[k : k + n])]


def _run_length(tokens: list[str]) -> int:
    """The longest n <= 3 such that every match of ``COVERAGE`` of the windows holds n plain tokens in a row; 0 if none."""
    total = max(1, len(tokens) - WINDOW + 1)
    for n in (3, 2):
        starts = _runs(tokens, n)
        holding = {w for k in starts for w in range(max(0, k + n - WINDOW), k + 1) if w < total}
        if len(holding) > (1 - COVERAGE) * total + 1e-9:
            return n
    return 0


def _combine(h: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(h[0]), np.uint64(len(h)))
    with np.errstate(over="ignore"):
        for x in h:
            out = mix(out * np.uint64(3) + x)
    return out


def _anchors(items: list[list[str]]) -> np.ndarray | None:
    """Hashes of the items' runs of plain words, by which texts are sieved; None if some item has no certain run."""
    out = [np.zeros(0, np.uint64)]
    for tokens in items:
        if not tokens:
            continue
        n = _run_length(tokens)
        if not n:
            return None
        starts = _runs(tokens, n)
        data = np.frombuffer(" ".join(t if t[0] != "\x01" else "?" for t in tokens).encode("utf-8", "surrogatepass"), np.uint8)
        h = Words(data, np.array([0, len(data)]), lower=False).hashes()
        at = np.array(starts)
        out.append(_combine([h[at + j] for j in range(n)]))
    return np.unique(np.concatenate(out))


# what str.split takes as white space beyond the separators of Words
_WIDE_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = np.zeros(256, bool)
_STRIP[[ord(c) for c in _EDGE]] = True


def candidates(data: np.ndarray, offsets: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Which lower-cased documents hold a run of two or three words that some item holds too."""
    words = Words(data, offsets, lower=False)
    starts, ends = words.starts.copy(), words.ends.copy()
    if len(starts) < 2 or not len(anchors):
        return np.zeros(words.n_docs, bool)
    moved = True
    while moved:  # edge punctuation comes in short runs
        left = (starts < ends) & _STRIP[words.data[np.minimum(starts, len(data) - 1)]]
        starts[left] += 1
        right = (starts < ends) & _STRIP[words.data[ends - 1]]
        ends[right] -= 1
        moved = left.any() or right.any()
    solid = starts < ends  # words of punctuation alone vanish
    h, doc = words.span_hash(starts[solid], ends[solid]), words.doc[solid]
    out = np.zeros(words.n_docs, bool)
    for n in (2, 3):
        if len(h) >= n:
            run = _combine([h[j : len(h) - n + 1 + j] for j in range(n)])
            k = np.minimum(np.searchsorted(anchors, run), len(anchors) - 1)
            hit = (anchors[k] == run) & (doc[: len(run)] == doc[n - 1 :])
            out[doc[: len(run)][hit]] = True
    return out


def contaminated(docs: DataFrame, bench: Benchmark | list[Benchmark], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, item_id, coverage, changed_slots)`` for every item a document holds.

    Whole texts are read.  Null and empty texts, and null and empty items, hold nothing; repeated rows and
    repeated items are each answered; an item counts once a document, at the diagonal of most coverage (the
    first of equals).  Empty tables give no rows; extra columns are not read.
    """
    if isinstance(bench, list):
        found = contaminated(docs, bench[0], id_col, text_col)
        for more in bench[1:]:
            found = found.unionByName(contaminated(docs, more, id_col, text_col))
        return found
    item_type = bench.kind
    item_arrow = to_arrow_type(docs.sparkSession.createDataFrame([], f"x {item_type}").schema[0].dataType)
    shared = docs.sparkSession.sparkContext.broadcast(bench)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = found_in(shared.value, batch.column(1))
            at = [d for d, _ in rows]
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([m[0] for _, m in rows], item_arrow), pa.array([m[1] for _, m in rows], pa.float64()), pa.array([m[2] for _, m in rows], pa.int32())],
                names=["id", "item_id", "coverage", "changed_slots"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, item_id {item_type}, coverage double, changed_slots int")


def found_in(bench: Benchmark, column: pa.Array) -> list[tuple[int, tuple]]:
    """``(position in column, match)`` for a column of texts."""
    column = column.fill_null("") if column.null_count else column
    if bench.anchors is None:
        keep = range(len(column))
    else:
        spaced = pc.replace_substring_regex(pc.utf8_lower(column), _WIDE_SPACE, " ")
        keep = [first + int(d) for first, _, data, offsets in groups(spaced) for d in np.flatnonzero(candidates(data, offsets, bench.anchors))]
    return [(d, m) for d in keep for m in bench.matches(column[d].as_py())]


def drop_contaminated(docs: DataFrame, bench: Benchmark | list[Benchmark], text_col: str = "text") -> DataFrame:
    """Rows that hold no item, with exactly their own columns."""
    if isinstance(bench, list):
        for one in bench:
            docs = drop_contaminated(docs, one, text_col)
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(bench)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[d for d, _ in found_in(shared.value, batch.column(at))]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = contaminated(docs, load_blocks(table(spark, sf_dir, "benchmark")))
    return found.withColumnRenamed("id", "doc_id")

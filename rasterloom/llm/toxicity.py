"""Toxicity by maximum-scoring segments over token log-odds.

Tokens are runs of letters; a token's evidence is the best lower confidence bound of the
log-odds of its whole form or one of its prefixes, under a Dirichlet prior; it counts once
in a segment, and again in a later one.  Every other token costs a fixed penalty.  A linear-time scan finds all maximal-scoring segments of a
document; extreme-value statistics (the chance that a clean text of that length holds such
a segment) turn scores into evidence, which is summed over significant segments and
calibrated to a probability.

Whole texts are read, in groups of whole documents; a null or empty text has no segment and the score of
that.  Rows with a null id or label are not learned from and a repeated id takes its largest label;
repeated rows score alike; of equal segments the first is reported.  Without toxic labels nothing has
evidence.  An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import held_out, table
from .textkernels import LOWER, Words, groups
from .training import in_training, labelled_sample, platt, sigmoid

PER_CLASS = 10_000  # training rows of a class
FOLDS, HELD = 3, 1
THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 7, 8, 10)
PRIOR = 1.0  # symmetric Dirichlet mass: documents added to each class with and without a feature
BOUND = 1.64  # standard errors below the estimate
MIN_DOCS = 3  # documents of the toxic class that must hold a feature
PENALTY = 1.0
SIGNIFICANT = 0.05

LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


class Tokens(Words):
    """Runs of letters (ASCII letters and all non-ASCII bytes), lower-cased in A-Z."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        super().__init__(np.where(LETTER[data], data, np.uint8(32)), offsets)
        self.data = LOWER[data]

    def levels(self, whole: np.ndarray, at: np.ndarray | slice = slice(None)) -> Iterator[np.ndarray]:
        """For tokens ``at`` of hashes ``whole``: these, then those of each prefix; a prefix longer than the token repeats the whole."""
        yield whole
        starts, length = self.starts[at], self.ends[at] - self.starts[at]
        for k in PREFIXES:
            out = whole.copy()
            longer = length > k
            if longer.any():
                out[longer] = self.span_hash(starts[longer], starts[longer] + k) ^ np.uint64(k)
            yield out


def maximal_segments(at: np.ndarray, gain: np.ndarray, penalty: float = PENALTY) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(first, last, score)`` where positions ``at`` score ``gain`` > 0 and all others ``-penalty``.

    Linear time: candidates are kept with their cumulative left and right sums and the place of the
    nearest candidate before with a smaller left sum, so a search skips all between; a new one absorbs
    those back to such a candidate while its right sum is smaller.
    """
    out: list[tuple[int, int, float, float, int]] = []  # first, last, left sum, right sum, nearest smaller left
    total, last_at = 0.0, -1
    for p, g in zip(at.tolist(), gain.tolist()):
        total -= penalty * (p - last_at - 1)
        first, left, j = p, total, len(out) - 1
        total += g
        last_at = p
        while True:
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= total:
                out.append((first, p, left, total, j))
                break
            first, _, left, _, nearest = out[j]
            del out[j:]
            j = nearest
    return [(a, b, r - l) for a, b, l, r, _ in out]


def distinct_segments(at: np.ndarray, gain: np.ndarray, form: np.ndarray, penalty: float = PENALTY) -> list[tuple[int, int, float]]:
    """Like :func:`maximal_segments`, where a ``form`` counts once in a segment and a repeat in it scores ``-penalty``.

    A run goes on while its score is above 0 and ends at its peak; walking back from there finds the start
    at which the forms up to the peak score most.  The search goes on behind the peak with no form counted,
    and before that start; a run reaches no further behind its peak than its score and new forms pay for.
    """
    if len(np.unique(form)) == len(form):
        return maximal_segments(at, gain, penalty)
    at, gain, form = at.tolist(), gain.tolist(), form.tolist()
    out: list[tuple[int, int, float]] = []
    todo = [(0, len(at))]
    while todo:
        i, stop = todo.pop()
        while i < stop:
            total, peak, end, seen, repeats, fewer = 0.0, 0.0, i, set(), 0, 0
            for j in range(i, stop):
                if j > i:
                    total -= penalty * (at[j] - at[j - 1] - 1)
                if total <= 0 and j > i:
                    break
                if form[j] in seen:
                    total, repeats = total - penalty, repeats + 1
                else:
                    seen.add(form[j])
                    total += gain[j]
                    if total > peak:
                        peak, end, fewer = total, j, repeats
            first = i
            if fewer:
                total, peak, seen = 0.0, 0.0, set()
                for j in range(end, i - 1, -1):
                    total -= penalty * (at[j + 1] - at[j] - 1) if j < end else 0.0
                    if form[j] in seen:
                        total -= penalty
                    else:
                        seen.add(form[j])
                        total += gain[j]
                        if total > peak:
                            peak, first = total, j
            out.append((at[first], at[end], peak))
            if first > i:
                todo.append((i, first))
            i = end + 1
    return sorted(out)


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of positive features
    gains: np.ndarray
    decay: float  # lambda of the extreme-value law
    search: float  # K of the extreme-value law
    slope: float
    offset: float

    def gain(self, tokens: Tokens, whole: np.ndarray) -> np.ndarray:
        """Evidence of each token, looked up once for each form of the group; ``whole`` has the tokens' hashes."""
        if not len(self.keys):
            return np.zeros(len(whole))
        forms, form = np.unique(whole, return_inverse=True)
        at = np.empty(len(forms), dtype=np.int64)
        at[form] = np.arange(len(whole))  # any token of a form stands for it
        best = np.zeros(len(forms))
        for h in tokens.levels(forms, at):
            k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            np.maximum(best, np.where(self.keys[k] == h, self.gains[k], 0.0), out=best)
        return best[form]

    def segments(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float, float]]]]:
        """Per document the token count and its segments ``(byte from, byte to, score, log10-free E-value)``."""
        for _, _, data, offsets in groups(column):
            tokens = Tokens(data, offsets)
            whole = tokens.hashes()
            gains = self.gain(tokens, whole)
            hit = np.flatnonzero(gains > 0)
            first = np.concatenate([[0], np.cumsum(tokens.per_doc)])
            cut = np.searchsorted(hit, first)
            for d in range(tokens.n_docs):
                own, m = hit[cut[d] : cut[d + 1]], int(tokens.per_doc[d])
                found = distinct_segments(own - first[d], gains[own], whole[own]) if len(own) else []
                base = int(offsets[d])
                yield m, [(int(tokens.starts[a + first[d]]) - base, int(tokens.ends[b + first[d]]) - base, s, self.expected(s, m)) for a, b, s in found]

    def expected(self, score: float, tokens: int) -> float:
        """Segments of at least this score expected in a clean text of so many tokens."""
        return self.search * max(tokens, 1) * math.exp(-self.decay * min(score, 700 / max(self.decay, 1e-9)))

    def evidence(self, column: pa.Array) -> np.ndarray:
        """Sum of -ln E over significant segments, 0 without any."""
        return np.array([sum(-math.log(max(e, 1e-300)) for _, _, _, e in found if e < SIGNIFICANT) for _, found in self.segments(column)])

    def score(self, column: pa.Array) -> np.ndarray:
        return sigmoid(self.slope * np.minimum(self.evidence(column), 100.0) + self.offset)


def fit_log_odds(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Positive features and their lower-bound log-odds, counted in documents of the sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.asarray(batch.column(0).cast(pa.int64()))
            for first, last, data, offsets in groups(batch.column(1)):
                tokens = Tokens(data, offsets)
                h = np.concatenate(list(tokens.levels(tokens.hashes())))
                doc = np.tile(tokens.doc, len(PREFIXES) + 1)
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, label = h[new], y[first:last][doc[new]]
                key, back = np.unique(h, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(np.bincount(back, label == 0, len(key)).astype(np.int64)), pa.array(np.bincount(back, label == 1, len(key)).astype(np.int64))], names=["h", "n0", "n1"]
                )

    counts = sample.select("y", "text").mapInArrow(count, "h long, n0 long, n1 long").groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = max(size.get(0, 0), 1), max(size.get(1, 0), 1)
    # posterior log-odds of holding the feature, under the symmetric prior in either class
    odds = F.log((F.col("n1") + PRIOR) / (n1 + 2 * PRIOR)) - F.log((F.col("n0") + PRIOR) / (n0 + 2 * PRIOR))
    error = F.sqrt(1 / (F.col("n1") + PRIOR) + 1 / (F.col("n0") + PRIOR))
    # features of the bounded sample: those in few toxic documents never reach the driver
    top = counts.where(F.col("n1") >= MIN_DOCS).select("h", (odds - BOUND * error).alias("g")).where("g > 0").toArrow()
    keys = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top["g"].to_numpy()[order]


def fit(sample: DataFrame) -> Model:
    """``sample`` holds ``doc_id``, ``text`` and 0/1 ``y``."""
    keys, gains = fit_log_odds(sample)
    plain = Model(keys, gains, 1.0, 1.0, 1.0, 0.0)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(plain.segments(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([m for m, _ in found], pa.int64()), pa.array([[s for _, _, s, _ in x] for _, x in found], pa.list_(pa.float64()))], names=["y", "m", "s"]
            )

    got = sample.select("y", "text").mapInArrow(best, "y long, m long, s array<double>").toArrow()
    y, m, s = got["y"].to_numpy(), got["m"].to_numpy().astype(float), got["s"].to_pylist()
    clean = [(mm, max(x, default=0.0)) for yy, mm, x in zip(y, m, s) if yy == 0]
    decay, search = extreme_value(clean)
    model = Model(keys, gains, decay, search, 1.0, 0.0)
    evidence = np.array([min(100.0, sum(max(0.0, -math.log(max(model.expected(v, mm), 1e-300))) for v in x if model.expected(v, mm) < SIGNIFICANT)) for mm, x in zip(m, s)])
    model.slope, model.offset = platt(evidence, y)
    if model.slope <= 0 and len(set(y.tolist())) == 2:
        model.slope = 0.0
    return model


def extreme_value(clean: list[tuple[float, float]]) -> tuple[float, float]:
    """lambda and K from the best segment of each clean document: exceedances over 0 are taken as exponential in tail."""
    best = np.array([s for _, s in clean if s > 0])
    tokens = sum(m for m, _ in clean)
    if len(best) < 5 or tokens <= 0:
        return 1.0, 1.0 / max(tokens, 1.0)
    floor = float(np.quantile(best, 0.5))
    decay = 1.0 / max(float((best[best >= floor] - floor).mean()), 0.2)
    # E(floor) over all clean tokens equals the number of documents at or above it
    return decay, float((best >= floor).sum()) / tokens * math.exp(decay * floor)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, n_segments, first_from, first_to)``; offsets are bytes of the strongest significant segment."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 16 bytes a positive feature of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = shared.value
            found = [[x for x in segs if x[3] < SIGNIFICANT] for _, segs in model.segments(batch.column(1))]
            evidence = np.array([min(100.0, sum(-math.log(max(x[3], 1e-300)) for x in f)) for f in found])
            top = [max(f, key=lambda x: x[2], default=None) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sigmoid(model.slope * evidence + model.offset), pa.float64()), pa.array([len(f) for f in found], pa.int32()),
                 pa.array([t and t[0] for t in top], pa.int32()), pa.array([t and t[1] for t in top], pa.int32())],
                names=["id", "score", "n_segments", "top_from", "top_to"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double, n_segments int, top_from int, top_to int")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    usable = labels.select("doc_id", "toxic").where(in_training("doc_id", FOLDS, HELD))
    return fit(labelled_sample(docs.select("doc_id", "text"), usable, "doc_id", "toxic", [0, 1], PER_CLASS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select(
        F.col("id").alias("doc_id"), held_out(F.col("id"), FOLDS, HELD).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_segments", "top_from", "top_to",
    )

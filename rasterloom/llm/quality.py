"""Quality classifier: naive Bayes support vectors.

Binary indicators of byte n-grams and word-shape n-grams are scaled by class log-count
ratios; a linear hinge-loss model is fitted on the scaled indicators by dual coordinate
descent, and its margin is calibrated to a probability.

Whole texts are read, in groups of whole documents; null text is empty text and has features of none, so all empty
texts score alike.  Rows with a null id or label are not learned from, a repeated id takes its largest
label; repeated rows score alike.  With fewer than two classes every score is the smoothed class share.  An
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import held_out, table
from .textkernels import Words, byte_ngrams, groups, mix
from .training import in_training, labelled_sample, platt, sigmoid

BITS = 18
PER_CLASS = 4000  # training rows of a class; the sample is at most twice that
SMOOTHING = 1.0
COST = 0.1
EPOCHS = 12
CALIBRATION_SHARE = 0.25
FOLDS, HELD = 5, 0
KEEP_AT = 0.3


def _shapes(words: Words, hashes: np.ndarray) -> np.ndarray:
    """A small code per word: case of its first two bytes, class of its last byte, equality with the word before."""
    raw = words.raw
    first, last = raw[words.starts], raw[words.ends - 1]
    second = raw[np.minimum(words.starts + 1, words.ends - 1)]
    upper = lambda b: (b >= 65) & (b <= 90)
    letter = lambda b: ((b | 32) >= 97) & ((b | 32) <= 122) | (b >= 128)
    same = np.zeros(len(first), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    tail = np.where(letter(last), 0, last)
    length = np.minimum(words.ends - words.starts, 24) // 4
    return (tail.astype(np.int64) << 8) | (length << 4) | (upper(first) << 3) | (upper(second) << 2) | (letter(first) << 1) | same


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each document of a group the distinct feature indices, unsorted."""
    parts = [byte_ngrams(data, offsets, 3)]
    words = Words(data, offsets)
    if len(words.starts):
        shape = _shapes(words, words.hashes()).astype(np.uint64)
        for n in (1, 2, 3):
            if len(shape) < n:
                continue
            code = np.full(len(shape) - n + 1, np.uint64(1000 + n))
            for k in range(n):
                code = mix(code) + shape[k : len(shape) - n + 1 + k]
            inside = words.doc[: len(code)] == words.doc[n - 1 :]
            parts.append((mix(code[inside]), words.doc[: len(code)][inside]))
    seen = np.zeros(1 << BITS, dtype=np.int32)
    bounds = [(f >> np.uint64(64 - BITS), np.searchsorted(owner, np.arange(len(offsets)))) for f, owner in parts]
    for d in range(len(offsets) - 1):
        f = np.concatenate([x[b[d] : b[d + 1]] for x, b in bounds]).astype(np.int64)
        order = np.arange(len(f), dtype=np.int32)
        seen[f] = order  # the last occurrence of a feature is its representative
        yield f[seen[f] == order]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, column: pa.Array) -> np.ndarray:
        out = []
        for _, _, data, offsets in groups(column):
            out += [float(self.weights[f].sum()) / np.sqrt(len(f) + 1.0) + self.bias for f in features(data, offsets)]
        return np.array(out, dtype=np.float64)

    def score(self, column: pa.Array) -> np.ndarray:
        return sigmoid(self.slope * self.margins(column) + self.offset)


def packed(f: np.ndarray) -> bytes:
    """Feature indices as numbers, or as a bitmap where that is smaller: at most 2**BITS / 8 bytes."""
    if 4 * len(f) < (1 << BITS) // 8:
        return f.astype(np.int32).tobytes()
    bits = np.zeros(1 << BITS, bool)
    bits[f] = True
    return np.packbits(bits).tobytes()


class Sample:
    """Feature indices per row, unpacked when asked for: a sample takes at most 2 x PER_CLASS x 2**BITS / 8 bytes."""

    def __init__(self, data: list[bytes]) -> None:
        self.data = data

    def __len__(self) -> int:
        return len(self.data)

    def __getitem__(self, i: int) -> np.ndarray:
        b = self.data[i]
        return np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8))).astype(np.int32) if len(b) == (1 << BITS) // 8 else np.frombuffer(b, np.int32)

    def __iter__(self) -> Iterator[np.ndarray]:
        return (self[i] for i in range(len(self.data)))


def log_count_ratios(rows: Sample | list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """ln of the ratio of smoothed, normalised indicator counts of class 1 to class 0."""
    counts = np.full((2, 1 << BITS), SMOOTHING)
    for f, label in zip(rows, y):
        counts[int(label), f] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """L1-loss linear SVM in the dual; classes are weighted to equal total cost.

    Rows are the scaled indicators divided by the square root of their number, plus a bias input of 1.
    """
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.array([(y == c).sum() for c in (0, 1)], dtype=float)
    cap = COST * len(y) / (2 * share[y.astype(int)])
    norm = np.array([float((scale[f] ** 2).sum()) / (len(f) + 1.0) + 1.0 for f in rows])
    alpha, w, bias, rng = np.zeros(len(y)), np.zeros(len(scale)), 0.0, np.random.default_rng(seed)
    for _ in range(EPOCHS):
        worst = 0.0
        for i in rng.permutation(len(y)):
            f = rows[i]
            v = scale[f] / np.sqrt(len(f) + 1.0)
            gradient = sign[i] * (float(w[f] @ v) + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cap[i])
            change = (new - alpha[i]) * sign[i]
            if change:
                w[f] += change * v
                bias += change
                worst = max(worst, abs(change))
            alpha[i] = new
        if worst < 1e-4:
            break
    return w * scale, bias


def fit(sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a sample with 0/1 column ``y``.  With fewer than two classes the score is the smoothed class share."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [packed(f) for _, _, data, offsets in groups(batch.column(2)) for f in features(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(rows, pa.binary())], names=["id", "y", "f"])

    kind = sample.schema[id_col].dataType.simpleString()
    got = sample.select(id_col, "y", text_col).mapInArrow(extract, f"id {kind}, y int, f binary").toArrow().sort_by("id")
    y = got["y"].to_numpy()
    rows = Sample([b.as_py() for b in got["f"]])
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, float(np.log((y.sum() + 1) / ((1 - y).sum() + 1))))
    scale = log_count_ratios(rows, y)
    # the calibration part is left out of the support vectors that calibrate
    part = np.random.default_rng(11).random(len(y)) < CALIBRATION_SHARE
    if len(set(y[~part].tolist())) == 2 and len(set(y[part].tolist())) == 2:
        inner = Sample([rows.data[i] for i in np.flatnonzero(~part)])
        w, b = dual_coordinate_descent(inner, log_count_ratios(inner, y[~part]), y[~part])
        margin = np.array([float(w[rows[i]].sum()) / np.sqrt(len(rows[i]) + 1.0) + b for i in np.flatnonzero(part)])
        slope, offset = platt(margin, y[part])
    else:
        slope, offset = 1.0, 0.0
    w, b = dual_coordinate_descent(rows, scale, y)
    return Model(w.astype(np.float32), b, slope, offset)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every row; null text is empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1)), pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Labels of the held-out fold are never read."""
    usable = labels.select(id_col, label_col).where(in_training(id_col, FOLDS, HELD))
    texts = docs.select(id_col, text_col)
    if id_col != "doc_id" or text_col != "text":
        texts = texts.toDF("doc_id", "text")
        usable = usable.withColumnRenamed(id_col, "doc_id")
    return fit(labelled_sample(texts, usable, "doc_id", label_col, [0, 1], PER_CLASS))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """Rows whose score reaches ``keep_at``, with exactly their own columns: a per-batch filter with no join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(batch.column(at)) >= keep_at))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id"), FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))

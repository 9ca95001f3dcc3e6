"""Language identification with error-correcting output codes.

Each language gets a binary codeword; one binary n-gram classifier per bit tells the
languages with a 1 from those with a 0.  Decoding sums a logistic loss over bits, weighted
by how well each bit did on its training sample, and takes the nearest codeword; a small
gap to the second codeword flags ambiguity.

Whole texts are read, in groups of whole documents.  A null or empty text, or one without letters, is
``und`` with score 0; so is every text when no language is labelled.  With one language all others
are that one.  Rows with a null id or language are not learned from; repeated rows are predicted alike and a
repeated id is learned from once for each of its rows; ties between codewords go to the first language by
name.  An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import held_out, table, written
from .textkernels import LOWER, byte_ngrams, groups
from .training import labelled_sample, platt, sigmoid

BITS = 16
ORDERS = (1, 2, 3, 4)
PER_LANGUAGE = 2000
LANGUAGES_AT_ONCE = 64  # whose counts are on the driver together
FOLDS, HELD = 4, 2
SMOOTHING = 0.5
AMBIGUOUS_BELOW = 0.9

FOLD = LOWER.copy()
FOLD[[b for b in range(128) if not (97 <= b <= 122 or 65 <= b <= 90)]] = 32


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """``n`` rows of 0/1; all splits into two non-empty sides up to 7 languages, else random rows far apart."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 7:
        columns = [c for c in itertools.product((0, 1), repeat=n) if c[0] == 1 and sum(c) < n]
        return np.array(columns, dtype=np.int8).T
    rng, width = np.random.default_rng(seed), math.ceil(10 * math.log2(n))
    best = None
    for _ in range(max(3, 200 * 64 // max(n, 64))):
        code = rng.integers(0, 2, (n, width), dtype=np.int8)
        code[0, code.sum(axis=0) == 0] = 1
        code[0, code.sum(axis=0) == n] = 0
        signs = 2.0 * code - 1
        gap = (width - (signs @ signs.T - 2 * width * np.eye(n)).max()) / 2  # least distance of two rows
        if best is None or gap > best[0]:
            best = (gap, code)
    return best[1]


def has_letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = np.concatenate([[0], np.cumsum((((data | 32) >= 97) & ((data | 32) <= 122)))])
    out = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for d in np.flatnonzero(~out):
        out[d] = any(c.isalpha() for c in data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace"))
    return out


def ngram_features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed n-grams of letters by order: feature and owner."""
    folded = FOLD[data]
    for n in ORDERS:
        h, owner = byte_ngrams(folded, offsets, n)
        yield (h >> np.uint64(64 - BITS)).astype(np.int64), owner


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # 2**BITS x bits
    slope: np.ndarray
    offset: np.ndarray
    trust: np.ndarray

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total, count = np.zeros((n, self.weights.shape[1])), np.zeros(n)
        for f, owner in ngram_features(data, offsets):
            for b in range(self.weights.shape[1]):
                total[:, b] += np.bincount(owner, self.weights[f, b], n)
            count += np.bincount(owner, minlength=n)
        return total / np.sqrt(np.maximum(count, 1))[:, None]

    def decode(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        langs, scores, doubts = [], [], []
        if not self.languages:
            return ["und"] * len(column), np.zeros(len(column)), np.zeros(len(column), bool)
        for _, _, data, offsets in groups(column):
            z = self.slope * self.margins(data, offsets) + self.offset
            sign = 2.0 * self.code - 1.0
            loss = (np.logaddexp(0, -z[:, None, :] * sign[None, :, :]) * self.trust).sum(axis=2)
            p = np.exp(loss.min(axis=1, keepdims=True) - loss)
            p /= p.sum(axis=1, keepdims=True)
            best, known = p.argmax(axis=1), has_letters(data, offsets)
            langs += [self.languages[b] if k else "und" for b, k in zip(best, known)]
            scores.append(np.where(known, p[np.arange(len(p)), best], 0.0))
            doubts.append(known & (scores[-1] < AMBIGUOUS_BELOW))
        return langs, np.concatenate(scores or [np.zeros(0)]), np.concatenate(doubts or [np.zeros(0, bool)])


def fit(sample: DataFrame, languages: list[str]) -> Model:
    """``sample`` holds ``text`` and language ``y``.  The driver holds one weight a bit and n-gram, and counts of a few languages at a time."""
    index = {x: i for i, x in enumerate(languages)}
    code = codewords(len(languages))
    if len(languages) < 2:
        one = np.zeros((1 << BITS, 1), np.float32)
        return Model(languages, code, one, np.zeros(1), np.ones(1), np.ones(1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            y = np.array([index[v.as_py()] for v in batch.column(0)])
            for first, last, data, offsets in groups(batch.column(1)):
                for f, owner in ngram_features(data, offsets):
                    label = y[first:last][owner]
                    for k in np.unique(label):
                        total[k] = total.get(k, 0) + np.bincount(f[label == k], minlength=1 << BITS)
        for k, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["y", "f", "c"])

    found = sample.select("y", "text").mapInArrow(count, "y int, f int, c long").groupBy("y", "f").agg(F.sum("c").alias("c"))
    blocks = math.ceil(len(languages) / LANGUAGES_AT_ONCE)
    if blocks > 1:  # read once a block
        found = written(found.repartition(blocks), "language-counts")
    on, off = code.T.astype(float), 1.0 - code.T
    side_on, side_off = np.zeros((len(on), 1 << BITS)), np.zeros((len(on), 1 << BITS))
    for first in range(0, len(languages), LANGUAGES_AT_ONCE):
        got = found.where(F.col("y").between(first, first + LANGUAGES_AT_ONCE - 1)).toArrow()
        counts = np.zeros((min(LANGUAGES_AT_ONCE, len(languages) - first), 1 << BITS))
        counts[got["y"].to_numpy() - first, got["f"].to_numpy()] = got["c"].to_numpy()
        share = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)
        own = slice(first, first + len(share))
        side_on += on[:, own] @ share
        side_off += off[:, own] @ share
    weights = np.log(side_on / on.sum(axis=1, keepdims=True)) - np.log(side_off / off.sum(axis=1, keepdims=True))
    bits = code.shape[1]
    model = Model(languages, code, np.ascontiguousarray(weights.T.astype(np.float32)), np.ones(bits), np.zeros(bits), np.ones(bits))

    def margin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.concatenate([model.margins(data, offsets) for _, _, data, offsets in groups(batch.column(1))] or [np.zeros((0, bits))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(z), pa.list_(pa.float64()))], names=["y", "z"])

    got = sample.select("y", "text").mapInArrow(margin, "y string, z array<double>").toArrow()
    z, y = np.array(got["z"].to_pylist()), np.array([index[v] for v in got["y"].to_pylist()])
    for b in range(bits):
        model.slope[b], model.offset[b] = platt(z[:, b], code[y, b])
        right = ((model.slope[b] * z[:, b] + model.offset[b] > 0) == (code[y, b] == 1)).mean()
        model.trust[b] = max(2 * right - 1, 0.01)
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Languages are all non-null values outside the held-out fold; one row each reaches the driver."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    usable = base.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD))
    languages = sorted(r["lang"] for r in usable.select("lang").distinct().collect())
    sample = labelled_sample(base.select("doc_id", "text"), usable.select("doc_id", "lang"), "doc_id", "lang", languages, PER_LANGUAGE) if languages else None
    return fit(sample, languages)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score, ambiguous)`` per row; ``und`` with score 0 without letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, doubts = shared.value.decode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(doubts, pa.bool_())], names=["id", "lang_pred", "score", "ambiguous"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, lang_pred string, score double, ambiguous boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id"), FOLDS, HELD).alias("held_out"), "lang_pred", "score", "ambiguous")

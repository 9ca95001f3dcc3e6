"""Bounded, stratified training samples and small linear-model helpers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import unused


PARTS = 64  # of a class, ranked apart first
FEW_CLASSES = 16


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, classes: list, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled rows of each class, in hash order of the id: columns of ``docs`` plus ``y``.

    ``labels`` holds ``id_col`` and ``label_col``; null ids and labels are ignored and a repeated
    id takes its largest label.  At most ``per_class * len(classes)`` ids are broadcast.
    """
    y = unused(docs, "y")[0]
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias(y))
    order = [F.xxhash64(id_col), F.col(id_col)]
    if len(classes) <= FEW_CLASSES:  # a top-k each: a task hands on no more rows than are wanted
        picked = None
        for value in classes:
            some = known.where(F.col(y) == value).orderBy(*order).limit(per_class)
            picked = some if picked is None else picked.union(some)
    else:  # the same rows: the first of each part of a class, then of the class, so no task meets a whole class
        known = known.where(F.col(y).isin(classes)).withColumn("_part", F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(PARTS)))
        for keys in ([y, "_part"], [y]):
            known = known.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= per_class).drop("_rank")
        picked = known.drop("_part")
    return docs.join(F.broadcast(picked), id_col)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic fit of 0/1 ``y`` on ``x`` with softened targets (Newton steps)."""
    pos, neg = float((y == 1).sum()), float((y == 0).sum())
    if not pos or not neg:
        return 0.0, float(np.log((pos + 1) / (neg + 1)))
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.ones_like(x) if weight is None else weight
    a, b = 0.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(steps):
        p = sigmoid(a * x + b)
        g, h = w * (p - target), w * np.maximum(p * (1 - p), 1e-9)
        ga, gb = float((g * x).sum()) + 1e-6 * a, float(g.sum())
        haa, hab, hbb = float((h * x * x).sum()) + 1e-6, float((h * x).sum()), float(h.sum()) + 1e-9
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (ga * hbb - gb * hab) / det, (gb * haa - ga * hab) / det
        step = min(1.0, 5.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-9:
            break
    return a, b


def in_training(id_col: str, modulus: int, remainder: int) -> Column:
    return ~(F.crc32(F.col(id_col).cast("string")) % modulus == remainder)

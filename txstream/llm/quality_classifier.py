"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products.

Fitting takes a bounded sample of labelled rows (``SAMPLE`` ids at most, those of smallest md5) outside the held-out
fold and passes over it ``PASSES`` times; the weights are one array of 2**BITS numbers, whatever the input. Scoring is
one pass over whole texts without a shuffle.

Defined cases: null and empty texts score by the bias alone; very long texts are read whole, in pieces that change
nothing; a score of 0.5 exactly predicts 1; an id with several labels counts once, with the larger one, and of several rows
with one id the first by partition is learnt from; ids of equal md5 don't occur, as ids are distinct; repeated rows are
scored each; null ids are not held out and stay null; no labelled rows give the score 0.5 for all; an empty table gives
none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts
from .features import vector
from .labelled import labelled_ids, vectors

BITS = 20
SAMPLE = 6_000
PASSES = 4
_SCORES = "doc_id long, held_out boolean, score double, predicted int"


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss; the bias is a coordinate of its own without regularisation."""

    bits: int = BITS
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros(1 << self.bits), np.zeros(1 << self.bits)
        self.bias_z = self.bias_n = 0.0

    def weights(self, index: np.ndarray | slice) -> np.ndarray:
        z = self.z[index]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) > self.l1, shrunk / ((self.beta + np.sqrt(self.n[index])) / self.alpha + self.l2), 0.0)

    @property
    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def update(self, index: np.ndarray, value: np.ndarray, label: int) -> float:
        """One example; gives the probability predicted before it."""
        w, bias = self.weights(index), self.bias
        p = _sigmoid(float(w @ value) + bias)
        g = (p - label) * value
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g
        g0 = p - label
        self.bias_z += g0 - ((self.bias_n + g0 * g0) ** 0.5 - self.bias_n**0.5) / self.alpha * bias
        self.bias_n += g0 * g0
        return p


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return _sigmoid(float(self.weights[index] @ value) + self.bias)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, limit: int = SAMPLE, passes: int = PASSES, bits: int = BITS) -> Model:
    """Fit on at most ``limit`` labelled ids for which ``usable`` (a condition on doc_id) holds."""
    ids = labelled_ids(labels, "quality", F.lit(True) if usable is None else usable, limit)
    rows = vectors(docs, ids, lambda text: vector(text, bits))
    learner, order = Ftrl(bits), np.random.default_rng(0)
    for _ in range(passes):
        for k in order.permutation(len(rows)):
            _, label, index, value = rows[k]
            learner.update(index, value, label)
    return Model(learner.weights(slice(None)).astype(np.float32), learner.bias, bits)


def score(docs: DataFrame, model: Model, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, score in [0, 1], predicted (1 from 0.5 on) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits weights: of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = np.array([m.score(*vector(t, m.bits)) for t in texts(batch.column(2))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.lit(False) if held_out is None else held_out
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("string")).mapInArrow(run, _SCORES)

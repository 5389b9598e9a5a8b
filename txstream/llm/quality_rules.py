"""Quality rules: counted rules, then hashed word and character n-gram logistic regression with calibrated probability.

The verdict of the model is its calibrated probability of a good text against the fixed ``THRESHOLD``. Fitting takes a
bounded sample of labelled rows (``SAMPLE`` ids of smallest md5): four fifths of it fit the regression by AdaGrad, the
rest fits the two numbers of the calibration (Platt). Scoring is one pass over whole texts in Arrow batches, no shuffle.

Defined cases: a null text has no words and fails the base rules, as an empty one does; very long texts are read whole,
in pieces that change nothing; a probability of the threshold exactly keeps; an id with several labels counts once, with
the larger one; repeated rows are judged each; null ids stay null; without labelled rows every probability is 1, so the
base rules alone decide; an empty table gives none; other columns are ignored, and columns in ``carry`` come back under
names of their own, whatever theirs are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, frugal, mixed, texts
from .features import NAME, vector
from .labelled import labelled_ids, vectors

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
THRESHOLD = 0.5
BITS, CHARS = 20, 4
SAMPLE, PASSES, RATE = 4_000, 5, 0.5
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
_RULES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that are found twice or more in the text, the first ones included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    k = len(number)
    pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
    _, at, counts = np.unique(pairs[:-1] * k + ids[2:], return_inverse=True, return_counts=True)
    often = counts[at] > 1
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= often
    return int(covered.sum())


def base(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text in UTF-8."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), chars, len(text.translate(None, _NOT_SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED * n_words


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    bits: int
    chars: int

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(self.weights[index] @ value) + self.bias

    def probability(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(index, value) + self.shift, -35, 35))))


def platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibrated log-odds, by Newton steps with smoothed targets."""
    good = labels.sum()
    bad = len(labels) - good
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    w = np.array([1.0, 0.0])
    loss = lambda v: float(np.sum(np.logaddexp(0, x @ v) - target * (x @ v)) + 5e-7 * v @ v)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - target) + 1e-6 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), gradient)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-4:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return float(w[0]), float(w[1])


def fit_vectors(rows: list[tuple[int, int, np.ndarray, np.ndarray]], bits: int, chars: int, passes: int = PASSES) -> Model:
    held = [zlib.crc32(f"calibration {r[0]}".encode()) % 5 == 0 for r in rows]
    train = [r for r, h in zip(rows, held) if not h]
    weights, squares, bias, bias_square = np.zeros(1 << bits), np.full(1 << bits, 1e-3), 0.0, 1e-3
    order = np.random.default_rng(0)
    for _ in range(passes):
        for k in order.permutation(len(train)):
            _, label, index, value = train[k]
            g = 1 / (1 + np.exp(-np.clip(weights[index] @ value + bias, -35, 35))) - label
            squares[index] += (step := g * value) ** 2
            weights[index] -= RATE * step / np.sqrt(squares[index])
            bias_square += g * g
            bias -= RATE * g / np.sqrt(bias_square)
    model = Model(weights.astype(np.float32), float(bias), 1.0, 0.0, bits, chars)
    rest = [r for r, h in zip(rows, held) if h]
    model.slope, model.shift = platt(np.array([model.margin(i, v) for _, _, i, v in rest]), np.array([r[1] for r in rest])) if rest else (1.0, 0.0)
    if not train:
        model.shift = 35.0
    return model


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, limit: int = SAMPLE, bits: int = BITS, chars: int = CHARS) -> Model:
    ids = labelled_ids(labels, "quality", F.lit(True) if usable is None else usable, limit)
    return fit_vectors(vectors(docs, ids, lambda text: vector(text, bits, chars)), bits, chars)


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """The rules' columns for every row, and the columns named in ``carry`` as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits weights: of fixed size
    fields = [x.split()[0] for x in _RULES.split(", ")]

    rows, places = carried(docs, carry, [F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("t")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = []
            for t in texts(batch.column(1)):
                n_words, word_chars, n_symbols, n_dup_lines, n_repeat = base(t or b"")
                failed = base_failed(n_words, n_repeat)
                p = m.probability(*vector(t, m.bits, m.chars))
                out.append((n_words, word_chars, n_symbols, n_dup_lines, n_repeat, failed, not failed and p >= threshold, p))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            made = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 8, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *[batch.column(k) for k in places]], names=[*fields, *(f"carry_{k}" for k in range(len(carry)))])

    types = "".join(f", carry_{k} {rows.schema.fields[at].dataType.simpleString()}" for k, at in enumerate(places))
    return rows.mapInArrow(frugal(run, NAME), _RULES + types)

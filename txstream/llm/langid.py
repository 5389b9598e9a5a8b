"""Language ID by mixture inference: how much of a document each language accounts for, and which set of languages.

A document is a mixture of words, each drawn from one language; a language gives a word the product of its letters'
trigram likelihoods. For a set of languages, expectation-maximisation finds the proportions and their log-likelihood. The
document's set is the one whose log-likelihood, less a penalty for each language beyond the first (``PENALTY`` x log of
the words, as the Bayesian information criterion has it), is greatest: from the best single language and from all of
them, languages are added, dropped and exchanged as long as that pays. The likelihood is concave in the proportions, so
that of all languages together bounds every set's; where even it doesn't pay for a second language, one is the answer.

Fitting counts the trigrams of a bounded sample: ``SAMPLE`` ids of smallest md5 of each language. The model is one array
of 2**BITS x languages, whatever the input. The background takes all trigrams of the learnt letters as equally likely: a
document that it explains better than the document's own mixture does is in none of the languages. Inference is one pass
over whole texts without a shuffle.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; null languages aren't learnt from; with
no learnt language all is ``und``; equal likelihoods and equal proportions go to the first language in order; very long
texts are taken whole, in pieces that end between words, so that the pieces change nothing; repeated rows are judged each
and counted each in fitting; null ids aren't held out; an empty table gives none; other columns are ignored, and columns
in ``carry`` come back under names of their own, whatever theirs are.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, frugal

UNKNOWN = "und"
BITS = 16
#: Ids of each language that are learnt from.
SAMPLE = 1_000
SMOOTHING = 0.5
PENALTY = 1.0
STEPS, TOLERANCE = 100, 1e-4
_COUNTS = "lang string, index binary, n binary, letters binary"
_FOUND = "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, proportions array<double>, gain double"
#: Longer texts are taken in pieces of so many characters and what is left of the word there, to bound memory.
PIECE = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000)


def pieces(text: str) -> Iterator[str]:
    """A lower-cased text in pieces that end where a letter run does."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end


def _codes(text: str) -> np.ndarray:
    """Code points of a lower-cased text, 0 for what is no letter, with an edge before and behind."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.concatenate([[0], np.where(_letters()[codes], codes, 0), [0]]).astype(np.uint64)


def trigrams(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the letter runs of a lower-cased text, with an edge before and behind each; where each run's begin."""
    codes = _codes(text)
    centre = np.flatnonzero(codes)
    if not len(centre):
        return centre, centre
    x = (codes[centre - 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[centre] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (codes[centre + 1] * np.uint64(0x165667B19E3779F9))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - bits)).astype(np.int64), np.flatnonzero(codes[centre - 1] == 0)


@dataclass
class Model:
    languages: list[str]
    loglik: np.ndarray  # 2**bits x languages
    alphabet: int = 0  # letters that were seen
    bits: int = BITS

    def read(self, text: str) -> tuple[np.ndarray, float]:
        """Log-likelihood of each word (rows) in each language, and of the whole text in the background."""
        parts, letters = [], 0
        for piece in pieces(text.lower()):
            index, starts = trigrams(piece, self.bits)
            if len(index):
                parts.append(np.add.reduceat(self.loglik[index], starts, axis=0))
                letters += len(index)
        return (np.concatenate(parts) if parts else np.zeros((0, len(self.languages)))), -3 * letters * float(np.log(self.alphabet + 1))

    def words(self, text: str) -> np.ndarray:
        return self.read(text)[0]


def mixture(words: np.ndarray, steps: int = STEPS, enough: float | None = None) -> tuple[np.ndarray, float, float]:
    """Proportions of the languages by expectation-maximisation, the log-likelihood they give, and a bound of any.

    Once the bound is no more than ``enough``, which is looked at after 1, 2, 4, ... steps, they are as good as needed.
    """
    n, k = words.shape
    top = words.max(axis=1)
    p = np.exp(words - top[:, None])
    share = np.full(k, 1 / k)
    for step in range(steps):
        both = p @ share
        pull = (p / both[:, None]).sum(axis=0) / n  # at the greatest likelihood, 1 or less for every language
        if pull.max() - 1 < TOLERANCE / n:
            break
        if enough is not None and not step & (step - 1) and float(np.log(both).sum() + top.sum()) + n * float(np.log(pull.max())) <= enough:
            break
        share = share * pull
    loglik = float(np.log(p @ share).sum() + top.sum())
    return share, loglik, loglik + n * float(np.log(max(1.0, pull.max())))


def infer(words: np.ndarray, penalty: float = PENALTY) -> tuple[list[int], np.ndarray, float]:
    """The languages of a document, the largest first, the proportion of each of them, and their log-likelihood.

    ``words`` has at least one row and one column.
    """
    n, k = words.shape
    price = penalty * np.log(n + 1)
    single = words.sum(axis=0, dtype=np.float64)
    best = int(np.argmax(single))
    found = [best], np.ones(1), float(single[best])
    if k == 1:
        return found
    every = mixture(words, enough=found[2] + price)
    if every[2] - price <= found[2]:
        return found
    known: dict[tuple[int, ...], tuple[np.ndarray, float]] = {(j,): (np.ones(1), float(single[j])) for j in range(k)}
    known[tuple(range(k))] = every[:2]

    def worth(chosen: tuple[int, ...]) -> float:
        if chosen not in known:
            known[chosen] = mixture(words[:, list(chosen)])[:2]
        return known[chosen][1] - price * (len(chosen) - 1)

    def climbed(chosen: tuple[int, ...]) -> tuple[int, ...]:
        while True:
            rest = [j for j in range(k) if j not in chosen]
            moves = [tuple(sorted((*chosen, j))) for j in rest]
            moves += [tuple(x for x in chosen if x != j) for j in chosen if len(chosen) > 1]
            moves += [tuple(sorted((*(x for x in chosen if x != j), other))) for j in chosen for other in rest]
            top = max(moves, key=worth)
            if worth(top) <= worth(chosen):
                return chosen
            chosen = top

    chosen = max((climbed((best,)), climbed(tuple(range(k)))), key=worth)
    share, loglik = known[chosen]
    order = sorted(range(len(chosen)), key=lambda x: (-share[x], x))
    return [chosen[x] for x in order], share[order], loglik


def from_counts(counts: dict[str, np.ndarray], alphabet: int = 0, bits: int = BITS) -> Model:
    languages = sorted(counts)
    table = np.array([counts[x] for x in languages], dtype=np.float64).reshape(len(languages), 1 << bits)
    used = max(1, int((table.sum(axis=0) > 0).sum()))
    loglik = np.log(table + SMOOTHING) - np.log(table.sum(axis=1, keepdims=True) + SMOOTHING * used * 2)
    return Model(languages, np.ascontiguousarray(loglik.T.astype(np.float32)), alphabet, bits)


def sampled(docs: DataFrame, limit: int) -> DataFrame:
    """lang and doc_id of the ``limit`` ids of smallest md5 of each language; the same whatever the partitions.

    Counts by language (a row each) give a threshold that about twice as many hashes pass; so few ids are ranked, and none
    of a language's other rows meet.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"))
    name = F.md5(F.col("doc_id").cast("string").cast("binary"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).select("lang", ((2.0 * limit + 100) / F.col("n")).alias("pass"))
    place = F.conv(F.substring(name, 1, 12), 16, 10).cast("double") / float(1 << 48)
    few = rows.join(F.broadcast(sizes), "lang").where(place < F.col("pass")).select("lang", "doc_id").distinct()
    order = Window.partitionBy("lang").orderBy(name, "doc_id")
    return few.withColumn("at", F.row_number().over(order)).where(F.col("at") <= limit).drop("at")


def fit(docs: DataFrame, usable: Column | None = None, limit: int = SAMPLE, bits: int = BITS) -> Model:
    """Count trigrams by language over at most ``limit`` documents of each for which ``usable`` (on doc_id) holds.

    The counts come back as one row for each language and task, of at most 2**bits numbers each; the sample's ids are
    broadcast, ``limit`` for each language.
    """
    known = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    if usable is not None:
        known &= usable
    ids = sampled(docs.where(known), limit)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, set[str]]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, letters = total.setdefault(lang, (np.zeros(1 << bits, dtype=np.int64), set()))
                for piece in pieces(text.lower()):
                    found += np.bincount(trigrams(piece, bits)[0], minlength=1 << bits)
                    letters.update(piece)
        for lang, (n, letters) in total.items():
            index = np.flatnonzero(n)
            made = [index.astype(np.int32).tobytes(), n[index].tobytes(), "".join(sorted(filter(str.isalpha, letters))).encode("utf-8", "ignore")]
            yield pa.RecordBatch.from_arrays([pa.array([lang]), *[pa.array([x], pa.binary()) for x in made]], names=["lang", "index", "n", "letters"])

    rows = docs.where(known).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "text").mapInArrow(count, _COUNTS)
    counts: dict[str, np.ndarray] = {}
    alphabet: set[str] = set()
    for lang, index, n, letters in rows.toLocalIterator():
        counts.setdefault(lang, np.zeros(1 << bits))[np.frombuffer(index, np.int32)] += np.frombuffer(n, np.int64)
        alphabet.update(letters.decode())
    return from_counts(counts, len(alphabet), bits)


def identify(docs: DataFrame, model: Model, held_out: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """For every row: lang_pred, the largest language of the chosen set, score, its proportion there, the set with its
    proportions, and gain: by how much a word is likelier in that mixture than in the background, as a logarithm."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits x languages: grows with languages alone
    fields = [x.split()[0] for x in _FOUND.split(", ")]

    held = F.lit(False) if held_out is None else held_out
    rows, places = carried(docs, carry, [F.col("doc_id").cast("long").alias("id"), held.alias("held"), F.col("text").cast("string").alias("t")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                words, alone = m.read(text) if text and m.languages else ((), 0.0)
                if len(words):
                    chosen, share, loglik = infer(words)
                    out.append((m.languages[chosen[0]], float(min(1.0, share[0])), [m.languages[c] for c in chosen], share.tolist(), (loglik - alone) / len(words)))
                else:
                    out.append((UNKNOWN, 0.0, [], [], None))
            kinds = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.float64())
            made = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, *[batch.column(k) for k in places]], names=[*fields, *(f"carry_{k}" for k in range(len(carry)))])

    types = "".join(f", carry_{k} {rows.schema.fields[at].dataType.simpleString()}" for k, at in enumerate(places))
    return rows.mapInArrow(frugal(run), _FOUND + types)

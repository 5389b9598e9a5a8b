"""Token counts: rollups of documents and tokens by source, language and tokenizer version, maintained by deltas.

A batch of changes (inserts, deletes, revised counts) becomes signed sums: an insert adds, a delete subtracts, a revision
subtracts the old count under the old version and adds the new. The sums of a batch are one commit: they are written
aside and renamed to the batch's folder, so a batch counts once, however often it is committed, and a failed attempt
leaves nothing that counts. Totals are the sums over commits; compaction folds commits into one base in the same way, and
what is committed meanwhile counts beside it.

Sums are partial before their shuffle, so a source with a third of all rows is no large group. Where the text itself
must be counted, that is one pass in Arrow batches.

Defined cases: null sources and languages are groups of their own; a null text has 0 tokens; null counts are 0; very
long texts are counted whole; sums have no order, so there are no ties; repeated rows count each; groups whose sums are all 0 are left out of totals; a batch without rows is a commit without rows; no
commits give no totals; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.batches import Batches
from . import tokens
from .common import texts

KEYS = ("source", "lang", "tokenizer")
#: Files of a commit: its rows are one for each source, language and version.
FILES = 8
_SUMS = "source string, lang string, tokenizer string, docs long, tokens long"


def signed(rows: DataFrame, tokenizer: Column | str, count: Column | str, sign: int) -> DataFrame:
    """Signed rows: one document and its count, added (1) or taken away (-1)."""
    version = F.lit(tokenizer) if isinstance(tokenizer, str) else tokenizer
    n = F.coalesce(F.col(count) if isinstance(count, str) else count, F.lit(0)).cast("long")
    return rows.select(F.col("source").cast("string"), F.col("lang").cast("string"), version.cast("string").alias("tokenizer"), F.lit(sign).cast("long").alias("docs"), (n * sign).alias("tokens"))


def inserts(rows: DataFrame, tokenizer: Column | str, count: Column | str) -> DataFrame:
    return signed(rows, tokenizer, count, 1)


def deletes(rows: DataFrame, tokenizer: Column | str, count: Column | str) -> DataFrame:
    return signed(rows, tokenizer, count, -1)


def revisions(rows: DataFrame, old: tuple[Column | str, Column | str], new: tuple[Column | str, Column | str]) -> DataFrame:
    """(version, count) before and after; both signs come from one pass over the rows."""
    sides = [F.struct(F.lit(t).alias("t") if isinstance(t, str) else t.cast("string").alias("t"), F.coalesce(F.col(n) if isinstance(n, str) else n, F.lit(0)).cast("long").alias("n"), F.lit(s).cast("long").alias("s")) for (t, n), s in ((old, -1), (new, 1))]
    both = rows.select(F.col("source").cast("string"), F.col("lang").cast("string"), F.explode(F.array(*sides)).alias("side"))
    return both.select("source", "lang", F.col("side.t").alias("tokenizer"), F.col("side.s").alias("docs"), (F.col("side.n") * F.col("side.s")).alias("tokens"))


def summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def counted(docs: DataFrame, path: str | None = None) -> DataFrame:
    """source, lang, bytes, tokens of every document; tokens by the tokenizer file ``path``."""
    path = path or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.loaded(path).ids
        for batch in batches:
            column = texts(batch.column(2))
            n = np.array([len(encode(t or b"")) // 4 for t in column], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(t or b"") for t in column], pa.int64()), pa.array(n)], names=["source", "lang", "bytes", "tokens"])

    return docs.select(F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "source string, lang string, bytes long, tokens long")


class Rollups:
    """The rollup table in the folder ``path``: a commit is a batch of sums (``sources.batches``)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._batches = Batches(spark, path, _SUMS)

    def has(self, batch: str) -> bool:
        return self._batches.has(batch)

    def committed(self) -> DataFrame:
        """name of every committed batch."""
        return self._batches.names()

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch of signed rows; False, with nothing done, if the batch has been committed before."""
        return self._batches.publish(batch, lambda: summed(deltas).coalesce(FILES))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all commits."""
        return summed(self._batches.rows()).where("docs != 0 or tokens != 0")

    def compact(self) -> bool:
        """Fold all commits that one listing shows into a new base; False if another compaction was first."""
        return self._batches.fold(lambda rows: summed(rows).coalesce(FILES))

"""Bounded samples of labelled documents, as sparse vectors: fitted where they are gathered, on the driver.

The sample is the ``limit`` labelled ids whose md5 is smallest, whatever the partitions; the documents are joined with
these few ids (a broadcast of at most ``limit`` rows), and only hashed vectors, never texts, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import smallest_hashes, texts

_VECTORS = "doc_id long, label int, index binary, value binary"


def labelled_ids(labels: DataFrame, label: str, fit: Column, limit: int) -> DataFrame:
    """doc_id, label of at most ``limit`` ids; an id labelled twice counts once, with its larger label."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & fit)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    return smallest_hashes(rows, "doc_id", limit)


def vectors(docs: DataFrame, ids: DataFrame, make: Callable[[bytes | None], tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(doc_id, label, indices, values) of the documents with these ids, ordered by the id's hash; one for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [make(t) for t in texts(batch.column(2))]
            columns = [[x.tobytes() for x, _ in made], [x.astype(np.float32).tobytes() for _, x in made]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.binary()) for c in columns]], names=["doc_id", "label", "index", "value"])

    few = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(ids), "doc_id")
    found = {}
    for doc_id, label, index, value in few.select("doc_id", "label", "text").mapInArrow(run, _VECTORS).orderBy(F.md5(F.col("doc_id").cast("string"))).toLocalIterator():
        found.setdefault(doc_id, (doc_id, label, np.frombuffer(index, np.int32), np.frombuffer(value, np.float32)))
    return list(found.values())

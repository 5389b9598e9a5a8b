"""Concatenate and cut: token streams laid end to end by two-pass prefix sums, cut into windows of equal length.

Pass 1 tokenises each partition once and writes the ids, with each document's offset in its partition, to the shared
folder; so a lost executor never changes what pass 2 sees. The totals of the partitions (one row each) are summed up to
global offsets. Pass 2 adds them and cuts every document at the windows' boundaries. No row moves between partitions:
the only rows that meet are the totals. Padding: the last sequence alone can be short.

Defined cases: a null or empty text is the closing id alone; repeated rows are packed each; null ids stay null; an empty
table gives no pieces; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import frugal, stored, texts

LENGTH = 4096
END_ID = 2
_IDS = "doc_id long, part long, part_start long, doc_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def tokenised(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, part_start (tokens before it in its partition), doc_tokens, ids (4 bytes each, closed by end_id)."""
    path = path or tokens.default_path()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = tokens.loaded(path).ids, TaskContext.get().partitionId(), 0
        for batch in batches:
            column = [encode(t or b"") + end for t in texts(batch.column(1))]
            lengths = np.array([len(x) // 4 for x in column], dtype=np.int64)
            starts = before + np.cumsum(lengths) - lengths
            before += int(lengths.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(column), part)), pa.array(starts), pa.array(lengths), pa.array(column, pa.binary())],
                names=["doc_id", "part", "part_start", "doc_tokens", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(frugal(run, tokens.NAME), _IDS)


def offsets(ids: DataFrame) -> DataFrame:
    """part, part_offset: tokens in all partitions before it. One row a partition, so the window is small."""
    totals = ids.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_offset"))


def cut(ids: DataFrame, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Pieces of every document: its tokens in [start, start + length) lie in ``sequence_id`` from ``offset``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, total, at = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            first, last = at // length, (at + total - 1) // length
            pieces = last - first + 1
            row = np.repeat(np.arange(len(at)), pieces)
            seq = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)]) if len(at) else first
            begin = np.maximum(seq * length, at[row])
            end = np.minimum((seq + 1) * length, at[row] + total[row])
            start, size = begin - at[row], end - begin
            views = [memoryview(x) for x in batch.column(3).to_pylist()]
            parts = [views[r][4 * s : 4 * (s + n)] for r, s, n in zip(row.tolist(), start.tolist(), size.tolist())]
            columns = [doc.take(pa.array(row)), pa.array(start), pa.array(size), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(total[row]), pa.array(seq), pa.array(begin - seq * length)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                flat = np.frombuffer(b"".join(parts), dtype="<i4")
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = _PIECES if with_ids else _PIECES.rsplit(",", 1)[0]
    placed = ids.join(F.broadcast(offsets(ids)), "part")  # a row for each partition of the input: bounded by its task count
    return placed.select("doc_id", "doc_tokens", (F.col("part_offset") + F.col("part_start")).alias("at"), "ids").mapInArrow(frugal(run), schema)


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pack documents into sequences of ``length`` tokens; ``ids`` are the piece's tokens where asked for."""
    return cut(stored(tokenised(docs, path, end_id), "packing", compression="zstd"), length, with_ids)

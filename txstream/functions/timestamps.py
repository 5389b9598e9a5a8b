"""Timestamps that several sources share without meeting, and contiguous runs of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit(sources: int) -> int:
    """The least power of ten that is not below the number of sources: source k owns the residue k."""
    if sources < 1:
        raise ValueError("there must be a source")
    return 10 ** len(str(sources - 1)) if sources > 1 else 1


def real(logical: Column, source: Column, sources: int) -> Column:
    return logical * unit(sources) + source


def logical(ts: Column, sources: int) -> Column:
    return F.floor(ts / unit(sources)).cast("long")


def owner(ts: Column, sources: int) -> Column:
    return ts % unit(sources)


def islands(rows: DataFrame, ts: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    """by, low, high, n of each maximal run of consecutive timestamps."""
    rows = rows.select(*by, ts).distinct()
    order = Window.partitionBy(*by).orderBy(ts)
    marked = rows.withColumn("island", F.col(ts) - F.row_number().over(order))
    return marked.groupBy(*by, "island").agg(F.min(ts).alias("low"), F.max(ts).alias("high"), F.count("*").alias("n")).drop("island")


def contiguous_high(rows: DataFrame, after: int, ts: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    """by, watermark: the last timestamp of the run that begins right after ``after``; ``after`` itself if none does."""
    found = islands(rows.where(F.col(ts) > after), ts, by)
    return found.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("low") == after + 1, F.col("high"))), F.lit(after)).alias("watermark"))


def polled(rows: DataFrame, after: int, ts: str = "ts", by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The rows of the contiguous run right after ``after``, and the rows that are left: those behind a gap, or before."""
    high = contiguous_high(rows, after, ts, by).withColumnRenamed("watermark", "__high")
    marked = rows.join(high, list(by), "left") if by else rows.join(F.broadcast(high), how="left")  # one row without keys
    inside = F.coalesce((F.col(ts) > after) & (F.col(ts) <= F.col("__high")), F.lit(False))
    return marked.where(inside).drop("__high"), marked.where(~inside).drop("__high")


def closed_high(closes: DataFrame, after: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """by, watermark: the last transaction up to which all have closed; one that asks for a replay (tid, vote) hasn't."""
    return contiguous_high(closes.where(F.col("vote") != "REPLAY"), after, "tid", by)

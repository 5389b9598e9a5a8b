"""Windowed analytics beside the transactional part: counts, suppression, ranks, firsts. All take batch or streaming rows,
except ranks, which need a window's rows whole and so run on batches (or in ``foreachBatch``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import COMMIT


def windowed(rows: DataFrame, ts: str, size: str, slide: str | None = None) -> DataFrame:
    """rows with win_start and win_end; a row stands in each sliding window that covers it."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return rows.withColumn("__w", w).withColumn("win_start", F.col("__w.start")).withColumn("win_end", F.col("__w.end")).drop("__w")


def suppressed(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """The rows of groups that have at most ``most`` rows: a counted semi join, so no group meets in a task."""
    few = rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") <= most).drop("n")
    return rows.join(few, by, "left_semi")


def counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def ranked(counted: DataFrame, by: list[str], name: str, k: int) -> DataFrame:
    """rank 1..k of each group, the greatest count first, ties by name."""
    order = Window.partitionBy(*by).orderBy(F.desc("n"), name)
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ends(counted: DataFrame, by: list[str], name: str, k: int) -> DataFrame:
    """The k least counts of each group as positive and the k greatest as not, without overlap; ties by name."""
    up = F.row_number().over(Window.partitionBy(*by).orderBy("n", name))
    size = F.count("*").over(Window.partitionBy(*by))
    marked = counted.withColumn("__up", up).withColumn("__size", size)
    head = F.least(F.lit(k), F.col("__size"))
    tail = F.when(F.col("__size") - head >= k, F.col("__size") - k).otherwise(head)
    positive = F.when(F.col("__up") <= head, True).when(F.col("__up") > tail, False)
    return marked.withColumn("positive", positive).where(F.col("positive").isNotNull()).drop("__up", "__size")


def outcomes(rows: DataFrame, by: list[str], vote: str = "vote") -> DataFrame:
    """commits and the rest in each group."""
    return rows.groupBy(*by).agg(F.count_if(F.col(vote) == COMMIT).alias("commits"), F.count_if(F.col(vote) != COMMIT).alias("others"))


def firsts(rows: DataFrame, by: list[str], order: Column, value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.min_by(value, order).alias(value))


def skipped(rows: DataFrame, order_by: list[str], n: int) -> DataFrame:
    """All but the first ``n`` rows of an order, which tells apart all rows."""
    from .tgraph import numbered

    return numbered(rows, order_by).where(F.col("tid") > n).drop("tid")


def delayed(rows: DataFrame, by: str, ts: str, step: str) -> DataFrame:
    """rows with release_at: groups of one time spread out, each by one more ``step`` in the order of their names."""
    names = rows.select(by).distinct()
    places = names.withColumn("__place", F.row_number().over(Window.orderBy(by)) - 1)  # a row for each name
    return rows.join(places, by).withColumn("release_at", F.col(ts) + F.expr(f"INTERVAL {step}") * F.col("__place")).drop("__place")

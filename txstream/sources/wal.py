"""A write-ahead log as batches of entries (``batches``): replay, snapshot, compaction, recovery.

A batch is written once: committing it again changes nothing. Entries: vote, tid, ts, source, updates.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import shard_of
from ..schemas import COMMIT, WAL
from .batches import Batches


class Log:
    """Batches of entries, each logged once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._batches = Batches(spark, path, WAL)

    def has(self, batch: str | int) -> bool:
        return self._batches.has(str(batch))

    def append(self, batch: str | int, entries: DataFrame) -> bool:
        """Log a batch; False if it is in the log already."""
        return self._batches.publish(str(batch), entries.select("vote", "tid", "ts", "source", "updates"))

    def entries(self) -> DataFrame:
        return self._batches.rows()

    def replay(self, namespace: str | None = "*", source: int | None = None) -> DataFrame:
        """Committed entries in the order of ts: all, those of a source, or those with updates of a namespace (and only these)."""
        return replay(self.entries(), namespace, source)

    def truncate(self, watermark: int, *batch: str | int) -> bool:
        """Keep what is later than the watermark, in one step: a crash leaves the log as it was or as it shall be.

        Batches that were logged count as logged still, and ``batch`` does from now on.
        """
        return self._batches.fold(lambda rows: rows.where(F.col("ts") > watermark), *map(str, batch))


def entries_of(results: DataFrame, sources: int = 1) -> DataFrame:
    """The entries of a graph's results: vote, tid, ts, source (by tid), updates of the namespaces' shard 0."""
    rows = F.transform("updates", lambda u: F.struct(F.concat(u["ns"], F.lit("-0")).alias("ns"), u["key"].alias("key"), u["value"].cast("double").alias("value")))
    return results.select("vote", "tid", "ts", F.pmod("tid", F.lit(sources)).cast("int").alias("source"), rows.alias("updates"))


def replay(entries: DataFrame, namespace: str | None = "*", source: int | None = None) -> DataFrame:
    rows = entries.where(F.col("vote") == COMMIT)
    if source is not None:
        rows = rows.where(F.col("source") == source)
    if namespace not in (None, "*"):
        own = F.filter("updates", lambda u: shard_of(u["ns"]) == namespace)
        rows = rows.withColumn("updates", own).where(F.size("updates") > 0)
    return rows.orderBy("ts")


def coordinated_watermark(watermarks: DataFrame) -> DataFrame:
    """The snapshot's watermark: the greatest of the sources'."""
    return watermarks.agg(F.max("watermark").alias("watermark"))


def recovered(snapshot: DataFrame, entries: DataFrame, watermark: int, namespace: str) -> DataFrame:
    """ns, key, value: a snapshot with the log's later committed updates on top."""
    tail = replay(entries.where(F.col("ts") > watermark), namespace).select("ts", F.explode("updates").alias("u"))
    tail = tail.select(F.lit(namespace).alias("ns"), "u.key", F.col("ts").alias("version"), "u.value")
    both = snapshot.select("ns", "key", F.lit(-1).cast("long").alias("version"), "value").unionByName(tail)
    return both.groupBy("ns", "key").agg(F.max_by("value", "version").alias("value"))


def pending(transactions: DataFrame, entries: DataFrame) -> DataFrame:
    """Transactions whose tid isn't in the log yet."""
    return transactions.join(entries.select("tid").distinct(), "tid", "left_anti")


def display(entries: DataFrame) -> DataFrame:
    """Entries as JSON lines, in the order of ts."""
    return entries.orderBy("ts").select(F.to_json(F.struct("vote", "tid", "ts", "source", "updates")).alias("line"))


def filler(spark: SparkSession, n: int, keys: int = 100) -> DataFrame:
    """n committed entries for recovery tests: ts k writes key a<k mod keys>."""
    one = F.struct(F.lit("balances").alias("ns"), F.concat(F.lit("a"), (F.col("id") % keys).cast("string")).alias("key"), F.col("id").cast("double").alias("value"))
    return spark.range(n).select(F.lit(COMMIT).alias("vote"), F.col("id").alias("tid"), F.col("id").alias("ts"), F.lit(0).alias("source"), F.array(one).alias("updates"))


def time_appends(log: Log, batches: int, entries: int) -> float:
    """Seconds a batch of so many entries takes to be logged, in the mean."""
    began = time.perf_counter()
    for k in range(batches):
        log.append(f"timed-{k}", filler(log.spark, entries))
    return (time.perf_counter() - began) / max(1, batches)

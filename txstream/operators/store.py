"""Version tables: the committed and pending versions of keys, read as of a watermark, snapshot and compacted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Isolation

_KEY = ("ns", "key")


def as_of(versions: DataFrame, watermark: int | Column | None = None, isolation: Isolation = Isolation.PL3) -> DataFrame:
    """ns, key, version, value: from PL2 on the last committed version up to the watermark, below it the last of any status."""
    rows = versions
    if isolation >= Isolation.PL2:
        rows = rows.where(F.col("status") == "COMMITTED")
        if watermark is not None:
            rows = rows.where(F.col("version") <= watermark)
    return rows.groupBy(*_KEY).agg(F.max("version").alias("version"), F.max_by("value", "version").alias("value"))


def snapshot(versions: DataFrame, watermark: int) -> DataFrame:
    """The committed state at a watermark as versions 0, to start again from."""
    return as_of(versions, watermark).select(*_KEY, F.lit(0).cast("long").alias("version"), F.lit(0).cast("long").alias("created_by"), F.lit("COMMITTED").alias("status"), "value")


def compact(versions: DataFrame, watermark: int, keep: int = 1) -> DataFrame:
    """Drop what no reader at or after the watermark sees: of versions up to it the last ``keep`` stay."""
    old = F.col("version") <= watermark
    order = Window.partitionBy(*_KEY, old).orderBy(F.desc("version"))
    return versions.withColumn("__n", F.row_number().over(order)).where(~old | (F.col("__n") <= keep)).drop("__n")


def lookup(ops: DataFrame, state: DataFrame, default) -> DataFrame:
    """ops with the ``value`` of their keys, or the default where a key hasn't been touched."""
    return ops.join(state.select(*_KEY, "value"), list(_KEY), "left").withColumn("value", F.coalesce("value", F.lit(default)))

"""Lineage paths: where a record stands among those that a transaction fanned out into, step by step.

A path is an array of (off, size): at each step the record was number ``off`` (from 1) of ``size``. The first step is
the transaction itself, (tid, 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import STEP


def step(off: Column, size: Column) -> Column:
    return F.struct(off.cast("int").alias("off"), size.cast("int").alias("size"))


def first(tid: Column | str) -> Column:
    tid = F.col(tid) if isinstance(tid, str) else tid
    return F.array(step(tid, F.lit(1)))


def appended(path: Column, off: Column, size: Column) -> Column:
    return F.concat(path, F.array(step(off, size)))


def offsets(path: Column | str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.transform(path, lambda s: s["off"])


def shifted(path: Column | str) -> Column:
    """How many children each step made: its offset with the size of the next step; the last made none."""
    path = F.col(path) if isinstance(path, str) else path
    sizes = F.concat(F.transform(F.slice(path, F.lit(2), F.size(path)), lambda s: s["size"]), F.array(F.lit(0)))
    return F.zip_with(path, sizes, lambda s, n: step(s["off"], n)).cast(f"array<{STEP}>")


def order_key(path: Column | str) -> Column:
    """Sorts paths of equal lengths by their offsets."""
    return offsets(path)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the offsets of two records of one fan-out; paths of other lengths or sizes are an error."""
    alike = (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: (x["size"] == y["size"]).alias("same")), lambda same: same)
    x, y = offsets(a), offsets(b)
    order = F.when(x < y, -1).when(x > y, 1).otherwise(0)
    return F.when(alike, order).otherwise(F.raise_error(F.lit("paths of different fan-outs don't compare")).cast("int"))


def flattened(records: DataFrame, tid: str = "tid", path: str = "path") -> DataFrame:
    """records with a path of one step behind the transaction's: their place among all of it, and how many they are."""
    order = Window.partitionBy(tid).orderBy(offsets(path))
    place, n = F.row_number().over(order), F.count("*").over(Window.partitionBy(tid))
    return records.withColumn(path, F.array(step(F.col(tid), F.lit(1)), step(place, n)))


def complete(records: DataFrame, tid: str = "tid", path: str = "path") -> DataFrame:
    """tid, complete: whether all leaves of a transaction's tree of records are there, told by whole numbers.

    Level by level, from the deepest: a parent that has all the children that its size says stands for them.
    """
    rows = records.select(F.col(tid), F.col(path).alias("p")).distinct()
    deepest = rows.agg(F.max(F.size("p"))).first()[0] or 0
    done = rows.where(F.size("p") == deepest)
    for level in range(deepest, 0, -1):
        if level < deepest:
            done = done.unionByName(rows.where(F.size("p") == level)).distinct()
        last = F.element_at("p", -1)
        up = done.select(tid, F.slice("p", 1, level - 1).alias("up"), last["off"].alias("off"), last["size"].alias("size"))
        # the transaction's own step is (tid, 1): one child
        whole = up.groupBy(tid, "up").agg(F.count_distinct("off").alias("n"), F.max("size").alias("size")).where("n = size")
        done = whole.select(tid, F.col("up").alias("p"))
    return records.select(tid).distinct().join(done.select(tid, F.lit(True).alias("complete")), tid, "left").select(tid, F.coalesce("complete", F.lit(False)).alias("complete"))

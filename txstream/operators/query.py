"""Queries on states: by keys, by predicate, over several states, each at a watermark."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import as_of

#: Keys that a query's predicate form takes: all, none, below a threshold.
select_all: Callable[[Column], Column] = lambda v: F.lit(True)
select_none: Callable[[Column], Column] = lambda v: F.lit(False)


def select_less_than(threshold: float) -> Callable[[Column], Column]:
    return lambda v: v < threshold


def with_watermark(queries: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Queries at the greatest watermark seen: one row, which an aggregate without keys proves."""
    return queries.crossJoin(F.broadcast(watermarks.agg(F.max("watermark").alias("watermark"))))


def point(queries: DataFrame, versions: DataFrame) -> DataFrame:
    """query_id, ns, key, value: each query's keys as of its watermark; untouched keys are left out.

    A key's versions and the watermarks that it is asked at are merged in one order, so a version is read once, however
    many queries ask; what was found at a watermark is then given to each of its queries.
    """
    asked = queries.select("query_id", "ns", F.explode(F.array_distinct("keys")).alias("key"), "watermark")
    held = versions.where(F.col("status") == "COMMITTED").select("ns", "key", F.col("version").alias("at"), F.struct("value").alias("held"))
    places = asked.select("ns", "key", F.col("watermark").alias("at")).distinct().withColumn("held", F.lit(None).cast(held.schema["held"].dataType))
    # of one place in time a version comes before the question
    past = Window.partitionBy("ns", "key").orderBy("at", F.col("held").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = held.unionByName(places).withColumn("last", F.last("held", ignorenulls=True).over(past)).where("held is null and last is not null")
    found = seen.select("ns", "key", F.col("at").alias("watermark"), F.col("last.value").alias("value"))
    return asked.join(found, ["ns", "key", "watermark"]).groupBy("query_id", "ns", "key").agg(F.max_by("value", "watermark").alias("value"))


def predicate(versions: DataFrame, ns: str, keep: Callable[[Column], Column], watermark: int | None = None) -> DataFrame:
    """ns, key, value of a state's keys for which the predicate holds at the watermark."""
    return as_of(versions.where(F.col("ns") == ns), watermark).where(keep(F.col("value"))).select("ns", "key", "value")


def merged(rows: DataFrame, by: tuple[str, ...] = ("query_id", "ns")) -> DataFrame:
    """Partial results as one map a query and namespace."""
    return rows.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("result"))


def invariant_total(rows: DataFrame, unit: float) -> DataFrame:
    """total, n, consistent: whether the values sum up to a multiple of ``unit``."""
    return rows.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"), F.count("*").alias("n")).withColumn("consistent", F.pmod("total", F.lit(float(unit))) == 0)


# ---------------------------------------------------------------- suppliers: None ends a supply
def null_supplier() -> Iterator[None]:
    return iter(())


def random_supplier(ns: str, keyspace: int, mean: float, deviation: float, seed: int = 0, prefix: str = "a") -> Iterator[tuple[str, str, list[str]]]:
    """Endless (query_id, ns, keys): the number of distinct keys is normal, clipped to [1, keyspace]."""
    source, n = random.Random(seed), 0
    while True:
        size = min(keyspace, max(1, round(source.gauss(mean, deviation))))
        yield f"0.{n}", ns, [f"{prefix}{k}" for k in source.sample(range(keyspace), size)]
        n += 1


def every(supplier: Iterator, seconds: float, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> Iterator:
    """A query each ``seconds``, as far as the supplier and whoever takes them keep up."""
    due = clock()
    for query in supplier:
        wait = due - clock()
        if wait > 0:
            sleep(wait)
        due = max(due, clock()) + seconds
        yield query


def visited(results: DataFrame, visitor: Callable[[str, str, dict], None]) -> int:
    """Give each merged result (query_id, ns, result) to a callback on the driver, one at a time; the number of them."""
    n = 0
    for row in results.select("query_id", "ns", "result").toLocalIterator():
        visitor(row.query_id, row.ns, row.result)
        n += 1
    return n


def limited(supplier: Iterator, n: int) -> Iterator:
    for _, query in zip(range(n), supplier):
        yield query

"""Requests to partitions: those with keys go to the partitions of their keys, those with a predicate to all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def partition_of(key: Column, partitions: int) -> Column:
    """The partition of a key: a hash that other systems can compute too."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(partitions)).cast("int")


def routed(requests: DataFrame, partitions: int) -> DataFrame:
    """query_id, part, keys, expected: a row for each partition that a request (query_id, keys) goes to, with its keys there.

    A null list of keys (a predicate) goes everywhere. ``expected``: answers to wait for; a request without a key gets none.
    """
    every = F.sequence(F.lit(0), F.lit(partitions - 1))
    with_keys = requests.where("keys is not null").select("query_id", F.explode(F.array_distinct("keys")).alias("key"))
    own = with_keys.groupBy("query_id", partition_of(F.col("key"), partitions).alias("part")).agg(F.array_sort(F.collect_list("key")).alias("keys"))
    counts = own.groupBy("query_id").agg(F.count("*").alias("expected"))
    own = own.join(counts, "query_id").select("query_id", "part", "keys", "expected")
    spread = requests.where("keys is null").select("query_id", F.explode(every).alias("part"), F.lit(None).cast("array<string>").alias("keys"), F.lit(partitions).cast("long").alias("expected"))
    return own.unionByName(spread)

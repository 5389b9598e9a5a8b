"""Inputs of the workloads: derived from tables, or generated from a seed."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import composed_id

START = 100.0


def account(n: Column) -> Column:
    return F.concat(F.lit("a"), n.cast("string"))


def transfers(orders: DataFrame, keyspace: int) -> DataFrame:
    """ord, src, dst, amount: a transfer for each order between two different accounts of ``keyspace`` (2 or more)."""
    k = F.lit(keyspace)
    dst = (F.col("o_custkey") + 1 + F.col("o_orderkey") % (k - 1)) % k
    return orders.select(F.col("o_orderkey").alias("ord"), account(F.col("o_custkey") % k).alias("src"), account(dst).alias("dst"), F.ceil(F.col("o_totalprice") / 10000).cast("double").alias("amount"))


def random_transfers(spark: SparkSession, n: int, keyspace: int, start: float = START, seed: int = 0) -> DataFrame:
    """Uniform accounts, never equal; the amount is a random share of ``start``, rounded up."""
    rows = spark.range(n).select(F.col("id").alias("ord"), F.floor(F.rand(seed) * keyspace).alias("s"), F.floor(F.rand(seed + 1) * (keyspace - 1)).alias("d"), F.ceil(F.rand(seed + 2) * start).cast("double").alias("amount"))
    return rows.select("ord", account(F.col("s")).alias("src"), account(F.when(F.col("d") >= F.col("s"), F.col("d") + 1).otherwise(F.col("d"))).alias("dst"), "amount")


def movements(transfer: Column) -> Column:
    """The two legs of a transfer: the source loses, the target gains."""
    leg = lambda key, amount: F.struct(transfer[key].alias("account"), amount.alias("amount"))
    return F.array(leg("src", -transfer["amount"]), leg("dst", transfer["amount"]))


def merged_transfers(legs: DataFrame) -> DataFrame:
    """id, src, dst, amount from the two legs (id, account, amount) of each transfer; halves without a pair are left out."""
    grouped = legs.groupBy("id").agg(F.min_by("account", "amount").alias("src"), F.max_by("account", "amount").alias("dst"), F.max("amount").alias("amount"), F.count("*").alias("n"))
    return grouped.where("n = 2").drop("n")


def commands(events: DataFrame, ns: str = "balances") -> DataFrame:
    """A command for each event: a purchase withdraws its value, any other deposits it, on the user's account."""
    method = F.when(F.col("event_type") == "purchase", "withdrawal").otherwise("deposit")
    return events.select(
        F.col("event_id").cast("string").alias("spu_id"), F.struct("ts", "event_id").alias("ord"), F.lit(ns).alias("ns"),
        F.col("user_id").cast("string").alias("key"), method.alias("method"), F.array("value").alias("params"),
    )


def random_commands(spark: SparkSession, n: int, keyspace: int, ns: str = "balances", start: float = START, seed: int = 0) -> DataFrame:
    return spark.range(n).select(
        composed_id(F.lit(0), F.col("id")).alias("spu_id"), F.col("id").alias("ord"), F.lit(ns).alias("ns"), account(F.floor(F.rand(seed) * keyspace)).alias("key"),
        F.when(F.rand(seed + 1) < 0.5, "deposit").otherwise("withdrawal").alias("method"), F.array(F.ceil(F.rand(seed + 2) * start).cast("double")).alias("params"),
    )


def no_commands(spark: SparkSession) -> DataFrame:
    from ..schemas import COMMANDS

    return spark.createDataFrame([], COMMANDS)


def purchases(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """ord (order and line), customer, product, category, ts of each line."""
    joined = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("o_custkey").alias("customer"), F.col("l_partkey").alias("product"), F.col("p_brand").alias("category"), F.col("o_orderdate").alias("ts"))


def votes(events: DataFrame) -> DataFrame:
    """event_id, ts, participant, area."""
    return events.select("event_id", "ts", F.col("user_id").alias("participant"), F.col("event_type").alias("area"))


def rate_stream(spark: SparkSession, per_second: int) -> DataFrame:
    """An endless stream (timestamp, value) for load tests."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load()


def tunable_transfers(spark: SparkSession, per_second: int, keyspace: int, start: float = START) -> DataFrame:
    """A stream of transfers at a rate: ids of the rate source, mapped to accounts and amounts by hash."""
    return transfers_of_ids(rate_stream(spark, per_second).select(F.col("value").alias("ord")), keyspace, start)


def transfers_of_ids(ids: DataFrame, keyspace: int, start: float = START) -> DataFrame:
    """ord, src, dst, amount of each id (ord): accounts that differ, and a whole amount up to ``start``, by hash."""
    part = lambda k, n: F.pmod(F.xxhash64("ord", F.lit(k)), F.lit(n).cast("long"))
    rows = ids.select("ord", part(0, keyspace).alias("s"), part(1, keyspace - 1).alias("d"), (part(2, int(start)) + 1).cast("double").alias("amount"))
    return rows.select("ord", account(F.col("s")).alias("src"), account(F.when(F.col("d") >= F.col("s"), F.col("d") + 1).otherwise(F.col("d"))).alias("dst"), "amount")


def tunable_queries(spark: SparkSession, per_second: int, keyspace: int, keys: int, ns: str = "balances") -> DataFrame:
    """A stream of queries (query_id, ns, keys) at a rate."""
    return queries_of_ids(rate_stream(spark, per_second).select(F.col("value").alias("n")), keyspace, keys, ns)


def queries_of_ids(ids: DataFrame, keyspace: int, keys: int, ns: str = "balances") -> DataFrame:
    """query_id, ns and up to ``keys`` distinct keys of each id (n), by hash."""
    drawn = [account(F.pmod(F.xxhash64("n", F.lit(k)), F.lit(keyspace).cast("long"))) for k in range(keys)]
    return ids.select(composed_id(F.lit(0), F.col("n")).alias("query_id"), F.lit(ns).alias("ns"), F.array_distinct(F.array(*drawn)).alias("keys"))


def socket_queries(spark: SparkSession, host: str, port: int) -> DataFrame:
    """A stream of query lines ``ns key key ...`` from a socket."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    parts = F.split("value", " +")
    return lines.select(parts[0].alias("ns"), F.slice(parts, 2, F.size(parts)).alias("keys"))


# ---------------------------------------------------------------- load
def primes(n: Column) -> Column:
    """How many primes there are up to n: a heavy computation that stays an expression."""
    divides = lambda k: F.exists(F.sequence(F.lit(2), F.greatest(F.lit(2), F.floor(F.sqrt(k)).cast("int"))), lambda d: (d < k) & (k % d == 0))
    return F.when(n >= 2, F.size(F.filter(F.sequence(F.lit(2), n.cast("int")), lambda k: ~divides(k)))).otherwise(0)


def busy_wait(micros: int):
    """A Pandas UDF that passes a column on and keeps a core busy for so long a row; for load tests."""

    @F.pandas_udf("double")
    def wait(column: pd.Series) -> pd.Series:
        end = time.perf_counter() + len(column) * micros / 1e6
        while time.perf_counter() < end:
            pass
        return column.astype("float64")

    return wait

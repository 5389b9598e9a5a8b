"""Streaming forms of workloads, over the tables as files; the SQL is that of the batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TxConfig
from ..functions import text
from ..operators import tgraph, windows
from ..sources import generators, wal
from ..sources.shared import scratch, stored
from ..streaming import driver, keyed, sequencer
from . import workloads


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = workloads.read(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parquet*")


def stream_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank's transfers as a stream; final balances."""
    fn = workloads.balances()
    build = lambda s: s.flat_map(generators.movements).state("balances", lambda v: v["account"], fn, lambda v: v["amount"])
    graph = driver.StreamingGraph(spark, scratch(spark, "stream-bank"), build, {"balances": "double"}, ["ord"])
    graph.run(generators.transfers(stream(spark, sf_dir, "orders"), workloads.ACCOUNTS), scratch(spark, "stream-bank-checkpoint")).awaitTermination()
    return graph.state("balances").select("key", "value")


def stream_wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = windows.counts(text.words(stream(spark, sf_dir, "documents").select("text"), "text"), ["word"])
    return driver.completed(counted, scratch(spark, "stream-words"), scratch(spark, "stream-words-checkpoint"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each hour and type, with late rows up to ten minutes."""
    rows = stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type").withWatermark("ts", "10 minutes")
    counted = rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    found = driver.completed(counted, scratch(spark, "stream-windows"), scratch(spark, "stream-windows-checkpoint"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("win_start"), "event_type", "n")


def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank as a durable stream: balances recovered from its log alone."""
    fn = workloads.balances()
    build = lambda s: s.flat_map(generators.movements).state("balances", lambda v: v["account"], fn, lambda v: v["amount"])
    graph = driver.StreamingGraph(spark, scratch(spark, "stream-log"), build, {"balances": "double"}, ["ord"], TxConfig(durable=True))
    graph.run(generators.transfers(stream(spark, sf_dir, "orders"), workloads.ACCOUNTS), scratch(spark, "stream-log-checkpoint")).awaitTermination()
    none = spark.createDataFrame([], "ns string, key string, value double")
    return wal.recovered(none, graph.log.entries(), 0, "balances").select("key", "value")


def stream_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank in three micro-batches, queries on its running state after each: every answer at the batch's watermark."""
    fn = workloads.balances()
    build = lambda s: s.flat_map(generators.movements).state("balances", lambda v: v["account"], fn, lambda v: v["amount"])
    graph = driver.StreamingGraph(spark, scratch(spark, "stream-marks"), build, {"balances": "double"}, ["ord"], fold_every=2)
    rows = stored(tgraph.numbered(generators.transfers(workloads.read(spark, sf_dir, "orders"), workloads.ACCOUNTS), ["ord"]), "transfers")
    third = F.floor((F.col("tid") - 1) * 3 / F.lit(rows.count()))
    asked = spark.createDataFrame([("all", "balances", [f"a{k}" for k in range(0, workloads.ACCOUNTS, 7)])], "query_id string, ns string, keys array<string>")
    out = None
    for batch in range(3):
        graph.process(rows.where(third == batch).drop("tid"), batch)
        found = stored(graph.ask(asked).select(F.lit(batch).alias("batch"), "watermark", "key", F.col("value").cast("double").alias("value")), "answers")
        out = found if out is None else out.unionByName(found)
    return out


def stream_sequencer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions released in contiguous order by a stream's own state, as the batch form releases them."""
    rows = stream(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("tid"), (F.col("event_id") * 3 + F.col("user_id") % 50).alias("at"))
    events = rows.select(F.lit("g").alias("graph"), "at", "tid", F.lit(False).alias("replay"))
    found = driver.appended(sequencer.sequenced(events), scratch(spark, "stream-sequence"), scratch(spark, "stream-sequence-checkpoint"))
    return found.select("tid", F.col("at").alias("released_at"))


def stream_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of each account folded by the stream's own state."""
    rows = generators.commands(stream(spark, sf_dir, "events"))
    rows = rows.select("spu_id", F.col("ord.ts").alias("ord"), "key", "method", F.col("params")[0].alias("param"))
    found = driver.appended(keyed.command_stream(rows, workloads.balances()), scratch(spark, "stream-commands"), scratch(spark, "stream-commands-checkpoint"))
    return found.select("spu_id", "key", "vote", F.round("value", 6).alias("value"))


QUERIES = {f.__name__: f for f in (stream_bank, stream_wordcount, stream_windows, stream_commands, stream_log, stream_watermarks, stream_sequencer)}
_T = workloads.bank_ctes()
ORACLE_SQL = {
    "stream_bank": workloads.ORACLE_SQL["bank_final_balances"],
    "stream_wordcount": workloads.ORACLE_SQL["wordcount"],
    "stream_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS win_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_commands": workloads.ORACLE_SQL["spu_deposit_withdraw"],
    "stream_log": workloads.ORACLE_SQL["bank_final_balances"],
    "stream_watermarks": f"""WITH {_T}, n AS (SELECT count(*) AS n FROM transfers), m AS (SELECT ((tid - 1) * 3 // n)::INTEGER AS batch, max(tid) AS watermark FROM transfers, n GROUP BY 1)
SELECT batch, watermark, key, arg_max(value, tid) AS value FROM m JOIN legs ON tid <= watermark WHERE substr(key, 2)::BIGINT % 7 = 0 GROUP BY ALL""",
    "stream_sequencer": """WITH e AS (SELECT event_id + 1 AS tid, event_id * 3 + user_id % 50 AS came FROM events), d AS (SELECT tid, min(came) AS came FROM e GROUP BY tid),
n AS (SELECT tid, max(came) OVER (ORDER BY tid) AS released_at, row_number() OVER (ORDER BY tid) AS place FROM d) SELECT tid, released_at FROM n WHERE place = tid""",
}

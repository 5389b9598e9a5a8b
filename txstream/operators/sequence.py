"""Release in order: what has come is given on once everything before it has, however late and mixed up it came.

``at`` is the place of an event in the order of arrival. All forms are batch forms; ``streaming.sequencer`` has the
streaming ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

CHUNK = 1 << 17


def released(done: DataFrame, first: int = 1, chunk: int = CHUNK) -> DataFrame:
    """tid, released_at of (tid, done_at): the arrival with which the last of ``first``, ..., tid was done.

    Transactions behind one that is missing aren't released. Maxima run inside chunks of tids, and over chunks by a row
    each; so no task sees all transactions.
    """
    rows = done.where(F.col("done_at").isNotNull() & (F.col("tid") >= first)).groupBy("tid").agg(F.min("done_at").alias("done_at"))
    rows = rows.withColumn("chunk", F.floor((F.col("tid") - first) / chunk).cast("long"))
    chunks = rows.groupBy("chunk").agg(F.count("*").alias("n"), F.max("done_at").alias("most"))
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.max("most").over(earlier).alias("so_far"))
    order = Window.partitionBy("chunk").orderBy("tid")
    place = F.col("before") + F.row_number().over(order)
    most = F.greatest(F.max("done_at").over(order), F.col("so_far"))
    return rows.join(F.broadcast(chunks), "chunk").select("tid", place.alias("place"), most.alias("released_at")).where(F.col("place") == F.col("tid") - first + 1).drop("place")


def sequenced(events: DataFrame, first: int = 1) -> DataFrame:
    """tid, released_at of decisions (at, tid, replay): a transaction is done with its first decision that no replay follows.

    A replay asks for another decision, so it holds back its transaction and all behind it until that has come.
    """
    asked = events.where("replay").groupBy("tid").agg(F.max("at").alias("asked_at"))
    made = events.where("not replay").join(asked, "tid", "left").where("asked_at is null or at > asked_at")
    return released(made.select("tid", F.col("at").alias("done_at")), first)


def total_order(records: DataFrame, first: int = 1) -> DataFrame:
    """records (at, tid, path) with released_at, of transactions that are complete, as all before them are.

    Records of a transaction go on in the order of their paths, transactions in the order of their ids.
    """
    whole = paths.complete(records).where("complete").select("tid")
    done = records.join(whole, "tid").groupBy("tid").agg(F.max("at").alias("done_at"))
    return records.join(released(done, first), "tid")


def flushed(rows: DataFrame, threshold: int, ts: str = "ts") -> DataFrame:
    """What came up to a timestamp, in order."""
    return rows.where(F.col(ts) <= threshold).orderBy(ts)

"""Transactional graphs: every input record is one transaction, fanned out, filtered, regrouped and tied to states.

``TGraph.open`` gives each record its transaction id; ``TStream`` transforms records while their lineage stays whole;
``state`` notes what each record does to a key; ``close`` runs all notes of all exits as one ledger and gives a result
for each transaction. Everything up to ``close`` is a lazy DataFrame.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import TxConfig
from ..functions import paths, votes
from ..schemas import ABORT, COMMIT, REPLAY
from ..sources.shared import stored
from . import ledger
from .statefn import StateFunction
from .store import as_of


def numbered(rows: DataFrame, order_by: list[str], first: int = 1, parallelism: int | None = None) -> DataFrame:
    """rows with ``tid``: 1, 2, ... in the order of ``order_by``, without sorting all rows in one task.

    Rows are sorted in ranges and written; each range numbers its own rows, and the ranges' sizes (one row each) sum up
    to offsets.
    """
    ranged = (rows.repartitionByRange(parallelism, *order_by) if parallelism else rows.repartitionByRange(*order_by)).withColumn("__range", F.spark_partition_id())
    ranged = stored(ranged, "ranges")  # written, so that later reads see the same ranges
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order_by))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))  # a row a partition
    return ranged.withColumn("__own", own).join(F.broadcast(offsets), "__range").withColumn("tid", F.col("__own") + F.col("__offset") + (first - 1)).drop("__own", "__range", "__offset")


_ids = itertools.count(1)


@dataclass
class TGraph:
    spark: SparkSession
    config: TxConfig = field(default_factory=TxConfig)
    #: Tells the graphs of a job apart.
    id: int = field(default_factory=lambda: next(_ids))

    def open(self, rows: DataFrame, order_by: list[str] | None = None, tid: str | None = None, done: DataFrame | None = None) -> "TStream":
        """Admit each row as a transaction, numbered in the order of ``order_by``, or named by the column ``tid``.

        ``done``: (tid) of transactions in a log, which are skipped.
        """
        if tid is None:
            rows, tid = numbered(rows, order_by or rows.columns, parallelism=self.config.open_parallelism), "tid"
        columns = [c for c in rows.columns if c != "tid"]
        opened = rows.select(F.col(tid).cast("long").alias("tid"), F.struct(*columns).alias("value"))
        if done is not None:
            opened = opened.join(done.select("tid").distinct(), "tid", "left_anti")
        opened = opened.select("tid", paths.first("tid").alias("path"), F.lit(COMMIT).alias("vote"), "value", F.col("value").alias("original"))
        return TStream(self, opened, opened.select("tid", "original"))


@dataclass
class TStream:
    """A stream of records (tid, path, vote, value) of a graph; a null value is a record that a filter emptied."""

    graph: TGraph
    df: DataFrame
    originals: DataFrame
    notes: tuple[tuple[DataFrame, str, StateFunction], ...] = ()

    def _with(self, df: DataFrame) -> "TStream":
        return TStream(self.graph, df, self.originals, self.notes)

    def map(self, fn: Callable[[Column], Column]) -> "TStream":
        """fn is applied to null values too."""
        return self._with(self.df.withColumn("value", fn(F.col("value"))))

    def flat_map(self, fn: Callable[[Column], Column]) -> "TStream":
        """fn gives an array; its k elements stand at (1, k) ... (k, k). None leaves an empty record, so that the transaction closes."""
        many = self.df.withColumn("__all", fn(F.col("value")))
        size = F.greatest(F.coalesce(F.size("__all"), F.lit(0)), F.lit(1))
        out = many.withColumn("__size", size).select("*", F.posexplode_outer("__all").alias("__at", "__one"))
        path = paths.appended(F.col("path"), F.coalesce(F.col("__at"), F.lit(0)) + 1, F.col("__size"))
        rest = [c for c in self.df.columns if c not in ("tid", "path", "value")]
        return self._with(out.select("tid", path.alias("path"), *rest, F.col("__one").alias("value")))

    def filter(self, predicate: Callable[[Column], Column]) -> "TStream":
        """The record stays; its value becomes null where the predicate isn't true."""
        return self._with(self.df.withColumn("value", F.when(predicate(F.col("value")), F.col("value"))))

    def key_by(self, key: Callable[[Column], Column]) -> "TStream":
        """Bring records of a key together; null values count as key 0. A hint: later operators shuffle as they need."""
        return self._with(self.df.repartition(F.coalesce(key(F.col("value")).cast("string"), F.lit("0"))))

    def window(self, fn: Callable[[Column], Column]) -> "TStream":
        """All records of a transaction become one: fn takes the array of their values in lineage order, nulls left out."""
        members = F.array_sort(F.collect_list(F.struct(paths.order_key("path").alias("o"), F.col("value").alias("v"))))
        values = F.filter(F.transform(members, lambda m: m["v"]), lambda v: v.isNotNull())
        grouped = self.df.groupBy("tid").agg(values.alias("__all"), votes.merged("vote").alias("vote"), F.any_value("original").alias("original"))
        return self._with(grouped.select("tid", paths.first("tid").alias("path"), "vote", fn(F.col("__all")).alias("value"), "original"))

    def state(self, namespace: str, key: Callable[[Column], Column], fn: StateFunction, elem: Callable[[Column], Column]) -> "TStream":
        """Note that each record applies ``fn`` to its key; the stream itself goes on unchanged. Null values do nothing."""
        value = F.col("value")
        note = self.df.where(value.isNotNull()).select("tid", paths.order_key("path").alias("ord"), F.lit(namespace).alias("ns"), key(value).cast("string").alias("key"), elem(value).alias("amount"))
        return TStream(self.graph, self.df, self.originals, (*self.notes, (note, namespace, fn)))

    def route(self, n: int, key: Callable[[Column], Column]) -> list["TStream"]:
        """Split into n streams by a whole number modulo n."""
        return [self._with(self.df.where(F.pmod(key(F.col("value")), F.lit(n)) == k)) for k in range(n)]

    @property
    def metadata(self) -> DataFrame:
        return self.df.select("tid", "path", "vote")

    @property
    def graph_id(self) -> int:
        return self.graph.id


@dataclass
class Closed:
    """results: tid, ts, original, vote, updates. versions, by namespace: ns, key, version, created_by, status, value."""

    results: DataFrame
    versions: dict[str, DataFrame]
    outcomes: dict[str, ledger.Outcome]
    config: TxConfig = field(default_factory=TxConfig)

    def read(self, namespace: str, watermark: int | None = None) -> DataFrame:
        """ns, key, version, value as of a watermark, at the graph's isolation level."""
        return as_of(self.versions[namespace], watermark, self.config.isolation)

    def final(self, namespace: str) -> DataFrame:
        """key, value: the last committed value of each touched key."""
        return self.versions[namespace].groupBy("key").agg(F.max_by("value", "version").alias("value"))


def reduced_votes(exits: list[DataFrame]) -> DataFrame:
    """tid, vote: each exit's votes merged, then those of all exits. Both are partial sums before one shuffle."""
    every = exits[0]
    for other in exits[1:]:
        every = every.unionByName(other)
    return every.groupBy("tid").agg(votes.merged("vote").alias("vote"))


def close(*exits: TStream, start: dict[str, DataFrame] | None = None, how: str = "auto") -> Closed:
    """Run the notes of all exits as one ledger, merge votes, and give a result for each transaction.

    States of one value type run together, so that a transaction is atomic across their namespaces; a transaction that
    aborts in one kind of state writes nothing in the others, as long as at most one kind has an invariant.
    """
    graph = exits[0].graph
    if any(e.graph is not graph for e in exits):
        raise ValueError("the exits belong to different graphs")
    seen: dict[int, tuple[DataFrame, str, StateFunction]] = {}
    for e in exits:
        for note in e.notes:
            seen.setdefault(id(note[0]), note)
    kinds: dict[str, list[tuple[DataFrame, str, StateFunction]]] = {}
    for note in seen.values():
        kinds.setdefault(note[2].value_type, []).append(note)

    def joined(notes: list[tuple[DataFrame, str, StateFunction]]) -> tuple[DataFrame, DataFrame | None]:
        ops, held = notes[0][0], None
        for note in notes[1:]:
            ops = ops.unionByName(note[0])
        for ns in sorted({n for _, n, _ in notes} & set(start or {})):
            part = start[ns].select(F.lit(ns).alias("ns"), "key", "value")
            held = part if held is None else held.unionByName(part)
        return ops, held

    bound = {k: n for k, n in kinds.items() if not all(f.free for _, _, f in n)}
    outcomes = {}
    for kind, notes in bound.items():
        ops, held = joined(notes)
        outcomes[kind] = ledger.execute(ops, {n: f for _, n, f in notes}, graph.config, held, how)

    decided = reduced_votes([e.df.select("tid", "vote") for e in exits] + [o.votes for o in outcomes.values()])
    if not graph.config.baseline:
        decided = decided.where(F.col("vote") != REPLAY)
    committed = decided.where(F.col("vote") == COMMIT).select("tid")
    versions, updates = {}, None
    for kind, notes in kinds.items():
        if kind in bound:
            written = outcomes[kind].writes
            if len(bound) > 1:
                written = written.join(committed, "tid", "left_semi")
        else:  # what has no invariant runs last, each key on its own, for committed transactions alone
            ops, held = joined(notes)
            written = ledger.free_writes(ops.join(committed, "tid", "left_semi"), {n: f for _, n, f in notes}, held)
        text = F.col("value").cast("string") if kind in ("double", "bigint", "int", "string") else F.to_json(F.struct("value"))
        one = written.select("tid", F.struct("ns", "key", text.alias("value")).alias("u"))
        updates = one if updates is None else updates.unionByName(one)
        for _, ns, _ in notes:
            versions[ns] = written.where(F.col("ns") == ns).select("ns", "key", F.col("tid").alias("version"), F.col("tid").alias("created_by"), F.lit("COMMITTED").alias("status"), "value")
    results = exits[0].originals.join(decided, "tid")
    if updates is not None:
        results = results.join(updates.groupBy("tid").agg(F.array_sort(F.collect_list("u")).alias("updates")), "tid", "left")
    else:
        results = results.withColumn("updates", F.lit(None).cast("array<struct<ns:string,key:string,value:string>>"))
    none = F.array().cast("array<struct<ns:string,key:string,value:string>>")
    results = results.select("tid", F.col("tid").alias("ts"), "original", "vote", F.when(F.col("vote") == ABORT, none).otherwise(F.coalesce("updates", none)).alias("updates"))
    return Closed(results, versions, outcomes, graph.config)


def series(graph: TGraph, first: TStream, build: list[Callable[[TStream], TStream]]) -> list[Closed]:
    """Graphs one after another: what the first one closes is opened, under the same ids, in the next."""
    out, stream = [], first
    for step in build:
        closed = close(step(stream))
        out.append(closed)
        stream = graph.open(closed.results.select("tid", "original.*"), tid="tid")
    return out

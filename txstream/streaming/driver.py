"""Streams through transactional graphs: one micro-batch after another, each committed once.

A micro-batch numbers its transactions after the last ones, runs its ledger on the state as of the last batch, and
writes versions, results and (where the graph is durable) log entries into folders named by the batch, and last its
watermark. A batch that failed half-way is written again over what it left; a batch whose watermark stands, complete, is
skipped. So each counts once.

Every ``fold_every`` batches the state as it then is becomes a base. A batch reads the newest base and the versions
since, so its work doesn't grow with the life of the stream.

Queries and commands meet the running state: queries see the committed batches, all up to one watermark; a batch of
commands is a batch like others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TxConfig
from ..operators import query, spu, tgraph
from ..operators.statefn import StateFunction
from ..operators.store import as_of, compact
from ..schemas import COMMIT
from ..sources.shared import filesystem, removed
from ..sources.wal import Log, entries_of

_MARKS = "watermark long"


@dataclass
class StreamingGraph:
    """``build`` ties an opened stream to its states; ``namespaces`` are theirs, with their value types."""

    spark: SparkSession
    path: str
    build: Callable[[tgraph.TStream], tgraph.TStream]
    namespaces: dict[str, str]
    order_by: list[str]
    config: TxConfig = field(default_factory=TxConfig)
    fold_every: int = 16

    @property
    def log(self) -> Log:
        """The write-ahead log; batches of a durable graph are logged by their numbers."""
        return Log(self.spark, f"{self.path}/log")

    def _batches(self, kind: str) -> list[int]:
        """Batches that are written completely."""
        fs, at = filesystem(self.spark, f"{self.path}/{kind}")
        found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
        names = [p.getName() for p in found if fs.exists(filesystem(self.spark, f"{p}/_SUCCESS")[1])]
        return sorted(int(n) for n in names)

    def committed(self, before: int | None = None) -> list[int]:
        """Batches whose watermark stands."""
        return [b for b in self._batches("watermarks") if before is None or b < before]

    def _read(self, kind: str, schema: str, batches: list[int]) -> DataFrame:
        paths = [f"{self.path}/{kind}/{b}" for b in batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def watermark(self, before: int | None = None) -> int:
        """The last transaction of the committed batches; 0 if none."""
        found = self._read("watermarks", _MARKS, self.committed(before)[-1:]).first()
        return found.watermark if found else 0

    def watermarks(self) -> DataFrame:
        """batch, watermark of the committed batches."""
        rows = self._read("watermarks", _MARKS, self.committed()).withColumn("batch", F.regexp_extract(F.input_file_name(), r"/watermarks/(\d+)/", 1).cast("long"))
        return rows.select("batch", "watermark")

    def watermark_stream(self) -> DataFrame:
        """The committed watermarks as a stream: a side output for whoever follows the graph."""
        fs, at = filesystem(self.spark, f"{self.path}/watermarks")
        fs.mkdirs(at)
        return self.spark.readStream.schema(_MARKS).option("recursiveFileLookup", "true").parquet(f"{self.path}/watermarks")

    def _schema(self, ns: str) -> str:
        return f"ns string, key string, version long, created_by long, status string, value {self.namespaces[ns]}"

    def versions(self, ns: str, before: int | None = None) -> DataFrame:
        """All versions that the committed batches wrote."""
        return self._read(f"versions-{ns}", self._schema(ns), self.committed(before))

    def _current(self, ns: str, before: int | None = None) -> DataFrame:
        """The newest base's versions and those since."""
        done = self.committed(before)
        bases = [b for b in self._batches(f"bases-{ns}") if b in set(done)]
        base = bases[-1] if bases else -1
        since = self._read(f"versions-{ns}", self._schema(ns), [b for b in done if b > base])
        return self._read(f"bases-{ns}", self._schema(ns), bases[-1:]).unionByName(since)

    def results(self, schema: str) -> DataFrame:
        return self._read("results", schema, self.committed())

    def state(self, ns: str, before: int | None = None) -> DataFrame:
        return as_of(self._current(ns, before), isolation=self.config.isolation)

    def _commit(self, batch: int, versions: dict[str, DataFrame], watermark: DataFrame) -> None:
        """Write a batch's versions, a base if it is time for one, and last its watermark."""
        for ns, rows in versions.items():
            rows.write.mode("overwrite").parquet(f"{self.path}/versions-{ns}/{batch}")
        if batch % self.fold_every == self.fold_every - 1:
            for ns in self.namespaces:
                own = self._read(f"versions-{ns}", self._schema(ns), [batch] if ns in versions else [])
                mark = watermark.first().watermark
                kept = compact(self._current(ns, batch).unionByName(own), mark, keep=self.config.max_versions or 1)
                kept.write.mode("overwrite").parquet(f"{self.path}/bases-{ns}/{batch}")
        watermark.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/watermarks/{batch}")

    def _begun(self, batch: int) -> bool:
        """Whether the batch still has to be done; what an attempt before left of its watermark goes."""
        if batch in self.committed():
            return False
        removed(self.spark, f"{self.path}/watermarks/{batch}")
        return True

    def process(self, rows: DataFrame, batch: int) -> None:
        """A micro-batch; for ``foreachBatch``."""
        if not self._begun(batch):
            return
        last = self.watermark(batch)
        graph = tgraph.TGraph(self.spark, self.config)
        opened = graph.open(tgraph.numbered(rows, self.order_by, first=last + 1), tid="tid")
        start = {ns: self.state(ns, batch).select("key", "value") for ns in self.namespaces} if last else None
        closed = tgraph.close(self.build(opened), start=start)
        closed.results.write.mode("overwrite").parquet(f"{self.path}/results/{batch}")
        results = self._read("results", closed.results.schema, [batch])
        if self.config.durable:
            self.log.append(batch, entries_of(results))
        mark = results.agg(F.coalesce(F.max("tid"), F.lit(last)).alias("watermark"))
        self._commit(batch, closed.versions, mark)

    def process_commands(self, rows: DataFrame, batch: int, ns: str, fn: StateFunction) -> None:
        """A batch of commands (spu_id, ord, key, method, params) on a running state: each a transaction on its key."""
        if not self._begun(batch):
            return
        last = self.watermark(batch)
        named = tgraph.numbered(rows, ["ord", "spu_id"], first=last + 1).withColumns({"own": F.col("spu_id"), "spu_id": F.col("tid").cast("string"), "ord": F.col("tid"), "ns": F.lit(ns)})
        held = self.state(ns, batch).select("ns", "key", "value") if last else None
        done = spu.apply_commands(named, fn, held).select(F.col("spu_id").cast("long").alias("tid"), "ns", "key", "vote", "value")
        done = done.join(named.select("tid", F.col("own").alias("spu_id")), "tid")
        done.write.mode("overwrite").parquet(f"{self.path}/commands/{batch}")
        written = self._read("commands", done.schema, [batch])
        good = written.where(F.col("vote") == COMMIT)
        versions = good.select("ns", "key", F.col("tid").alias("version"), F.col("tid").alias("created_by"), F.lit("COMMITTED").alias("status"), "value")
        self._commit(batch, {ns: versions}, written.agg(F.coalesce(F.max("tid"), F.lit(last)).alias("watermark")))

    def ask(self, queries: DataFrame) -> DataFrame:
        """query_id, ns, key, value, watermark: queries (query_id, ns, keys) on the committed state, all at one watermark."""
        mark = self.watermark()
        at = queries.withColumn("watermark", F.lit(mark).cast("long"))
        found = None
        for ns in self.namespaces:
            one = query.point(at.where(F.col("ns") == ns), self._current(ns)).withColumn("value", F.col("value").cast("string"))
            found = one if found is None else found.unionByName(one)
        return found.withColumn("watermark", F.lit(mark).cast("long"))

    def answer(self, queries: DataFrame, out: str, checkpoint: str, visitor: Callable[[DataFrame, int], None] | None = None):
        """Answer a stream of queries from the running state, each micro-batch at the watermark it meets; into ``out``."""

        def one(rows: DataFrame, batch: int) -> None:
            found = self.ask(rows)
            found.write.mode("overwrite").parquet(f"{out}/{batch}")
            if visitor is not None:
                visitor(self.spark.read.schema(found.schema).parquet(f"{out}/{batch}"), batch)

        return queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def run(self, stream: DataFrame, checkpoint: str, available_now: bool = True):
        """Start the stream; with ``available_now`` all that is there is processed, batch by batch, and it ends."""
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def completed(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """The last complete result of an aggregating stream over what is there, as a table: nothing reaches the driver."""

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/{batch}")

    query_ = stream.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query_.awaitTermination()
    last = query_.lastProgress["batchId"] if query_.lastProgress else 0
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/{last}")


def appended(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All results of an appending stream over what is there, through Parquet files."""
    query_ = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query_.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)

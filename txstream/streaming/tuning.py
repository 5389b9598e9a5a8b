"""A source whose rate is tuned: unloaded latency first, then higher and higher rates until latency gives way."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .. import metrics
from ..sources import generators


@dataclass
class TunableSource:
    """Drives ``process(rows, batch)`` with a rate stream, each rate for ``seconds``; latencies are those of micro-batches.

    ``records`` turns the ids of the stream (timestamp, value) into the records that are processed.
    """

    spark: SparkSession
    process: Callable[[DataFrame, int], None]
    checkpoints: str
    records: Callable[[DataFrame], DataFrame] = lambda ids: ids
    seconds: float = 5.0
    warm_up: int = 1
    curve: list[tuple[int, float]] = field(default_factory=list)

    def latency(self, rate: int) -> float:
        """Mean seconds from a micro-batch's trigger to its commit at a rate; at rate 0 with one record in flight."""
        ids = generators.rate_stream(self.spark, max(1, rate))
        rows = self.records(ids)
        folder = f"{self.checkpoints}/rate-{rate}-{len(self.curve)}"
        query = rows.writeStream.foreachBatch(self.process).option("checkpointLocation", folder).start()
        end = time.monotonic() + self.seconds
        while query.isActive and (time.monotonic() < end or len([p for p in query.recentProgress if p["numInputRows"]]) <= self.warm_up) and time.monotonic() < end + 60:
            time.sleep(0.1)
        done = [p["durationMs"]["triggerExecution"] / 1e3 for p in query.recentProgress if p["numInputRows"]]
        query.stop()
        if query.exception() is not None:
            raise query.exception()
        done = done[self.warm_up :] or done
        found = sum(done) / len(done) if done else float("inf")
        self.curve.append((rate, found))
        return found

    def sustainable(self, start: int, step: int, queue: float = 50.0, most: int = 20) -> tuple[int, float]:
        """The greatest rate whose latency stays below ``queue`` times the unloaded one, and that one."""
        return metrics.sustainable_rate(self.latency, start, step, queue, most)

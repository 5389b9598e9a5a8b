"""Statistics of runs: percentiles, counters, throughput, curves and the JSON report."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def stats(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, p5, p50, p95, stddev of a column, exact."""
    quantile = lambda q, name: F.percentile(value, q).alias(name)
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), quantile(0.05, "p5"), quantile(0.5, "p50"), quantile(0.95, "p95"), F.stddev_samp(value).alias("stddev"))


def described(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    quantile = lambda q, name: F.percentile(value, q).alias(name)
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), quantile(0.25, "q1"), quantile(0.5, "q2"), quantile(0.75, "q3"), F.max(value).alias("high"))


def vote_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("vote").agg(F.count("*").alias("n"))


def latencies(starts: DataFrame, ends: DataFrame, by: str = "id", ts: str = "ts") -> DataFrame:
    """id, seconds between the first start and the last end of what has both."""
    first, last = starts.groupBy(by).agg(F.min(ts).alias("__from")), ends.groupBy(by).agg(F.max(ts).alias("__to"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return first.join(last, by).select(by, ((micros("__to") - micros("__from")) / 1e6).alias("seconds"))


def tracked(rows: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """The rows as they are, and their ids aside, for trackers."""
    return rows, rows.select(F.col(by).alias("id"))


def counters(results: DataFrame) -> DataFrame:
    """commits, aborts, replays and closed of a graph's results; transactions that run in order are never replayed."""
    n = lambda vote: F.count_if(F.col("vote") == vote)
    return results.agg(n("COMMIT").alias("commits"), n("ABORT").alias("aborts"), n("REPLAY").alias("replays"), F.count("*").alias("closed"))


def observed(rows: DataFrame, **values: Column) -> tuple[DataFrame, Observation]:
    """rows with accumulators beside them: after an action the observation has their values, and no pass is added."""
    seen = Observation(f"accumulators {uuid.uuid4().hex}")
    return rows.observe(seen, *[v.alias(n) for n, v in values.items()]), seen


def finish_on_count(rows: DataFrame, n: int, severe: bool = True) -> bool:
    """Whether there are ``n`` rows; more are an error unless ``severe`` is off. No more than n + 1 are counted."""
    found = rows.limit(n + 1).count()
    if found > n and severe:
        raise ValueError(f"more than {n} rows")
    return found >= n


@dataclass
class TimeDelta:
    """Times between the start and the end of ids, and their curve in the order of ends."""

    started: dict[object, float] = field(default_factory=dict)
    curve: list[float] = field(default_factory=list)

    def start(self, key: object, now: float) -> None:
        self.started.setdefault(key, now)

    def end(self, key: object, now: float) -> float | None:
        """Seconds since the start of ``key``; None for one that hasn't started or has ended before."""
        since = self.started.pop(key, None)
        if since is not None:
            self.curve.append(now - since)
            return now - since
        return None

    @property
    def mean(self) -> float:
        return sum(self.curve) / len(self.curve) if self.curve else 0.0


@dataclass
class Throughput:
    """Records a second over buckets of at least ``bucket`` seconds, after the first ``warm_up`` records."""

    bucket: float = 10.0
    warm_up: int = 0
    curve: list[float] = field(default_factory=list)
    _seen: int = 0
    _held: int = 0
    _since: float | None = None

    def add(self, n: int, now: float) -> None:
        self._seen += n
        if self._seen <= self.warm_up:
            return
        if self._since is None:
            self._since = now
            return
        self._held += n
        if now - self._since >= self.bucket:
            self.curve.append(self._held / (now - self._since))
            self._held, self._since = 0, now

    @property
    def mean(self) -> float:
        return sum(self.curve) / len(self.curve) if self.curve else 0.0


@dataclass
class Report:
    """Named numbers and curves, written as indented JSON."""

    name: str
    metrics: dict[str, object] = field(default_factory=dict)

    def put(self, key: str, value: object) -> None:
        self.metrics[key] = value

    def text(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True, default=str)

    def write(self, folder: str) -> str:
        path = f"{folder}/{self.name}.json"
        with open(path, "w") as f:
            f.write(self.text())
        return path


def sustainable_rate(run: Callable[[int], float], start: int, step: int, queue: float = 50.0, most: int = 1_000) -> tuple[int, float]:
    """The greatest rate whose latency stays below the unloaded one times ``queue``; and the unloaded latency.

    ``run(rate)`` measures the mean latency at a rate; ``run(0)`` with one record in flight.
    """
    unloaded, rate, best = run(0), start, 0
    for _ in range(most):
        if run(rate) >= unloaded * queue:
            break
        best, rate = rate, rate + step
    return best, unloaded


def timed(action: Callable[[], object]) -> float:
    began = time.perf_counter()
    action()
    return time.perf_counter() - began

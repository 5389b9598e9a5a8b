"""Streams released in order: decisions by contiguous ids, and records of transactions once these are complete.

A graph is one key, as its order is one: the state holds what waits, and no more. Batch forms are in ``operators.sequence``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sequenced(events: DataFrame, first: int = 1) -> DataFrame:
    """graph, tid, at of a stream (graph, at, tid, replay): each transaction given on once all before it are decided.

    ``at`` is then the arrival that released it. A replay holds its transaction back until another decision has come; one
    that comes after the transaction was released is late and changes nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, waiting = state.get if state.exists else (first, [])
        held, out = set(waiting), []
        for _, row in pd.concat(list(batches)).sort_values("at", kind="stable").iterrows():
            if row["replay"]:
                held.discard(int(row["tid"]))
            elif row["tid"] >= following:
                held.add(int(row["tid"]))
            while following in held:
                held.discard(following)
                out.append((key[0], following, int(row["at"])))
                following += 1
        state.update((following, sorted(held)))
        yield pd.DataFrame(out, columns=["graph", "tid", "at"])

    return events.groupBy("graph").applyInPandasWithState(step, "graph string, tid long, at long", "following long, waiting array<long>", "append", GroupStateTimeout.NoTimeout)


def is_complete(found: set[tuple[tuple[int, int], ...]]) -> bool:
    """Whether a set of paths has all leaves of one tree, by whole numbers."""

    def below(prefix: tuple, paths: list[tuple]) -> bool:
        if any(len(p) == len(prefix) for p in paths):
            return len(paths) == 1
        own: dict[int, list[tuple]] = {}
        for p in paths:
            own.setdefault(p[len(prefix)][0], []).append(p)
        size = paths[0][len(prefix)][1]
        return len(own) == size and all(below((*prefix, group[0][len(prefix)]), group) for group in own.values())

    return bool(found) and below((), sorted(found))


def total_order(records: DataFrame, first: int = 1) -> DataFrame:
    """graph, tid, path, value of a stream (graph, tid, path, value): transactions in the order of their ids, each once it is
    complete, its records in the order of their paths. ``path`` is an array of (off, size)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, waiting = state.get if state.exists else (first, "{}")
        held = {int(t): rows for t, rows in json.loads(waiting).items()}
        for row in pd.concat(list(batches)).itertuples(index=False):
            path = [[int(s["off"]), int(s["size"])] for s in row.path]
            if row.tid >= following and path not in [p for p, _ in held.get(row.tid, [])]:
                held.setdefault(int(row.tid), []).append([path, row.value])
        out = []
        while following in held and is_complete({tuple(map(tuple, p)) for p, _ in held[following]}):
            for path, value in sorted(held.pop(following), key=lambda x: x[0]):
                out.append((key[0], following, [{"off": a, "size": b} for a, b in path], value))
            following += 1
        state.update((following, json.dumps(held)))
        yield pd.DataFrame(out, columns=["graph", "tid", "path", "value"])

    kind = "graph string, tid long, path array<struct<off:int,size:int>>, value string"
    return records.groupBy("graph").applyInPandasWithState(step, kind, "following long, waiting string", "append", GroupStateTimeout.NoTimeout)

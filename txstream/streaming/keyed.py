"""Stateful streams of one key each: commands folded in order with the state kept by the stream itself."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.statefn import StateFunction
from ..schemas import ABORT, COMMIT


def command_stream(commands: DataFrame, fn: StateFunction) -> DataFrame:
    """spu_id, key, vote, value of a stream (spu_id, ord, key, method, param): each micro-batch's commands of a key in order."""
    python = {name: forms[1] for name, forms in fn.commands.items()}
    default, ok = fn.default, fn.py_invariant

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value = state.get[0] if state.exists else default
        rows = pd.concat(list(batches)).sort_values("ord", kind="stable")
        out = []
        for spu_id, method, param in zip(rows["spu_id"], rows["method"], rows["param"]):
            if method not in python:
                raise ValueError(f"{method} is not a command of this state")
            new = python[method](param, value)
            good = ok(new)
            value = new if good else value
            out.append((spu_id, key[0], COMMIT if good else ABORT, value))
        state.update((value,))
        yield pd.DataFrame(out, columns=["spu_id", "key", "vote", "value"])

    return commands.groupBy("key").applyInPandasWithState(fold, "spu_id string, key string, vote string, value double", "value double", "append", GroupStateTimeout.NoTimeout)

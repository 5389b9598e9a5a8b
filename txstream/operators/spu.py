"""Single-key commands: methods of a state applied to one key each, in order, without a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import ABORT, COMMIT
from .folds import folded
from .statefn import StateFunction


def call(fn: StateFunction, method: str, *params):
    """The Python form of a command, the current value last; unknown methods are an error."""
    return fn.command(method)[1](*params)


def checked(commands: DataFrame, fn: StateFunction) -> DataFrame:
    """Commands whose method the state offers; any other makes the query fail when it runs."""
    known = F.col("method").isin(list(fn.commands))
    return commands.withColumn("method", F.when(known, F.col("method")).otherwise(F.raise_error(F.concat(F.coalesce("method", F.lit("null")), F.lit(" is not a command of this state"))).cast("string")))


def apply_commands(commands: DataFrame, fn: StateFunction, state: DataFrame | None = None) -> DataFrame:
    """spu_id, ns, key, vote, value: each key's commands in their order (ord), from its state or the default.

    The value is the key's after the command: unchanged where the invariant refused it. ``state``: ns, key, value.
    """
    rows = checked(commands, fn).select("ns", "key", "spu_id", "ord", "method", "params")
    first = fn.default_column()
    if state is not None:
        rows = rows.join(state.select("ns", "key", F.col("value").alias("held")), ["ns", "key"], "left")
        first = F.coalesce(F.col("held"), first)
    methods, holds = {name: forms[1] for name, forms in fn.commands.items()}, fn.py_invariant

    def step(value, row: dict) -> tuple:
        new = methods[row["method"]](row["params"][0], value)
        ok = new is not None and holds(new)
        return (new if ok else value), ok

    found = folded(rows, ("ns", "key"), ("ord", "spu_id"), first, fn.value_type, step, ("spu_id",))
    return found.select("spu_id", "ns", "key", F.when(F.col("ok"), COMMIT).otherwise(ABORT).alias("vote"), "value")

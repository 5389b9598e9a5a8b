"""Folds of rows in order, key by key: a task sorts its keys' rows and streams them, holding one key's value."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folded(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], first: Column, value_type: str, step: Callable[[Any, dict], tuple[Any, bool]], keep: tuple[str, ...]) -> DataFrame:
    """``by``, ``keep``, ok, value of every row: ``step(value, row)`` gives the key's value after it and whether it went through.

    ``first`` is a key's value before its first row (the same in all its rows). A key with very many rows is a long task,
    as its rows depend on each other, but no large one: values alone are held.
    """
    columns = [*by, *keep, *[c for c in rows.columns if c not in (*by, *keep)]]
    schema = rows.select(*columns).schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields[: len(by) + len(keep)]) + f", ok boolean, value {value_type}"
    given = rows.select(*columns, first.cast(value_type).alias("__first")).repartition(*by).sortWithinPartitions(*by, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value = None, None
        for batch in batches:
            n = len(by) + len(keep)
            values, oks = [], []
            for row in batch.to_pylist():
                own = [row[c] for c in by]
                if own != key:
                    key, value = own, row["__first"]
                value, ok = step(value, row)
                values.append(value)
                oks.append(ok)
            kind = batch.schema.field("__first").type
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(oks, pa.bool_()), pa.array(values, kind)], names=[*batch.schema.names[:n], "ok", "value"])

    return given.mapInArrow(run, out)



def co_mapped(first: DataFrame, second: DataFrame, by: tuple[str, ...], order: str, start: Any, value_type: str, steps: tuple[Callable, Callable], keep: str) -> DataFrame:
    """``by``, ``keep``, side, ok, value: two inputs that share a value for each key, taken together in ``order``.

    ``steps`` are those of the first and of the second input. Rows of both at one place in the order: the first's come first.
    """
    sides = [d.withColumn("side", F.lit(k)) for k, d in enumerate((first, second))]
    both = sides[0].unionByName(sides[1], allowMissingColumns=True)
    return folded(both, by, (order, "side"), F.lit(start), value_type, lambda value, row: steps[row["side"]](value, row), (keep, "side"))

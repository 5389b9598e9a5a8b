"""Words of lines, and composed identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(line: Column) -> Column:
    """Lower-cased runs of [A-Za-z0-9_]; none of a null line."""
    return F.filter(F.split(F.lower(line), "[^a-z0-9_]+"), lambda w: F.length(w) > 0)


def words(lines: DataFrame, line: str) -> DataFrame:
    return lines.select(F.explode(tokens(F.col(line))).alias("word"))


def composed_id(*parts: Column) -> Column:
    """Parts joined by dots."""
    return F.concat_ws(".", *[p.cast("string") for p in parts])


def shard_of(namespace: Column) -> Column:
    """The plain namespace of a name with a shard behind a dash."""
    return F.element_at(F.split(namespace, "-"), 1)


def close_line(tid: Column, ts: Column, vote: Column, batch_size: Column, deps: Column) -> Column:
    """A close notification as a line of commas: tid, ts, vote, batch size, and the dependencies joined by ``;``."""
    return F.concat_ws(",", tid.cast("string"), ts.cast("string"), vote, batch_size.cast("string"), F.array_join(F.transform(deps, lambda d: d.cast("string")), ";"))


def close_fields(line: Column) -> Column:
    """The notification of a line, as ``close_line`` writes it."""
    parts = F.split(line, ",", -1)
    deps = F.transform(F.filter(F.split(parts[4], ";"), lambda d: d != ""), lambda d: d.cast("long"))
    return F.struct(parts[0].cast("long").alias("tid"), parts[1].cast("long").alias("ts"), parts[2].alias("vote"), parts[3].cast("int").alias("batch_size"), deps.alias("deps"))

"""Votes of transactions: a lattice in which merging takes the worst."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ABORT, COMMIT, RANKS, REPLAY

NAMES = [COMMIT, ABORT, REPLAY]


def rank(vote: Column | str) -> Column:
    """0, 1, 2 for COMMIT, ABORT, REPLAY; null for anything else."""
    vote = F.col(vote) if isinstance(vote, str) else vote
    return F.when(vote == COMMIT, 0).when(vote == ABORT, 1).when(vote == REPLAY, 2)


def named(ranked: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in NAMES]), ranked.cast("int") + 1)


def merged(vote: Column | str) -> Column:
    """The merged vote of a group: an aggregate with partial sums."""
    return named(F.max(rank(vote)))


def reduced(rows: DataFrame, *by: str) -> DataFrame:
    """by, vote, cohorts, deps: the merged vote of each group and the unions of its lists, without repetition, in order."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return rows.groupBy(*by).agg(merged("vote").alias("vote"), union("cohorts"), union("deps"))


def merge(votes: Iterable[str]) -> str:
    return NAMES[max((RANKS[v] for v in votes), default=0)]

"""Connected components of a table of links, by minimum labels with pointer jumping.

Up to ``ONE`` links are labelled in one task, as arrays. Of more, tasks first replace their links by a star for each group
that hangs together in them, which leaves no more links than there were and mostly far fewer. Then each round every node takes the least label of its neighbours and then its label's own label, so distances halve; a
round is written to the shared folder, which cuts the lineage, and the one before goes. Only the number of changed labels
reaches the driver. A node with many links, and a label that most nodes have, are looked up where their rows are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import released, stored
from .joins import looked_up


#: Links that one task labels, some 50 MB; and that a task turns into stars at a time.
ONE = 1 << 18


def labelled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in links and the least id that each can reach."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)  # whole groups take the lower label
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def given() -> pa.RecordBatch:
        ids, least = labelled(*(np.concatenate(side) for side in zip(*held)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least)], names=["id", "component"])

    for batch in batches:
        for at in range(0, batch.num_rows, ONE):
            held.append(tuple(batch.column(k).slice(at, ONE).to_numpy() for k in range(2)))
            if sum(len(x) for x, _ in held) >= ONE:
                yield given()
    if held:
        yield given()


def components(links: DataFrame) -> DataFrame:
    """id, component (the least id reachable) for every id in links (a, b); an empty table gives none."""
    links = stored(links.select("a", "b").distinct(), "links")
    if links.limit(ONE + 1).count() <= ONE:
        found = stored(links.repartition(1).mapInArrow(_stars, "id long, component long"), "labels")
        released(links)
        return found
    stars = links.mapInArrow(_stars, "id long, component long").select(F.col("id").alias("a"), F.col("component").alias("b"))
    return _rounds(stars)


def _rounds(links: DataFrame) -> DataFrame:
    """Components by rounds over all links; an id that links to itself alone is a component."""
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    # as many links lead from a node as to it
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component"), F.count("*").alias("n")), "labels")
    while True:
        near = looked_up(both, labels.select(F.col("id").alias("b"), "component", "n"), "b")
        near = near.groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        moved = stored(labels.join(near, "id").select("id", "component", "n", F.least("component", "near").alias("via")), "labels")
        vias = moved.groupBy("via").agg(F.count("*").alias("times"))
        jump = vias.join(labels.select(F.col("id").alias("via"), F.col("component").alias("beyond")), "via")
        found = looked_up(moved, jump, "via", "times")
        changed = F.least("via", "beyond") < F.col("component")
        new = stored(found.select("id", F.least("via", "beyond").alias("component"), "n", changed.alias("changed")), "labels")
        released(labels, moved)
        labels = new
        if labels.where("changed").isEmpty():
            released(both)
            return labels.select("id", "component")

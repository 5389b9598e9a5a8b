"""Near duplicates by MinHash with sequential Bayesian verification.

1. One pass makes each document's sketch: the size and a 128-bit key of its shingle set, ``BANDS`` band keys of
   ``ROWS`` minima each, and ``HASHES`` one-byte minima. Documents with equal sets become one class, whose least id
   stands for it, so copies meet nothing but an aggregate.
2. Classes that share a band key are candidates. Not all pairs of a bucket are made: each member meets one of a few
   representatives of its bucket, chosen by hash (a different one for each fourth of the bands). Candidates are compared
   in batches of ``BATCH`` minima; a pair goes as soon as the posterior probability (uniform prior) that its similarity
   reaches the threshold falls below ``MISS``. Survivors join their classes into clusters of similar documents. Buckets
   that still hold several clusters are compared whole, under the same bounds, in blocks that give on a forest.
3. All surviving pairs lie within clusters. A cluster's members meet in blocks inside tasks, where surviving pairs are
   confirmed on full sets; of the links between two components one is given on.

Blocks hold up to about ``MEMBERS`` members and ``BLOCK`` shingles, whatever the size of a bucket or cluster. One that
needs several blocks goes through three steps (``linked``): pairs within blocks; then a few members of each component so
far, in blocks of their own, as long as that joins components; and last all members outside the largest component
against everyone. So a large group that hangs together costs what its members do, and no pair of two components is left
out. What the last step adds grows with the members outside the largest component alone.

Pairs never become rows, and the links lost are those that share no band, (1 - s**ROWS)**BANDS of the pairs at
similarity s (3e-6 at 0.8), and MISS of the pruned. Keys that many rows have (a set, a band, a cluster) are looked up
where the rows are (``operators.joins``).

Defined cases: a text without words (or null) has an empty set and is linked with nothing; a text with fewer words than
a shingle is one shingle; very long texts take part with their whole sets; a similarity of exactly the threshold is a link;
equal sets are one class and the least id stands for a component; rows with a null id are linked with nothing, are kept,
and have a null component; rows that share an id are one document; an empty table gives none; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.joins import looked_up
from .common import WordHash, frugal, holds, released, stored, texts, windows

HASHES, ROWS, BANDS = 128, 4, 24
BATCH, MISS = 16, 1e-6
#: Members and shingles (8 bytes each) of a block: a task holds two blocks.
MEMBERS, BLOCK = 1 << 12, 1 << 20
#: Members that stand for a component of a cluster of many blocks.
SPOKESMEN = 4
#: Representatives of a bucket: as many orders of its members are tried, one for each group of bands.
ORDERS = 4
_SKETCH = "doc_id long, n_shingles long, set_key binary, minima binary, bands array<long>"
_SETS = "doc_id long, shingles binary"
_random = np.random.default_rng(20_011)
_A = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_words = WordHash()
_NAME = "near_dedup"
holds(_NAME, _words.clear)


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, A-Z lower-cased."""
    return np.unique(windows(_words.of((text or b"").lower().split()), size))


def minima(shingles: np.ndarray) -> np.ndarray:
    """HASHES 32-bit minima of a set that isn't empty; in pieces, so that memory is bounded."""
    out = np.full(HASHES, np.uint64(0xFFFFFFFF))
    for at in range(0, len(shingles), 2048):
        part = (shingles[at : at + 2048, None] * _A + _B) >> np.uint64(32)
        np.minimum(out, part.min(axis=0), out=out)
    return out.astype(np.uint32)


def band_keys(found: np.ndarray) -> np.ndarray:
    rows = found[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    return windows_by_row(np.concatenate([np.arange(BANDS, dtype=np.uint64)[:, None] + np.uint64(1), rows], axis=1))


def windows_by_row(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), dtype=np.uint64)
    for k in range(rows.shape[1]):
        out = (out ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def least_matches(percent: int, miss: float = MISS) -> np.ndarray:
    """For each batch of minima the least number of matches, so far, that keeps a pair.

    One-byte minima match with probability s + (1 - s) / 256 at similarity s. Given m matches in n the posterior of the
    match probability is Beta(m + 1, n - m + 1); it reaches t with the probability that Binomial(n + 1, t) is m or less.
    """
    t = percent / 100 + (1 - percent / 100) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append(m)
    return np.array(out)


def surviving(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows of minima survive all batches, and the matches they have."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), dtype=np.int64)
    for k, need in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= need]
    return alive, matches[alive]


def sketches(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, small, bands = [], [], [], []
            for text in texts(batch.column(1)):
                shingles = shingle_set(text, size)
                counts.append(len(shingles))
                found = minima(shingles) if len(shingles) else None
                keys.append(xxhash.xxh3_128_digest(shingles.tobytes()) if found is not None else None)
                small.append(found.astype(np.uint8).tobytes() if found is not None else None)
                bands.append(band_keys(found).tolist() if found is not None else None)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(small, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_key", "minima", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(frugal(run, _NAME), _SKETCH)


def shingle_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """The full sets of the documents named in ``ids`` (doc_id, distinct)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size).tobytes() for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(ids, "doc_id", "left_semi").mapInArrow(frugal(run, _NAME), _SETS)


def compared(pairs: DataFrame, small: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs (id, rep) that sequential comparison of their minima doesn't prune. Many may have one rep."""
    least = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, HASHES) for k in (2, 3)]
            at = pa.array(surviving(*sides, least)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    reps = pairs.groupBy("rep").agg(F.count("*").alias("n")).join(small.select(F.col("doc_id").alias("rep"), F.col("minima").alias("other")), "rep")
    own = pairs.join(small.withColumnRenamed("doc_id", "id"), "id")
    return looked_up(own, reps, "rep", how="inner").select("id", "rep", "minima", "other").mapInArrow(run, "a long, b long")


def _common(rows: list[np.ndarray]):
    """Exact sizes of intersections, by the rows that have each value: 20 bytes a value, however many rows there are."""
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    at = np.unique(np.concatenate(rows), return_inverse=True)[1].astype(np.int32)
    order = np.argsort(at, kind="stable")
    owner = (np.searchsorted(bounds, order, "right") - 1).astype(np.int32)
    first = np.concatenate([[0], np.cumsum(np.bincount(at))])

    def sizes(x: int, others: np.ndarray) -> np.ndarray:
        mine = at[bounds[x] : bounds[x + 1]]
        found = np.zeros(len(rows), dtype=np.int64)
        for k in range(0, len(mine), 4096):  # the rows of so many values at a time
            start, n = first[mine[k : k + 4096]], first[mine[k : k + 4096] + 1] - first[mine[k : k + 4096]]
            places = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            found += np.bincount(owner[places], minlength=len(rows))
        return found[others]

    return sizes


def _pairs(group: dict, least: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of a block its partners that survive, of another root than its own so far.

    Where members visit, they are compared with those that live in the block; else all are, each pair once.
    """
    root, visits, small = group["root"], group["visits"], group["small"]
    cross, living = visits.any(), np.flatnonzero(~visits)
    for x in np.flatnonzero(visits) if cross else range(len(root)):
        others = living if cross else living[x + 1 :]
        others = others[root[others] != root[x]]
        if len(others):
            others = others[surviving(np.broadcast_to(small[x], (len(others), HASHES)), small[others], least)[0]]
            if len(others):
                yield x, others


def block_links(group: dict, least: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (a, b) that join the members of a block into components of its surviving pairs; where the group has sets, of
    those that they confirm. Members with one label are joined already."""
    ids, sets, common, out = group["ids"], group.get("sets"), None, []
    sizes = np.array([len(x) for x in sets]) if sets is not None else None
    group = group | {"root": (root := group["label"].copy())}
    for x, others in _pairs(group, least):
        if sets is not None:
            others = others[np.minimum(sizes[others], sizes[x]) * 100 >= percent * np.maximum(sizes[others], sizes[x])]
            if not len(others):
                continue
            common = common or _common(sets)
            shared = common(x, others)
            others = others[100 * shared >= percent * (sizes[x] + sizes[others] - shared)]
        for y in others:
            if root[x] != root[y]:
                out.append((ids[x], ids[y]))
                root[root == root[y]] = root[x]
    return out


def _blocks(weight, n):
    return F.ceil(F.greatest(weight / BLOCK, n / MEMBERS))


def _sizes(members: DataFrame) -> DataFrame:
    """key, n, blocks: the blocks that a key's members need."""
    return stored(members.groupBy("key").agg(F.count("*").alias("n"), _blocks(F.sum("weight"), F.count("*")).alias("blocks")), "sizes")


def _within(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """members (key, id, label, weight) dealt into blocks (i), each with its own alone."""
    dealt = looked_up(members, sizes, "key", how="inner")
    return dealt.select("key", F.pmod(F.xxhash64("id"), "blocks").alias("i"), F.lit(0).cast("long").alias("j"), "id", "label", F.lit(False).alias("visits"))


def _across(members: DataFrame) -> DataFrame:
    """members dealt so that each pair of two labels meets: those outside a key's largest label, in parts (j), visit all
    blocks (i) of the key."""
    labels = members.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    keys = labels.groupBy("key").agg(F.max(F.struct("n", "w", "label")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    rest = _blocks(F.col("w") - F.col("top.w"), F.col("n") - F.col("top.n"))
    keys = stored(keys.select("key", F.col("top.label").alias("top"), "n", _blocks(F.col("w"), F.col("n")).alias("blocks"), rest.alias("parts")).where("parts > 0"), "sizes")
    dealt = looked_up(members, keys, "key", how="inner")
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    living = dealt.select("key", F.pmod(F.xxhash64("id"), "blocks").alias("i"), all_of("parts").alias("j"), "id", "label", F.lit(False).alias("visits"))
    visiting = dealt.where("label != top").select("key", all_of("blocks").alias("i"), F.pmod(F.xxhash64("id"), "parts").alias("j"), "id", "label", F.lit(True).alias("visits"))
    return living.unionByName(visiting)


def _met(dealt: DataFrame, small: DataFrame, sets: DataFrame | None, percent: int) -> DataFrame:
    """a, b: what ``block_links`` finds in each block (key, i, j)."""
    full = dealt.join(small.withColumnRenamed("doc_id", "id"), "id")
    if sets is not None:
        full = full.join(sets.withColumnRenamed("doc_id", "id"), "id")
    least, with_sets = least_matches(percent), sets is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in runs(batches, 3):
            group = {
                "ids": found.column("id").to_numpy(), "label": found.column("label").to_numpy(), "visits": found.column("visits").to_numpy(),
                "small": np.frombuffer(b"".join(found.column("minima").to_pylist()), dtype=np.uint8).reshape(-1, HASHES),
            }
            if with_sets:
                group["sets"] = [np.frombuffer(x, dtype=np.uint64) for x in found.column("shingles").to_pylist()]
            pairs = block_links(group, least, percent)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], names=["a", "b"])

    full = full.select("key", "i", "j", "id", "label", "visits", "minima", *(["shingles"] if with_sets else []))
    return full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def linked(members: DataFrame, small: DataFrame, sets_of, percent: int) -> DataFrame:
    """a, b: links that join each key's members (key, id, label, weight) as all surviving pairs among them do.

    ``sets_of(ids)`` gives the full sets that confirm pairs, or None where minima are to decide.
    """

    def met(dealt: DataFrame) -> DataFrame:
        return stored(_met(dealt, small, sets_of(dealt.select(F.col("id").alias("doc_id")).distinct()), percent), "met")

    def relabelled(rows: DataFrame, links: DataFrame) -> DataFrame:
        """Members of keys that have several labels still, labels renewed by the links between them."""
        named = rows.select("id", "label").distinct()
        ends = links.join(named.select(F.col("id").alias("a"), F.col("label").alias("x")), "a").join(named.select(F.col("id").alias("b"), F.col("label").alias("y")), "b")
        new = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a != b"))
        counts = rows.groupBy("label").agg(F.count("*").alias("n")).join(new.withColumnRenamed("id", "label"), "label")
        renewed = stored(looked_up(rows, stored(counts, "labels"), "label").withColumn("label", F.coalesce("component", "label")).drop("component"), "members")
        mixed = renewed.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
        return stored(looked_up(renewed, stored(mixed.select("key", "n"), "mixed"), "key", how="inner"), "members")

    sizes = _sizes(members)
    if sizes.where("blocks > 1").isEmpty():  # every key is a block
        zero = F.lit(0).cast("long")
        return met(members.select("key", zero.alias("i"), zero.alias("j"), "id", "label", F.lit(False).alias("visits")))
    links = met(stored(_within(members, sizes), "dealt"))
    large, labels = relabelled(looked_up(members, sizes.where("blocks > 1").drop("blocks"), "key", how="inner"), links), None
    while not large.isEmpty():
        before, labels = labels, large.select("key", "label").distinct().count()
        if before is not None and 2 * labels > before:  # what is left isn't joined by a few members of each
            return links.union(met(stored(_across(large), "dealt")))
        chosen = F.array_distinct(F.array(*[F.min_by(F.struct("id", "weight"), F.xxhash64("id", F.lit(k))) for k in range(SPOKESMEN)]))
        few = large.groupBy("key", "label").agg(chosen.alias("some"))
        few = stored(few.select("key", "label", F.explode("some").alias("one")).select("key", "one.id", "label", "one.weight"), "few")
        found = met(stored(_within(few, _sizes(few)), "dealt"))
        links, large = links.union(found), relabelled(large, found)
    return links


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of neighbouring rows with equal first ``keys`` columns, across batches; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    name: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            now = tuple(c[a] for c in columns)
            if name is not None and now != name:
                yield name, pa.Table.from_batches(held)
                held = []
            name = now
            held.append(batch.slice(a, b - a))
    if held:
        yield name, pa.Table.from_batches(held)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; links join sets with a Jaccard similarity of percent / 100."""
    sketch = stored(sketches(docs, size), "sketches")
    known = sketch.where(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    classes = stored(known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    named = classes.select(F.col("set_key").alias("key"), "rep")
    leaders = stored(known.join(named, (known.set_key == named.key) & (known.doc_id == named.rep)).select("doc_id", "n_shingles", "minima", "bands"), "leaders")
    small = leaders.select("doc_id", "minima")

    bands = leaders.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "key"))
    tried = F.min_by(F.col("id"), F.xxhash64(F.col("id"), F.pmod("band", F.lit(ORDERS))))
    buckets = stored(bands.groupBy("key").agg(tried.alias("rep"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = stored(looked_up(bands.select("key", "id"), buckets.withColumn("size", F.col("n")), "key", how="inner"), "members")
    pairs = stored(members.where("id != rep").select("id", "rep").distinct(), "pairs")
    open_pairs = stored(compared(pairs, small, percent), "survivors")
    similar = components(open_pairs)

    # buckets whose representatives haven't brought all their members together
    labelled = stored(members.where("size > 2").select("key", "id").join(similar, "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"), F.lit(0).cast("long").alias("weight")), "labelled")
    mixed = labelled.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key", "n")
    mixed = stored(looked_up(labelled, stored(mixed, "mixed"), "key", how="inner"), "mixed")
    if not mixed.isEmpty():
        similar = components(open_pairs.union(linked(mixed, small, lambda ids: None, percent)))

    near = leaders.select(F.col("doc_id").alias("id"), "n_shingles").join(similar, "id")
    near = stored(near.select(F.col("component").alias("key"), "id", F.col("id").alias("label"), F.col("n_shingles").alias("weight")), "near")
    labels = components(linked(near, small, lambda ids: shingle_sets(docs, ids, size), percent))

    found = stored(classes.join(labels, F.col("rep") == F.col("id"), "left").select("set_key", F.coalesce("component", "rep").alias("component"), "n"), "found")
    released(classes, leaders, buckets, members, pairs, open_pairs, labelled, mixed, near)
    rows = sketch.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    component = F.coalesce("component", "doc_id")
    return looked_up(rows, found, "set_key").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

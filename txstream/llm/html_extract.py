"""HTML extraction: host suffix arrays find the text that a host's pages repeat, and articles are told from the rest.

1. Each page is scanned into blocks (``markup``): in an article, in marked boilerplate, or elsewhere; each in a region, the
   innermost box that is open there.
2. The pages' token streams outside articles (a boundary, then the words, of each block) are dealt out by host and page,
   in ranges, so a host with many pages falls into several tasks. In each task the streams of a host are concatenated,
   up to ``SHARD`` tokens at a time, and their suffixes sorted to depth ``LONG``: neighbours that agree so far begin a
   long substring. Each distinct one is passed on with the number of distinct pages that have it, unless the host lies in
   this shard alone and too few have it.
3. The counts of a host's shards are added up. Copies of a page, equal or near, are one distinct page. What a share of a
   host's distinct pages have (``SHARE``; at least ``SURE``, or ``PAGES`` of a host of two) is repeated, and what most of
   them have (``OFTEN``; at least ``SURE``) is repeated often.
4. All pages are joined with what their host repeats. Tokens covered by repeated substrings are boilerplate and are
   cut out of their blocks; runs that are the page's own stay, each as a paragraph. In a region that is mostly the page's
   own, what is repeated, but not often, is a quotation and stays.

A passage that several articles quote, or an article that appears on two pages of a host, is repeated too, but is no
boilerplate; and the template of a host with one page never repeats. So marks are
evidence: marked articles stay, marked boilerplate goes, and repetition decides about all other blocks of every page,
whether it marks an article or not. README says more.

Defined cases: a null html counts as empty and gives an empty text; a page whose url is null or names no host has
no host to repeat it and keeps its text; very long pages are scanned and sorted whole; counts that just reach a share are
repeated; repeated rows count as one page and are extracted each; an empty table gives none; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, mixed, stored, windows
from .markup import ARTICLE, BOILERPLATE, FREE, blocks, placed

LONG = 8
PAGES = 2
SHARD = 1 << 20
#: What counts as repeated: on PAGES distinct pages at least, on SURE of them where the host has so many (two pages
#: that quote one another are no template), and on this share of them.
SURE = 3
SHARE = 0.25
#: In regions that are mostly a page's own only what this share of the host's distinct pages have is no quotation.
OFTEN = 0.75
#: Pages of a host whose contents agree in so many of the minima of their substrings are copies and count once.
MINIMA, COPIES = 16, 13
_STREAMS = "key long, host string, sketch binary, stream binary"
_PAGES = "key long, page_id long, url string, places array<int>, texts array<string>, regions array<int>"
_COUNTS = "host string, print long, pages long"
_TEXTS = "page_id long, url string, text string, n_chars long, n_blocks int, n_repeated int, repeated_tokens long"
_BOUNDARY = b"\x00block"
_words = WordHash()


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def stream_of(places: list[int], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the blocks outside articles and, for each, the number of its block."""
    tokens, owners = [], []
    for k, (place, text) in enumerate(zip(places, texts)):
        if place != ARTICLE:
            found = _words.of([_BOUNDARY, *text.encode("utf-8", "surrogatepass").split()])
            tokens.append(found)
            owners.append(np.full(len(found), k))
    return (np.concatenate(tokens), np.concatenate(owners)) if tokens else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def key_of(host: str, stream: bytes) -> int:
    """What repetition decides depends on a page's host and stream alone; a page without a stream has a key of any kind."""
    return xxhash.xxh64_intdigest(stream, xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"))) - (1 << 63)


def sketch_of(places: list[int], texts: list[str]) -> bytes:
    """Minima of the hashed substrings of a page's content: all but marked boilerplate, or that if there is nothing else."""
    content = [t for p, t in zip(places, texts) if p != BOILERPLATE] or texts
    tokens = windows(_words.of(" ".join(content).encode("utf-8", "surrogatepass").split()), LONG)
    return b"".join((mixed(tokens ^ np.uint64(k + 1)).min() >> np.uint64(16)).tobytes()[:6] for k in range(MINIMA))


def copies(sketches: list[bytes]) -> np.ndarray:
    """For each page the number of its group of copies, equal or near.

    Sorted by each of the minima in turn, near copies are neighbours; linked groups are joined.
    """
    grid = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(sketches), MINIMA, 6).astype(np.int64) @ (1 << np.arange(0, 48, 8))
    first = list(range(len(grid)))

    def root(k: int) -> int:
        while first[k] != k:
            first[k] = first[first[k]]
            k = first[k]
        return k

    for turn in range(MINIMA):
        order = np.lexsort(np.roll(grid, -turn, axis=1).T[::-1])
        near = (grid[order[1:]] == grid[order[:-1]]).sum(axis=1) >= COPIES
        for a, b in zip(order[:-1][near].tolist(), order[1:][near].tolist()):
            first[root(b)] = root(a)
    return np.unique([root(k) for k in range(len(grid))], return_inverse=True)[1]


def prints(tokens: np.ndarray, length: int = LONG) -> np.ndarray:
    """A hash of the ``length`` tokens from each position that has so many."""
    return windows(tokens, length).view(np.int64) if len(tokens) >= length else np.zeros(0, np.int64)


def sorted_suffixes(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of integer tokens, sorted to ``depth`` or beyond by prefix doubling, and the ranks of suffixes.

    Suffixes that agree in their first ``depth`` tokens (or more, to the next power of two) have equal ranks.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    done = 1
    while done < depth:
        step = min(done, depth - done)
        after = np.zeros(len(rank), dtype=np.int64)
        after[: max(0, len(rank) - step)] = rank[step:] + 1
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1]
        done += step
    return np.argsort(rank, kind="stable"), rank


def repeated_counts(streams: list[np.ndarray], length: int = LONG, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct substring of ``length`` tokens as its print, and how many of the streams (or of their groups) have it."""
    groups = np.arange(len(streams)) if groups is None else groups
    page = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
    names = np.unique(np.concatenate(streams), return_inverse=True)[1] if streams else np.zeros(0, np.int64)
    joined, at, made = np.empty(len(page), np.int64), 0, 0
    whole = np.zeros(len(page), dtype=bool)
    marks = np.zeros(len(page), dtype=np.int64)
    for k, s in enumerate(streams):
        joined[at : at + len(s)] = names[made : made + len(s)]
        joined[at + len(s)] = len(names) + k  # an end of its own, so nothing repeats across it
        if len(s) >= length:
            whole[at : at + len(s) - length + 1] = True
            marks[at : at + len(s) - length + 1] = prints(s, length)
        at, made = at + len(s) + 1, made + len(s)
    suffixes, rank = sorted_suffixes(joined, length)
    suffixes = suffixes[whole[suffixes]]  # suffixes too short for a long substring go
    if not len(suffixes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    group = np.cumsum(np.concatenate([[True], rank[suffixes][1:] != rank[suffixes][:-1]])) - 1
    distinct = np.unique(group * len(streams) + groups[page[suffixes]]) // len(streams)
    return marks[suffixes[np.concatenate([[True], group[1:] != group[:-1]])]], np.bincount(distinct)


def scanned(pages: DataFrame) -> DataFrame:
    """Hosts and token streams of all pages; pages of a host with equal streams share their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, streams, sketches = [host_of(u) for u in batch.column(0).to_pylist()], [], []
            for h in batch.column(1).to_pylist():
                found = blocks(h or "")
                places, texts = [p for p, _ in found], [t for _, t in found]
                streams.append(stream_of(places, texts)[0].tobytes())
                sketches.append(sketch_of(places, texts) if texts else None)
            keys = [key_of(h, s) for h, s in zip(hosts, streams)]
            at = pa.array([k for k, (h, s) in enumerate(zip(hosts, sketches)) if h and s], pa.int64())
            made = [pa.array(keys, pa.int64()), pa.array(hosts, pa.string()), pa.array(sketches, pa.binary()), pa.array(streams, pa.binary())]
            yield pa.RecordBatch.from_arrays([m.take(at) for m in made], names=[x.split()[0] for x in _STREAMS.split(", ")])

    return pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, _STREAMS)


def shard_counts(scans: DataFrame, length: int = LONG, at_least: int = 1) -> DataFrame:
    """host, print, pages: counts of each shard of a host, copies counted once; a null print counts the shard's pages.

    A host's pages are dealt in order of their sketches, so that copies meet: equal ones always; near ones unless the
    host is cut into shards or tasks between them. Where a shard is all of a host, counts below ``at_least`` end here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(host: str, streams: list[np.ndarray], sketches: list[bytes], whole: bool) -> pa.RecordBatch:
            groups = copies(sketches)
            marks, counts = repeated_counts(streams, length, groups)
            if whole:
                marks, counts = marks[counts >= at_least], counts[counts >= at_least]
            marks, counts = [None, *marks.tolist()], [int(groups.max()) + 1, *counts.tolist()]
            return pa.RecordBatch.from_arrays([pa.array([host] * len(marks), pa.string()), pa.array(marks, pa.int64()), pa.array(counts, pa.int64())], names=["host", "print", "pages"])

        host, held, sketches, size, last = None, [], [], 0, None
        whole = False  # neither the task's first host, which may have begun before, nor its last
        for batch in batches:
            for name, sketch, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (name, sketch, data) == last:
                    continue
                # a run of equal sketches isn't cut, unless it is long
                if held and (name != host or size >= SHARD and (sketch != sketches[-1] or size >= 4 * SHARD)):
                    yield given(host, held, sketches, whole and name != host)
                    held, sketches, size, whole = [], [], 0, name != host
                host, last = name, (name, sketch, data)
                held.append(np.frombuffer(data, dtype=np.uint64))
                sketches.append(sketch)
                size += len(held[-1]) + 1
        if held:
            yield given(host, held, sketches, False)

    dealt = scans.select("host", "sketch", "key", "stream").repartitionByRange("host", "sketch").sortWithinPartitions("host", "sketch", "key")
    return dealt.select("host", "sketch", "stream").mapInArrow(run, _COUNTS)


def repeated_prints(scans: DataFrame, length: int = LONG, at_least: int = PAGES) -> DataFrame:
    """host (as a number) and print of what enough of the host's distinct pages have, and whether they have it often."""
    counts = shard_counts(scans, length, at_least).groupBy(F.xxhash64("host").alias("host"), "print").agg(F.sum("pages").alias("pages"))
    counts = stored(counts.where(F.col("print").isNull() | (F.col("pages") >= at_least)), "prints")
    hosts = counts.where("print is null").select("host", F.greatest(F.lit(at_least), F.least(F.lit(SURE), "pages"), F.ceil(F.col("pages") * SHARE)).alias("needed"), F.greatest(F.lit(SURE), F.ceil(F.col("pages") * OFTEN)).alias("many"))
    found = counts.where("print is not null").join(hosts, "host").where("pages >= needed")
    return found.select("host", "print", (F.col("pages") >= F.col("many")).alias("often"))


def _read(pages: DataFrame) -> DataFrame:
    """The blocks of all pages under the keys of their streams; a page without one has a key that spreads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, texts, regions = [], [], [], []
            for k, (u, h) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                found = placed(h or "")
                places.append([p for p, _, _ in found])
                texts.append([t for _, t, _ in found])
                regions.append([r for _, _, r in found])
                stream = stream_of(places[-1], texts[-1])[0].tobytes()
                host = host_of(u)
                keys.append(key_of(host, stream) if host and stream else k)
            made = [pa.array(places, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string())), pa.array(regions, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(0), batch.column(1), *made], names=[x.split()[0] for x in _PAGES.split(", ")])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, _PAGES)


def extract(pages: DataFrame, length: int = LONG, at_least: int = PAGES) -> DataFrame:
    """page_id, url, text, n_chars for every row, with the number of its blocks and of those that repetition covers wholly."""
    scans = stored(scanned(pages), "pages")
    repeated = repeated_prints(scans, length, at_least)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(prints(np.frombuffer(s, dtype=np.uint64), length)) for s in batch.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(found) if found else [], pa.int64())], names=["key", "host", "print"])

    # hosts as numbers, so that rows of the join are short; copies ask once
    windows_ = scans.dropDuplicates(["key"]).select("key", F.xxhash64("host").alias("host"), "stream").mapInArrow(own, "key long, host long, print long")
    covered = windows_.join(repeated, ["host", "print"]).groupBy("key").agg(F.collect_list("print").alias("prints"), F.collect_list(F.when(F.col("often"), F.col("print"))).alias("often"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for places, texts, regions, prints_, often in zip(*(batch.column(k).to_pylist() for k in range(2, 7))):
                kept, gone, tokens = own_runs(places, texts, prints_ or [], length, regions, often or [])
                text = "\n\n".join(kept)
                out.append((text, len(text), len(texts), gone, tokens))
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)]], names=[x.split()[0] for x in _TEXTS.split(", ")])

    return _read(pages).join(covered, "key", "left").select("page_id", "url", "places", "texts", "regions", "prints", "often").mapInArrow(run, _TEXTS)


def _covered(tokens: np.ndarray, repeated: list[int], length: int) -> np.ndarray:
    """Which tokens lie in a repeated substring."""
    at = np.flatnonzero(np.isin(prints(tokens, length), np.array(repeated, dtype=np.int64)))
    cover = np.zeros(len(tokens) + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + length, -1)
    return np.cumsum(cover)[:-1] > 0


def own_runs(places: list[int], texts: list[str], repeated: list[int], length: int = LONG, regions: list[int] | None = None, often: list[int] = ()) -> tuple[list[str], int, int]:
    """The texts of articles and the runs of other unmarked blocks that repeated substrings don't cover, in order; the
    number of blocks that they cover wholly, and of covered tokens. In regions that they cover less than half, those in
    ``often`` count alone."""
    if not repeated:
        return [t for p, t in zip(places, texts) if p != BOILERPLATE], 0, 0
    tokens, owners = stream_of(places, texts)
    covered = _covered(tokens, repeated, length)
    starts = np.searchsorted(owners, np.arange(len(texts) + 1))
    if regions is not None:
        words = np.ones(len(tokens), dtype=bool)
        words[starts[:-1][np.diff(starts) > 0]] = False  # boundaries
        region = np.unique(np.array(regions, dtype=np.int64)[owners], return_inverse=True)[1]
        n, hit = (np.bincount(region, weights=w, minlength=1) for w in (words, words & covered))
        mostly_own = (2 * hit < n)[region]
        covered = np.where(mostly_own, _covered(tokens, list(often), length), covered)
    kept, gone = [], 0
    for k, (place, text) in enumerate(zip(places, texts)):
        if place == ARTICLE:
            kept.append(text)
            continue
        inside = covered[starts[k] + 1 : starts[k + 1]]  # without the boundary
        gone += bool(inside.all())
        if place == FREE and not inside.any():
            kept.append(text)
        elif place == FREE:
            words = text.split(" ")
            edges = np.flatnonzero(np.diff(np.concatenate([[True], inside, [True]])))
            kept += [" ".join(words[a:b]) for a, b in edges.reshape(-1, 2).tolist()]
    return kept, gone, int(covered.sum())

import random

import numpy as np
import pytest

from txstream.llm import near_dedup, queries
from txstream.llm.common import table

from .conftest import SCHEMA, prose


def brute(rows, size, percent):
    """Components by comparing all pairs of sets of word tuples."""
    sets = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        n = min(size, len(words))
        sets[doc_id] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in ids}


def found_of(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def test_documents_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.op5_near_dedup(spark, sf).collect()
    wanted = brute([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()], 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


@pytest.mark.parametrize("block", [1 << 20, 4_000])
def test_a_cloud_of_copies_around_the_threshold(spark, monkeypatch, block):
    """Copies whose pairs are as often links as not, in one block and in many."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    r, words = random.Random(5), [f"w{k}" for k in range(3_000)]
    base = [r.choice(words) for _ in range(150)]
    rows = []
    for k in range(130):
        copy = list(base)
        for at in r.sample(range(150), r.choice([4, 7, 9, 11, 14])):
            copy[at] = r.choice(words)
        rows.append((k + 1, " ".join(copy)))
    rows += [(200 + k, prose(k, 60)) for k in range(40)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], SCHEMA)
    assert found_of(near_dedup.near_duplicates(docs, 2, 80)) == brute(rows, 2, 80)


@pytest.mark.parametrize(("members", "block"), [(8, 1 << 20), (256, 2_000)])
def test_large_groups_go_through_many_blocks(spark, monkeypatch, members, block):
    """A tight group, a chain whose ends aren't similar, and a loose cloud, each in blocks much smaller than itself."""
    monkeypatch.setattr(near_dedup, "MEMBERS", members)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    r, words = random.Random(6), [f"w{k}" for k in range(5_000)]
    rows, tight, chain = [], [r.choice(words) for _ in range(80)], [r.choice(words) for _ in range(100)]
    for k in range(60):
        copy = list(tight)
        copy[r.randrange(80)] = r.choice(words)
        rows.append((k + 1, " ".join(copy)))
    for k in range(30):
        for at in range(3):
            chain[(k * 3 + at) % 100] = r.choice(words)
        rows.append((100 + k, " ".join(chain)))
    cloud = [r.choice(words) for _ in range(100)]
    for k in range(40):
        copy = list(cloud)
        for at in r.sample(range(100), r.choice([3, 5, 8])):
            copy[at] = r.choice(words)
        rows.append((200 + k, " ".join(copy)))
    r.shuffle(rows)
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], SCHEMA)
    assert found_of(near_dedup.near_duplicates(docs, 1, 80)) == brute(rows, 1, 80)


def test_a_block_of_short_near_copies_is_small():
    """Memory grows with the values of a block, not with its members times its values; MEMBERS bounds both."""
    import tracemalloc

    r = np.random.default_rng(0)
    base = np.sort(r.integers(0, 1 << 62, 26).astype(np.uint64))
    n = 1_600
    sets = [np.sort(np.concatenate([base[:-2], r.integers(0, 1 << 62, 2).astype(np.uint64)])) for _ in range(n)]
    minima = np.stack([near_dedup.minima(x) for x in sets[:64]]).astype(np.uint8)
    group = {"ids": np.arange(n), "label": np.arange(n), "visits": np.arange(n) >= n // 2, "small": minima[np.arange(n) % 64], "sets": sets}
    tracemalloc.start()
    links = near_dedup.block_links(group, near_dedup.least_matches(80), 80)
    assert tracemalloc.get_traced_memory()[1] < 40e6 and len(links) > n // 3  # 25 kB a member
    tracemalloc.stop()


def test_intersections_against_sets():
    r = np.random.default_rng(1)
    rows = [np.unique(r.integers(0, 300, n).astype(np.uint64)) for n in (1, 5, 50, 200, 200, 9_000)]
    sizes = near_dedup._common(rows)
    for x in range(len(rows)):
        assert sizes(x, np.arange(len(rows))).tolist() == [len(set(rows[x].tolist()) & set(y.tolist())) for y in rows]


def test_many_exact_copies_are_one_class(spark):
    rows = [(k, prose(k % 3, 40).upper() if k % 2 else prose(k % 3, 40)) for k in range(1, 300)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], SCHEMA)
    assert {c for _, c in found_of(near_dedup.near_duplicates(docs)).values()} == {1, 2, 3}


def test_odd_rows(odd, odd_rows):
    rows = near_dedup.near_duplicates(odd, 2, 80).collect()
    assert len(rows) == len(odd_rows)
    known = [r for r in rows if r.doc_id is not None]
    wanted = brute([(r[0], r[1]) for r in odd_rows if r[0] is not None], 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in known} == wanted
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    by = {r.doc_id: r for r in known}
    assert by[4].n_shingles == by[5].n_shingles == by[6].n_shingles == 0 and by[4].kept and by[7].n_shingles == 1
    assert by[2].component_id == 1 and by[3].component_id == 1


def test_empty_and_clashing(empty, clashing):
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.near_duplicates(clashing, 2).count() == 15


def test_pruning_bounds():
    least = near_dedup.least_matches(80)
    assert list(least) == sorted(least) and len(least) == near_dedup.HASHES // near_dedup.BATCH
    r = np.random.default_rng(1)
    similar = r.random((4_000, near_dedup.HASHES)) < 0.8
    a = np.zeros(similar.shape, np.uint8)
    alive, matches = near_dedup.surviving(a, np.where(similar, 0, 1).astype(np.uint8), least)
    assert len(alive) == 4_000 and (matches == similar.sum(axis=1)).all()
    assert len(near_dedup.surviving(a, (r.random(a.shape) > 0.4).astype(np.uint8), least)[0]) < 100


def test_minima_estimate_similarity():
    words = [f"x{k}".encode() for k in range(2_400)]
    a, b = (near_dedup.minima(near_dedup.shingle_set(b" ".join(w), 1)) for w in (words[:1_800], words[600:]))
    assert abs((a == b).mean() - 0.5) < 0.15

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from txstream.operators import components, joins


@pytest.mark.parametrize("share", [1, 4, 1_000])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_and_other_keys_find_their_rows(spark, monkeypatch, share, how):
    monkeypatch.setattr(joins, "SHARE", share)
    monkeypatch.setattr(joins, "FEW", 0)
    rows = spark.range(300).select("id", F.when(F.col("id") < 100, 7).when(F.col("id") < 290, F.col("id") % 40).when(F.col("id") < 295, 99).cast("long").alias("k"))
    table = rows.where("k != 99").groupBy("k").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    found = joins.looked_up(rows, table, "k", how=how)
    assert set(found.columns) == {"id", "k", "least"}
    wanted = rows.join(table.drop("n"), "k", how).select("id", "k", "least")
    assert sorted(map(repr, found.select("id", "k", "least").collect())) == sorted(map(repr, wanted.collect()))


def test_a_small_table_is_broadcast(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id long, k string")
    table = spark.createDataFrame([("a", 5, 1)], "k string, v int, n long")
    assert {(r.id, r.v) for r in joins.looked_up(rows, table, "k").collect()} == {(1, 5), (2, None), (3, None)}
    assert {(r.id, r.v) for r in joins.looked_up(rows, table, "k", how="inner").collect()} == {(1, 5)}


def test_a_hot_key_is_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(joins, "FEW", 100)
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"))
    table = rows.groupBy("k").agg(F.max("id").alias("most"), F.count("*").alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = joins.looked_up(rows, table, "k")
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 6_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("words", [1, 1 << 18])
def test_a_sieve_loses_no_key(spark, monkeypatch, words):
    monkeypatch.setattr(joins, "WORDS", words)
    rows = spark.range(6_000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 5_000).alias("k"), F.lit("a").alias("__word"), F.lit("b").alias("__MASK"))
    table = spark.range(0, 5_000, 10).select(F.col("id").cast("int").alias("k"), F.lit(True).alias("gone"))
    some, others = joins.sifted(rows, table, "k")
    assert set(some.columns) == set(others.columns) == set(rows.columns)
    first, second = ({(r.id, r.k) for r in x.collect()} for x in (some, others))
    assert not first & second and first | second == {(k, k % 5_000 if k % 7 else None) for k in range(6_000)}
    found = {x for x in first if x[1] is not None and x[1] % 10 == 0}
    assert not {x for x in second if x[1] is not None and x[1] % 10 == 0} and not {x for x in first if x[1] is None}
    if words > 1:
        assert len(first) - len(found) < 600  # of 4,600 others
    none = joins.sifted(rows, table.limit(0), "k")
    assert none[0].count() == 0 and none[1].count() == 6_000


@pytest.mark.parametrize("one", [1 << 18, 16])
def test_components_of_a_long_chain(spark, monkeypatch, one):
    """In one task, and in rounds over the stars of many."""
    monkeypatch.setattr(components, "ONE", one)
    r = random.Random(4)
    ids = list(range(120))
    r.shuffle(ids)
    links = [(ids[k], ids[k + 1]) for k in range(len(ids) - 1) if k != 59] + [(500, 501), (502, 502)]
    found = {x.id: x.component for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[x] for x in ids[:60]} == {min(ids[:60])} and {found[x] for x in ids[60:]} == {min(ids[60:])}
    assert (found[500], found[501], found[502]) == (500, 500, 502)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_labels_of_random_links():
    r = np.random.default_rng(0)
    for n in (1, 10, 300):
        a, b = r.integers(0, 200, n), r.integers(0, 200, n)
        least = {int(x): int(x) for x in np.concatenate([a, b])}
        for _ in range(n + 1):
            for x, y in zip(a.tolist(), b.tolist()):
                least[x] = least[y] = min(least[x], least[y])
        ids, labels = components.labelled(a, b)
        assert dict(zip(ids.tolist(), labels.tolist())) == least

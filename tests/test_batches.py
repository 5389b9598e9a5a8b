import pytest
from pyspark.sql import functions as F

from txstream.sources import batches, wal

SCHEMA = "k string, n long"


def made(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def summed(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"))


def totals(store):
    return {r.k: r.n for r in summed(store.rows()).collect()}


@pytest.fixture
def store(spark, tmp_path):
    return batches.Batches(spark, f"file://{tmp_path}/b", SCHEMA)


def test_batches_count_once_before_and_after_folding(spark, store):
    assert totals(store) == {} and store.fold(summed)
    assert store.publish("a", made(spark, ("x", 1), ("y", 2))) and not store.publish("a", made(spark, ("x", 1)))
    assert store.publish("b", made(spark, ("x", 10)))
    assert store.fold(summed) and not store.publish("a", made(spark, ("x", 1)))
    assert store.publish("c", made(spark, ("x", 100)))
    for _ in range(3):
        assert totals(store) == {"x": 111, "y": 2}
        store.fold(summed)
    assert sorted(r.name for r in store.names().collect()) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        store.publish("../x", made(spark))


def test_a_batch_published_while_folding_counts_once(spark, store):
    store.publish("a", made(spark, ("x", 1)))

    def slow(rows):
        assert store.publish("late", made(spark, ("x", 10)))
        return summed(rows)

    assert store.fold(slow)
    assert totals(store) == {"x": 11}
    assert store.fold(summed) and totals(store) == {"x": 11}


def test_of_two_folds_at_once_one_counts(spark, store):
    store.publish("a", made(spark, ("x", 1)))

    def slow(rows):
        assert store.fold(summed)
        return summed(rows)

    assert not store.fold(slow)
    assert totals(store) == {"x": 1}


def test_a_crash_before_the_batches_are_deleted_changes_nothing(spark, store, monkeypatch):
    store.publish("a", made(spark, ("x", 1)))
    store.publish("b", made(spark, ("x", 2)))
    with monkeypatch.context() as m:
        m.setattr(store, "_published", lambda aside, target, put=store._published: put(aside, target) and (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.fold(summed)
    assert store._whole("open") == ["a", "b"]  # still there, beside the base that has them
    assert totals(store) == {"x": 3} and not store.publish("b", made(spark, ("x", 2)))
    assert store.fold(summed) and totals(store) == {"x": 3}


def test_half_written_batches_do_not_count(spark, store, tmp_path):
    store.publish("a", made(spark, ("x", 1)))
    made(spark, ("x", 5)).write.parquet(f"file://{tmp_path}/b/open/torn")
    (tmp_path / "b/open/torn/_SUCCESS").unlink()
    assert totals(store) == {"x": 1}


def test_truncating_a_log_is_one_step(spark, tmp_path, monkeypatch):
    log = wal.Log(spark, f"file://{tmp_path}/log")
    log.append(0, wal.filler(spark, 100))
    with monkeypatch.context() as m:
        m.setattr(log._batches, "_published", lambda aside, target, put=log._batches._published: put(aside, target) and (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            log.truncate(89)
    assert sorted(r.ts for r in log.entries().collect()) == list(range(90, 100))
    assert not log.append(0, wal.filler(spark, 100)) and log.has(0)

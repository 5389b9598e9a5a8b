import pytest
from pyspark.sql import functions as F

from txstream.config import OPTIMISTIC, PESSIMISTIC, Isolation, TxConfig
from txstream.operators import tgraph
from txstream.operators.statefn import additive, appending


def opened(spark, values, **settings):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "at long, n int")
    return tgraph.TGraph(spark, TxConfig(**settings)).open(rows, ["at"])


def listed(stream):
    return [(r.tid, r.value, [tuple(s) for s in r.path]) for r in stream.df.orderBy("tid", F.col("path")).collect()]


def test_map_keeps_ids(spark):
    found = listed(opened(spark, [1, 2, 3, 4, 5]).map(lambda v: v["n"] * 2))
    assert [(t, v) for t, v, _ in found] == [(1, 2), (2, 4), (3, 6), (4, 8), (5, 10)]


def test_flat_map_numbers_what_it_fans_out(spark):
    found = listed(opened(spark, [2, 3, 2, 1]).flat_map(lambda v: F.sequence(F.lit(0), v["n"] - 1)))
    assert [v for _, v, _ in found] == [0, 1, 0, 1, 2, 0, 1, 0]
    assert [t for t, _, _ in found] == [1, 1, 2, 2, 2, 3, 3, 4]
    assert [p[-1][1] for _, _, p in found] == [2, 2, 3, 3, 3, 2, 2, 1]


def test_filter_keeps_the_record(spark):
    found = listed(opened(spark, range(1, 11)).filter(lambda v: v["n"] % 2 == 0).map(lambda v: v["n"]))
    assert [v for _, v, _ in found] == [None, 2, None, 4, None, 6, None, 8, None, 10]


def test_an_empty_fan_out_still_closes(spark):
    stream = opened(spark, [0, 2]).flat_map(lambda v: F.when(v["n"] > 0, F.sequence(F.lit(1), v["n"])))
    closed = tgraph.close(stream.state("s", lambda v: F.lit("k"), additive(0.0), lambda v: v.cast("double")))
    assert [(r.tid, r.vote, len(r.updates)) for r in closed.results.orderBy("tid").collect()] == [(1, "COMMIT", 0), (2, "COMMIT", 1)]
    assert closed.final("s").collect()[0]["value"] == 3.0


def test_a_window_sees_a_whole_transaction_in_order(spark):
    stream = opened(spark, [3, 1]).flat_map(lambda v: F.sequence(v["n"], F.lit(1)))
    found = listed(stream.window(lambda all_: F.array_join(F.transform(all_, lambda x: x.cast("string")), ">")))
    assert found == [(1, "3>2>1", [(1, 1)]), (2, "1", [(2, 1)])]


def test_one_failed_operation_aborts_all_states(spark):
    stream = opened(spark, [5, 7, 5]).state("a", lambda v: F.lit("x"), additive(10.0, low=0.0), lambda v: -v["n"].cast("double"))
    both = stream.state("list", lambda v: F.lit("x"), appending("int"), lambda v: v["n"])
    closed = tgraph.close(both)
    assert [r.vote for r in closed.results.orderBy("tid").collect()] == ["COMMIT", "ABORT", "COMMIT"]
    assert closed.final("list").first()["value"] == [5, 5]
    assert closed.final("a").first()["value"] == 0.0


def test_exits_of_two_graphs_do_not_close_together(spark):
    with pytest.raises(ValueError):
        tgraph.close(opened(spark, [1]), opened(spark, [1]))


def test_logged_transactions_are_skipped(spark):
    rows = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "id long, n int")
    stream = tgraph.TGraph(spark).open(rows, tid="id", done=spark.createDataFrame([(2,)], "tid long"))
    assert [t for t, _, _ in listed(stream)] == [1, 3]


def test_routes_split_by_key(spark):
    parts = opened(spark, range(7)).route(3, lambda v: v["n"])
    assert [sorted(v["n"] for _, v, _ in listed(p)) for p in parts] == [[0, 3, 6], [1, 4], [2, 5]]


def test_numbers_follow_the_order_over_many_partitions(spark):
    rows = spark.range(1000).select((999 - F.col("id")).alias("x")).repartition(7)
    found = tgraph.numbered(rows, ["x"]).collect()
    assert sorted((r.tid, r.x) for r in found) == [(k + 1, k) for k in range(1000)]
    assert tgraph.numbered(rows.where("x < 0"), ["x"]).count() == 0


def test_settings(spark):
    assert TxConfig(isolation=Isolation.PL0, strategy=PESSIMISTIC).strategy == OPTIMISTIC
    assert TxConfig(parallelism=8).open_parallelism == 8 and TxConfig(parallelism=0).open_parallelism is None
    with pytest.raises(ValueError):
        TxConfig(strategy="NONE")
    for level in (Isolation.PL0, Isolation.PL4):  # numbering is total with any number of tasks
        assert [t for t, _, _ in listed(opened(spark, range(5), isolation=level, parallelism=3))] == [1, 2, 3, 4, 5]


def test_reading_what_a_graph_closed(spark):
    closed = tgraph.close(opened(spark, [5, 7, 5]).state("a", lambda v: F.lit("x"), additive(20.0), lambda v: -v["n"].cast("double")))
    assert [closed.read("a", w).first()["value"] for w in (1, 2, 3)] == [15.0, 8.0, 3.0]
    assert closed.read("a").first()["version"] == 3


def test_graphs_and_records_tell_themselves_apart(spark):
    one, two = opened(spark, [1]), opened(spark, [1, 2])
    assert one.graph_id != two.graph_id
    assert [(r.tid, r.vote) for r in two.metadata.orderBy("tid").collect()] == [(1, "COMMIT"), (2, "COMMIT")]
    keyed = opened(spark, [4, 4, None]).map(lambda v: v["n"]).key_by(lambda v: v)
    assert sorted((r.tid, r.value) for r in keyed.df.collect()) == [(1, 4), (2, 4), (3, None)]

import random

import pytest

from txstream.config import TxConfig
from txstream.operators.statefn import ACCOUNT_COMMANDS, additive
from txstream.schemas import PATH
from txstream.sources import generators, wal
from txstream.streaming import sequencer, tuning
from txstream.streaming.driver import StreamingGraph, appended

ROWS = [(1, "a", "b", 60.0), (2, "b", "a", 10.0), (3, "a", "b", 60.0), (4, "b", "c", 150.0), (5, "c", "a", 250.0), (6, "c", "a", 300.0)]
SCHEMA = "ord long, src string, dst string, amount double"


FN = additive(100.0, low=0.0, commands=ACCOUNT_COMMANDS)


def graph_at(spark, path, **settings):
    fn = FN
    return StreamingGraph(spark, path, lambda s: s.flat_map(generators.movements).state("b", lambda v: v["account"], fn, lambda v: v["amount"]), {"b": "double"}, ["ord"], **settings)


def test_batches_go_on_and_count_once(spark, tmp_path):
    graph = graph_at(spark, f"file://{tmp_path}/g")
    for batch, part in enumerate((ROWS[:2], ROWS[2:], [])):
        for _ in range(2):  # the second time is a retry
            graph.process(spark.createDataFrame(part, SCHEMA), batch)
    whole = graph_at(spark, f"file://{tmp_path}/w")
    whole.process(spark.createDataFrame(ROWS, SCHEMA), 0)
    found = [{r.key: r.value for r in g.state("b").collect()} for g in (graph, whole)]
    assert found[0] == found[1]
    assert graph.watermark() == 6 and graph.committed() == [0, 1, 2]


def test_a_half_written_batch_is_written_again(spark, tmp_path):
    graph = graph_at(spark, f"file://{tmp_path}/h")
    graph.process(spark.createDataFrame(ROWS[:2], SCHEMA), 0)
    spark.createDataFrame([("b", "a", 99, 99, "COMMITTED", 1.0)], "ns string, key string, version long, created_by long, status string, value double").write.parquet(f"file://{tmp_path}/h/versions-b/1")
    assert {r.key: r.value for r in graph.state("b").collect()} == {"a": 50.0, "b": 150.0}
    graph.process(spark.createDataFrame(ROWS[2:], SCHEMA), 1)
    assert graph.state("b").where("version = 99").count() == 0


@pytest.mark.parametrize("n", [1, 3])
def test_a_stream_of_files(spark, tmp_path, n):
    spark.createDataFrame(ROWS, SCHEMA).repartition(n).write.parquet(f"{tmp_path}/in")
    graph = graph_at(spark, f"file://{tmp_path}/s")
    graph.run(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/c").awaitTermination()
    assert graph.watermark() == len(ROWS)


def test_a_watermark_that_is_half_written_does_not_count(spark, tmp_path):
    graph = graph_at(spark, f"file://{tmp_path}/t")
    graph.process(spark.createDataFrame(ROWS[:2], SCHEMA), 0)
    (tmp_path / "t/watermarks/1/_temporary/0").mkdir(parents=True)  # a crash while it was written
    assert graph.committed() == [0] and graph.watermark() == 2
    graph.process(spark.createDataFrame(ROWS[2:], SCHEMA), 1)
    assert graph.committed() == [0, 1] and graph.watermark() == 6


@pytest.mark.parametrize("keep", [None, 2])
def test_bases_stand_for_the_versions_before(spark, tmp_path, keep):
    graph = graph_at(spark, f"file://{tmp_path}/f", fold_every=2, config=TxConfig(max_versions=keep))
    whole = graph_at(spark, f"file://{tmp_path}/w")
    for batch, row in enumerate(ROWS):
        graph.process(spark.createDataFrame([row], SCHEMA), batch)
    whole.process(spark.createDataFrame(ROWS, SCHEMA), 0)
    assert {r.key: r.value for r in graph.state("b").collect()} == {r.key: r.value for r in whole.state("b").collect()}
    assert graph._batches("bases-b") == [1, 3, 5] and graph._current("b").count() == (3 if keep is None else 6)
    assert [(r.batch, r.watermark) for r in graph.watermarks().orderBy("batch").collect()] == [(k, k + 1) for k in range(6)]


def test_a_durable_graph_logs_what_it_closes_once(spark, tmp_path):
    graph = graph_at(spark, f"file://{tmp_path}/d", config=TxConfig(durable=True))
    for batch, part in enumerate((ROWS[:3], ROWS[3:])):
        for _ in range(2):
            graph.process(spark.createDataFrame(part, SCHEMA), batch)
    assert sorted(r.tid for r in graph.log.entries().collect()) == [1, 2, 3, 4, 5, 6]
    none = spark.createDataFrame([], "ns string, key string, value double")
    recovered = {r.key: r.value for r in wal.recovered(none, graph.log.entries(), 0, "b").collect()}
    assert recovered == {r.key: r.value for r in graph.state("b").collect()}


def test_queries_and_commands_meet_the_running_state(spark, tmp_path):
    graph = graph_at(spark, f"file://{tmp_path}/q")
    asked = spark.createDataFrame([("q", "b", ["a", "b", "z"])], "query_id string, ns string, keys array<string>")
    graph.process(spark.createDataFrame(ROWS[:2], SCHEMA), 0)
    first = {(r.key, r.value, r.watermark) for r in graph.ask(asked).collect()}
    assert first == {("a", "50.0", 2), ("b", "150.0", 2)}
    commands = spark.createDataFrame([("c1", 1, "a", "withdrawal", [60.0]), ("c2", 2, "a", "deposit", [15.0]), ("c3", 3, "z", "withdrawal", [30.0])], "spu_id string, ord long, key string, method string, params array<double>")
    for _ in range(2):
        graph.process_commands(commands, 1, "b", FN)
    assert {(r.key, r.value, r.watermark) for r in graph.ask(asked).collect()} == {("a", "65.0", 5), ("b", "150.0", 5), ("z", "70.0", 5)}
    graph.process(spark.createDataFrame([(9, "z", "a", 70.0)], SCHEMA), 2)
    assert {r.key: r.value for r in graph.state("b").collect()} == {"a": 135.0, "b": 150.0, "z": 0.0}
    seen = []
    asked.write.parquet(f"{tmp_path}/asked")
    stream = spark.readStream.schema(asked.schema).parquet(f"{tmp_path}/asked")
    graph.answer(stream, f"file://{tmp_path}/out", f"{tmp_path}/c", lambda rows, batch: seen.extend(rows.collect())).awaitTermination()
    assert {(r.key, r.value) for r in seen} == {("a", "135.0"), ("b", "150.0"), ("z", "0.0")}
    marks = appended(graph.watermark_stream(), f"{tmp_path}/marks", f"{tmp_path}/mc")
    assert sorted(r.watermark for r in marks.collect()) == [2, 5, 6]


def files(spark, path, batches, schema):
    """A stream that takes one file a micro-batch, in order."""
    import os
    import time

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{k}")
        for name in os.listdir(f"{path}/{k}"):
            os.utime(f"{path}/{k}/{name}", (time.time() - 100 + k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_the_sequencer_over_batches(spark, tmp_path):
    batches = [[("g", 1, 1, False), ("g", 2, 2, False)], [("g", 3, 4, True)], [("g", 4, 5, False)], [("g", 5, 4, False)], [("g", 6, 3, False)]]
    stream = files(spark, f"{tmp_path}/in", batches, "graph string, at long, tid long, replay boolean")
    found = appended(sequencer.sequenced(stream), f"{tmp_path}/out", f"{tmp_path}/c")
    assert sorted((r.at, r.tid) for r in found.collect()) == [(1, 1), (2, 2), (6, 3), (6, 4), (6, 5)]


def test_total_order_over_batches(spark, tmp_path):
    leaves = [("g", t, [(t, 1), (a, 3)], f"{t}.{a}") for t in range(1, 6) for a in range(1, 4)]
    random.Random(0).shuffle(leaves)
    lost = [x for x in leaves if x[3] != "4.2"]
    stream = files(spark, f"{tmp_path}/in", [lost[:5], lost[5:9], lost[9:] + lost[:2]], f"graph string, tid long, path {PATH}, value string")
    found = appended(sequencer.total_order(stream), f"{tmp_path}/out", f"{tmp_path}/c")
    assert sorted(r.value for r in found.collect()) == [f"{t}.{a}" for t in range(1, 4) for a in range(1, 4)]
    assert sequencer.is_complete({((1, 1), (1, 2)), ((1, 1), (2, 2), (1, 1))}) and not sequencer.is_complete({((1, 1), (1, 2))})


def test_a_tunable_source_finds_a_rate(spark, tmp_path):
    n = []
    source = tuning.TunableSource(spark, lambda rows, batch: n.append(rows.count()), f"{tmp_path}/c", lambda ids: generators.transfers_of_ids(ids.selectExpr("value as ord"), 5), seconds=2.0)
    best, unloaded = source.sustainable(10, 10, most=1)
    assert best == 10 and 0 < unloaded < 60 and sum(n) > 0 and [r for r, _ in source.curve] == [0, 10]

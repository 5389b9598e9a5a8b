import json

import pytest
from pyspark.sql import functions as F

from txstream import metrics
from txstream.config import Isolation
from txstream.operators import query, spu, store, windows
from txstream.operators.statefn import ACCOUNT_COMMANDS, UnknownCommand, additive
from txstream.schemas import COMMANDS, WAL, versions
from txstream.sources import generators, wal

V = [("b", "x", 1, 1, "COMMITTED", 5.0), ("b", "x", 4, 4, "COMMITTED", 8.0), ("b", "x", 6, 6, "ABORTED", 9.0), ("b", "y", 2, 2, "COMMITTED", 60.0), ("c", "x", 3, 3, "COMMITTED", 1.0)]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(V, versions("double"))


def test_reads_as_of_a_watermark(table):
    found = {(r.ns, r.key): r.value for r in store.as_of(table, 3).collect()}
    assert found == {("b", "x"): 5.0, ("b", "y"): 60.0, ("c", "x"): 1.0}
    assert {r.value for r in store.as_of(table, isolation=Isolation.PL1).where("ns = 'b' and key = 'x'").collect()} == {9.0}


def test_compaction_keeps_what_readers_can_see(table):
    kept = store.compact(table, 4)
    assert {(r.key, r.version) for r in kept.where("ns = 'b'").collect()} == {("x", 4), ("x", 6), ("y", 2)}
    for w in (4, 5, 6):
        assert sorted(map(tuple, store.as_of(kept, w).collect())) == sorted(map(tuple, store.as_of(table, w).collect()))


def test_many_queries_of_a_key_with_many_versions(spark):
    """Pairs of a query and a version, 10**10 here, would take minutes; merging both takes seconds."""
    n = 100_000
    table = spark.range(1, n + 1).select(F.lit("b").alias("ns"), F.lit("x").alias("key"), (F.col("id") * 2).alias("version"), (F.col("id") * 2).alias("created_by"), F.lit("COMMITTED").alias("status"), F.col("id").cast("double").alias("value"))
    asked = spark.range(n).select(F.col("id").cast("string").alias("query_id"), F.lit("b").alias("ns"), F.array(F.lit("x"), F.lit("z")).alias("keys"), (F.col("id") * 2 + 1).alias("watermark"))
    found = []
    assert metrics.timed(lambda: found.extend(query.point(asked, table).collect())) < 60
    assert {(int(r.query_id), r.key): r.value for r in found} == {(k, "x"): float(k) for k in range(1, n)}  # the first asks before all versions


def test_a_query_given_at_several_watermarks_is_answered_at_the_last(spark, table):
    asked = spark.createDataFrame([("q1", "b", ["x"], 1), ("q1", "b", ["x"], 5), ("q2", "b", ["x"], None), ("q3", "b", ["y"], 1)], "query_id string, ns string, keys array<string>, watermark long")
    assert [tuple(r) for r in query.point(asked, table).collect()] == [("q1", "b", "x", 8.0)]


def test_queries(spark, table):
    asked = spark.createDataFrame([("q1", "b", ["x", "z", "x"], 4), ("q2", "b", ["x", "y"], 3)], "query_id string, ns string, keys array<string>, watermark long")
    found = {(r.query_id, r.key): r.value for r in query.point(asked, table).collect()}
    assert found == {("q1", "x"): 8.0, ("q2", "x"): 5.0, ("q2", "y"): 60.0}
    assert {r.query_id: r.result for r in query.merged(query.point(asked, table)).collect()} == {"q1": {"x": 8.0}, "q2": {"x": 5.0, "y": 60.0}}
    assert {r.key for r in query.predicate(table, "b", query.select_less_than(50)).collect()} == {"x"}
    assert query.predicate(table, "b", query.select_none).count() == 0
    wm = query.with_watermark(asked.drop("watermark"), spark.createDataFrame([(2,), (4,)], "watermark long"))
    assert {r.watermark for r in wm.collect()} == {4}
    assert query.invariant_total(spark.createDataFrame([(150.0,), (50.0,)], "value double"), 100).first()["consistent"]


def test_suppliers():
    drawn = list(query.limited(query.random_supplier("b", 5, 2, 3), 20))
    assert len(drawn) == 20 and all(1 <= len(set(k)) == len(k) <= 5 for _, _, k in drawn)
    assert list(query.null_supplier()) == []


def test_commands(spark):
    fn = additive(100.0, low=0.0, commands=ACCOUNT_COMMANDS)
    rows = spark.createDataFrame([("1", 1, "b", "x", "withdrawal", [70.0]), ("2", 2, "b", "x", "withdrawal", [70.0]), ("3", 3, "b", "x", "deposit", [5.0]), ("4", 1, "b", "y", "deposit", [1.0])], COMMANDS)
    found = {r.spu_id: (r.vote, r.value) for r in spu.apply_commands(rows, fn, spark.createDataFrame([("b", "y", 7.0)], "ns string, key string, value double")).collect()}
    assert found == {"1": ("COMMIT", 30.0), "2": ("ABORT", 30.0), "3": ("COMMIT", 35.0), "4": ("COMMIT", 8.0)}
    assert spu.call(fn, "withdrawal", 1, 42) == 41
    with pytest.raises(UnknownCommand):
        spu.call(fn, "audit", 1, 42)
    with pytest.raises(Exception, match="audit is not a command"):
        spu.apply_commands(rows.withColumn("method", F.lit("audit")), fn).collect()
    assert spu.apply_commands(generators.no_commands(spark), fn).count() == 0


def test_log(spark, tmp_path):
    log = wal.Log(spark, f"file://{tmp_path}/log")
    assert log.entries().count() == 0 and log.replay().count() == 0
    entry = ("COMMIT", 1, 1, 0, [("b-0", "x", 1.0), ("b-1", "y", 2.0), ("c", "z", 3.0)])
    aborted = ("ABORT", 2, 2, 1, [])
    assert log.append(0, spark.createDataFrame([entry, aborted], WAL))
    assert not log.append(0, spark.createDataFrame([entry], WAL))
    assert log.append(1, wal.filler(spark, 10_000))
    assert log.entries().count() == 10_002
    assert [len(r.updates) for r in log.replay("b").collect()] == [2]
    assert log.replay(source=1).count() == 0
    assert [r.ts for r in log.replay("balances").collect()] == list(range(10_000))
    log.truncate(9_990, 2)
    assert sorted(r.ts for r in log.entries().collect()) == list(range(9_991, 10_000))
    assert wal.display(log.entries()).count() == 9
    assert wal.coordinated_watermark(spark.createDataFrame([(11,), (8,)], "watermark long")).first()["watermark"] == 11


def test_recovery(spark):
    snapshot = spark.createDataFrame([("b", "x", 5.0), ("b", "y", 6.0)], "ns string, key string, value double")
    tail = spark.createDataFrame([("COMMIT", 9, 9, 0, [("b-0", "x", 1.0)]), ("ABORT", 10, 10, 0, [("b-0", "y", 0.0)]), ("COMMIT", 3, 3, 0, [("b-0", "y", 2.0)])], WAL)
    assert {r.key: r.value for r in wal.recovered(snapshot, tail, 8, "b").collect()} == {"x": 1.0, "y": 6.0}


def test_ranks_from_both_ends(spark):
    rows = spark.createDataFrame([("g", f"p{k}", k) for k in range(5)] + [("h", "q", 1)], "g string, name string, n int")
    found = {(r.g, r.name): r.positive for r in windows.ends(rows, ["g"], "name", 2).collect()}
    assert found == {("g", "p0"): True, ("g", "p1"): True, ("g", "p3"): False, ("g", "p4"): False, ("h", "q"): True}
    found = {(r.name): r.positive for r in windows.ends(rows.where("g = 'g'"), ["g"], "name", 3).collect()}
    assert found == {"p0": True, "p1": True, "p2": True, "p3": False, "p4": False}


def test_generated_inputs(spark):
    rows = generators.random_transfers(spark, 500, 5).collect()
    assert all(r.src != r.dst and 1 <= r.amount <= 100 for r in rows)
    assert {r.method for r in generators.random_commands(spark, 50, 5).collect()} == {"deposit", "withdrawal"}


def test_metrics(tmp_path):
    t = metrics.Throughput(bucket=1.0, warm_up=10)
    for k in range(40):
        t.add(5, k * 0.5)
    assert t.curve and abs(t.mean - 10) < 1
    best, unloaded = metrics.sustainable_rate(lambda rate: 1.0 + rate / 10, 100, 100, queue=50)
    assert (best, unloaded) == (400, 1.0)
    r = metrics.Report("run")
    r.put("commits", 3)
    assert json.load(open(r.write(str(tmp_path))))["metrics"] == {"commits": 3}


def test_counts_latencies_and_accumulators(spark):
    rows = spark.range(10).select("id", (F.col("id") * 60).alias("s"))
    assert metrics.finish_on_count(rows, 10) and not metrics.finish_on_count(rows, 11) and metrics.finish_on_count(rows, 9, severe=False)
    with pytest.raises(ValueError):
        metrics.finish_on_count(rows, 9)
    timed = rows.select("id", F.timestamp_seconds("s").alias("ts"))
    ends = timed.where("id < 3").select("id", (F.col("ts") + F.expr("INTERVAL 1500 MILLISECONDS")).alias("ts"))
    assert {r.id: r.seconds for r in metrics.latencies(timed, ends).collect()} == {0: 1.5, 1: 1.5, 2: 1.5}
    delta = metrics.TimeDelta()
    for key, start, end in (("a", 1.0, 2.0), ("b", 1.0, 4.0)):
        delta.start(key, start)
        delta.end(key, end)
    assert delta.end("a", 9.0) is None and delta.curve == [1.0, 3.0] and delta.mean == 2.0
    seen, counts = metrics.observed(rows, n=F.count("*"), most=F.max("id"))
    seen.write.format("noop").mode("overwrite").save()
    assert counts.get == {"n": 10, "most": 9}
    kept, ids = metrics.tracked(rows, "id")
    assert kept is rows and ids.count() == 10


def test_queries_by_time_and_visitors(spark):
    slept, now = [], [0.0]

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    drawn = list(query.limited(query.every(query.random_supplier("b", 9, 2, 1), 0.5, sleep, lambda: now[0]), 4))
    assert len(drawn) == 4 and slept == [0.5] * 3
    results = spark.createDataFrame([("q", "b", {"x": 1.0})], "query_id string, ns string, result map<string,double>")
    found = []
    assert query.visited(results, lambda *x: found.append(x)) == 1 and found == [("q", "b", {"x": 1.0})]


def test_lookups_have_defaults(spark, table):
    ops = spark.createDataFrame([("b", "x"), ("b", "q")], "ns string, key string")
    assert {r.key: r.value for r in store.lookup(ops, store.as_of(table), 100.0).collect()} == {"x": 8.0, "q": 100.0}


def test_inputs_from_rates(spark):
    rows = generators.transfers_of_ids(spark.range(500).select(F.col("id").alias("ord")), 7).collect()
    assert all(r.src != r.dst and 1 <= r.amount <= 100 for r in rows) and len({r.src for r in rows} | {r.dst for r in rows}) == 7
    asked = generators.queries_of_ids(spark.range(50).select(F.col("id").alias("n")), 9, 3).collect()
    assert all(1 <= len(set(r["keys"])) == len(r["keys"]) <= 3 for r in asked)
    assert generators.tunable_transfers(spark, 5, 7).isStreaming and generators.tunable_queries(spark, 5, 7, 2).isStreaming


def test_load_functions(spark):
    found = spark.range(31).select(generators.primes(F.col("id")).alias("n")).collect()
    assert [found[k].n for k in (0, 1, 2, 3, 4, 10, 30)] == [0, 0, 1, 2, 2, 4, 10]
    assert metrics.timed(lambda: spark.range(2_000).coalesce(1).select(generators.busy_wait(100)("id")).collect()) > 0.2


def test_queries_from_a_socket(spark, tmp_path):
    import socket
    import threading

    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        peer, _ = server.accept()
        peer.sendall(b"balances a1 a2\nvotes p7\n")
        done.wait(30)
        peer.close()

    done = threading.Event()
    threading.Thread(target=serve, daemon=True).start()
    stream = generators.socket_queries(spark, "127.0.0.1", server.getsockname()[1])
    seen = []
    running = stream.writeStream.foreachBatch(lambda rows, _: seen.extend((r.ns, r["keys"]) for r in rows.collect())).option("checkpointLocation", f"{tmp_path}/c").start()
    for _ in range(100):
        if len(seen) == 2:
            break
        __import__("time").sleep(0.2)
    running.stop()
    done.set()
    assert sorted(seen) == [("balances", ["a1", "a2"]), ("votes", ["p7"])]


def test_timed_appends(spark, tmp_path):
    log = wal.Log(spark, f"file://{tmp_path}/timed")
    assert wal.time_appends(log, 2, 10) > 0 and log.entries().count() == 20

"""The smaller operators as queries over the tables, each with its SQL. Every query reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import metrics
from ..config import SWEEP, TxConfig
from ..functions import paths, text, timestamps, votes
from ..operators import folds, ledger, query, routing, sequence, store, tgraph, windows
from ..operators.statefn import additive
from ..schemas import ABORT, COMMIT, REPLAY
from ..sources import generators
from ..sources.shared import stored
from . import workloads
from .workloads import _FINAL, _T, ACCOUNTS, LINE_ORDER, START, bank, bank_ctes, bank_stream, read, registered

_LINES = "row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)"


def lines(spark: SparkSession, sf_dir: str, *columns: str) -> tgraph.TStream:
    return tgraph.TGraph(spark).open(read(spark, sf_dir, "lineitem").select(*LINE_ORDER, *columns), LINE_ORDER)


# ---------------------------------------------------------------- streams of transactions
@registered("SELECT l_suppkey AS key, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1")
def t_key_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records brought together by key, and counted there."""
    keyed = lines(spark, sf_dir, "l_suppkey", "l_quantity").key_by(lambda v: v["l_suppkey"])
    return keyed.df.groupBy(F.col("value.l_suppkey").alias("key")).agg(F.count("*").alias("n"), F.sum("value.l_quantity").alias("quantity"))


@registered(f"SELECT tid, i + 1 AS off, n AS size, 'COMMIT' AS vote FROM (SELECT {_LINES} AS tid, 1 + l_quantity::BIGINT % 3 AS n FROM lineitem), unnest(range(n)) AS t(i)")
def t_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelopes of records: transaction, place and vote."""
    fanned = lines(spark, sf_dir, "l_quantity").flat_map(lambda v: F.sequence(F.lit(0).cast("long"), v["l_quantity"].cast("long") % 3)).metadata
    last = F.element_at("path", -1)
    return fanned.select("tid", last["off"].cast("long").alias("off"), last["size"].cast("long").alias("size"), "vote")


_CLOSES = "SELECT l_orderkey AS tid, l_orderkey * 100 + l_linenumber * 7 % 90 + CASE WHEN l_orderkey % 11 = 0 THEN 1700 ELSE 0 END AS came FROM lineitem"


@registered(f"""WITH c AS (SELECT dense_rank() OVER (ORDER BY tid) AS tid, came FROM ({_CLOSES})), d AS (SELECT tid, min(came) AS came FROM c WHERE tid % 977 <> 0 GROUP BY tid),
n AS (SELECT tid, max(came) OVER (ORDER BY tid) AS released_at, row_number() OVER (ORDER BY tid) AS place FROM d) SELECT tid, released_at FROM n WHERE place = tid""")
def release_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions released once all before them are done; those behind one that never is, aren't."""
    rows = read(spark, sf_dir, "lineitem")
    late = F.when(F.col("l_orderkey") % 11 == 0, 1700).otherwise(0)
    done = rows.select(F.col("l_orderkey"), (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 7 % 90 + late).alias("done_at"))
    ids = tgraph.numbered(done.select("l_orderkey").distinct(), ["l_orderkey"])
    return sequence.released(done.join(ids, "l_orderkey").where("tid % 977 != 0").select("tid", "done_at"))


@registered("""WITH e AS (SELECT event_id + 1 AS tid, event_id * 3 + user_id % 50 AS came, false AS replay FROM events UNION ALL
SELECT event_id + 1, event_id * 3 + 200, true FROM events WHERE event_type = 'error' UNION ALL SELECT event_id + 1, event_id * 3 + 400, false FROM events WHERE event_type = 'error'),
d AS (SELECT tid, min(came) AS done FROM e x WHERE NOT replay AND NOT EXISTS (SELECT 1 FROM e y WHERE y.tid = x.tid AND y.replay AND y.came >= x.came) GROUP BY tid),
n AS (SELECT tid, max(done) OVER (ORDER BY tid) AS released_at, row_number() OVER (ORDER BY tid) AS place FROM d) SELECT tid, released_at FROM n WHERE place = tid""")
def sequencer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions in contiguous order: errors ask for a replay, which comes later and holds back what is behind."""
    rows = read(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("tid"), (F.col("event_id") * 3).alias("t"), (F.col("user_id") % 50).alias("late"), "event_type")
    errors = rows.where("event_type = 'error'")
    events = rows.select("tid", (F.col("t") + F.col("late")).alias("at"), F.lit(False).alias("replay"))
    events = events.union(errors.select("tid", F.col("t") + 200, F.lit(True))).union(errors.select("tid", F.col("t") + 400, F.lit(False)))
    return sequence.sequenced(events)


@registered("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS tid FROM orders),
l AS (SELECT tid, row_number() OVER (PARTITION BY tid ORDER BY l_linenumber, l_partkey, l_extendedprice) AS off, count(*) OVER (PARTITION BY tid) AS size, tid * 10 + l_partkey % 37 AS came FROM lineitem JOIN o ON l_orderkey = o_orderkey),
k AS (SELECT * FROM l WHERE NOT (tid % 1009 = 0 AND off = size)), d AS (SELECT tid, max(came) AS done FROM k GROUP BY tid HAVING count(*) = max(size)),
n AS (SELECT tid, max(done) OVER (ORDER BY tid) AS released_at, row_number() OVER (ORDER BY tid) AS place FROM d)
SELECT k.tid, off, released_at FROM k JOIN n ON k.tid = n.tid WHERE place = n.tid""")
def total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as records of transactions: released when an order's lines are all there, as are those of all before."""
    orders = tgraph.numbered(read(spark, sf_dir, "orders").select("o_orderkey").where("o_orderkey is not null"), ["o_orderkey"])
    rows = read(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    own = F.struct("l_linenumber", "l_partkey", "l_extendedprice")
    all_ = rows.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct(own.alias("o"), (F.col("tid") * 10 + F.col("l_partkey") % 37).alias("at")))).alias("all"))
    legs = all_.select("tid", F.size("all").alias("size"), F.posexplode("all").alias("k", "one")).withColumn("off", F.col("k") + 1)
    legs = legs.where("not (tid % 1009 = 0 and off = size)").select("tid", "one.at", paths.appended(paths.first("tid"), F.col("off"), F.col("size")).alias("path"))
    return sequence.total_order(legs).select("tid", F.element_at("path", -1)["off"].cast("long").alias("off"), "released_at")


@registered("""SELECT tid, row_number() OVER (PARTITION BY tid ORDER BY i, j) AS off, count(*) OVER (PARTITION BY tid) AS size, i * 10 + j AS value FROM
(SELECT row_number() OVER (ORDER BY o_orderkey) AS tid, 1 + o_orderkey % 3 AS n FROM orders), unnest(range(1, n + 1)) AS a(i), unnest(range(1, i + 2)) AS b(j)""")
def schedule_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two fan-outs, numbered as if there had been one."""
    opened = tgraph.TGraph(spark).open(read(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])
    first = opened.flat_map(lambda v: F.sequence(F.lit(1).cast("long"), 1 + v["o_orderkey"] % 3))
    second = first.flat_map(lambda i: F.transform(F.sequence(F.lit(1).cast("long"), i + 1), lambda j: i * 10 + j))
    last = F.element_at("path", -1)
    return paths.flattened(second.df).select("tid", last["off"].cast("long").alias("off"), last["size"].cast("long").alias("size"), "value")


@registered("SELECT event_id, ts, user_id FROM events QUALIFY row_number() OVER (ORDER BY ts, event_id) > 500")
def skip_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events but the first 500 in time."""
    return windows.skipped(read(spark, sf_dir, "events").select("event_id", "ts", "user_id"), ["ts", "event_id"], 500)


@registered("SELECT event_id, ts FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events)")
def flush_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came up to the middle id, in order."""
    rows = read(spark, sf_dir, "events").select("event_id", "ts")
    middle = rows.agg(F.floor(F.max("event_id") / 2)).first()[0]  # one number
    return sequence.flushed(rows, middle, "event_id")


@registered("""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS win_end, event_type AS area, count(*) AS n FROM events GROUP BY ALL)
SELECT win_end, area, n, win_end + INTERVAL 10 SECOND * (dense_rank() OVER (ORDER BY area) - 1) AS release_at FROM w""")
def delayed_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of hours, given out area by area, ten seconds apart."""
    counted = windows.counts(windows.windowed(generators.votes(read(spark, sf_dir, "events")), "ts", "1 hour"), ["win_end", "area"])
    return windows.delayed(counted, "area", "win_end", "10 seconds")


@registered("""WITH c AS (SELECT dense_rank() OVER (ORDER BY l_orderkey) AS tid, l_linenumber % 2 AS source, CASE WHEN l_orderkey % 4999 = 3 THEN 'REPLAY' ELSE 'COMMIT' END AS vote FROM lineitem),
d AS (SELECT DISTINCT source, tid FROM c WHERE vote <> 'REPLAY'), r AS (SELECT source, tid, tid - row_number() OVER (PARTITION BY source ORDER BY tid) AS g FROM d)
SELECT source, coalesce(max(tid) FILTER (g = 0), 0) AS watermark FROM r GROUP BY source""")
def closed_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source, the transaction up to which all have closed; those to be replayed haven't."""
    rows = read(spark, sf_dir, "lineitem")
    ids = tgraph.numbered(rows.select("l_orderkey").distinct(), ["l_orderkey"])
    vote = F.when(F.col("l_orderkey") % 4999 == 3, REPLAY).otherwise(COMMIT)
    closes = rows.join(ids, "l_orderkey").select("tid", (F.col("l_linenumber") % 2).cast("long").alias("source"), vote.alias("vote"))
    return timestamps.closed_high(closes, 0, ("source",))


@registered("""WITH d AS (SELECT event_type AS key, event_id AS ts, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM (SELECT DISTINCT event_type, event_id // 4 AS event_id FROM events) WHERE event_id > 100),
w AS (SELECT key, coalesce(max(ts) FILTER (g = 100), 100) AS high FROM d GROUP BY key)
SELECT event_id, event_type AS key FROM events e JOIN w ON e.event_type = w.key WHERE event_id // 4 > 100 AND event_id // 4 <= high""")
def poll_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken from the front of each type's queue as far as their numbers, in fours, are contiguous."""
    rows = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("key"), F.floor(F.col("event_id") / 4).alias("ts"))
    return timestamps.polled(rows, 100, by=("key",))[0].select("event_id", "key")


@registered(f"SELECT tid, CASE WHEN n > 1 THEN -1 ELSE 0 END AS forward, CASE WHEN n > 1 THEN 1 ELSE 0 END AS backward FROM (SELECT {_LINES} AS tid, 1 + l_quantity::BIGINT % 3 AS n FROM lineitem)")
def path_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last record of each fan-out, compared by their paths."""
    fanned = lines(spark, sf_dir, "l_quantity").flat_map(lambda v: F.sequence(F.lit(0).cast("long"), v["l_quantity"].cast("long") % 3)).df
    ends = fanned.groupBy("tid").agg(F.min_by("path", paths.order_key("path")).alias("a"), F.max_by("path", paths.order_key("path")).alias("b"))
    return ends.select("tid", paths.compare(F.col("a"), F.col("b")).alias("forward"), paths.compare(F.col("b"), F.col("a")).alias("backward"))


# ---------------------------------------------------------------- votes and codecs
_REDUCED = """SELECT l_orderkey AS tid, CASE max(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) WHEN 0 THEN 'COMMIT' WHEN 1 THEN 'ABORT' ELSE 'REPLAY' END AS vote,
list_sort(list(DISTINCT l_suppkey)) AS cohorts, list_sort(list(DISTINCT l_partkey % 5)) AS deps FROM lineitem GROUP BY 1"""


def reduced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    vote = F.when(F.col("l_returnflag") == "N", COMMIT).when(F.col("l_returnflag") == "A", ABORT).otherwise(REPLAY)
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tid"), vote.alias("vote"), F.array("l_suppkey").alias("cohorts"), F.array(F.col("l_partkey") % 5).alias("deps"))
    return votes.reduced(rows, "tid")


@registered(f"SELECT tid, vote, array_to_string(cohorts, ',') AS cohorts, array_to_string(deps, ',') AS deps FROM ({_REDUCED})")
def vote_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of an order's lines merged, with the unions of their suppliers and dependencies."""
    shown = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return reduced_lines(spark, sf_dir).select("tid", "vote", shown("cohorts"), shown("deps"))


@registered(f"SELECT tid || ',' || tid * 10 || ',' || vote || ',' || len(cohorts) || ',' || array_to_string(deps, ';') AS line, tid, tid * 10 AS ts, vote, len(cohorts) AS batch_size, list_sum(deps) AS deps_sum FROM ({_REDUCED})")
def close_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close notifications as lines, and read back from them."""
    rows = reduced_lines(spark, sf_dir)
    line = text.close_line(F.col("tid"), F.col("tid") * 10, F.col("vote"), F.size("cohorts"), F.col("deps"))
    back = rows.select(line.alias("line")).select("line", text.close_fields(F.col("line")).alias("c"))
    total = F.aggregate("c.deps", F.lit(0).cast("long"), lambda a, x: a + x)
    return back.select("line", "c.tid", "c.ts", "c.vote", F.col("c.batch_size").cast("long").alias("batch_size"), total.alias("deps_sum"))


@registered(f"""WITH {_T}, k AS (SELECT tid, a AS k FROM transfers UNION SELECT tid, b FROM transfers), b AS (SELECT tid, lag(tid) OVER (PARTITION BY k ORDER BY tid) AS d FROM k)
SELECT tid, string_agg(DISTINCT d::VARCHAR, ',' ORDER BY d::VARCHAR) AS depends_on FROM b WHERE d IS NOT NULL GROUP BY tid""")
def dependency_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions that must be decided right before each."""
    rows = tgraph.numbered(generators.transfers(read(spark, sf_dir, "orders"), ACCOUNTS), ["ord"])
    ops = rows.select("tid", F.lit("balances").alias("ns"), F.explode(F.array("src", "dst")).alias("key"))
    return ledger.dependencies(ops).select("tid", F.array_join(F.array_sort(F.transform("depends_on", lambda x: x.cast("string"))), ",").alias("depends_on"))


# ---------------------------------------------------------------- states
@registered(f"WITH {bank_ctes()} SELECT t.tid, 'a' || a AS key, coalesce(f.value, {START}) AS value FROM transfers t LEFT JOIN ({_FINAL}) f ON 'a' || a = f.key")
def state_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last balance of each transfer's source, or the default of an account that never moved."""
    closed = bank(spark, sf_dir)
    asked = closed.results.select("tid", F.lit("balances").alias("ns"), F.col("original.src").alias("key"))
    return store.lookup(asked, store.as_of(closed.versions["balances"]), START).select("tid", "key", "value")


_SWEPT = ", ".join(f"('{s}', 'PL{int(level)}')" for s, level in SWEEP)


@registered(f"WITH {bank_ctes()}, c AS (SELECT count(*) FILTER (commit) AS commits, count(*) FILTER (NOT commit) AS aborts, 0::BIGINT AS replays, count(*) AS closed FROM voted) SELECT * FROM (VALUES {_SWEPT}) AS s(strategy, level), c")
def isolation_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank under every strategy and isolation level of the sweep: one outcome, and no transaction replayed."""
    out = None
    rows = stored(tgraph.numbered(generators.transfers(read(spark, sf_dir, "orders"), ACCOUNTS), ["ord"]), "transfers")  # one input, with its ids
    for strategy, level in SWEEP:
        graph = tgraph.TGraph(spark, TxConfig(isolation=level, strategy=strategy))
        closed = tgraph.close(bank_stream(graph, rows, tid="tid"))
        one = metrics.counters(closed.results).select(F.lit(strategy).alias("strategy"), F.lit(level.name).alias("level"), "*")
        out = one if out is None else out.unionByName(one)
    return out


_KV = """WITH t AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS tid, o_custkey % 700 AS a, (o_custkey + 1 + o_orderkey % 699) % 700 AS b, (1 + o_orderkey % 60)::BIGINT AS m, o_orderkey % 3 = 0 AS deposit FROM orders),
f AS (SELECT list(tid ORDER BY tid) AS tids, list_reduce(list({'a': (a + 1)::INTEGER, 'b': (b + 1)::INTEGER, 'm': CASE WHEN deposit THEN 0 ELSE m END, 'd': m} ORDER BY tid), lambda s, x:
  CASE WHEN s.bal[x.a] - x.m >= 0 THEN {'bal': list_transform(s.bal, lambda v, i: CASE WHEN i = x.a THEN v - x.m WHEN i = x.b THEN v + x.d ELSE v END), 'ok': list_append(s.ok, true)}
  ELSE {'bal': s.bal, 'ok': list_append(s.ok, false)} END, {'bal': list_transform(range(700), lambda i: 100::BIGINT), 'ok': []::BOOLEAN[]}) AS s FROM t)"""


@registered(_KV + " SELECT unnest(tids) AS tid, CASE WHEN unnest(s.ok) THEN 'COMMIT' ELSE 'ABORT' END AS vote FROM f")
def kv_deposit_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deposits on one key and transfers between two, in whole numbers; what would leave the source below 0 aborts."""
    n = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(n.alias("ord"), (F.col("o_custkey") % 700).cast("string").alias("src"), ((F.col("o_custkey") + 1 + n % 699) % 700).cast("string").alias("dst"), (1 + n % 60).alias("amount"), (n % 3 == 0).alias("deposit"))
    leg = lambda key, amount: F.struct(key.alias("key"), amount.cast("double").alias("amount"))
    legs = lambda v: F.when(v["deposit"], F.array(leg(v["dst"], v["amount"]))).otherwise(F.array(leg(v["src"], -v["amount"]), leg(v["dst"], v["amount"])))
    stream = tgraph.TGraph(spark).open(rows, ["ord"]).flat_map(legs)
    closed = tgraph.close(stream.state("kv", lambda v: v["key"], additive(START, low=0.0, scale=0), lambda v: v["amount"]))
    return closed.results.select("tid", "vote")


@registered("""WITH b AS (SELECT o_custkey AS key, o_orderkey AS came, 0 AS side, 1 AS d FROM orders UNION ALL SELECT user_id, event_id, 1, -1 FROM events),
g AS (SELECT key, list({'came': came, 'side': side, 'd': d} ORDER BY came, side) AS l FROM b GROUP BY key),
f AS (SELECT key, list_reduce(l, lambda s, x: {'v': greatest(0, s.v + x.d), 'o': list_append(s.o, {'came': x.came, 'side': x.side, 'v': greatest(0, s.v + x.d)})}, {'v': 0::BIGINT, 'o': []::STRUCT(came BIGINT, side INTEGER, v BIGINT)[]}) AS s FROM g),
o AS (SELECT key, unnest(s.o) AS o FROM f) SELECT key, o.came AS "at", o.side AS side, o.v AS value FROM o""")
def co_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and events over one map: an order adds to its customer's count, an event takes from its user's, never below 0."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("at"))
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("at"))
    steps = (lambda v, row: (v + 1, True), lambda v, row: (max(0, v - 1), v > 0))
    found = folds.co_mapped(orders, events, ("key",), "at", 0, "bigint", steps, "at")
    return found.select("key", "at", "side", "value")


# ---------------------------------------------------------------- queries and load
_PART = "('0x' || substr(md5(key), 1, 8))::BIGINT % 8"


@registered(f"""WITH q AS (SELECT c_custkey AS id, unnest(CASE WHEN c_custkey % 10 = 0 THEN ['*'] ELSE list_distinct(['a' || c_custkey % 1000, 'a' || c_custkey * 7 % 1000, 'a' || c_custkey * 31 % 1000]) END) AS key FROM customer),
p AS (SELECT id, {_PART} AS part, string_agg(key, ',' ORDER BY key) AS keys FROM q WHERE key <> '*' GROUP BY ALL)
SELECT '0.' || id AS query_id, part::INTEGER AS part, keys, count(*) OVER (PARTITION BY id) AS expected FROM p UNION ALL SELECT '0.' || id, p::INTEGER, NULL, 8 FROM q, range(8) AS r(p) WHERE key = '*'""")
def route_or_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of keys to the partitions of their keys, queries of predicates to all eight."""
    c = F.col("c_custkey")
    keys = F.array(*[generators.account(n) for n in (c % 1000, c * 7 % 1000, c * 31 % 1000)])
    asked = read(spark, sf_dir, "customer").select(text.composed_id(F.lit(0), c).alias("query_id"), F.when(c % 10 != 0, keys).alias("keys"))
    return routing.routed(asked, 8).select("query_id", "part", F.array_join("keys", ",").alias("keys"), "expected")


@registered("SELECT event_id, (SELECT count(*) FROM range(2, 2 + event_id % 40) AS r(p) WHERE NOT EXISTS (SELECT 1 FROM range(2, r.p) AS d(q) WHERE r.p % d.q = 0)) AS primes FROM events WHERE event_id % 40 >= 0")
def pure_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heavy computation a record, without a state: the primes up to a number."""
    return read(spark, sf_dir, "events").select("event_id", generators.primes(F.col("event_id") % 40 + 1).cast("long").alias("primes"))


@registered("SELECT o_orderkey AS id, epoch(max(l_shipdate) - any_value(o_orderdate))::DOUBLE AS seconds FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds from an order to the last shipment of its lines."""
    starts = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"))
    ends = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("ts"))
    return metrics.latencies(starts, ends)


@registered("SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1")
def tracked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of records, set aside by a tracker and counted."""
    return metrics.tracked(read(spark, sf_dir, "events"), "user_id")[1].groupBy("id").agg(F.count("*").alias("n"))


@registered("SELECT count(*) AS records, max(value) AS greatest, count(*) FILTER (event_type = 'error') AS errors FROM events")
def accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accumulators that ride along an action."""
    rows, seen = metrics.observed(read(spark, sf_dir, "events"), records=F.count("*"), greatest=F.max("value"), errors=F.count_if(F.col("event_type") == "error"))
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(seen.get[n] for n in ("records", "greatest", "errors"))], "records long, greatest double, errors long")


@registered(f"WITH {bank_ctes()}, f AS ({_FINAL}) SELECT 'rich' AS query_id, 'balances' AS ns, count(*) AS n, sum(value) AS total FROM f WHERE value >= 150 UNION ALL SELECT 'poor', 'balances', count(*), sum(value) FROM f WHERE value < 50")
def q_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of a user's own: two predicates on one state, each merged to a result."""
    versions = bank(spark, sf_dir).versions["balances"]
    asked = {"rich": lambda v: v >= 150, "poor": query.select_less_than(50)}
    found = [query.predicate(versions, "balances", keep).select(F.lit(name).alias("query_id"), "ns", "value") for name, keep in asked.items()]
    return found[0].unionByName(found[1]).groupBy("query_id", "ns").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


NAMES = [n for n, f in workloads.QUERIES.items() if f.__module__ == __name__]

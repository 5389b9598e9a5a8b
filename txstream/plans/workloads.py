"""The workloads as queries over the tables, and the same in SQL. Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import metrics
from ..config import PESSIMISTIC, TxConfig
from ..functions import paths, text, timestamps, votes
from ..operators import ledger, query, spu, store, tgraph, windows
from ..operators.statefn import ACCOUNT_COMMANDS, StateFunction, additive, appending, overwriting
from ..schemas import ABORT, COMMIT, REPLAY
from ..sources import generators, wal

#: Accounts of the bank, start of a balance, units of a product in stock, greatest number of votes, places of a ranking.
ACCOUNTS, START, STOCK, MOST_VOTES, PLACES = 1_000, 100.0, 100, 10, 10
#: Line numbers repeat within an order; these columns together order lines without ties.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- the bank
def balances(low_open: bool = False) -> StateFunction:
    """Accounts that start at 100 and never fall below 0 (``low_open``: never reach it)."""
    return additive(START, low=0.0, low_open=low_open, commands=ACCOUNT_COMMANDS)


def bank_stream(graph: tgraph.TGraph, rows: DataFrame, ns: str = "balances", fn: StateFunction | None = None, tid: str | None = None) -> tgraph.TStream:
    stream = graph.open(rows, ["ord"], tid)
    return stream.flat_map(generators.movements).state(ns, lambda v: v["account"], fn or balances(), lambda v: v["amount"])


def bank(spark: SparkSession, sf_dir: str, accounts: int = ACCOUNTS, how: str = "auto", config: TxConfig = TxConfig()) -> tgraph.Closed:
    graph = tgraph.TGraph(spark, config)
    return tgraph.close(bank_stream(graph, generators.transfers(read(spark, sf_dir, "orders"), accounts)), how=how)


def bank_ctes(accounts: int = ACCOUNTS, low: str = ">= 0", first: float = START, name: str = "", source: str = "transfers") -> str:
    """CTEs transfers, voted (tid, commit) and legs (tid, key, delta, value after) of the bank in SQL: a fold in order."""
    transfers = f"""transfers AS (
  SELECT row_number() OVER (ORDER BY o_orderkey) AS tid, (o_custkey % {accounts})::INTEGER AS a,
         ((o_custkey + 1 + o_orderkey % ({accounts} - 1)) % {accounts})::INTEGER AS b, ceil(o_totalprice / 10000)::DOUBLE AS m FROM orders
), """
    least, most = "acc.bal[least(x.a, x.b)]", "acc.bal[greatest(x.a, x.b)]"
    return f"""{transfers if source == "transfers" else ""}fold{name} AS (
  SELECT list(tid ORDER BY tid) AS tids, list_reduce(list({{'a': a + 1, 'b': b + 1, 'm': m}} ORDER BY tid), lambda acc, x:
    CASE WHEN acc.bal[x.a] - x.m {low} AND acc.bal[x.b] + x.m {low} THEN {{
      'bal': list_concat(list_concat(acc.bal[1:least(x.a, x.b) - 1], [{least} + CASE WHEN x.a < x.b THEN -x.m ELSE x.m END]),
             list_concat(list_concat(acc.bal[least(x.a, x.b) + 1:greatest(x.a, x.b) - 1], [{most} + CASE WHEN x.a < x.b THEN x.m ELSE -x.m END]), acc.bal[greatest(x.a, x.b) + 1:])),
      'votes': list_append(acc.votes, true)}}
    ELSE {{'bal': acc.bal, 'votes': list_append(acc.votes, false)}} END,
    {{'bal': list_transform(range({accounts}), lambda i: {first}::DOUBLE), 'votes': []::BOOLEAN[]}}) AS s FROM {source}
), voted{name} AS (
  SELECT unnest(tids) AS tid, unnest(s.votes) AS commit FROM fold{name}
), legs{name} AS (
  SELECT tid, 'a' || k AS key, delta, {first} + sum(delta) OVER (PARTITION BY k ORDER BY tid) AS value
  FROM (SELECT tid, a AS k, -m AS delta FROM {source} UNION ALL SELECT tid, b, m FROM {source}) JOIN voted{name} USING (tid) WHERE commit
)"""


_VOTE = "CASE WHEN commit THEN 'COMMIT' ELSE 'ABORT' END AS vote"
_FINAL = "SELECT key, arg_max(value, tid) AS value FROM legs GROUP BY key"


def _results(closed: tgraph.Closed) -> DataFrame:
    shown = F.array_join(F.transform("updates", lambda u: F.concat(u["key"], F.lit("="), u["value"].cast("double").cast("long").cast("string"))), ",")
    return closed.results.select("tid", F.col("original.src").alias("src"), F.col("original.dst").alias("dst"), F.col("original.amount").alias("amount"), "vote", shown.alias("updates"))


@registered(f"""WITH {bank_ctes()}, shown AS (SELECT tid, string_agg(key || '=' || value::BIGINT, ',' ORDER BY key) AS updates FROM legs GROUP BY tid)
SELECT t.tid, 'a' || a AS src, 'a' || b AS dst, m AS amount, {_VOTE}, coalesce(updates, '') AS updates FROM transfers t JOIN voted v ON t.tid = v.tid LEFT JOIN shown s ON t.tid = s.tid""")
def bank_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(bank(spark, sf_dir))


@registered(f"WITH {bank_ctes()} SELECT {_VOTE}, count(*) AS n FROM voted GROUP BY commit")
def bank_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.vote_counts(bank(spark, sf_dir).results)


@registered(f"WITH {bank_ctes()} {_FINAL}")
def bank_final_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank(spark, sf_dir).final("balances")


@registered(f"WITH {bank_ctes(15_000)} {_FINAL}")
def bank_parallel_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ledger by parallel rounds of prefix sums, over as many accounts as a bank of this size has."""
    return bank(spark, sf_dir, 15_000, how="rounds").final("balances")


@registered(f"WITH {bank_ctes(3_000)} {_FINAL}")
def bank_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ledger under a pessimistic strategy: transactions that share keys, directly or through others, in order."""
    return bank(spark, sf_dir, 3_000, config=TxConfig(strategy=PESSIMISTIC)).final("balances")


def _cents_sql(accounts: int) -> str:
    """The bank in whole cents: amounts from 0.01 to 60.00, so that balances meet 0.00 exactly."""
    transfers = f"""transfers AS (
  SELECT row_number() OVER (ORDER BY o_orderkey) AS tid, (o_custkey % {accounts})::INTEGER AS a,
         ((o_custkey + 1 + o_orderkey % ({accounts} - 1)) % {accounts})::INTEGER AS b, (1 + o_orderkey * 7919 % 6000)::BIGINT AS m FROM orders
), """
    return transfers + bank_ctes(accounts, first="10000", source="(SELECT * FROM transfers)").replace("ceil(o_totalprice / 10000)::DOUBLE", "m")


def _cents(spark: SparkSession, sf_dir: str, how: str, accounts: int = 500) -> DataFrame:
    rows = read(spark, sf_dir, "orders")
    rows = generators.transfers(rows, accounts).join(rows.select(F.col("o_orderkey").alias("ord"), ((1 + F.col("o_orderkey") * 7919 % 6000) / 100).alias("cents")), "ord")
    config = TxConfig(rest_limit=0)  # rounds to the end, and groups that share keys
    closed = tgraph.close(bank_stream(tgraph.TGraph(spark, config), rows.select("ord", "src", "dst", F.col("cents").alias("amount"))), how=how)
    return closed.versions["balances"].select("key", F.col("version").alias("tid"), F.round(F.col("value") * 100).cast("long").alias("cents"))


_CENTS = f"WITH {_cents_sql(500)} SELECT key, tid, value::BIGINT AS cents FROM legs"


@registered(_CENTS)
def bank_cents_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every balance in cents, in order in one task."""
    return _cents(spark, sf_dir, "serial")


@registered(_CENTS)
def bank_cents_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every balance in cents, in rounds."""
    return _cents(spark, sf_dir, "rounds")


@registered(_CENTS)
def bank_cents_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every balance in cents, by groups of transactions that share keys."""
    return _cents(spark, sf_dir, "groups")


@registered(f"WITH {bank_ctes()}, f AS ({_FINAL}) SELECT sum(value) AS total, count(*) AS n, sum(value) % 100 = 0 AS consistent FROM f")
def bank_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = query.predicate(bank(spark, sf_dir).versions["balances"], "balances", query.select_all)
    return query.invariant_total(found, START)


_T = bank_ctes().split("fold AS")[0].rstrip().rstrip(",")


@registered(f"""WITH {_T} SELECT tid, key, delta AS amount, sum(delta) OVER (PARTITION BY key ORDER BY tid) AS value
FROM (SELECT tid, 'a' || a AS key, -m AS delta FROM transfers UNION ALL SELECT tid, 'a' || b, m FROM transfers)""")
def bank_no_txn_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running balances from 0 without any guarantee."""
    rows = tgraph.numbered(generators.transfers(read(spark, sf_dir, "orders"), ACCOUNTS), ["ord"])
    legs = rows.select("tid", F.posexplode(generators.movements(F.struct("src", "dst", "amount"))).alias("ord", "leg"))
    ops = legs.select("tid", "ord", F.lit("balances").alias("ns"), F.col("leg.account").alias("key"), F.col("leg.amount").alias("amount"))
    return ledger.running_sums(ops).select("tid", "key", "amount", "value")


@registered(f"WITH {_T} SELECT tid AS id, 'a' || a AS src, 'a' || b AS dst, m AS amount FROM transfers")
def t_window_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both legs of a transfer, fanned out and merged again by a transaction's window."""
    stream = tgraph.TGraph(spark).open(generators.transfers(read(spark, sf_dir, "orders"), ACCOUNTS), ["ord"]).flat_map(generators.movements)
    merged = stream.window(lambda legs: F.struct(legs[0]["account"].alias("src"), legs[1]["account"].alias("dst"), legs[1]["amount"].alias("amount")))
    return merged.df.select(F.col("tid").alias("id"), "value.src", "value.dst", "value.amount")


@registered(f"WITH {_T} SELECT tid AS id, 'a' || a AS src, 'a' || b AS dst, m AS amount FROM transfers")
def merge_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The halves of transfers paired by id."""
    rows = tgraph.numbered(generators.transfers(read(spark, sf_dir, "orders"), ACCOUNTS), ["ord"])
    legs = rows.select(F.col("tid").alias("id"), F.explode(generators.movements(F.struct("src", "dst", "amount"))).alias("leg")).select("id", "leg.*")
    return generators.merged_transfers(legs)


@registered(f"""WITH {bank_ctes(low="> 0")}, {bank_ctes(low="> 0", name="2", source="(SELECT t.* FROM transfers t)")}
SELECT v.tid, CASE WHEN v.commit THEN 'COMMIT' ELSE 'ABORT' END AS first, CASE WHEN w.commit THEN 'COMMIT' ELSE 'ABORT' END AS second FROM voted v JOIN voted2 w ON v.tid = w.tid""")
def bank_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two graphs in series: what the first closes, committed or not, the second opens on a state of its own."""
    graph, fn = tgraph.TGraph(spark), balances(low_open=True)
    step = lambda ns: lambda s: s.flat_map(generators.movements).state(ns, lambda v: v["account"], fn, lambda v: v["amount"])
    opened = graph.open(generators.transfers(read(spark, sf_dir, "orders"), ACCOUNTS), ["ord"])
    first, second = tgraph.series(graph, opened, [step("one"), step("two")])
    return first.results.select("tid", F.col("vote").alias("first")).join(second.results.select("tid", F.col("vote").alias("second")), "tid")


@registered(f"""WITH {_T}, even AS (SELECT * FROM transfers WHERE tid % 2 = 0), odd AS (SELECT * FROM transfers WHERE tid % 2 = 1), {bank_ctes(low="> 0", name="e", source="even")}, {bank_ctes(low="> 0", name="o", source="odd")}
SELECT 0 AS graph, key, arg_max(value, tid) AS value FROM legse GROUP BY key UNION ALL SELECT 1, key, arg_max(value, tid) FROM legso GROUP BY key""")
def bank_parallel_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers routed by id to two graphs side by side, each with a state of its own."""
    rows = tgraph.numbered(generators.transfers(read(spark, sf_dir, "orders"), ACCOUNTS), ["ord"])
    out = []
    for k in range(2):
        graph = tgraph.TGraph(spark)
        closed = tgraph.close(bank_stream(graph, rows.where(F.col("tid") % 2 == k), fn=balances(low_open=True), tid="tid"))
        out.append(closed.final("balances").select(F.lit(k).alias("graph"), "key", "value"))
    return out[0].unionByName(out[1])


@registered(f"""WITH {bank_ctes(low=">= -1e18")}, judged AS (SELECT tid, tid * 7919 % 100 >= 20 AS commit FROM transfers)
SELECT {_VOTE}, count(*) AS n, sum(CASE WHEN commit THEN m ELSE 0 END) AS moved FROM judged JOIN transfers USING (tid) GROUP BY commit""")
def aborts_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the transfers aborts, told by the id."""
    graph = tgraph.TGraph(spark)
    rows = tgraph.numbered(generators.transfers(read(spark, sf_dir, "orders"), ACCOUNTS), ["ord"]).select("tid", "src", "dst", "amount", F.col("tid").alias("n"))
    stream = graph.open(rows, tid="tid")
    gate = additive(0.0, high=0.0)
    fails = lambda v: F.when((v["n"] * 7919) % 100 < 20, 1.0).otherwise(0.0)
    closed = tgraph.close(stream.state("gate", lambda v: v["n"].cast("string"), gate, fails))
    return closed.results.groupBy("vote").agg(F.count("*").alias("n"), F.sum(F.when(F.col("vote") == COMMIT, F.col("original.amount")).otherwise(0.0)).alias("moved"))


# ---------------------------------------------------------------- purchases
_PURCHASED = f"""p AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS tid, o_custkey AS customer, l_partkey AS product, p_brand AS category
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY tid) < {STOCK} AS commit FROM p)"""


@registered(f"WITH {_PURCHASED} SELECT tid, customer, product, {_VOTE} FROM r")
def purchase_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases through two exits: products by user, and a stock that must not run out."""
    return purchases_closed(spark, sf_dir).results.select("tid", F.col("original.customer").alias("customer"), F.col("original.product").alias("product"), "vote")


def purchases_closed(spark: SparkSession, sf_dir: str, with_users: bool = True) -> tgraph.Closed:
    rows = generators.purchases(*(read(spark, sf_dir, t) for t in ("lineitem", "orders", "part")))
    opened = tgraph.TGraph(spark).open(rows, LINE_ORDER)
    stock = opened.state("stock", lambda v: v["product"].cast("string"), additive(float(STOCK), low=0.0, low_open=True), lambda v: F.lit(-1.0))
    if not with_users:
        return tgraph.close(stock)
    by_user = opened.state("products", lambda v: v["customer"].cast("string"), appending("bigint"), lambda v: v["product"])
    return tgraph.close(by_user, stock)


@registered(f"""WITH {_PURCHASED}
SELECT customer::VARCHAR AS customer, string_agg(product::VARCHAR, ',' ORDER BY tid) AS products, count(*) AS n FROM r WHERE commit GROUP BY customer""")
def purchases_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = purchases_closed(spark, sf_dir).final("products")
    return final.select(F.col("key").alias("customer"), F.array_join(F.transform("value", lambda x: x.cast("string")), ",").alias("products"), F.size("value").cast("long").alias("n"))


def bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer, product, category of the purchases that committed."""
    done = purchases_closed(spark, sf_dir, with_users=False).results.where(F.col("vote") == COMMIT)
    return done.select("original.customer", "original.product", "original.category")


@registered(f"WITH {_PURCHASED} SELECT category, product, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, product) AS rank FROM (SELECT category, product, count(*) AS n FROM r WHERE commit GROUP BY ALL)) WHERE rank <= 10")
def top10_products_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the purchases that the stock allowed."""
    return windows.ranked(windows.counts(bought(spark, sf_dir), ["category", "product"]), ["category"], "product", 10).withColumn("rank", F.col("rank").cast("long"))


@registered(f"WITH {_PURCHASED} SELECT category, customer, n FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, customer) AS rank FROM (SELECT category, customer, count(*) AS n FROM r WHERE commit GROUP BY ALL)) WHERE rank = 1")
def most_active_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the purchases that the stock allowed."""
    return windows.ranked(windows.counts(bought(spark, sf_dir), ["category", "customer"]), ["category"], "customer", 1).drop("rank")


# ---------------------------------------------------------------- commands
_SPU = """WITH g AS (SELECT user_id, list({'id': event_id, 'd': CASE WHEN event_type = 'purchase' THEN -value ELSE value END} ORDER BY ts, event_id) AS l FROM events GROUP BY user_id),
f AS (SELECT user_id, list_reduce(l, lambda acc, x: CASE WHEN acc.v + x.d >= 0 THEN {'v': acc.v + x.d, 'out': list_append(acc.out, {'id': x.id, 'ok': true, 'v': acc.v + x.d})}
  ELSE {'v': acc.v, 'out': list_append(acc.out, {'id': x.id, 'ok': false, 'v': acc.v})} END, {'v': 100.0::DOUBLE, 'out': []::STRUCT(id BIGINT, ok BOOLEAN, v DOUBLE)[]}) AS s FROM g),
o AS (SELECT user_id, unnest(s.out) AS o FROM f) """


@registered(_SPU + "SELECT o.id::VARCHAR AS spu_id, user_id::VARCHAR AS key, CASE WHEN o.ok THEN 'COMMIT' ELSE 'ABORT' END AS vote, round(o.v, 6) AS value FROM o")
def spu_deposit_withdraw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-key commands, each key's in order."""
    done = spu.apply_commands(generators.commands(read(spark, sf_dir, "events")), balances())
    return done.select("spu_id", "key", "vote", F.round("value", 6).alias("value"))


@registered("SELECT user_id::VARCHAR AS key, round(sum(CASE WHEN event_type = 'purchase' THEN -value ELSE value END), 4) AS value, count(*) AS n FROM events GROUP BY user_id")
def spu_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deposits and withdrawals summed from 0, without an invariant."""
    rows = generators.commands(read(spark, sf_dir, "events"))
    signed = F.when(F.col("method") == "withdrawal", -F.col("params")[0]).otherwise(F.col("params")[0])
    return rows.groupBy("key").agg(F.round(F.sum(signed), 4).alias("value"), F.count("*").alias("n"))


# ---------------------------------------------------------------- voting
_HOUR = "SELECT s AS win_start, s + INTERVAL 2 HOUR AS win_end, event_type AS area, user_id AS participant FROM (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events)"
_ENDS = f"""c AS (SELECT win_start, win_end, area, participant, count(*) AS n FROM ({_HOUR}) GROUP BY ALL),
u AS (SELECT *, row_number() OVER (PARTITION BY win_start, area ORDER BY n, participant) AS up, count(*) OVER (PARTITION BY win_start, area) AS size FROM c),
e AS (SELECT win_start, win_end, area, participant, n, CASE WHEN up <= least({PLACES}, size) THEN true WHEN up > CASE WHEN size - least({PLACES}, size) >= {PLACES} THEN size - {PLACES} ELSE least({PLACES}, size) END THEN false END AS positive FROM u)"""


def vote_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes_ = windows.windowed(generators.votes(read(spark, sf_dir, "events")), "ts", "2 hours", "1 hour")
    return windows.ends(windows.counts(votes_, ["win_start", "win_end", "area", "participant"]), ["win_start", "area"], "participant", PLACES)


@registered(f"WITH {_ENDS} SELECT * FROM e WHERE positive IS NOT NULL")
def win_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten least and ten greatest counts of each sliding window and area."""
    return vote_ends(spark, sf_dir)


@registered(f"""WITH {_ENDS}, g AS (SELECT participant, list({{'d': CASE WHEN positive THEN 1 ELSE -1 END}} ORDER BY win_start, area, positive) AS l FROM e WHERE positive IS NOT NULL GROUP BY participant),
f AS (SELECT participant, list_reduce(l, lambda acc, x: CASE WHEN acc.v + x.d BETWEEN 0 AND {MOST_VOTES} THEN {{'v': acc.v + x.d, 'c': acc.c + 1, 'a': acc.a}} ELSE {{'v': acc.v, 'c': acc.c, 'a': acc.a + 1}} END, {{'v': 0::BIGINT, 'c': 0::BIGINT, 'a': 0::BIGINT}}) AS s FROM g)
SELECT participant, s.v::DOUBLE AS value, s.c AS commits, s.a AS aborts FROM f""")
def votes_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of 0 to 10 by participant: up for a least count, down for a greatest."""
    points = vote_ends(spark, sf_dir).select("win_start", "area", "participant", "positive")
    stream = tgraph.TGraph(spark).open(points, ["win_start", "area", "positive", "participant"])
    fn = additive(0.0, low=0.0, high=float(MOST_VOTES))
    closed = tgraph.close(stream.state("votes", lambda v: v["participant"].cast("string"), fn, lambda v: F.when(v["positive"], 1.0).otherwise(-1.0)))
    counts = windows.outcomes(closed.results.withColumn("participant", F.col("original.participant")), ["participant"])
    final = closed.final("votes").select(F.col("key").cast("long").alias("participant"), "value")
    return counts.join(final, "participant", "left").select("participant", F.coalesce("value", F.lit(0.0)).alias("value"), "commits", F.col("others").alias("aborts"))


@registered("WITH w AS (SELECT *, time_bucket(INTERVAL 10 MINUTE, ts) AS win_start FROM events) SELECT event_id, win_start, event_type AS area, user_id AS participant FROM w QUALIFY count(*) OVER (PARTITION BY win_start, event_type) <= 2")
def win_tumbling_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of windows and areas that have at most two."""
    rows = windows.windowed(generators.votes(read(spark, sf_dir, "events")), "ts", "10 minutes")
    return windows.suppressed(rows, ["win_start", "area"], 2).select("event_id", "win_start", "area", "participant")


@registered(f"SELECT win_start, area, participant, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY win_start, area ORDER BY n DESC, participant) AS rank FROM (SELECT win_start, area, participant, count(*) AS n FROM ({_HOUR}) GROUP BY ALL)) WHERE rank <= {PLACES}")
def win_sliding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.windowed(generators.votes(read(spark, sf_dir, "events")), "ts", "2 hours", "1 hour")
    return windows.ranked(windows.counts(rows, ["win_start", "area", "participant"]), ["win_start", "area"], "participant", PLACES).withColumn("rank", F.col("rank").cast("long"))


@registered(_SPU + "SELECT time_bucket(INTERVAL 1 HOUR, e.ts) AS win_start, count(*) FILTER (o.ok) AS commits, count(*) FILTER (NOT o.ok) AS others FROM o JOIN events e ON o.id = e.event_id GROUP BY 1")
def win_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of commands by hour."""
    events = read(spark, sf_dir, "events")
    done = spu.apply_commands(generators.commands(events), balances()).select(F.col("spu_id").cast("long").alias("event_id"), "vote")
    return windows.outcomes(windows.windowed(events.select("event_id", "ts").join(done, "event_id"), "ts", "1 hour"), ["win_start"])


@registered("SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS win_start, user_id AS key, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def first_of_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.windowed(read(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("key")), "ts", "15 minutes")
    return windows.firsts(rows, ["win_start", "key"], F.struct("ts", "event_id"), "event_id")


@registered("SELECT user_id::VARCHAR AS key, arg_max(event_id, (ts, event_id)) AS value FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS w, user_id, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM events GROUP BY 1, 2) GROUP BY user_id")
def overwrite_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each window overwrites its user's state; no invariant."""
    rows = windows.windowed(read(spark, sf_dir, "events").select("event_id", "ts", "user_id"), "ts", "15 minutes")
    firsts = rows.groupBy("win_start", "user_id").agg(F.min(F.struct("ts", "event_id")).alias("e")).select("e.ts", "e.event_id", "user_id")
    stream = tgraph.TGraph(spark).open(firsts, ["ts", "event_id"])
    return tgraph.close(stream.state("last", lambda v: v["user_id"].cast("string"), overwriting("bigint"), lambda v: v["event_id"])).final("last")


# ---------------------------------------------------------------- queries on states
@registered(f"""WITH {bank_ctes()}, q AS (SELECT c_custkey AS id, 'a' || unnest([c_custkey % 1000, c_custkey * 7 % 1000, c_custkey * 31 % 1000]) AS key FROM customer)
SELECT DISTINCT '0.' || id AS query_id, 'balances' AS ns, key, value FROM q JOIN ({_FINAL}) USING (key)""")
def q_point_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of three accounts for each customer, at the last watermark."""
    versions = bank(spark, sf_dir).versions["balances"]
    c = F.col("c_custkey")
    asked = read(spark, sf_dir, "customer").select(text.composed_id(F.lit(0), c).alias("query_id"), F.lit("balances").alias("ns"), F.array(*[generators.account(n) for n in (c % 1000, c * 7 % 1000, c * 31 % 1000)]).alias("keys"))
    return query.point(query.with_watermark(asked, versions.select(F.col("version").alias("watermark"))), versions)


@registered(f"WITH {bank_ctes()} SELECT 'balances' AS ns, key, value FROM ({_FINAL}) WHERE value < 50")
def q_predicate_lt50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.predicate(bank(spark, sf_dir).versions["balances"], "balances", query.select_less_than(50))


@registered(f"WITH {bank_ctes()}, h AS (SELECT max(tid) // 2 AS w FROM transfers) SELECT key, max(tid) AS version, arg_max(value, tid) AS value FROM legs, h WHERE tid <= w GROUP BY key")
def q_asof_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All accounts as of the middle transaction."""
    closed = bank(spark, sf_dir)
    middle = closed.results.agg(F.floor(F.max("tid") / 2).cast("long").alias("w")).first()[0]  # one number
    return store.as_of(closed.versions["balances"], middle).select("key", "version", "value")


@registered(f"""WITH {bank_ctes()}, b AS ({_FINAL}), n AS (SELECT key, count(*)::DOUBLE AS value FROM legs GROUP BY key)
SELECT 'balances' AS ns, key, value FROM b UNION ALL SELECT 'moves', key, value FROM n""")
def q_multi_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query on two states at one watermark: balances, and how often an account moved."""
    stream = bank_stream(tgraph.TGraph(spark), generators.transfers(read(spark, sf_dir, "orders"), ACCOUNTS))
    both = stream.state("moves", lambda v: v["account"], additive(0.0), lambda v: F.lit(1.0))
    closed = tgraph.close(both)
    found = [query.predicate(closed.versions[ns], ns, query.select_all) for ns in ("balances", "moves")]
    return found[0].unionByName(found[1])


@registered(f"""WITH {bank_ctes()}, q AS (SELECT c_nationkey AS id, 'a' || c_custkey % 1000 AS key FROM customer)
SELECT id::VARCHAR AS query_id, 'balances' AS ns, string_agg(key || '=' || value::BIGINT, ',' ORDER BY key) AS result FROM (SELECT DISTINCT id, key, value FROM q JOIN ({_FINAL}) USING (key)) GROUP BY id""")
def q_result_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each nation's accounts, its partial results merged to a map (shown as text)."""
    versions = bank(spark, sf_dir).versions["balances"]
    asked = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("query_id")).agg(F.collect_set(generators.account(F.col("c_custkey") % 1000)).alias("keys"))
    found = query.point(query.with_watermark(asked.withColumn("ns", F.lit("balances")), versions.select(F.col("version").alias("watermark"))), versions)
    shown = F.transform(F.array_sort(F.map_entries("result")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("long").cast("string")))
    return query.merged(found).select("query_id", "ns", F.array_join(shown, ",").alias("result"))


# ---------------------------------------------------------------- dataflow
@registered("SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS tid, l_quantity * 2 AS value FROM lineitem")
def t_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = tgraph.TGraph(spark).open(read(spark, sf_dir, "lineitem").select(*LINE_ORDER, "l_quantity"), LINE_ORDER)
    return opened.map(lambda v: v["l_quantity"] * 2).df.select("tid", "value")


@registered("SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS tid, CASE WHEN l_quantity > 25 THEN l_quantity END AS value FROM lineitem")
def t_filter_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered records stay, empty."""
    opened = tgraph.TGraph(spark).open(read(spark, sf_dir, "lineitem").select(*LINE_ORDER, "l_quantity"), LINE_ORDER)
    return opened.filter(lambda v: v["l_quantity"] > 25).map(lambda v: v["l_quantity"]).df.select("tid", "value")


@registered("""SELECT tid, i + 1 AS off, greatest(n, 1) AS size, CASE WHEN n > 0 THEN i ELSE -1 END AS value, CASE WHEN n > 0 THEN 0 ELSE -1 END::BIGINT AS step
FROM (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS tid, l_quantity::BIGINT % 5 AS n FROM lineitem), unnest(range(greatest(n, 1))) AS t(i)""")
def t_flatmap_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fan-out of 0 to 4 records; none leaves an empty one, so that the transaction can close."""
    opened = tgraph.TGraph(spark).open(read(spark, sf_dir, "lineitem").select(*LINE_ORDER, "l_quantity"), LINE_ORDER)
    n = lambda v: v["l_quantity"].cast("long") % 5
    fanned = opened.flat_map(lambda v: F.when(n(v) > 0, F.sequence(F.lit(0).cast("long"), n(v) - 1)).otherwise(F.array().cast("array<bigint>")))
    last = F.element_at(fanned.df["path"], -1)
    sizes = F.element_at(paths.shifted("path"), -1)["size"]
    return fanned.df.select("tid", last["off"].cast("long").alias("off"), last["size"].cast("long").alias("size"), F.coalesce("value", F.lit(-1)).alias("value"), F.when(F.col("value").isNotNull(), sizes).otherwise(-1).cast("long").alias("step"))


@registered("""SELECT o_orderkey AS tid, max(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END)::VARCHAR AS worst,
CASE max(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) WHEN 0 THEN 'COMMIT' WHEN 1 THEN 'ABORT' ELSE 'REPLAY' END AS vote FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def vote_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of an order's lines merged; the worst wins."""
    vote = F.when(F.col("l_returnflag") == "N", COMMIT).when(F.col("l_returnflag") == "A", ABORT).otherwise(REPLAY)
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tid"), vote.alias("vote"))
    kept = rows.join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tid")), "tid")
    merged = tgraph.reduced_votes([kept.where("vote = 'COMMIT'"), kept.where("vote != 'COMMIT'")])
    return merged.select("tid", votes.rank("vote").cast("string").alias("worst"), "vote")


@registered("SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z0-9_]+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.counts(text.words(read(spark, sf_dir, "documents").select("text"), "text"), ["word"])


@registered("SELECT user_id AS key, low, high, n FROM (SELECT user_id, min(e) AS low, max(e) AS high, count(*) AS n FROM (SELECT user_id, event_id AS e, event_id - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) GROUP BY user_id, g) WHERE n > 1")
def contiguous_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive ids of a user."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ts"))
    return timestamps.islands(rows, by=("key",)).where("n > 1")


@registered("SELECT key, coalesce(max(high) FILTER (low = 1), 0) AS watermark FROM (SELECT key, min(ts) AS low, max(ts) AS high FROM (SELECT l_linenumber % 3 AS key, l_orderkey AS ts, l_orderkey - dense_rank() OVER (PARTITION BY l_linenumber % 3 ORDER BY l_orderkey) AS g FROM lineitem WHERE l_orderkey > 0) GROUP BY key, g) GROUP BY key")
def contiguous_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last timestamp below which all have closed, by source."""
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 3).alias("key"), F.col("l_orderkey").alias("ts"))
    return timestamps.contiguous_high(rows, 0, by=("key",))


@registered("SELECT event_id, user_id % 37 AS source, event_id * 100 + user_id % 37 AS real, (event_id * 100 + user_id % 37) // 100 AS logical, (event_id * 100 + user_id % 37) % 100 AS owner FROM events")
def timestamp_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps of 37 sources that never meet."""
    rows = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 37).alias("source"))
    rows = rows.withColumn("real", timestamps.real(F.col("event_id"), F.col("source"), 37))
    return rows.withColumn("logical", timestamps.logical(F.col("real"), 37)).withColumn("owner", timestamps.owner(F.col("real"), 37))


@registered(f"WITH {_T} SELECT tid, 'a' || k AS key, row_number() OVER (PARTITION BY k ORDER BY tid) AS position FROM (SELECT tid, a AS k FROM transfers UNION ALL SELECT tid, b FROM transfers)")
def lock_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each transaction's place in the queues of its keys."""
    rows = tgraph.numbered(generators.transfers(read(spark, sf_dir, "orders"), ACCOUNTS), ["ord"])
    ops = rows.select("tid", F.lit("balances").alias("ns"), F.explode(F.array("src", "dst")).alias("key"))
    return ledger.conflict_ranks(ops).select("tid", "key", F.col("position").cast("long").alias("position"))


# ---------------------------------------------------------------- log and versions
def _log_entries(closed: tgraph.Closed) -> DataFrame:
    return wal.entries_of(closed.results, 4)


@registered(f"WITH {bank_ctes()}, h AS (SELECT max(tid) // 3 AS w FROM transfers) SELECT t.tid, 'a' || a AS src FROM transfers t, h WHERE NOT EXISTS (SELECT 1 FROM voted v WHERE v.tid = t.tid AND v.tid <= w)")
def recovery_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions that a log with the first third doesn't have yet."""
    closed = bank(spark, sf_dir)
    third = closed.results.agg(F.floor(F.max("tid") / 3)).first()[0]
    return wal.pending(closed.results.select("tid", F.col("original.src").alias("src")), _log_entries(closed).where(F.col("ts") <= third))


@registered(f"WITH {bank_ctes()} SELECT 'balances' AS ns, key, value FROM ({_FINAL})")
def recovery_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances from a snapshot in the middle and the log's later updates."""
    closed = bank(spark, sf_dir)
    middle = closed.results.agg(F.floor(F.max("tid") / 2).cast("long")).first()[0]
    return wal.recovered(store.snapshot(closed.versions["balances"], middle), _log_entries(closed), middle, "balances")


@registered(f"WITH {bank_ctes()}, h AS (SELECT max(tid) // 2 AS w FROM transfers) SELECT key, tid AS version, value FROM legs, h QUALIFY tid > w OR row_number() OVER (PARTITION BY key, tid <= w ORDER BY tid DESC) = 1")
def version_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that readers from the middle transaction on can see."""
    closed = bank(spark, sf_dir)
    middle = closed.results.agg(F.floor(F.max("tid") / 2).cast("long")).first()[0]
    return store.compact(closed.versions["balances"], middle).select("key", "version", "value")


# ---------------------------------------------------------------- metrics
@registered("SELECT event_type AS label, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(stddev_samp(value), 6) AS stddev FROM events GROUP BY 1")
def metric_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.stats(read(spark, sf_dir, "events").withColumnRenamed("event_type", "label"), "value", ("label",))
    return rows.select("label", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p5", "p50", "p95", "stddev")])


@registered("SELECT o_orderpriority AS label, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS low, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS q2, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, max(o_totalprice) AS high FROM orders GROUP BY 1")
def describe_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.described(read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "label"), ["label"], "o_totalprice")
    return rows.select("label", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "low", *[F.round(c, 4).alias(c) for c in ("q1", "q2", "q3")], "high")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank_results(spark, sf_dir)


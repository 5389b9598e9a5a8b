import random
from decimal import Decimal

import pyarrow as pa
import pytest

from txstream.config import PESSIMISTIC, TxConfig
from txstream.operators import ledger, tgraph
from txstream.operators.statefn import additive, appending
from txstream.plans import dataflow

OPS = "tid long, ord int, ns string, key string, amount double"


def in_order(ops, low, high, start=None, default=100.0):
    """The outcome by definition: transactions one after another."""
    state, votes, writes = dict(start or {}), {}, {}
    for tid in sorted({o[0] for o in ops}):
        own, ok = {}, True
        for _, _, ns, key, amount in sorted((o for o in ops if o[0] == tid), key=lambda o: o[1]):
            own[ns, key] = own.get((ns, key), state.get((ns, key), default)) + amount
            ok = ok and low <= own[ns, key] <= high
        votes[tid] = "COMMIT" if ok else "ABORT"
        if ok:
            state |= own
            writes |= {(tid, *k): v for k, v in own.items()}
    return votes, writes


def transfers(n, keys, seed):
    r = random.Random(seed)
    out = []
    for tid in range(1, n + 1):
        for k in range(r.choice([1, 2, 2, 3])):
            out.append((tid, k, r.choice(["a", "b"]), f"k{r.randrange(keys)}", float(r.randint(-40, 35))))
    return out


WAYS = ["serial", "rounds", "groups", "some"]


def test_a_fold_goes_on_over_batches_and_drops_groups_that_have_ended(monkeypatch):
    monkeypatch.setattr(ledger, "KEYS", 1)
    fold = ledger._Fold({"a": (0, 10, True), "b": (None, None, False)})
    columns = ["part", "tid", "ns", "key", "net", "low", "high", "base", "sure"]
    rows = lambda *r: pa.table(dict(zip(columns, map(list, zip(*r)))))
    first = fold.decided(rows(
        (1, 1, "a", "x", -3, -3, -3, 5, False), (1, 1, "b", "x", -9, -9, -9, 0, False), (1, 2, "a", "x", -2, -2, -2, 5, False),
        (1, 3, "a", "x", 4, 4, 4, 5, True), (1, 4, "a", "x", 5, 5, 5, 5, False), (2, 5, "a", "y", 1, 0, 1, 9, False), (2, 6, "a", "z", 1, 0, 2, 9, False),
    ))
    assert list(zip(*first.to_pydict().values())) == [(1, True), (2, False), (4, False), (5, True), (6, False)]
    assert set(fold.codes) == {("a", "y"), ("a", "z")}  # of the part that goes on
    second = fold.decided(rows((2, 7, "a", "y", 1, 0, 1, 9, False), (2, 8, "a", "z", 1, 0, 1, 9, False)))
    assert list(zip(*second.to_pydict().values())) == [(7, False), (8, True)]


def test_the_sweep_numbers_its_transactions_once(spark, monkeypatch):
    made = []
    own = tgraph.numbered
    monkeypatch.setattr(tgraph, "numbered", lambda *a, **k: made.append(1) or own(*a, **k))
    found = dataflow.isolation_sweep(spark, "/root/testdata/sf0.001").collect()
    assert len(made) == 1 and len(found) == 5 and len({(r.commits, r.aborts, r.replays, r.closed) for r in found}) == 1


def run(rows, states, how, start=None, chunk=1 << 17):
    if how == "some":  # rounds, and the rest in one task
        units = {ns: fn.in_units() for ns, fn in states.items()}
        made = rows.withColumn("amount", next(iter(states.values())).units(rows.amount))
        started = start.withColumn("value", next(iter(states.values())).units(start.value)) if start is not None else None
        done = ledger.rounds(made, units, limit=40, chunk=chunk, start=started)
        scale = float(10 ** next(iter(states.values())).scale)
        return ledger.Outcome(done.votes, done.writes.withColumn("value", done.writes.value / scale))
    return ledger.execute(rows, states, TxConfig(rest_limit=0), start, how)


@pytest.mark.parametrize(("n", "keys", "how", "chunk"), [(120, 4, "serial", 1), (120, 4, "rounds", 16), (200, 60, "rounds", 1 << 17), (1, 1, "rounds", 4), (200, 60, "groups", 1), (120, 4, "groups", 1), (200, 30, "some", 16)])
def test_every_way_gives_the_serial_outcome(spark, monkeypatch, n, keys, how, chunk):
    monkeypatch.setattr(ledger, "CHUNK", chunk)
    ops = transfers(n, keys, n + keys)
    states = {ns: additive(100.0, low=0.0, high=250.0) for ns in ("a", "b")}
    done = run(spark.createDataFrame(ops, OPS), states, how, chunk=chunk)
    votes, writes = in_order(ops, 0.0, 250.0)
    assert {r.tid: r.vote for r in done.votes.collect()} == votes
    assert {(r.tid, r.ns, r.key): r.value for r in done.writes.collect()} == writes


@pytest.mark.parametrize("how", WAYS)
def test_cents_up_to_the_boundary(spark, how):
    """Amounts that no double holds, spent to exactly nothing: sums of doubles would refuse the last."""
    spent = [7.65, 1.36, 25.1, 26.9, 10.66, 19.52, 8.81]
    ops = [(k + 1, 0, "a", "x", -v) for k, v in enumerate(spent)] + [(8, 0, "a", "x", -0.01), (9, 0, "a", "x", 0.03), (10, 0, "a", "x", -0.03)]
    r = random.Random(7)
    for t in range(11, 120):
        a, b = r.sample("pqrs", 2)
        m = r.randint(1, 4_000) / 100
        ops += [(t, 0, "a", a, -m), (t, 1, "a", b, m)]
    done = run(spark.createDataFrame(ops, OPS), {"a": additive(100.0, low=0.0)}, how)
    exact = [(t, k, ns, key, Decimal(str(v))) for t, k, ns, key, v in ops]
    votes, writes = in_order(exact, Decimal(0), Decimal(10**9), default=Decimal(100))
    assert votes[7] == "COMMIT" and votes[8] == "ABORT" and votes[10] == "COMMIT"
    assert {r.tid: r.vote for r in done.votes.collect()} == votes
    assert {(r.tid, r.ns, r.key): r.value for r in done.writes.collect()} == {k: float(v) for k, v in writes.items()}


def test_folds_of_cents_agree_with_the_ledger(spark):
    r = random.Random(3)
    ops = [(t, 0, "a", r.choice("xy"), r.randint(-3_000, 2_500) / 100) for t in range(1, 150)]
    rows, fn = spark.createDataFrame(ops, OPS), additive(100.0, low=0.0)
    folded = {x.tid: (x.vote, x.value) for x in ledger.keyed_folds(rows, fn).collect()}
    done = ledger.execute(rows, {"a": fn}, TxConfig(rest_limit=0), how="rounds")
    assert {t: v for t, (v, _) in folded.items()} == {x.tid: x.vote for x in done.votes.collect()}
    assert {t: v for t, (vote, v) in folded.items() if vote == "COMMIT"} == {x.tid: x.value for x in done.writes.collect()}


def test_amounts_finer_than_the_scale_are_refused(spark):
    rows = spark.createDataFrame([(1, 0, "a", "x", 0.00001)], OPS)
    with pytest.raises(Exception, match="more than 4 decimal places"):
        ledger.execute(rows, {"a": additive(1.0)}).votes.collect()
    assert ledger.execute(rows, {"a": additive(1.0, scale=5)}).writes.first().value == 1.00001


def test_the_limit_changes_nothing(spark):
    ops = transfers(150, 12, 5)
    rows, states = spark.createDataFrame(ops, OPS), {ns: additive(100.0, low=0.0, high=250.0) for ns in ("a", "b")}
    found = [ledger.execute(rows, states, TxConfig(serial_limit=n, rest_limit=m)) for n, m in ((1, 0), (50, 40), (1, 10_000), (10_000, 0))] + [ledger.execute(rows, states, TxConfig(strategy=PESSIMISTIC))]
    first = [sorted(map(tuple, d.votes.collect())) for d in found]
    assert all(f == first[0] for f in first) and len({str(sorted(map(str, d.writes.select("tid", "ns", "key", "value").collect()))) for d in found}) == 1


def test_queues_and_dependencies(spark):
    rows = spark.createDataFrame([(t, 0, "a", k, 1.0) for t, k in ((1, "x"), (1, "y"), (2, "y"), (3, "x"), (5, "x"), (5, "y"))], OPS)
    assert {(r.tid, r.key): r.position for r in ledger.conflict_ranks(rows, chunk=2).collect()} == {(1, "x"): 1, (1, "y"): 1, (2, "y"): 2, (3, "x"): 2, (5, "x"): 3, (5, "y"): 3}
    assert {r.tid: r.depends_on for r in ledger.dependencies(rows).collect()} == {2: [1], 3: [1], 5: [2, 3]}


@pytest.mark.parametrize("how", WAYS)
def test_states_go_on_from_where_they_were(spark, how):
    ops = [(5, 0, "a", "x", -20.0), (6, 0, "a", "x", -20.0), (7, 0, "a", "y", -100.0), (8, 0, "a", "y", -1.0)]
    done = run(spark.createDataFrame(ops, OPS), {"a": additive(100.0, low=0.0)}, how, spark.createDataFrame([("a", "x", 30.0)], "ns string, key string, value double"))
    assert {r.tid: r.vote for r in done.votes.collect()} == {5: "COMMIT", 6: "ABORT", 7: "COMMIT", 8: "ABORT"}
    assert {(r.tid, r.key): r.value for r in done.writes.collect()} == {(5, "x"): 10.0, (7, "y"): 0.0}


def test_an_invariant_holds_after_each_operation(spark):
    ops = [(1, 0, "a", "x", -150.0), (1, 1, "a", "x", 100.0), (2, 0, "a", "x", 100.0), (2, 1, "a", "x", -150.0)]
    for how in WAYS:
        done = run(spark.createDataFrame(ops, OPS), {"a": additive(100.0, low=0.0)}, how)
        assert {r.tid: r.vote for r in done.votes.collect()} == {1: "ABORT", 2: "COMMIT"}


def test_open_bounds(spark):
    ops = [(1, 0, "a", "x", -100.0), (2, 0, "a", "x", -99.0)]
    for how in WAYS:
        done = run(spark.createDataFrame(ops, OPS), {"a": additive(100.0, low=0.0, low_open=True)}, how)
        assert {r.tid: r.vote for r in done.votes.collect()} == {1: "ABORT", 2: "COMMIT"}


def test_empty_ledgers(spark):
    none = spark.createDataFrame([], OPS)
    for how in WAYS:
        done = run(none, {"a": additive(1.0)}, how)
        assert done.votes.count() == 0 and done.writes.count() == 0


def test_keys_fold_on_their_own(spark):
    rows = spark.createDataFrame([(t, 0, "a", k, a) for t, k, a in ((1, "x", -60.0), (2, "x", -60.0), (3, "y", -60.0), (4, "x", -40.0))], OPS)
    found = ledger.keyed_folds(rows, additive(100.0, low=0.0)).collect()
    assert {r.tid: (r.vote, r.value) for r in found} == {1: ("COMMIT", 40.0), 2: ("ABORT", 40.0), 3: ("COMMIT", 40.0), 4: ("COMMIT", 0.0)}
    lists = ledger.free_writes(rows.withColumn("amount", rows.tid), {"a": appending("bigint")}).collect()
    assert {(r.key, r.tid): r.value for r in lists}["x", 4] == [1, 2, 4]


def test_rounds_need_sums(spark):
    with pytest.raises(ValueError):
        ledger.execute(spark.createDataFrame([], "tid long, ord int, ns string, key string, amount bigint"), {"a": appending("bigint")}, how="rounds")

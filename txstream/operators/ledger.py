"""Ledgers: transactions over keyed states, with the outcome of running them one after another in tid order.

Operations are rows (tid, ord, ns, key, amount): ``ord`` orders a transaction's operations. A transaction commits if the
invariant holds after each of its operations; else it writes nothing. Ways to the same outcome:

``running_sums``   no invariant: prefix sums.
``rounds``         additive states. A round bounds what every key holds before each open transaction: at least if all that
                   is open before takes and nothing gives, at most the other way round. What holds at both ends commits,
                   what fails at both aborts, and these votes are final; the next round carries open transactions alone.
                   Sums are two-level, by chunks of tids, so a key with most operations is many groups. When no more than
                   ``rest_limit`` operations are open, or a round decides little, the rest runs in order: transactions
                   that share no open key, directly or through others, in parallel.
``serial``         one task runs the transactions in order, whatever the states.
``keyed_folds``    transactions of one key each: every key's operations fold in order, all keys in parallel.

Additive states are summed in whole units (``statefn``), so all ways agree bit for bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PESSIMISTIC, TxConfig
from ..schemas import ABORT, COMMIT
from ..sources.shared import released, stored
from .components import components
from .folds import folded
from .joins import looked_up
from .statefn import StateFunction, additive

#: Transactions of a key that are summed up to one number before sums run over keys.
CHUNK = 1 << 17
#: Keys that a task in order holds before it drops those of groups that have ended.
KEYS = 1 << 20
_KEY = ("ns", "key")


@dataclass
class Outcome:
    """votes: tid, vote of every transaction. writes: ns, key, tid, value (after the transaction) of committed ones."""

    votes: DataFrame
    writes: DataFrame
    rounds: int = 0


def _sums_before(rows: DataFrame, amounts: dict[str, Column], order: tuple[str, ...] = ("tid",)) -> DataFrame:
    """rows with, for each name in ``amounts``, the sum of that amount over the key's earlier rows.

    ``rows`` carries (ns, key, chunk) and the columns of ``order``. Chunks are summed first; their sums, few for each key,
    run up to an offset for each chunk; inside a chunk a window adds the rest.
    """
    chunks = rows.groupBy(*_KEY, "chunk").agg(*[F.sum(a).alias(f"__{n}") for n, a in amounts.items()])
    earlier = Window.partitionBy(*_KEY).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    offsets = chunks.select(*_KEY, "chunk", *[F.coalesce(F.sum(f"__{n}").over(earlier), none).alias(f"__{n}") for n in amounts])
    inside = Window.partitionBy(*_KEY, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(offsets, [*_KEY, "chunk"])
    found = {n: F.col(f"__{n}") + F.coalesce(F.sum(a).over(inside), none) for n, a in amounts.items()}
    return joined.withColumns(found).drop(*[f"__{n}" for n in amounts])


def running_sums(ops: DataFrame, start: float = 0.0, scale: int = 4, chunk: int = CHUNK) -> DataFrame:
    """ops with ``value``: the key's sum so far, without any guarantee."""
    fn = additive(start, scale=scale).in_units()
    rows = ops.withColumn("__units", additive(start, scale=scale).units(F.col("amount"))).withColumn("chunk", _chunk(chunk))
    sums = _sums_before(rows, {"value": F.col("__units")}, ("tid", "ord"))
    return sums.withColumn("value", (F.lit(fn.default) + F.col("value") + F.col("__units")) / float(10**scale)).drop("__units", "chunk")


def _chunk(size: int) -> Column:
    return F.floor(F.col("tid") / size).cast("long")


def netted(ops: DataFrame) -> DataFrame:
    """One row for each transaction and key: net, and the least and greatest sum on the way (low, high)."""
    way = Window.partitionBy("tid", *_KEY).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    sums = ops.withColumn("way", F.sum("amount").over(way))
    return sums.groupBy("tid", *_KEY).agg(F.sum("amount").alias("net"), F.min("way").alias("low"), F.max("way").alias("high"))


def _by_state(states: dict[str, StateFunction], give) -> Column:
    found = F.lit(None)
    for ns, fn in states.items():
        found = F.when(F.col("ns") == ns, give(fn)).otherwise(found)
    return found


def rounds(ops: DataFrame, states: dict[str, StateFunction], limit: int = 0, chunk: int = CHUNK, start: DataFrame | None = None, least: float = 0.2) -> Outcome:
    """Additive states in whole units, any number of keys a transaction. ``start``: ns, key, value where it isn't the default.

    ``limit``: operations that are left to one task in order. A round that decides less than the share ``least`` of what is
    open is the last, as each of the others would need one of its own.
    """
    rows = netted(ops).withColumn("chunk", _chunk(chunk)).withColumn("base", F.lit(0).cast("bigint"))
    if start is not None:
        held = start.select(*_KEY, F.col("value").alias("held"))
        rows = rows.join(held, list(_KEY), "left").withColumn("base", F.coalesce(F.col("held") - _by_state(states, lambda f: F.lit(f.default)), "base")).drop("held")
    rows = stored(rows.withColumn("base", F.col("base") + _by_state(states, lambda f: F.lit(f.default))), "ledger")
    n_open, done, votes, made = rows.count(), 0, [], []
    every = open_ = rows.withColumn("sure", F.lit(False))
    own = Window.partitionBy("tid")
    while n_open > limit:
        done += 1
        # what committed in the last round is exact; of what is open, all that takes, or all that gives
        exact = F.when(F.col("sure"), F.col("net")).otherwise(0)
        takes, gives = (F.when(F.col("sure"), F.col("net")).otherwise(side(F.col("net"), F.lit(0))) for side in (F.least, F.greatest))
        judged = _sums_before(open_, {"exact": exact, "takes": takes, "gives": gives}).where(~F.col("sure"))
        at = lambda sums, way: F.col("base") + F.col(sums) + F.col(way)
        holds = _by_state(states, lambda f: f.within(at("takes", "low"), at("gives", "high")))
        fails = _by_state(states, lambda f: f.beyond(at("gives", "low"), at("takes", "high")))
        voted = judged.select("tid", *_KEY, "net", "low", "high", "chunk", (F.col("base") + F.col("exact")).alias("base"), holds.alias("holds"), fails.alias("fails"))
        voted = voted.withColumns({"sure": F.min("holds").over(own), "gone": F.max("fails").over(own)}).drop("holds", "fails")
        voted = stored(voted, "round")
        made.append(voted)
        votes.append(voted.where("sure or gone").select("tid", F.col("sure").alias("commit")))
        open_ = voted.where("not gone").drop("gone")
        before, n_open = n_open, open_.where("not sure").count()
        if before - n_open < least * before:
            break
    if n_open:
        made.append(_rest(open_, states, one=n_open <= limit))
        votes.append(made[-1])
    decided = rows.select("tid", F.lit(True).alias("commit")).limit(0)
    for more in votes:
        decided = decided.unionByName(more)
    decided = stored(decided.groupBy("tid").agg(F.min("commit").alias("commit")), "votes")
    released(*made)
    # with all votes known, one pass gives what every key holds after each transaction
    committed = every.join(decided.where("commit"), "tid", "left_semi")
    sums = _sums_before(committed, {"before": F.col("net")})
    writes = sums.select(*_KEY, "tid", (F.col("base") + F.col("before") + F.col("net")).alias("value"))
    return Outcome(decided.select("tid", F.when(F.col("commit"), COMMIT).otherwise(ABORT).alias("vote")), writes, done)


class _Fold:
    """What the keys of open transactions have moved by, as transactions run in order: whole ones at a time, sorted by
    (part, tid), one row for each of their keys."""

    def __init__(self, bounds: dict[str, tuple[int | None, int | None, bool]]) -> None:
        self.bounds = bounds
        self.codes: dict[tuple[str, str], int] = {}
        self.parts: list[int] = []  # by code, the part that the key is of
        self.moved: list[int] = []

    def _coded(self, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The place of each row's key in ``moved``; the place of its namespace in the list of them."""
        ns, key = (rows.column(c).combine_chunks().dictionary_encode() for c in _KEY)
        ns, key = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (ns, key))
        names, keys, n = ns.dictionary.to_pylist(), key.dictionary.to_pylist(), len(key.dictionary)
        space = ns.indices.to_numpy().astype(np.int64)
        found, first, at = np.unique(space * n + key.indices.to_numpy(), return_index=True, return_inverse=True)
        part, places = rows.column("part").to_numpy(), []
        for x, row in zip(found.tolist(), first.tolist()):
            name = names[x // n], keys[x % n]
            code = self.codes.setdefault(name, len(self.codes))
            if code == len(self.moved):
                self.moved.append(0)
                self.parts.append(int(part[row]))
            places.append(code)
        return np.array(places)[at], space, names

    def _forget(self, part: int) -> None:
        """Only the keys of the part that goes on are still needed."""
        kept = [(name, code) for name, code in self.codes.items() if self.parts[code] == part]
        self.codes = {name: k for k, (name, _) in enumerate(kept)}
        self.moved, self.parts = [self.moved[code] for _, code in kept], [part] * len(kept)

    def decided(self, rows: pa.Table) -> pa.RecordBatch:
        """tid, commit of the open transactions among the rows."""
        code, space, names = self._coded(rows)
        part, tid, net, low, high, base, sure = (rows.column(c).to_numpy() for c in ("part", "tid", "net", "low", "high", "base", "sure"))
        any_, none = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        least, most = np.full(len(tid), none), np.full(len(tid), any_)
        for k, name in enumerate(names):  # how far a key may have moved for the transaction to hold on it
            floor, ceiling, is_open = self.bounds[name]
            own = (space == k) & ~sure
            if floor is not None:
                least[own] = floor + bool(is_open) - base[own] - low[own]
            if ceiling is not None:
                most[own] = ceiling - base[own] - high[own]
        begins = np.flatnonzero(np.concatenate([[True], (tid[1:] != tid[:-1]) | (part[1:] != part[:-1])]))
        moved, ok = self.moved, []
        code, net, least, most = (x.tolist() for x in (code, net, least, most))
        ends = [*begins[1:].tolist(), len(tid)]
        for a, b in zip(begins.tolist(), ends):
            for k in range(a, b):
                if not least[k] <= moved[code[k]] <= most[k]:
                    ok.append(False)
                    break
            else:
                for k in range(a, b):
                    moved[code[k]] += net[k]
                ok.append(True)
        if len(self.moved) > KEYS:
            self._forget(int(part[-1]))
        asked = ~sure[begins]
        return pa.RecordBatch.from_arrays([pa.array(tid[begins][asked], pa.int64()), pa.array(np.array(ok, dtype=bool)[asked])], names=["tid", "commit"])


def _rest(rows: DataFrame, states: dict[str, StateFunction], one: bool) -> DataFrame:
    """tid, commit of the open transactions (``sure`` is false), run in order beside those that are sure.

    ``one``: in one task; else those that share keys, directly or through others, in one, and such groups in parallel.
    """
    rows = rows.select("tid", *_KEY, "net", "low", "high", "base", "sure")
    if one:
        dealt = rows.withColumn("part", F.lit(0).cast("long")).repartition(1)
    else:
        rows = stored(rows.withColumn("node", F.xxhash64(*_KEY)), "rest")
        asks = rows.where("not sure").select("tid", "node")
        links = asks.join(asks.groupBy("tid").agg(F.min("node").alias("a")), "tid").select("a", F.col("node").alias("b")).where("a != b")
        counts = rows.groupBy("node").agg(F.count("*").alias("n"))
        named = counts.join(components(links).withColumnRenamed("id", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("part"), "n")
        needed = asks.select("node").distinct()  # what touches no open transaction's keys is of no use here
        dealt = looked_up(rows, stored(named.join(needed, "node", "left_semi"), "parts"), "node", how="inner").drop("node").repartition("part")
    bounds = {ns: (fn.low, fn.high, fn.low_open) for ns, fn in states.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, held, now = _Fold(bounds), [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            part, tid = (batch.column(c).to_numpy() for c in ("part", "tid"))
            begins = np.flatnonzero((tid[1:] != tid[:-1]) | (part[1:] != part[:-1])) + 1
            if now is not None and now != (part[0], tid[0]):  # the transaction that was held is whole
                begins = np.concatenate([[0], begins])
            now = part[-1], tid[-1]
            if len(begins):
                held.append(batch.slice(0, begins[-1]))
                yield fold.decided(pa.Table.from_batches(held).combine_chunks())
                held = []
            held.append(batch.slice(begins[-1] if len(begins) else 0))
        if held:
            yield fold.decided(pa.Table.from_batches(held).combine_chunks())

    return stored(dealt.sortWithinPartitions("part", "tid").mapInArrow(run, "tid long, commit boolean"), "rest")


def serial(ops: DataFrame, states: dict[str, StateFunction], start: DataFrame | None = None) -> Outcome:
    """One task, rows in order of (tid, ord). The amounts may be of any type that the states' Python forms take.

    Holds the states' keys; rows stream through in batches.
    """
    kind = dict(ops.dtypes)["amount"]
    value_type = next(iter(states.values())).value_type
    rows = ops.select(F.lit(1).alias("part"), "tid", "ord", "ns", "key", "amount", F.lit(None).cast(value_type).alias("value"))
    if start is not None:
        first = start.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("tid"), F.lit(None).cast(dict(ops.dtypes)["ord"]).alias("ord"), "ns", "key", F.lit(None).cast(kind).alias("amount"), F.col("value").cast(value_type))
        rows = rows.unionByName(first)
    functions = {ns: (fn.default, fn.py_apply, fn.py_invariant) for ns, fn in states.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], object] = {}
        tid, own, ok = None, {}, True
        out: list[tuple] = []

        def end() -> None:
            if tid is None:
                return
            if ok:
                held.update(own)
                out.extend((tid, True, ns, key, v) for (ns, key), v in own.items())
            else:
                out.append((tid, False, None, None, None))

        def given() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * 5
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names=["tid", "commit", "ns", "key", "value"])
            out.clear()
            return batch

        types = None
        for batch in batches:
            types = (pa.int64(), pa.bool_(), pa.string(), pa.string(), batch.schema.field("value").type)
            for part, t, ns, key, amount, value in zip(*(batch.column(c).to_pylist() for c in ("part", "tid", "ns", "key", "amount", "value"))):
                if part == 0:
                    held[ns, key] = value
                    continue
                if t != tid:
                    end()
                    tid, own, ok = t, {}, True
                if ok:
                    default, apply, invariant = functions[ns]
                    v = own[ns, key] if (ns, key) in own else held.get((ns, key), default)
                    v = apply(v, amount)
                    own[ns, key] = v
                    ok = invariant(v)
            yield given()
        if types:
            end()
            yield given()

    made = rows.repartition(1).sortWithinPartitions("part", "tid", "ord").mapInArrow(run, f"tid long, commit boolean, ns string, key string, value {value_type}")
    made = stored(made, "serial")
    votes = made.select("tid", F.when(F.col("commit"), COMMIT).otherwise(ABORT).alias("vote")).distinct()
    return Outcome(votes, made.where("commit").select("ns", "key", "tid", "value"))


def execute(ops: DataFrame, states: dict[str, StateFunction], config: TxConfig = TxConfig(), start: DataFrame | None = None, how: str = "auto") -> Outcome:
    """Run ops by the way that fits: additive states in order up to ``serial_limit`` operations and in rounds beyond,
    other states in order. The way never changes the outcome.

    ``how``: ``serial``, ``rounds`` (whatever the size), ``groups`` (no rounds: groups of transactions that share
    keys, each in order). A pessimistic strategy runs groups, as locks on keys would order transactions.
    """
    if not all(fn.additive for fn in states.values()):
        if how not in ("auto", "serial"):
            raise ValueError(f"{how} need additive states")
        return serial(ops, states, start)
    exact = {ns: fn.in_units() for ns, fn in states.items()}
    units = ops.withColumn("amount", _by_state(states, lambda f: f.units(f.amount(F.col("amount")))))
    if start is not None:
        start = start.select(*_KEY, _by_state(states, lambda f: f.units(F.col("value"))).alias("value"))
    if how == "auto" and config.strategy == PESSIMISTIC:
        how = "groups"
    if how == "auto":
        how = "rounds" if ops.limit(config.serial_limit + 1).count() > config.serial_limit else "serial"
    if how == "groups":
        done = rounds(units, exact, 0, start=start, least=2.0)
    else:
        done = rounds(units, exact, config.rest_limit, start=start) if how == "rounds" else serial(units, exact, start)
    size = _by_state(states, lambda f: F.lit(float(10**f.scale)))
    return Outcome(done.votes, done.writes.withColumn("value", F.col("value") / size), done.rounds)


def keyed_folds(ops: DataFrame, fn: StateFunction, elem: str = "amount", start: DataFrame | None = None) -> DataFrame:
    """tid, ord, ns, key, vote, value: transactions of one operation each; value is the key's after the operation.

    Every key folds its own operations in order, all keys in parallel.
    """
    ops = ops.select("tid", "ord", *_KEY, F.col(elem).alias("e"))
    own, first = fn, fn.default_column()
    if start is not None:
        ops = ops.join(start.select(*_KEY, F.col("value").alias("held")), list(_KEY), "left")
        first = F.coalesce(F.col("held"), first)
    if fn.additive:
        own, first, ops = fn.in_units(), fn.units(first), ops.withColumn("e", fn.units(fn.amount(F.col("e"))))
    apply, holds = own.py_apply, own.py_invariant

    def step(value, row: dict) -> tuple:
        new = apply(value, row["e"])
        ok = bool(holds(new))
        return (new if ok else value), ok

    found = folded(ops, _KEY, ("tid", "ord"), first, own.value_type, step, ("tid", "ord"))
    value = F.col("value") / float(10**fn.scale) if fn.additive else F.col("value")
    return found.select("tid", "ord", *_KEY, F.when(F.col("ok"), COMMIT).otherwise(ABORT).alias("vote"), value.alias("value"))


def free_writes(ops: DataFrame, states: dict[str, StateFunction], start: DataFrame | None = None) -> DataFrame:
    """ns, key, tid, value after each transaction, for states without an invariant; any number of keys a transaction."""
    out = None
    for ns, fn in states.items():
        own = keyed_folds(ops.where(F.col("ns") == ns), fn, start=None if start is None else start.where(F.col("ns") == ns))
        own = own.groupBy(*_KEY, "tid").agg(F.max_by("value", "ord").alias("value"))
        out = own if out is None else out.unionByName(own)
    return out


def conflict_ranks(ops: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """tid, ns, key, position: the place of a transaction in its key's lock queue; its greatest is its dependency depth's floor."""
    rows = ops.select("tid", *_KEY).distinct().withColumn("chunk", _chunk(chunk))
    return _sums_before(rows, {"position": F.lit(1)}).withColumn("position", (F.col("position") + 1).cast("int")).drop("chunk")


def dependencies(ops: DataFrame) -> DataFrame:
    """tid, depends_on: the transactions right before it in the queues of its keys, which decide before it can."""
    queue = Window.partitionBy(*_KEY).orderBy("tid")
    pairs = ops.select("tid", *_KEY).distinct().withColumn("blocker", F.lag("tid").over(queue)).where("blocker is not null")
    return pairs.groupBy("tid").agg(F.array_sort(F.collect_set("blocker")).alias("depends_on"))

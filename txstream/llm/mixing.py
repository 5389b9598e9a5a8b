"""Mixing sources to target weights by Poisson replication; DataFrame functions alone.

Source s gets the mean repetition rate r = weight x total size / size of s, so that the expected sizes of the sources in
the mix are in the ratio of the weights, and the whole keeps its size. A document's copies are the Poisson(r) quantile of
a number in (0, 1) that is hashed from the seed and its id: the same on every run, whatever the partitions. The copies
are exploded and ordered by a hashed key, which shuffles them globally.

Sizes are characters (``length(text)``). The default weights are the source shares to the power ``TEMPER``, normalised:
large sources are thinned and small ones repeated. Rates above ``STEP`` are taken as sums of independent draws at a rate
of at most ``STEP`` each, which keeps exp(-r) and the table of the inverse exact.

Defined cases: a null source is a source of its own; a null or empty text has size 0; a source of size 0 has the rate 1;
a source without a given weight has the rate 0; very long texts count with their whole length; rows that share an id get
the same copies, and copies with equal keys stand in any order; null ids count as the text 'null'; an empty table gives
none; all columns of the table are kept under their names, and a column that is added gets underscores behind its own
where the table has one of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored

TEMPER = 0.5
SEED = 17
STEP = 8.0
#: Terms of the inverse at a rate of STEP or less: the tail beyond is under 1e-13, below the hash's own grain of 2**-48.
TERMS = 48
#: Sources up to so many are broadcast (some 450 bytes each, so 25 MB at most); more are joined by shuffle, each in SALTS
#: parts, so that a large source isn't one task.
FEW_SOURCES, SALTS = 50_000, 64
_RATE, _SOURCE, _DRAWS, _TABLE = "__mix_rate", "__mix_source", "__mix_draws", "__mix_table"
_COPIES, _REPLICA, _KEY, _SALT = "__mix_copies", "__mix_replica", "__mix_key", "__mix_salt"


def unit(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the seed and the parts: 48 bits and a half."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def cumulated(rate: Column, terms: int = TERMS) -> Column:
    """P(Poisson(rate) <= k) for k from 0 to terms - 1: the table that inverts the distribution."""
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("all"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * rate / i
        return F.struct(p.alias("p"), (s["sum"] + p).alias("sum"), F.concat(s["all"], F.array(s["sum"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(terms - 1)), start, step, lambda s: s["all"])


def copies(doc_id: Column, draws: Column, table: Column, seed: int = SEED) -> Column:
    """The sum of ``draws`` Poisson quantiles: each the number of k whose cumulated probability is below a hashed number."""
    name = F.coalesce(doc_id.cast("string"), F.lit("null"))
    numbers = F.transform(F.sequence(F.lit(1), draws), lambda i: unit(seed, name, i))
    return F.aggregate(numbers, F.lit(0), lambda total, u: total + F.size(F.filter(table, lambda x: x < u)))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temper: float = TEMPER) -> DataFrame:
    """source, rate: the mean repetitions of each source. One aggregate with partial sums before its shuffle.

    The sources' sizes are written, a row each; only their two totals reach the driver.
    """
    sizes = docs.groupBy(F.col("source").alias(_SOURCE)).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("double")).alias("size"))
    if weights is None:
        wish = F.pow("size", F.lit(temper))
    else:
        wish = F.lit(0.0)
        for name, weight in weights.items():
            wish = F.when(F.col(_SOURCE).eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(wish)
    wanted = stored(sizes.withColumn("wish", F.when(F.col("size") > 0, wish).otherwise(0.0)), "sources")
    wishes, total = wanted.agg(F.coalesce(F.sum("wish"), F.lit(0.0)), F.coalesce(F.sum("size"), F.lit(0.0))).first()
    rate = F.round(F.col("wish") / F.lit(wishes) * F.lit(total) / F.col("size"), 9) if wishes > 0 else F.lit(1.0)
    return wanted.select(_SOURCE, F.when(F.col("size") > 0, rate).otherwise(1.0).alias(_RATE))


def counted(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = SEED, temper: float = TEMPER) -> DataFrame:
    """All rows of docs with ``__mix_rate`` and ``__mix_copies`` (or these names with underscores behind them)."""
    source, salt, draws, inverse, rate, copied = (free_name(n, docs.columns) for n in (_SOURCE, _SALT, _DRAWS, _TABLE, _RATE, _COPIES))
    table = rates(docs, weights, temper).withColumn(_DRAWS, F.greatest(F.lit(1), F.ceil(F.col(_RATE) / STEP).cast("int")))
    table = table.withColumn(_TABLE, cumulated(F.col(_RATE) / F.col(_DRAWS)))
    table = table.select(F.col(_SOURCE).alias(source), F.col(_RATE).alias(rate), F.col(_DRAWS).alias(draws), F.col(_TABLE).alias(inverse))
    same = docs["source"].eqNullSafe(table[source])
    if table.select(source).limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        joined = docs.join(F.broadcast(table), same)
    else:
        spread = docs.withColumn(salt, F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)))
        many = table.withColumn("salt_of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = spread.join(many, spread["source"].eqNullSafe(many[source]) & (spread[salt] == many["salt_of"])).drop(spread[salt], many["salt_of"])
    return joined.withColumn(copied, copies(F.col("doc_id"), F.col(draws), F.col(inverse), seed)).drop(source, draws, inverse)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = SEED, temper: float = TEMPER, details: bool = True) -> DataFrame:
    """The mix, shuffled: docs' columns and, with details, mix_rate, mix_copies, mix_replica (from 1) and mix_key.

    A hash of the hashed key deals each copy into a partition and the key orders it there: one shuffle, no sampling pass.
    """
    made = counted(docs, weights, seed, temper)
    rate, copied, replica, key = (free_name(n, docs.columns) for n in (_RATE, _COPIES, _REPLICA, _KEY))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    order = F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed} order"), name, F.col(replica).cast("string")).cast("binary")), 1, 16)
    many = F.when(F.col(copied) > 0, F.sequence(F.lit(1), F.col(copied))).otherwise(F.array().cast("array<int>"))
    spread = made.withColumn(replica, F.explode(many)).withColumn(key, order)
    spread = spread.repartition(key).sortWithinPartitions(key, replica)
    if not details:
        return spread.select(docs.columns)
    shown = [F.col(have).alias(free_name(wanted, docs.columns)) for have, wanted in zip((rate, copied, replica, key), ("mix_rate", "mix_copies", "mix_replica", "mix_key"))]
    return spread.select(*docs.columns, *shown)


#: The same rows in DuckDB: production parameters.
SQL = f"""
WITH sizes AS (
  SELECT source, sum(coalesce(length(text), 0)::DOUBLE) AS size FROM documents GROUP BY source
), wanted AS (
  SELECT *, CASE WHEN size > 0 THEN pow(size, {TEMPER}) ELSE 0.0 END AS wish FROM sizes
), rates AS (
  SELECT source, CASE WHEN size > 0 THEN round(wish / (SELECT sum(wish) FROM wanted) * (SELECT sum(size) FROM wanted) / size, 9) ELSE 1.0 END AS rate
  FROM wanted
), parted AS (
  SELECT source, rate, greatest(1, ceil(rate / {STEP}))::INTEGER AS draws, rate / greatest(1, ceil(rate / {STEP}))::INTEGER AS part FROM rates
), terms AS (
  SELECT source, k, exp(-part) * coalesce(list_product([part / i for i in range(1, k + 1)]), 1) AS p FROM parted, range(0, {TERMS}) AS t(k)
), cumulated AS (
  SELECT source, list(c ORDER BY k) AS cdf
  FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms) GROUP BY source
), drawn AS (
  SELECT d.*, r.rate, list_sum([
      len(list_filter(c.cdf, lambda x: x < (('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || i), 1, 12))::BIGINT + 0.5) / {float(1 << 48)}))
      for i in range(1, r.draws + 1)])::INTEGER AS copies
  FROM documents d JOIN parted r ON d.source IS NOT DISTINCT FROM r.source JOIN cumulated c ON d.source IS NOT DISTINCT FROM c.source
)
SELECT doc_id, text, lang, source, n_chars, rate AS mix_rate, copies AS mix_copies, replica::INTEGER AS mix_replica,
       substr(md5('{SEED} order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || replica), 1, 16) AS mix_key
FROM drawn, unnest(range(1, copies + 1)) AS t(replica)
"""

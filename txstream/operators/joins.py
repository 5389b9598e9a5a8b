"""Joins that hold when a key has a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than one in so many of all rows; so fewer keys than this are hot, and these can be broadcast.
SHARE = 1_000
#: A table of so many rows, or fewer, is broadcast whole.
FEW = 1 << 14
#: Bits for each key of a sieve, and the most words of 64 bits that one has (some 30 bytes each where it is broadcast).
BITS, WORDS = 16, 1 << 18


def looked_up(rows: DataFrame, table: DataFrame, key: str, n: str = "n", how: str = "left") -> DataFrame:
    """rows with the columns of ``table``, which has one short row for a key and counts in ``n`` the rows that have it.

    A table of up to FEW rows is broadcast. Of a larger one, rows of hot keys are joined where they are, with fewer than
    SHARE rows of the table; the rest is shuffled, no key with more than its SHARE-th part. Rows whose key is null or not
    in the table get nulls (``how``: left) or go (inner). Both inputs are read several times. ``n`` isn't given on.
    """
    total, most, size = table.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0)), F.count("*")).first()
    if size <= FEW:
        return rows.join(F.broadcast(table.drop(n)), key, how)
    known = rows.where(F.col(key).isNotNull())  # an outer join would bring all nulls together
    if most * SHARE <= total:
        out = known.join(table.drop(n), key, how)
    else:
        hot = F.col(n) * SHARE > total
        few, many = table.where(hot).drop(n), table.where(~hot).drop(n)
        out = known.join(F.broadcast(few), key).unionByName(known.join(F.broadcast(few.select(key)), key, "left_anti").join(many, key, how))
    return out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else out


def sifted(rows: DataFrame, table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """rows in two parts: those that may have their key in ``table``, and those that haven't, whose key may be null.

    The keys' hashes are set in a bitmap of bounded size, which is broadcast in words. Of rows whose key isn't in the table
    about one in ``BITS`` is in the first part nevertheless, more where the bitmap is at its greatest size. So what has to
    be shuffled to the table's rows is little more than what finds one. Both inputs are read several times.
    """
    n = table.count()
    words = min(WORDS, max(1, n * BITS // 64))
    hashed = F.xxhash64(F.col(key).cast(table.schema[key].dataType))
    place, bit = F.pmod(hashed, F.lit(words).cast("long")), F.pmod(F.shiftrightunsigned(hashed, 40), F.lit(64)).cast("int")
    word, mask = "__word", "__mask"
    while {word, mask} & {c.lower() for c in rows.columns}:
        word, mask = f"{word}_", f"{mask}_"
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    sieve = table.where(F.col(key).isNotNull()).select(place.alias(word), one.alias(mask)).groupBy(word).agg(F.bit_or(mask).alias(mask))
    seen = rows.withColumn(word, place).join(F.broadcast(sieve), word, "left")
    hit = F.coalesce(F.col(mask).isNotNull() & F.col(key).isNotNull() & (F.getbit(mask, bit) == 1), F.lit(False))
    return seen.where(hit).drop(word, mask), seen.where(~hit).drop(word, mask)

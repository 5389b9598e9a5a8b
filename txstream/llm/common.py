"""What the operators of this subpackage share: tables in the cluster's shared folder, bounded label samples, the memory of
Python workers, words and hashes.

Words are the runs of ``[^\\x20\\x09-\\x0D]+``; on UTF-8 bytes that is exactly ``bytes.split()``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import released, removed, scratch, shared_dir, stored  # noqa: F401


# ---------------------------------------------------------------- tables
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo: how the contracts deal rows into folds. A null id gives null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def fold(column: str, modulus: int, remainder: int):
    """True for rows of the held-out fold; rows with a null id are outside it."""
    return F.coalesce(crc_mod(column, modulus) == remainder, F.lit(False))


def with_fields(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator reads, whatever else the table carries."""
    return df.select(*[F.col(c) for c in columns])


def smallest_hashes(rows: DataFrame, key: str, n: int) -> DataFrame:
    """A bounded sample: the ``n`` rows whose md5 of the key is smallest; the same rows whatever the partitions."""
    return rows.orderBy(F.md5(F.col(key).cast("string")), F.col(key)).limit(n)


def free_name(name: str, columns: list[str]) -> str:
    """The name, with underscores behind it until no column has it (whatever the case of its letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def carried(docs: DataFrame, carry: tuple[str, ...], own: list) -> tuple[DataFrame, list[int]]:
    """``own`` columns, the text the last of them, and those named in ``carry`` as carry_0, ...; where each of these is.

    A carried text is the text that is judged already, so a batch holds it once.
    """
    same = [c == "text" and dict(docs.dtypes)[c] == "string" for c in carry]
    more = [F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry) if not same[k]]
    others = iter(range(len(own), len(own) + len(more)))
    return docs.select(*own, *more), [len(own) - 1 if s else next(others) for s in same]


# ---------------------------------------------------------------- memory of Python workers
#: Rows that a Python worker holds at once as objects, texts and results; a batch of Spark's has up to 10,000.
ROWS = 1_000
_holders: dict[str, Callable[[], None]] = {}


def holds(name: str, release: Callable[[], None]) -> None:
    """What ``release`` frees is kept between the tasks of those operators alone that begin under this name."""
    _holders[name] = release


def begun(name: str | None) -> None:
    """Let go of what other operators keep in this process: a worker serves one stage after another, as long as it lives."""
    for other, release in _holders.items():
        if other != name:
            release()
    trimmed()


def trimmed() -> None:
    """Give freed memory back to the system: Arrow's, and what small objects leave between others."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], name: str | None = None):
    """``run`` on ROWS rows at a time, beside what is kept under ``name`` alone."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun(name)
        yield from run(slices(batches))
        trimmed()

    return task


# ---------------------------------------------------------------- words and hashes
#: A word cache stops taking new words here (some 20 MB); words beyond it are hashed each time.
CACHE_WORDS = 100_000
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class WordHash(dict):
    """word (bytes) -> 64-bit hash, computed once for frequent words."""

    def __missing__(self, word: bytes) -> int:
        value = self.value(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value

    def value(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(word)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(32))) * M1
    return x ^ (x >> np.uint64(29))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` values; one of the whole sequence where it is shorter; none where it is empty."""
    n = len(hashes)
    size = min(size, n)
    if not size:
        return hashes[:0]
    out = np.full(n - size + 1, np.uint64(size) * M3, dtype=np.uint64)
    for k in range(size):
        out = mixed(out * M2 + hashes[k : n - size + 1 + k])
    return out


def utf8(value: str | None) -> bytes:
    return b"" if value is None else value.encode("utf-8")


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without a decoded copy."""
    return column.cast(pa.large_binary()).to_pylist()

"""Batches that count once: folders of Parquet files, published by a rename and folded into bases.

``open/<name>`` are published batches; ``bases/<number>`` hold what was folded before (``rows``) and the names of the
batches in it (``names``). Whatever is being written lies in ``writing``. A batch or base is there whole or not at all; a
batch whose name a base has doesn't count beside it. So a batch counts once, however often it is published, and a crash
at any point leaves the same rows to be read.

Every reading lists the open batches before the newest base: a batch that a fold takes away in between is in that base.
Names of folded batches stay a table; the driver sees those of open batches alone. Renames must be atomic, as HDFS and
local file systems have them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filesystem

_NAMES = "name string"


class Batches:
    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _at(self, name: str):
        return filesystem(self.spark, f"{self.path}/{name}")

    def _whole(self, folder: str) -> list[str]:
        """The complete entries of a folder."""
        fs, at = self._at(folder)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n for n in names if fs.exists(self._at(f"{folder}/{n}/_SUCCESS")[1]))

    def _folded(self, base: str | None) -> DataFrame:
        return self.spark.read.schema(_NAMES).parquet(f"{self.path}/bases/{base}/names") if base else self.spark.createDataFrame([], _NAMES)

    def _listed(self) -> tuple[list[str], str | None, list[str]]:
        names, bases = self._whole("open"), self._whole("bases")
        base, folded = bases[-1] if bases else None, set()
        if base and names:
            folded = {r.name for r in self._folded(base).where(F.col("name").isin(names)).collect()}  # of the open ones
        return [n for n in names if n not in folded], base, sorted(folded)

    def listed(self) -> tuple[list[str], str | None]:
        """The batches that are open, and the newest base: together they are all that counts."""
        return self._listed()[:2]

    def _published(self, aside: str, target: str) -> bool:
        fs, source = self._at(aside)
        _, to = self._at(target)
        fs.mkdirs(to.getParent())
        if not fs.exists(to) and fs.rename(source, to):
            if not fs.exists(self._at(f"{target}/{source.getName()}")[1]):
                return True
            fs.delete(self._at(f"{target}/{source.getName()}")[1], True)  # another attempt was first, and this one landed inside it
        fs.delete(source, True)
        return False

    def has(self, name: str) -> bool:
        names, base = self.listed()
        return name in names or not self._folded(base).where(F.col("name") == name).isEmpty()

    def names(self) -> DataFrame:
        """name of every batch that counts."""
        names, base = self.listed()
        return self._folded(base).union(self.spark.createDataFrame([(n,) for n in names], _NAMES))

    def publish(self, name: str, rows: DataFrame | Callable[[], DataFrame]) -> bool:
        """Add a batch; False, with nothing done, if one of that name counts already."""
        if not re.fullmatch(r"[\w.-]+", name):
            raise ValueError("a batch is named by letters, digits, dots and dashes")
        if self.has(name):
            return False
        aside = f"writing/{uuid.uuid4().hex}"
        rows = rows() if callable(rows) else rows
        rows.write.parquet(f"{self.path}/{aside}")
        return self._published(aside, f"open/{name}")

    def _read(self, names: list[str], base: str | None) -> DataFrame:
        paths = [f"{self.path}/open/{n}" for n in names] + ([f"{self.path}/bases/{base}/rows"] if base else [])
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        """The rows of all batches, as far as folds have left them."""
        return self._read(*self.listed())

    def fold(self, transform: Callable[[DataFrame], DataFrame], *also: str) -> bool:
        """Replace all that counts by what ``transform`` makes of it, as a new base; False if another fold was first.

        ``also`` names batches that count as published from now on. What comes in meanwhile stays open. Folded batches and
        the base before stay until the next fold, for readers that have listed them.
        """
        names, base, folded = self._listed()
        if not names and not also and base is None:
            return True
        aside, number = f"writing/{uuid.uuid4().hex}", f"{int(base or 0) + 1:010d}"
        transform(self._read(names, base)).write.parquet(f"{self.path}/{aside}/rows")
        new = self.spark.createDataFrame([(n,) for n in (*names, *also)], _NAMES)
        self._folded(base).union(new).distinct().write.parquet(f"{self.path}/{aside}/names")
        fs, mark = self._at(f"{aside}/_SUCCESS")
        fs.create(mark).close()
        if not self._published(aside, f"bases/{number}"):
            return False
        for n in folded:
            fs.delete(self._at(f"open/{n}")[1], True)
        for old in self._whole("bases"):
            if int(old) < int(number) - 1:
                fs.delete(self._at(f"bases/{old}")[1], True)
        return True

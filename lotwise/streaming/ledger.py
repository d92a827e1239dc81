"""What a stream keeps: a folder for each batch, replaced as a whole, and a base that takes them in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.sources.storage import file_system

#: Batches that are taken into a new base together.
EVERY = 16


def newest(*keys: str) -> Callable[[DataFrame], DataFrame]:
    """Of the rows of a key those of the latest batch count."""

    def fold(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
        return rows.withColumn("place", place).where(F.col("place") == 1).drop("place", "batch")

    return fold


def summed(*keys: str, value: str) -> Callable[[DataFrame], DataFrame]:
    """The rows of a key add up, in the value's own decimal type."""

    def fold(rows: DataFrame) -> DataFrame:
        kind = rows.schema[value].dataType
        return rows.groupBy(*keys).agg(F.sum(value).cast(kind).alias(value))

    return fold


class Ledger:
    """A table that a stream changes batch by batch.

    ``put`` writes a batch's rows to a folder of its number; done again, after a failure, it replaces that
    folder or, where the base has the batch already, does nothing. So each batch counts once. ``state``
    folds the base and the batches behind it. ``compact`` writes a new base every ``every`` batches
    and deletes what was there before the base it replaces: readers of that one have time until the
    next, and there are never more than 2 bases and 2 * every batches. A folder counts once it is
    whole (has its _SUCCESS).

    Where ``final`` is given (rows to a condition, that no later batch changes a row), compaction puts such
    rows into a folder of their own, once, and the base keeps the others: it stays as small as what
    can still change, however long the history is."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, fold: Callable[[DataFrame], DataFrame], every: int = EVERY, final: Callable[[DataFrame], Column] | None = None):
        self.spark, self.folder, self.schema, self.fold, self.every, self.final = spark, folder.rstrip("/"), schema, fold, every, final

    def numbers(self, kind: str) -> list[int]:
        """Whole folders of a kind, base or batch, by number."""
        path, system = file_system(self.spark, self.folder)
        if not system.exists(path):
            return []
        names = [s.getPath().getName() for s in system.listStatus(path)]
        # final rows are whole where there is a base of their number
        whole = [n for n in names if n.startswith(f"{kind}=") and (kind == "final" or system.exists(file_system(self.spark, f"{self.folder}/{n}/_SUCCESS")[0]))]
        return sorted(int(n.partition("=")[2]) for n in whole)

    def base(self) -> int:
        return max(self.numbers("base"), default=-1)

    def put(self, rows: DataFrame, number: int) -> None:
        if number > self.base():
            self._write(rows, "batch", number)

    def batch(self, number: int) -> DataFrame:
        """The rows of one batch."""
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/batch={number}")

    def paths(self, before: int | None = None) -> list[str]:
        """The folders that make up the state, or that before a batch."""
        limit = float("inf") if before is None else before
        base = max((n for n in self.numbers("base") if n < limit), default=-1)
        return [f"{self.folder}/base={base}"] * (base >= 0) + [f"{self.folder}/batch={n}" for n in self.numbers("batch") if base < n < limit]

    def _read(self, paths: list[str]) -> DataFrame:
        schema = f"{self.schema}, batch long"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def changing(self, before: int | None = None) -> DataFrame:
        """The state without the rows that were final at the last compaction."""
        return self.fold(self._read(self.paths(before)))

    def state(self, before: int | None = None) -> DataFrame:
        rows = self.changing(before)
        base = max((n for n in self.numbers("base") if before is None or n < before), default=-1) if self.final else -1
        closed = [f"{self.folder}/final={n}" for n in self.numbers("final") if n <= base] if self.final else []
        return rows.unionByName(self._read(closed).drop("batch")) if closed else rows

    def _write(self, rows: DataFrame, kind: str, number: int) -> None:
        rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/{kind}={number}")

    def compact(self, number: int) -> bool:
        """A new base after batch ``number`` if there are ``every`` batches behind the present one."""
        before = self.base()
        if number - before < self.every:
            return False
        rows = self.changing(number + 1)
        if self.final:
            done = F.coalesce(self.final(rows), F.lit(False))
            self._write(rows.where(done), "final", number)
            rows = rows.where(~done)
        self._write(rows, "base", number)
        old = [("base", n) for n in self.numbers("base") if n < before] + [("batch", n) for n in self.numbers("batch") if n <= before]
        for kind, n in old:
            path, system = file_system(self.spark, f"{self.folder}/{kind}={n}")
            system.delete(path, True)
        return True

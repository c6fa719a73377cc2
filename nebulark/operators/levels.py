"""A table that takes batches and deletions for long: parts in levels of doubling size, merged when two meet in a level.

A row is rewritten once a level, so some log2(rows / least) times, and a reader opens at most a part a level.
Deletions are tables of ids that strike rows of earlier batches only; a merge leaves out the rows they strike,
and one that no part needs any more is forgotten.  Each change is a new version of a list of parts,
written last and whole: a reader sees the list before or after it, and a change that fails leaves nothing behind but
folders that no list names (see :meth:`Levels.expire`).
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a part of level 0, at most.
LEAST = 100_000
_LIST = "name string, deletion boolean, rows long, applied long"


@dataclass(frozen=True)
class Part:
    """Rows, or deleted ids; no deletion up to change number ``applied`` strikes its rows any more."""

    name: str
    deletion: bool
    rows: int
    applied: int


class Levels:
    """The table in folder ``path``; rows are known by ``key``.  One writer at a time: a second one's change is refused."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", least: int = LEAST) -> None:
        self.spark, self.path, self.key, self.least = spark, path.rstrip("/"), key, least

    def _fs(self, folder: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(folder)
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def version(self) -> int:
        """The number of the last change, 0 before the first."""
        done = []
        for name in self._names("lists"):
            fs, at = self._fs(f"lists/{name}/_SUCCESS")
            if fs.exists(at):
                done.append(int(name))
        return max(done, default=0)

    def parts(self, version: int | None = None) -> list[Part]:
        version = self.version() if version is None else version
        rows = self.spark.read.schema(_LIST).parquet(f"{self.path}/lists/{version}").collect() if version else []  # a row a part
        return sorted((Part(**r.asDict()) for r in rows), key=lambda p: p.name)

    def level(self, part: Part) -> int:
        return max(0, math.ceil(math.log2(max(1, part.rows) / self.least)))

    def _write(self, rows: DataFrame, number: int, deletion: bool) -> Part:
        name = f"{number}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/parts/{name}")
        return Part(name, deletion, self._open(name).count(), number)

    def _open(self, *names: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/parts/{n}" for n in names])

    def _commit(self, number: int, parts: list[Part]) -> None:
        needed = min((p.applied for p in parts if not p.deletion), default=number)
        parts = [p for p in parts if p.rows and (not p.deletion or p.applied > needed)]
        rows = [(p.name, p.deletion, p.rows, p.applied) for p in parts]
        self.spark.createDataFrame(rows, _LIST).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/lists/{number}")

    def _alive(self, rows: list[Part], deletions: list[Part]) -> DataFrame:
        table = self._open(*[p.name for p in rows])
        deletions = [p for p in deletions if any(p.applied > r.applied for r in rows)]
        if not deletions:
            return table
        gone = self._open(*[p.name for p in deletions]).groupBy("__gone").agg(F.max("__number").alias("__number"))
        return table.join(gone, (F.col(self.key) == F.col("__gone")) & (F.col("__change") < F.col("__number")), "left_anti")

    def _merged(self, number: int, parts: list[Part]) -> list[Part]:
        """Merge parts until no two share a level."""
        while True:
            deletions, by_level = [p for p in parts if p.deletion], {}
            for p in parts:
                if not p.deletion:
                    by_level.setdefault(self.level(p), []).append(p)
            full = next((v for _, v in sorted(by_level.items()) if len(v) > 1), None)
            if full is None:
                return parts
            one = self._write(self._alive(full, deletions), number, False)
            parts = [p for p in parts if p not in full] + [one]

    def _deletion(self, ids: DataFrame, number: int) -> Part:
        gone = ids.select(F.col(self.key).alias("__gone")).where("__gone is not null").distinct()
        return self._write(gone.withColumn("__number", F.lit(number).cast("long")), number, True)

    def _next(self) -> tuple[int, list[Part]]:
        last = self.version()
        return last + 1, self.parts(last)

    def add(self, rows: DataFrame, instead: bool = False) -> None:
        """A batch of rows; with ``instead`` they take the place of earlier rows with their keys."""
        number, parts = self._next()
        new = self._write(rows.withColumn("__change", F.lit(number).cast("long")), number, False)
        if instead:
            parts.append(self._deletion(self._open(new.name), number))
        self._commit(number, self._merged(number, [*parts, new]))

    def delete(self, ids: DataFrame) -> None:
        """Strike the rows with these keys that are there now; rows added later stay.  Rows go from storage with the next merge."""
        number, parts = self._next()
        self._commit(number, [*parts, self._deletion(ids, number)])

    def compact(self) -> None:
        """One part, no deletions."""
        number, parts = self._next()
        rows, deletions = [p for p in parts if not p.deletion], [p for p in parts if p.deletion]
        if len(rows) > 1 or deletions:
            self._commit(number, [self._write(self._alive(rows, deletions), number, False)] if rows else [])

    def read(self) -> DataFrame:
        """The rows that are not struck; ValueError if no row was ever added."""
        parts = self.parts()
        rows = [p for p in parts if not p.deletion]
        if not rows:
            raise ValueError("the table has no rows")
        return self._alive(rows, [p for p in parts if p.deletion]).drop("__change")

    def expire(self) -> int:
        """Delete the folders that the last list does not name; how many there were.  No reader of an older list may be left."""
        named = {p.name for p in self.parts()}
        gone = [n for n in self._names("parts") if n not in named]
        for name in gone:
            fs, at = self._fs(f"parts/{name}")
            fs.delete(at, True)
        return len(gone)

"""Exact search of a saved inverted file: cells are read, nearest bound first, until a stop condition holds.

A vector lies within its cell's radius of the centroid that is nearest to it, so a query at distance d of
that centroid has it no nearer than d - radius; and as no other centroid is nearer to the vector, no nearer
than the plane half-way between that centroid and the query's own.  The larger of the two bounds orders
a query's cells.  Rounds read the next cells, twice as many each time; what was found
gives the distance beyond which nothing can matter, and a query is done when its next cell's bound exceeds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nebulark.operators.neighbors import MET_TOGETHER, cell_radii, document_vectors, filed_vectors, in_meetings, load_centres
from nebulark.plans.work import cut


def _ranked(found: DataFrame) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id")))


def _least(d: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least distances, ties by ``order``."""
    if k < 1:
        return np.zeros(0, np.int64)
    near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if k < len(d) else np.arange(len(d))
    return near[np.lexsort((order[near], d[near]))[:k]]


@dataclass(frozen=True)
class Nearest:
    """The ``k`` nearest vectors."""

    k: int
    start = float("inf")

    def chosen(self, d: np.ndarray, order: np.ndarray, groups: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        """Of a meeting, the places of what may be in the answer, from a query's distances."""
        return _least(d, order, self.k)

    def kept(self, found: DataFrame) -> DataFrame:
        """What may still be in the answer."""
        return _ranked(found).where(F.col("rank") <= self.k).drop("rank")

    def limits(self, found: DataFrame) -> DataFrame:
        """(qid, limit): nothing farther can matter; a query without one needs more."""
        return found.groupBy("qid").agg(F.max("distance").alias("limit"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.k).drop("n")

    def answer(self, found: DataFrame) -> DataFrame:
        return _ranked(found).where(F.col("rank") <= self.k)


@dataclass(frozen=True)
class WithinDistance:
    """Vectors at distance <= ``eps``, at least ``least`` of them and at most ``most``."""

    eps: float
    least: int = 0
    most: int | None = None

    @property
    def start(self) -> float:
        """The limit of a query for which nothing was found yet."""
        return float("inf") if self.least else self.eps

    def chosen(self, d: np.ndarray, order: np.ndarray, groups: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        near = np.flatnonzero(d <= self.eps)
        if len(near) < self.least:
            return _least(d, order, self.least)
        return near if self.most is None else near[_least(d[near], order[near], max(self.least, self.most))]

    def kept(self, found: DataFrame) -> DataFrame:
        ranked = _ranked(found)
        ranked = ranked.where((F.col("distance") <= self.eps) | (F.col("rank") <= self.least))
        return (ranked if self.most is None else ranked.where(F.col("rank") <= self.most)).drop("rank")

    def limits(self, found: DataFrame) -> DataFrame:
        enough = found.groupBy("qid").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.least)
        full = F.lit(False) if self.most is None else F.col("n") >= self.most
        return enough.select("qid", F.when(full, F.col("far")).otherwise(F.greatest("far", F.lit(self.eps))).alias("limit"))

    def answer(self, found: DataFrame) -> DataFrame:
        return _ranked(self.kept(found))


@dataclass(frozen=True)
class NearestDocuments:
    """The nearest vector of each of the ``documents`` nearest documents; a document is as near as its nearest vector."""

    documents: int
    doc: str = "label"
    start = float("inf")

    def chosen(self, d: np.ndarray, order: np.ndarray, groups: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        by, first = groups
        ranked = d[by]
        least = np.repeat(np.minimum.reduceat(ranked, first), np.diff(np.append(first, len(by))))
        own = np.flatnonzero(ranked == least)  # by document, then id: the first of each document is its nearest
        one = by[own[np.unique(np.searchsorted(first, own, "right"), return_index=True)[1]]]
        return one[_least(d[one], order[one], self.documents)]

    def kept(self, found: DataFrame) -> DataFrame:
        own = Window.partitionBy("qid", self.doc).orderBy("distance", "id")
        first = found.withColumn("rank", F.row_number().over(own)).where("rank = 1")
        return _ranked(first).where(F.col("rank") <= self.documents).drop("rank")

    def limits(self, found: DataFrame) -> DataFrame:
        return Nearest(self.documents).limits(found)

    def answer(self, found: DataFrame) -> DataFrame:
        return _ranked(found)


def ordered_cells(queries: DataFrame, centres: np.ndarray, radii: np.ndarray, vector: str) -> DataFrame:
    """qid, q and order: the cells that hold vectors with the least squared distance that one may have, nearest first."""
    shared = queries.sparkSession.sparkContext.broadcast((centres, radii))  # a row a cell

    @F.pandas_udf("array<struct<bound:double,cell:int>>")
    def order(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        centres, radii = shared.value
        there = np.flatnonzero(radii >= 0)
        apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2)) if len(centres) <= 4096 else None
        for s in batches:
            out = []
            for v in s:
                d2 = ((centres - np.asarray(v, np.float64)) ** 2).sum(1)
                own = int(d2.argmin())
                gap = apart[own] if apart is not None else np.sqrt(((centres - centres[own]) ** 2).sum(1))
                plane = np.divide(d2 - d2[own], 2 * gap, out=np.zeros(len(d2)), where=gap > 0)
                low = np.maximum(np.maximum(np.sqrt(d2) - radii, plane), 0.0)[there] * (1 - 1e-9)
                at = np.lexsort((d2[there], low))
                out.append([(float(low[i]) ** 2, int(there[i])) for i in at])
            yield pd.Series(out)

    asked = queries.where(F.col(vector).isNotNull()).select(F.col("id").alias("qid"), F.col(vector).alias("q"))
    return asked.withColumn("order", order("q"))


def _meetings(probed: DataFrame, filed: DataFrame, stop: Nearest | WithinDistance | NearestDocuments, vector: str) -> DataFrame:
    """What a query's cells hold that may be in its answer; each task of a cell keeps only that."""
    doc = getattr(stop, "doc", None)
    columns = tuple(c for c in filed.columns if c not in ("cell", vector))

    def choose(q: pa.Table, v: pa.Table, d) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        order, groups = np.unique(v["id"].to_pandas(), return_inverse=True)[1], None
        if doc is not None:
            code = pd.factorize(v[doc].to_pandas(), use_na_sentinel=False)[0]
            by = np.lexsort((order, code))
            groups = by, np.flatnonzero(np.diff(code[by], prepend=-1))
        everything = np.arange(len(v))
        for i in range(0, len(q), MET_TOGETHER):
            some = np.arange(i, min(i + MET_TOGETHER, len(q)))
            rows = d(some, everything)
            places = [stop.chosen(row, order, groups) for row in rows]
            who, place = np.repeat(some, [len(p) for p in places]), np.concatenate(places)
            yield who, place, rows[who - i, place]

    sent = probed.select(F.col("cell").cast("int").alias("key"), "qid", F.col("q").alias("__q"))
    held = filed.select(F.col("cell").cast("int").alias("key"), *columns, F.col(vector).alias("__v"))
    return in_meetings(sent, held, choose, ("qid",), columns)


def search(spark: SparkSession, path: str, queries: DataFrame, stop: Nearest | WithinDistance | NearestDocuments, first: int = 2, vector: str = "embedding") -> DataFrame:
    """(qid, id, ..., distance, rank, cells_read): the exact answer of ``stop``, squared distances, ties to the smaller id.

    ``cells_read`` is the share of the cells that the query read.  Query ids must be unique.  A query
    without a vector has no rows; an empty index gives none.
    """
    centres = load_centres(spark, path)
    radii = cell_radii(spark, path, len(centres)) if len(centres) else np.zeros(0)
    filed = filed_vectors(spark, path).where(F.col("homes")[0] == F.col("cell")).drop("homes")
    waiting = cut(ordered_cells(queries, centres, radii, vector).withColumns({"at": F.lit(0), "limit": F.lit(stop.start)}))
    found, read, width = None, None, first
    while found is None or not waiting.isEmpty():
        step = F.filter(F.slice("order", F.col("at") + 1, F.lit(width)), lambda c: c["bound"] <= F.col("limit"))
        probed = waiting.select("qid", "q", F.explode(step).alias("c")).select("qid", "q", F.col("c.cell").alias("cell"))
        here = _meetings(cut(probed), filed, stop, vector)
        counts = waiting.select("qid", F.size(step).alias("cells"))
        found = cut(stop.kept(here if found is None else found.unionByName(here)))
        read = cut(counts if read is None else read.unionByName(counts).groupBy("qid").agg(F.sum("cells").cast("int").alias("cells")))
        limits = stop.limits(found).withColumnRenamed("limit", "__limit")
        waiting = waiting.withColumn("at", F.col("at") + F.lit(width)).where(F.size("order") > F.col("at")).join(limits, "qid", "left")
        waiting = waiting.withColumn("limit", F.coalesce("__limit", F.lit(stop.start))).drop("__limit")
        waiting = cut(waiting.where(F.col("order")[F.col("at")]["bound"] <= F.col("limit")))
        width *= 2
    share = read.select("qid", (F.col("cells") / F.lit(float(max(1, len(centres))))).alias("cells_read"))
    return stop.answer(found).join(share, "qid")


def documents(spark: SparkSession, path: str, queries: DataFrame, vectors: DataFrame, count: int, doc: str = "label", vector: str = "embedding") -> DataFrame:
    """All vectors of the ``count`` nearest documents of each query (see ``neighbors.in_documents``), found in an index that files ``doc`` along."""
    near = search(spark, path, queries, NearestDocuments(count, doc), vector=vector).select("qid", "id", doc, "distance")
    return document_vectors(near, queries, vectors, count, doc, vector)

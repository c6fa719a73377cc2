"""Sorts, ranks and offsets; ties break by id so that results are stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nebulark.functions import geometry as G
from nebulark.plans.work import cut


def by_key(df: DataFrame, key: str, ascending: bool = True, tie: str = "id") -> DataFrame:
    c = F.col(key)
    return df.orderBy(c.asc() if ascending else c.desc(), tie)


def by_axis(df: DataFrame, axis: int, position: str | None = None, tie: str = "id") -> DataFrame:
    """Sort points by one coordinate, a column of AXES or an element of an array column."""
    return df.orderBy(F.col(G.AXES[axis]) if position is None else F.element_at(position, axis + 1), tie)


def by_position(df: DataFrame) -> DataFrame:
    return df.orderBy(*G.AXES)


def top(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(k)


def numbered(df: DataFrame, key: Column, tie: str = "id", name: str = "position") -> DataFrame:
    """A global 0-based rank by ``key``, equal keys by ``tie``, without one task holding all rows.

    A range partitioning follows the data, however they are spread; ranks are taken inside its parts
    and shifted by the parts' offsets (a row a part, broadcast).
    """
    parts = df.withColumn("__key", key).repartitionByRange(F.col("__key").asc_nulls_first(), F.col(tie).asc_nulls_first())
    spread = cut(parts.withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__off"))
    within = Window.partitionBy("__part").orderBy(F.col("__key").asc_nulls_first(), F.col(tie).asc_nulls_first())
    return spread.join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__off") + F.row_number().over(within) - 1).cast("long")).drop("__part", "__off", "__key")


def cell_offsets(points: DataFrame, n: int) -> DataFrame:
    """(cell_id, n, start): counts of grid cells and their exclusive prefix sum.

    Slabs of cells are summed apart and shifted by the slabs' totals, n rows.
    """
    cells = points.groupBy(G.cell_id(n).alias("cell_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("slab", F.floor(F.col("cell_id") / F.lit(n * n)))
    slabs = cells.groupBy("slab").agg(F.sum("n").alias("t"))
    before = Window.orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    slabs = slabs.select("slab", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("slab").orderBy("cell_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return cells.join(F.broadcast(slabs), "slab").select("cell_id", "n", start.cast("long").alias("start"))


def cell_ranks(points: DataFrame, n: int) -> DataFrame:
    """id, cell_id and the 0-based rank of each point in its cell, by id."""
    marked = points.select("id", G.cell_id(n).alias("cell_id"))
    order = Window.partitionBy("cell_id").orderBy("id")
    return marked.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))

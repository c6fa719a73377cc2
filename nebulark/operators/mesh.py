"""Mass assignment: a stencil per axis, one explode to cells, summed by cell number.

A mesh is a sparse table (ix, iy, iz, val).  Partial aggregation sums a task's particles before the
shuffle, so what moves is bounded by cells, not by particles times stencil.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulark.plans.work import cut

AXES = ("x", "y", "z")
CELL = ["ix", "iy", "iz"]


def stencil(x: Column, n: int, scheme: str, centering: str = "node", periodic: bool = True) -> Column:
    """Array of (i, w): the cells of one axis that a position in [0, 1] touches, and their weights.

    ``node`` puts NGP, CIC and PCS weights around cell corners; ``cell`` around cell centres (NGP and
    CIC); TSC is the same in both.  Indices wrap, or leave the mesh unless ``periodic``.
    """
    s = x * F.lit(float(n))
    one = F.lit(1.0)
    if scheme == "ngp":
        parts = [(F.floor(s + (0.5 if centering == "node" else 0.0)), one)]
    elif scheme == "cic" and centering == "node":
        i, f = F.floor(s), s - F.floor(s)
        parts = [(i, one - f), (i + 1, f)]
    elif scheme == "cic":
        i = F.floor(s)
        d = s - F.lit(0.5) - i
        parts = [(i, one - F.abs(d)), (i + F.when(d > 0, 1).otherwise(-1), F.abs(d))]
    elif scheme == "tsc":
        t = s - F.lit(0.5)
        c = F.floor(t + F.lit(0.5))
        d = t - c
        a, b = F.lit(0.5) - d, F.lit(0.5) + d
        parts = [(c - 1, F.lit(0.5) * a * a), (c, F.lit(0.75) - d * d), (c + 1, F.lit(0.5) * b * b)]
    elif scheme == "pcs":
        i, u = F.floor(s), s - F.floor(s)
        v = one - u
        parts = [(i - 1, v * v * v / 6.0), (i, (F.lit(4.0) - 6.0 * u * u + 3.0 * u * u * u) / 6.0), (i + 1, (one + 3.0 * u + 3.0 * u * u - 3.0 * u * u * u) / 6.0), (i + 2, u * u * u / 6.0)]
    else:
        raise ValueError(f"no such scheme: {scheme}")
    at = lambda i: F.pmod(i.cast("long"), F.lit(n)).cast("int") if periodic else i.cast("int")
    return F.array(*[F.struct(at(i).alias("i"), w.alias("w")) for i, w in parts])


#: Cells of an axis that a scheme touches.
WIDTH = {"ngp": 1, "cic": 2, "tsc": 3, "pcs": 4}


def exploded(df: DataFrame, n: int, scheme: str, centering: str = "node", periodic: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each particle and cell it touches: cell (a long, see :func:`by_cell`), w and the ``keep`` columns.

    The three stencils are worked out once a particle; one explode of a constant array walks their product.
    """
    places = range(WIDTH.get(scheme, 0))
    product = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(AXES, o, strict=True)]) for o in itertools.product(places, places, places)])
    out = df.select(*keep, *[stencil(F.col(c), n, scheme, centering, periodic).alias(f"s{c}") for c in AXES]).withColumn("__o", F.explode(product))
    x, y, z = (F.col(f"s{c}")[F.col(f"__o.{c}")] for c in AXES)
    if not periodic:
        out = out.where(reduce(lambda a, b: a & b, [(s["i"] >= 0) & (s["i"] < n) for s in (x, y, z)]))
    cell = z["i"] + F.lit(n).cast("long") * (y["i"] + F.lit(n).cast("long") * x["i"])
    return out.select(cell.alias("cell"), (x["w"] * y["w"] * z["w"]).alias("w"), *keep)


def by_cell(rows: DataFrame, n: int, *sums: Column, keys: tuple[Column, ...] = ()) -> DataFrame:
    """Sums of exploded rows by cell: ix, iy, iz and the sums.  The key of the shuffle is one long."""
    table = rows.groupBy(*keys, "cell").agg(*sums)
    c, m = F.col("cell"), F.lit(n).cast("long")
    at = [F.expr(f"cell div {n * n}"), F.expr(f"cell div {n}") % m, c % m]
    return table.select(*[k for k in table.columns if k != "cell"][: len(keys)], *[v.cast("int").alias(k) for v, k in zip(at, CELL, strict=True)], *[k for k in table.columns if k != "cell"][len(keys) :])


def assign(df: DataFrame, n: int, scheme: str = "tsc", value: str | None = None, centering: str = "node", periodic: bool = True) -> DataFrame:
    """Sparse mesh (ix, iy, iz, val): the sum of weights, or of weights times ``value``."""
    rows = exploded(df, n, scheme, centering, periodic, (value,) if value else ())
    return by_cell(rows, n, F.sum(F.col("w") * F.col(value) if value else F.col("w")).alias("val"))


def all_cells(spark: SparkSession, n: int) -> DataFrame:
    c = F.col("id")
    return spark.range(n**3).select(F.floor(c / F.lit(n * n)).cast("int").alias("ix"), (F.floor(c / F.lit(n)) % n).cast("int").alias("iy"), (c % n).cast("int").alias("iz"))


def dense(mesh: DataFrame, n: int, value: str = "val") -> DataFrame:
    """Every cell, 0 where the sparse mesh has none."""
    return all_cells(mesh.sparkSession, n).join(mesh, CELL, "left").select(*CELL, F.coalesce(value, F.lit(0.0)).alias(value))


def contrast(mesh: DataFrame, n: int) -> DataFrame:
    """delta = val / mean - 1 on every cell; 0 on an empty mesh.

    The mesh is written once, n^3 rows at most: its mean and its cells come from one scatter.
    """
    mesh = cut(mesh)
    mean = mesh.agg((F.sum("val") / F.lit(float(n**3))).alias("mean"))
    cells = dense(mesh, n).crossJoin(F.broadcast(mean))  # one row
    return cells.select(*CELL, F.when(F.col("mean") != 0, F.col("val") / F.col("mean") - F.lit(1.0)).otherwise(F.lit(0.0)).alias("val"))


def minmax(mesh: DataFrame, n: int) -> DataFrame:
    return dense(mesh, n).agg(F.min("val").alias("low"), F.max("val").alias("high"))


def analytic_field(spark: SparkSession, n: int, kind: str = "gauss", size: float | None = None) -> DataFrame:
    """A Gaussian (sigma 0.01 by default) or top-hat (radius 0.15) density centred in the unit box."""
    r2 = F.lit(0.0)
    for c in CELL:
        d = (F.col(c) + 0.5) / F.lit(float(n)) - F.lit(0.5)
        r2 = r2 + d * d
    if kind == "gauss":
        s = 0.01 if size is None else size
        val = F.exp(-r2 / F.lit(2 * s * s)) / F.lit((2 * math.pi * s * s) ** 1.5)
    else:
        r = 0.15 if size is None else size
        val = F.when(r2 <= r * r, F.lit(1.0)).otherwise(F.lit(0.0))
    return all_cells(spark, n).select(*CELL, val.alias("val"))


def rolled(mesh: DataFrame, n: int, shift: tuple[int, int, int]) -> DataFrame:
    """The mesh moved cyclically, e.g. to centre a cell."""
    return mesh.withColumns({c: F.pmod(F.col(c) + F.lit(s), F.lit(n)).cast("int") for c, s in zip(CELL, shift, strict=True)})

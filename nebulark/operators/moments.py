"""Velocity moments of particles on a mesh: density, mean velocity, dispersion tensor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nebulark.operators.mesh import CELL, by_cell, dense, exploded

VELOCITY = ("vx", "vy", "vz")
TENSOR = ("xx", "xy", "xz", "yy", "yz", "zz")




def _mw() -> Column:
    return F.col("mass") * F.col("w")


def density(particles: DataFrame, n: int, scheme: str = "tsc", background: float | None = None) -> DataFrame:
    """rho = sum of m w by cell; with a background mass above 1, 1 + rho n^3 / background on every cell."""
    rho = by_cell(exploded(particles, n, scheme, keep=("mass",)), n, F.sum(_mw()).alias("rho"))
    if background is None:
        return rho
    if background <= 1:
        raise ValueError("the background mass must be above 1")
    return dense(rho, n, "rho").withColumn("rho", F.lit(1.0) + F.col("rho") * F.lit(n**3 / background))


def _per_mass(column: str) -> Column:
    return F.when(F.col("rho") > 0, F.col(column) / F.col("rho")).otherwise(F.lit(0.0))


def mean_velocity(particles: DataFrame, n: int, scheme: str = "tsc") -> DataFrame:
    """rho and u = sum of m w v / rho by cell; 0 where rho is not positive."""
    rows = exploded(particles, n, scheme, keep=("mass", *VELOCITY))
    sums = by_cell(rows, n, F.sum(_mw()).alias("rho"), *[F.sum(_mw() * F.col(v)).alias(f"p{v}") for v in VELOCITY])
    return sums.select(*CELL, "rho", *[_per_mass(f"p{v}").alias(f"u{v[1]}") for v in VELOCITY])


def dispersion(particles: DataFrame, n: int, scheme: str = "tsc") -> DataFrame:
    """rho and the central second moments / rho by cell, in one pass of partial sums.

    Velocities are taken from the mean of all particles, so that the squares stay small; the cell's own
    mean goes off by algebra: <(v-u)(v-u)> = <dd> - <d><d> for d = v - mean.
    """
    mean = particles.agg(*[F.avg(v).alias(f"__{v}") for v in VELOCITY])
    moved = particles.crossJoin(F.broadcast(mean)).withColumns({v: F.col(v) - F.coalesce(f"__{v}", F.lit(0.0)) for v in VELOCITY})  # one row
    rows = exploded(moved, n, scheme, keep=("mass", *VELOCITY))
    first = [F.sum(_mw() * F.col(v)).alias(f"p{v[1]}") for v in VELOCITY]
    second = [F.sum(_mw() * F.col(f"v{t[0]}") * F.col(f"v{t[1]}")).alias(t) for t in TENSOR]
    sums = by_cell(rows, n, F.sum(_mw()).alias("rho"), *first, *second)
    u = {c: _per_mass(f"p{c}") for c in "xyz"}
    central = {t: _per_mass(t) - u[t[0]] * u[t[1]] for t in TENSOR}
    return sums.select(*CELL, "rho", *[(F.greatest(v, F.lit(0.0)) if t[0] == t[1] else v).alias(f"s{t}") for t, v in central.items()])


def dispersion_trace(tensor: DataFrame) -> DataFrame:
    """sqrt of the trace (the sum of the eigenvalues), and that over its mean."""
    one = tensor.select(*CELL, F.sqrt(F.greatest(F.col("sxx") + F.col("syy") + F.col("szz"), F.lit(0.0))).alias("sigma"))
    mean = one.agg(F.avg("sigma").alias("m"))
    return one.crossJoin(F.broadcast(mean)).select(*CELL, "sigma", F.when(F.col("m") > 0, F.col("sigma") / F.col("m")).otherwise(F.lit(0.0)).alias("relative"))  # one row

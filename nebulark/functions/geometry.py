"""Periodic geometry in a unit box as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nebulark.config import RadialBins, SmuBins, SpspBins

AXES = ("x", "y", "z")


def wrap(x: Column) -> Column:
    """x - floor(x), in [0, 1)."""
    return x - F.floor(x)


def wrap_once(x: Column, size: float = 1.0) -> Column:
    """One shift by the box where the value left it."""
    return F.when(x >= size, x - F.lit(size)).when(x < 0.0, x + F.lit(size)).otherwise(x)


def nearest_image(d: Column) -> Column:
    """The separation to the nearest periodic image."""
    return d - F.floor(d + F.lit(0.5))


def separations(left: str, right: str, periodic: bool = True) -> tuple[Column, Column, Column]:
    """dx, dy, dz of two sets of coordinate columns that carry a prefix."""
    out = tuple(F.col(f"{left}{c}") - F.col(f"{right}{c}") for c in AXES)
    return tuple(nearest_image(d) for d in out) if periodic else out


def square(d: tuple[Column, ...]) -> Column:
    out = d[0] * d[0]
    for x in d[1:]:
        out = out + x * x
    return out


def radial_bin(r: Column, bins: RadialBins) -> Column:
    """The bin of a separation, null outside [low, high)."""
    inside = (r >= F.lit(bins.low)) & (r < F.lit(bins.high))
    place = F.ln(r / F.lit(bins.low)) / F.lit(bins.step) if bins.log else (r - F.lit(bins.low)) / F.lit(bins.step)
    return F.when(inside, F.least(F.floor(place), F.lit(bins.n - 1)).cast("int"))


def smu_bins(r: Column, along: Column, bins: SmuBins, include_mu_one: bool = False) -> tuple[Column, Column]:
    """(ir, imu) of a separation and its part along the line of sight.

    Zero separations have no angle and no bin, and mu = 1 only with ``include_mu_one``.
    """
    mu = F.try_divide(along, r)
    mu = F.abs(mu) if bins.half else mu
    place = F.floor((mu - F.lit(bins.mu_low)) / F.lit(bins.mu_step)).cast("int")
    place = F.least(place, F.lit(bins.n_mu - 1)) if include_mu_one else place
    return radial_bin(r, bins.r), F.when((place >= 0) & (place < bins.n_mu), place)


def spsp_bins(across: Column, along: Column, bins: SpspBins) -> tuple[Column, Column]:
    """(iperp, ipar) of a separation's parts across and along the line of sight."""
    par = F.abs(along) if bins.half else along
    place = F.floor((par - F.lit(bins.par_low)) / F.lit(bins.par_step)).cast("int")
    return radial_bin(across, bins.perp), F.when((place >= 0) & (place < bins.n_par), place)


def cell(x: Column, n: int) -> Column:
    """Cell number of a coordinate on a grid of n cells, wrapped."""
    return F.pmod(F.floor(x * F.lit(float(n))), F.lit(n)).cast("long")


def cell_id(n: int, names: tuple[str, str, str] = AXES) -> Column:
    x, y, z = (cell(F.col(c), n) for c in names)
    return z + n * (y + n * x)


def octant(mid: tuple[float, float, float] = (0.5, 0.5, 0.5)) -> Column:
    """Bits 1, 2, 4: x, y, z above the middle."""
    return sum((F.when(F.col(c) > F.lit(m), 1 << i).otherwise(0) for i, (c, m) in enumerate(zip(AXES, mid, strict=True))), F.lit(0)).cast("int")


def morton(levels: int) -> Column:
    """Octant path of a position in the unit box, ``levels`` octants deep, as a long."""
    n = 1 << levels
    at = [F.least(F.greatest(F.floor(F.col(c) * F.lit(float(n))), F.lit(0)), F.lit(n - 1)).cast("long") for c in AXES]
    out = F.lit(0).cast("long")
    for b in range(levels):
        for i, v in enumerate(at):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(v, b).bitwiseAND(F.lit(1).cast("long")), 3 * b + i))
    return out


def box_distance2(low: tuple[Column, ...], high: tuple[Column, ...], q: tuple[Column, ...]) -> Column:
    """Squared distance of a point to an axis-aligned box, 0 inside."""
    return square(tuple(F.greatest(a - x, x - b, F.lit(0.0)) for a, b, x in zip(low, high, q, strict=True)))


def box_meets_sphere(low: tuple[Column, ...], high: tuple[Column, ...], q: tuple[Column, ...], r: Column) -> Column:
    return box_distance2(low, high, q) <= r * r

"""Power spectra, multipoles and correlation functions by inverse transform."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nebulark.config import RadialBins
from nebulark.functions.geometry import radial_bin
from nebulark.functions.spectral import folded, legendre, window2
from nebulark.operators import fft
from nebulark.operators.mesh import contrast

MAX_ELL = 12


def _k(n: int) -> tuple[Column, Column, Column]:
    return tuple(folded(F.col(c), n).cast("double") for c in ("ix", "iy", "iz"))


def _length(ks: tuple[Column, ...]) -> Column:
    return F.sqrt(ks[0] * ks[0] + ks[1] * ks[1] + ks[2] * ks[2])


def shot_noise(n: int, particles: int | None) -> float:
    """n^6 / N in mesh units (unit volume), 0 without correction."""
    return n**6 / particles if particles else 0.0


def mode_power(modes: DataFrame, n: int, scheme: str, noise: float = 0.0, modes2: DataFrame | None = None) -> DataFrame:
    """Each stored mode's k, kz and power, window-corrected: |d|^2/W^2 - noise, or Re(d1 d2*)/W^2."""
    ks = _k(n)
    w2 = window2(ks, n, scheme)
    if modes2 is None:
        p = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / w2 - F.lit(noise)
    else:
        other = modes2.select("ix", "iy", "iz", F.col("re").alias("re2"), F.col("im").alias("im2"))
        modes = modes.join(other, ["ix", "iy", "iz"])
        p = (F.col("re") * F.col("re2") + F.col("im") * F.col("im2")) / w2
    return fft.half_space(modes, n).select("ix", "iy", "iz", _length(ks).alias("k"), ks[2].alias("kz"), p.alias("p"))


def binned(power: DataFrame, n: int, bins: RadialBins, ells: tuple[int, ...] = (0,)) -> DataFrame:
    """(ik, modes, p0, p2, ...): (2l+1) times the mean of p P_l(kz/k), over n^6; one pass for all l.

    Bins are in grid units of k; the zero mode has no bin.
    """
    rows = power.where("k > 0").withColumn("ik", radial_bin(F.col("k"), bins)).where("ik is not null")
    mu = F.col("kz") / F.col("k")
    means = [(F.avg(F.col("p") * legendre(ell, mu)) * F.lit((2.0 * ell + 1.0) / n**6)).alias(f"p{ell}") for ell in ells]
    return rows.groupBy("ik").agg(F.count(F.lit(1)).alias("modes"), *means)


def power_spectrum(mesh: DataFrame, n: int, scheme: str, bins: RadialBins, particles: int | None = None, mesh2: DataFrame | None = None, ells: tuple[int, ...] = (0,)) -> DataFrame:
    """P(k) of density meshes in units of the box volume, on bins of grid wave numbers."""
    one = fft.forward_half(contrast(mesh, n), n)
    two = None if mesh2 is None else fft.forward_half(contrast(mesh2, n), n)
    return binned(mode_power(one, n, scheme, shot_noise(n, particles), two), n, bins, ells)


def in_length_units(spectrum: DataFrame, n: int, bins: RadialBins, size: float) -> DataFrame:
    """k and P in the box's length unit; bin 0 and k at or above the Nyquist number are left out."""
    mid = F.lit(bins.low) + (F.col("ik") + 0.5) * F.lit(bins.step)
    if bins.log:
        mid = F.lit(bins.low) * F.exp((F.col("ik") + 0.5) * F.lit(bins.step))
    cols = [F.col(c) * F.lit(size**3) for c in spectrum.columns if c.startswith("p")]
    names = [c for c in spectrum.columns if c.startswith("p")]
    return spectrum.where((F.col("ik") > 0) & (mid < n / 2)).select("ik", (mid * F.lit(2 * math.pi / size)).alias("k"), "modes", *[c.alias(x) for c, x in zip(cols, names, strict=True)])


def integer_bins(modes: DataFrame, n: int) -> DataFrame:
    """(ik, modes, p): mean |d|^2 / n^6 by floor(k), the zero mode kept and no window."""
    k = F.floor(_length(_k(n))).cast("int")
    p = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    rows = fft.half_space(modes, n).select(k.alias("ik"), p.alias("p")).where(F.col("ik") < n // 2)
    return rows.groupBy("ik").agg(F.count(F.lit(1)).alias("modes"), (F.avg("p") / F.lit(float(n) ** 6)).alias("p"))


def correlation(mesh: DataFrame, n: int, scheme: str, bins: RadialBins, particles: int | None = None, mesh2: DataFrame | None = None) -> DataFrame:
    """(ir, cells, xi): the inverse transform of the mode power, averaged over cells by folded lag (box units)."""
    one = fft.forward_half(contrast(mesh, n), n)
    two = None if mesh2 is None else fft.forward_half(contrast(mesh2, n), n)
    power = mode_power(one, n, scheme, shot_noise(n, particles), two)  # real and even, as is its transform
    half = power.select("ix", "iy", "iz", F.when(F.col("k") > 0, F.col("p")).otherwise(F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))
    lags = fft.inverse_half(half, n).select((_length(_k(n)) / F.lit(float(n))).alias("r"), (F.col("val") / F.lit(float(n) ** 6)).alias("v"))
    return lags.select(radial_bin(F.col("r"), bins).alias("ir"), "v").where("ir is not null").groupBy("ir").agg(F.count(F.lit(1)).alias("cells"), F.avg("v").alias("xi"))


def correlation_without_block(mesh: DataFrame, n: int, scheme: str, bins: RadialBins, level: int, particles: int | None = None, mesh2: DataFrame | None = None) -> DataFrame:
    """(block_id, ir, xi) of leave-one-cube-out meshes: the cube's contrast is 0, the rest is scaled by
    sqrt(b / (b - 1)) for b = level^3 cubes and centred again.  All cubes go through the same passes.
    Two meshes give their cross correlation, without shot noise.
    """
    blocks = level**3
    cube = lambda c: F.floor(F.col(c) * F.lit(level) / F.lit(n)).cast("int")
    owner = cube("iz") + level * (cube("iy") + level * cube("ix"))
    scale = F.lit((blocks / (blocks - 1)) ** 0.5)

    def modes_of(field: DataFrame) -> DataFrame:
        cells = contrast(field, n).withColumn("owner", owner).withColumn("block_id", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        cells = cells.withColumn("val", F.when(F.col("owner") == F.col("block_id"), F.lit(0.0)).otherwise(F.col("val") * scale))
        means = cells.groupBy("block_id").agg(F.avg("val").alias("m"))
        cells = cells.join(F.broadcast(means), "block_id").withColumn("val", F.col("val") - F.col("m"))  # a row a block
        return fft.forward_half(cells, n, batch="block_id")

    modes, ks = modes_of(mesh), _k(n)
    if mesh2 is None:
        power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / window2(ks, n, scheme) - F.lit(shot_noise(n, particles))
    else:
        cell = ["block_id", "ix", "iy", "iz"]
        modes = modes.join(modes_of(mesh2).select(*cell, F.col("re").alias("re2"), F.col("im").alias("im2")), cell)
        power = (F.col("re") * F.col("re2") + F.col("im") * F.col("im2")) / window2(ks, n, scheme)
    half = modes.select("block_id", "ix", "iy", "iz", F.when(_length(ks) > 0, power).otherwise(F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))
    lags = fft.inverse_half(half, n, batch="block_id").select("block_id", radial_bin(_length(ks) / F.lit(float(n)), bins).alias("ir"), (F.col("val") / F.lit(float(n) ** 6)).alias("v"))
    return lags.where("ir is not null").groupBy("block_id", "ir").agg(F.avg("v").alias("xi"))

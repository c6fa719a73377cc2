"""Cosmology as column expressions, with quadrature and root finding where there is no closed form."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical constants (km/s; cm; s; g).
LIGHT_KMS = 299792.458
PARSEC_CM = 3.0856775814913673e18
MPC_CM = PARSEC_CM * 1e6
YEAR_S = 3.15576e7
MSUN_G = 1.98841e33
#: Critical density today in units of h^2 Msun / Mpc^3.
RHO_CRIT = 2.77536627e11


def redshift(a: Column) -> Column:
    return F.lit(1.0) / a - F.lit(1.0)


def scale_factor(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + z)


def hubble_a(a: Column, om: float, ol: float) -> Column:
    """H(a) in units of h km/s/Mpc, without curvature and radiation."""
    return F.lit(100.0) * F.sqrt(F.lit(om) / (a * a * a) + F.lit(ol))


def hubble_z(z: Column, om: float, ol: float) -> Column:
    x = F.lit(1.0) + z
    return F.lit(100.0) * F.sqrt(F.lit(om) * x * x * x + F.lit(ol))


def hubble_full(a: Column, h0: float, om: float, ol: float, orad: float) -> Column:
    """H(a) with radiation and the curvature that closes the budget."""
    ok = 1.0 - om - ol - orad
    return F.lit(h0) * F.sqrt(F.lit(orad) / (a * a * a * a) + F.lit(om) / (a * a * a) + F.lit(ok) / (a * a) + F.lit(ol))


def dtda(a: Column, om: float, ol: float) -> Column:
    ok = 1.0 - om - ol
    return F.sqrt(a / (F.lit(om) + F.lit(ok) * a + F.lit(ol) * a * a * a))


def poisson_noise(box: float, n: int) -> float:
    """Shot-noise level of n^3 particles: (L/n)^3."""
    return (box / n) ** 3


def nyquist(box: float, n: int) -> float:
    return math.pi * n / box


def particle_mass(box: float, n: int, om: float) -> float:
    return om * RHO_CRIT * poisson_noise(box, n)


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(96)


def ages(a: np.ndarray, om: float, ol: float) -> np.ndarray:
    """Time since the start at many scale factors at once, in Hubble times, by Gauss-Legendre quadrature."""
    s = np.sqrt(a)
    x = s[:, None] * (_NODES + 1) / 2
    return (2 * x * x / np.sqrt(om + (1.0 - om - ol) * x * x + ol * x**6)) @ _WEIGHTS * s / 2


def scale_factors(t: np.ndarray, om: float, ol: float, rounds: int = 40) -> np.ndarray:
    """The inverse of :func:`ages` for all times at once: Newton steps (the slope is dt/da), kept positive."""
    a = (1.5 * np.sqrt(om) * np.maximum(t, 1e-12)) ** (2 / 3)
    for _ in range(rounds):
        slope = np.sqrt(a / (om + (1.0 - om - ol) * a + ol * a**3))
        new = np.maximum(a - (ages(a, om, ol) - t) / slope, a / 4)
        if np.all(np.abs(new - a) <= 1e-14 * a):
            break
        a = new
    return a


def _over(function: Callable[[np.ndarray], np.ndarray]):
    @F.pandas_udf("double")
    def udf(v: pd.Series) -> pd.Series:
        out = v.astype("float64").copy()
        known = out.notna()
        out[known] = function(out[known].to_numpy())
        return out

    return udf


def age_of(om: float, ol: float):
    """Pandas UDF: time since the start at scale factor a, in Hubble times; null stays null."""
    return _over(lambda a: ages(a, om, ol))


def scale_factor_of_age(om: float, ol: float):
    """Pandas UDF: the scale factor at a time (the inverse of :func:`age_of`)."""
    return _over(lambda t: scale_factors(t, om, ol))


def eigenvalues_3x3():
    """Pandas UDF: ascending eigenvalues of a symmetric tensor given as columns xx, xy, xz, yy, yz, zz."""

    @F.pandas_udf("array<double>")
    def values(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
        m = np.stack([np.stack(r, -1) for r in ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))], -2)
        return pd.Series(list(np.linalg.eigvalsh(m)))

    return values

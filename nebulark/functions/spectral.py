"""Wave-number helpers: bins, the assignment window and Legendre polynomials."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDER = {"none": 0, "ngp": 1, "cic": 2, "tsc": 3, "pcs": 4}


def folded(i: Column, n: int) -> Column:
    """|wave number| of index i on n points."""
    return F.least(i, F.lit(n) - i)


def sinc(x: Column) -> Column:
    return F.when(F.abs(x) < 1e-12, F.lit(1.0)).otherwise(F.try_divide(F.sin(x), x))


def window2(ks: tuple[Column, Column, Column], n: int, scheme: str) -> Column:
    """W^2(k) of a mesh assignment of order p: the product of sinc^(2p)(pi k / n) over the axes."""
    out = F.lit(1.0)
    for k in ks:
        s = sinc(k * F.lit(math.pi / n))
        for _ in range(2 * ORDER[scheme]):
            out = out * s
    return out


def legendre_coefficients(order: int) -> list[float]:
    """Coefficients of P_order, lowest power first, by the three-term recursion."""
    low, high = [1.0], [0.0, 1.0]
    if order == 0:
        return low
    for m in range(1, order):
        nxt = [0.0, *((2 * m + 1) / (m + 1) * c for c in high)]
        for i, c in enumerate(low):
            nxt[i] -= m / (m + 1) * c
        low, high = high, nxt
    return high


def legendre(order: int, mu: Column) -> Column:
    out = F.lit(0.0)
    for c in reversed(legendre_coefficients(order)):
        out = out * mu + F.lit(c)
    return out

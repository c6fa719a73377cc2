"""Halo mass histograms and mass functions on logarithmic bins with linear centres."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mass_histogram(halos: DataFrame, low: float, high: float, n: int, mass: str = "mvir") -> DataFrame:
    """(im, m_low, m_high, m_mid, n) of every bin; the last bin includes its upper edge."""
    step = math.log(high / low) / n
    m = F.col(mass)
    place = F.least(F.floor(F.ln(m / F.lit(low)) / F.lit(step)).cast("int"), F.lit(n - 1))
    counts = halos.where((m >= low) & (m <= high)).select(place.alias("im")).groupBy("im").agg(F.count(F.lit(1)).alias("n"))
    edge = lambda k: F.lit(low) * F.exp((F.col("id") + k) * F.lit(step))
    bins = halos.sparkSession.range(n).select(F.col("id").cast("int").alias("im"), edge(0).alias("m_low"), edge(1).alias("m_high"))
    out = bins.join(F.broadcast(counts), "im", "left")  # a row a bin
    return out.select("im", "m_low", "m_high", ((F.col("m_low") + F.col("m_high")) / 2.0).alias("m_mid"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def mass_function(halos: DataFrame, low: float, high: float, n: int, size: float, per: str = "dm", mass: str = "mvir") -> DataFrame:
    """dn/dM (``dm``), dn/dlnM (``dlnm``) or dn/dlog10M (``dlog10m``) per volume."""
    hist = mass_histogram(halos, low, high, n, mass)
    width = {"dm": F.col("m_high") - F.col("m_low"), "dlnm": F.ln(F.col("m_high") / F.col("m_low")), "dlog10m": F.log10(F.col("m_high") / F.col("m_low"))}[per]
    return hist.select("im", "m_mid", "n", (F.col("n") / width / F.lit(size**3)).alias("dn"))

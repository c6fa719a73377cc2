"""Catalogue selections, shifts and samples; selections compose lazily and an empty one stays empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulark.config import Box
from nebulark.functions import cosmology as C
from nebulark.functions.geometry import AXES, wrap, wrap_once

#: The two sets of halo column names, by role.
LABELS = {
    "default": {"pos": "pos", "vel": "vel", "pot": "pot_total", "mass": "Mvir", "level": "child_level"},
    "alternate": {"pos": "Pos", "vel": "Vel", "pot": "Pot", "mass": "Mass", "level": "ChildLevel"},
}
#: Modulus of the portable row hash: a prime whose squares fit a long.
HASH_MOD = 2147483647
#: Buckets of a histogram of hashes, and rows of a bucket that are few enough to be ranked at once.
BUCKETS, BORDER_ROWS = 1024, 10_000


def row_hash(key: Column, seed: int) -> Column:
    """A hash of an integer key in [0, HASH_MOD): two rounds of squaring, in plain arithmetic that any engine repeats.

    Remainder and quotient of the key enter in rounds of their own, the second with a factor of the
    seed, so keys that meet under one seed part under another.
    """
    p = F.lit(HASH_MOD)
    key = key.cast("long")
    k = F.pmod(key, p)
    q = F.pmod(F.call_function("div", key - k, p), p)  # whole numbers all the way
    a = F.pmod(k * 48_271 + q * 40_692 + F.lit(seed * 69_621 + 11), p)
    b = F.pmod(F.pmod(a * a, p) * 16_807 + a * 40_692 + 12_345 + q * F.lit(second_factor(seed)), p)
    return F.pmod(F.pmod(b * b, p) * 48_271 + b * 69_621 + a, p)


def second_factor(seed: int) -> int:
    """What the quotient of a key is multiplied with in the second round."""
    return (seed * 7_919 + 31_337) % 65_521


def select_range(df: DataFrame, column: str, low: float, high: float, closed: str = "both") -> DataFrame:
    """Rows with low <= v <= high (``both``) or low <= v < high (``left``); cuts compose with AND."""
    v = F.col(column)
    if closed not in ("both", "left"):
        raise ValueError("closed is 'both' or 'left'")
    return df.where((v >= low) & ((v <= high) if closed == "both" else (v < high)))


def select_mass_level(df: DataFrame, log_mass: tuple[float, float], levels: tuple[int, int] = (0, 100)) -> DataFrame:
    """The programs' cut: 10^low <= mvir <= 10^high and the child level in range."""
    return select_range(select_range(df, "mvir", 10.0 ** log_mass[0], 10.0 ** log_mass[1]), "child_level", *levels)


def select_position(df: DataFrame, low: float, high: float, pad: float = 0.0) -> DataFrame:
    for c in AXES:
        df = select_range(df, c, low - pad, high + pad)
    return df


def only_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(F.col(ids.columns[0]).alias("__k")), F.col(key) == F.col("__k"), "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Tombstones: rows whose id is not deleted."""
    return df.join(ids.select(F.col(ids.columns[0]).alias("__k")), F.col(key) == F.col("__k"), "left_anti")


def upsert(base: DataFrame, delta: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``delta`` replace those of ``base`` with the same key; the others stay."""
    return without_ids(base, delta.select(key), key).unionByName(delta)


def sample_bernoulli(df: DataFrame, rate: float, seed: int = 100, key: str = "id") -> DataFrame:
    """Each row with probability ``rate``, decided by a hash of its key: the same rows on any cluster."""
    return df.where(row_hash(F.col(key), seed) < F.lit(int(rate * HASH_MOD)))


def sample_exact(df: DataFrame, ratio: float, seed: int = 100, key: str = "id") -> DataFrame:
    """floor(n * ratio) rows without replacement, those with the smallest hashes (ties by key).

    Two histograms of the hashes find the narrow range in which the last of them lies; what is below is
    taken by a filter, and only the rows of that range, about n / BUCKETS**2 of them, are ranked.
    """
    hashed = df.withColumn("__h", row_hash(F.col(key), seed))
    low, width, missing = 0, -(-HASH_MOD // BUCKETS), None
    while True:
        inside = hashed.where((F.col("__h") >= low) & (F.col("__h") < low + width * BUCKETS))
        counts = dict(inside.groupBy(F.floor((F.col("__h") - F.lit(low)) / F.lit(width)).cast("int").alias("b")).count().collect())  # BUCKETS rows at most
        if missing is None:
            missing = int(sum(counts.values()) * ratio)
        bucket = 0
        while bucket < BUCKETS and counts.get(bucket, 0) <= missing:
            missing -= counts.get(bucket, 0)
            bucket += 1
        low += bucket * width
        if bucket == BUCKETS or width == 1 or counts.get(bucket, 0) <= BORDER_ROWS:
            break
        width = max(1, -(-width // BUCKETS))
    below = hashed.where(F.col("__h") < low)
    if missing:
        border = hashed.where((F.col("__h") >= low) & (F.col("__h") < low + width))
        below = below.unionByName(border.orderBy("__h", key).limit(missing))
    return below.drop("__h")


def in_box_units(df: DataFrame, size: float) -> DataFrame:
    """Positions divided by the box and wrapped to [0, 1)."""
    return df.withColumns({c: wrap(F.col(c) / F.lit(size)) for c in AXES})


def shift_redshift_space(df: DataFrame, box: Box, axis: str = "z", a: Column | None = None) -> DataFrame:
    """Position on the axis moves by v / (a H(a) L); ``a`` may be a column (a row's own scale factor)."""
    a = F.lit(box.a) if a is None else a
    factor = F.lit(1.0) / (a * C.hubble_a(a, box.omega_m, box.omega_l) * F.lit(box.size))
    return df.withColumn(axis, wrap(F.col(axis) + F.col(f"v{axis}") * factor))


def shift_gravitational(df: DataFrame, box: Box, axis: str = "z", a: Column | None = None) -> DataFrame:
    """Position on the axis moves by -pot c / (a H(a) L)."""
    a = F.lit(box.a) if a is None else a
    factor = F.lit(C.LIGHT_KMS) / (a * C.hubble_a(a, box.omega_m, box.omega_l) * F.lit(box.size))
    return df.withColumn(axis, wrap(F.col(axis) - F.col("pot") * factor))


def shift_while_loading(df: DataFrame, box: Box, axis: str = "z", by: str = "velocity") -> DataFrame:
    """The loaders' shift by ``velocity`` or ``pot``: in length units, with a single wrap at the box's ends."""
    factor = F.lit(1.0) / (F.lit(box.a) * C.hubble_a(F.lit(box.a), box.omega_m, box.omega_l))
    move = F.col(f"v{axis}") * factor if by == "velocity" else -F.col("pot") * F.lit(C.LIGHT_KMS) * factor
    return df.withColumn(axis, wrap_once(F.col(axis) + move, box.size))


def random_catalog(spark: SparkSession, n: int, seed: int = 10) -> DataFrame:
    """n points spread evenly by hashes of their number: id, x, y, z; the same on any cluster."""
    ids = spark.range(n)
    return ids.select("id", *[(row_hash(F.col("id") * 3 + k, seed * 31 + k) / F.lit(float(HASH_MOD))).alias(c) for k, c in enumerate(AXES)])


def corner_clusters(spark: SparkSession, n: int, width: float = 0.1, seed: int = 1) -> DataFrame:
    """Two clusters of n points each in opposite corners of the unit box."""
    pts = random_catalog(spark, 2 * n, seed)
    return pts.select("id", *[F.when(F.col("id") < n, F.col(c) * F.lit(width)).otherwise(F.lit(1.0 - width) + F.col(c) * F.lit(width)).alias(c) for c in AXES])


def bounding_box(df: DataFrame, columns: tuple[str, ...] = AXES) -> DataFrame:
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])

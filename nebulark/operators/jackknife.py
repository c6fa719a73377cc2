"""Jackknife errors: pairs carry the blocks of both ends and are counted once.

What a block takes away is the sum over pairs that touch it, so leave-one-out counts of all blocks
come from a single pass over the pairs instead of one recount a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nebulark.config import RadialBins, SmuBins, SpspBins
from nebulark.functions import geometry as G
from nebulark.operators import ordering
from nebulark.operators.catalog import row_hash
from nebulark.operators.pairs import count_r_between, count_smu, count_spsp, project_smu, project_spsp, spine


def spatial_blocks(cat: DataFrame, level: int) -> DataFrame:
    """block_id of cubes, level^3 of them."""
    return cat.withColumn("block_id", G.cell_id(level).cast("int"))


def shuffle_blocks(cat: DataFrame, blocks: int, seed: int = 10, key: str = "id") -> DataFrame:
    """Equal slices of the rows in the order of a hash, one row a block that holds it.

    m = ceil(N / B) rows, slices start at b * floor((N - m) / (B - 1)); they may overlap by a few rows
    and leave a few at the end.  Rows are numbered by a range partitioning, so no task sorts all of them.
    """
    n = cat.count()
    m = -(-n // blocks)
    step = (n - m) // (blocks - 1) if blocks > 1 else 0
    numbered = ordering.numbered(cat.withColumn("__h", row_hash(F.col(key), seed)), F.col("__h"), key, "__pos")
    slices = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(b * step).alias("lo"), F.lit(b * step + m).alias("hi")) for b in range(blocks)])
    mine = F.filter(slices, lambda s: (F.col("__pos") >= s["lo"]) & (F.col("__pos") < s["hi"]))
    return numbered.withColumn("block_id", F.explode(F.transform(mine, lambda s: s["b"]))).drop("__h", "__pos")


def block_sizes(cat: DataFrame) -> DataFrame:
    return cat.groupBy("block_id").agg(F.count(F.lit(1)).alias("m"))


def _without(ends: DataFrame, frame: DataFrame, keys: list[str], blocks: int) -> DataFrame:
    """(block_id, keys, n) from pairs by bin and both ends' blocks: all pairs less those that touch the block."""
    tagged = ends.select(*keys, F.array_distinct(F.array("block_id1", "block_id2")).alias("touched"), "n")
    totals = tagged.groupBy(*keys).agg(F.sum("n").alias("total"))
    gone = tagged.select(*keys, F.explode("touched").alias("block_id"), "n").groupBy(*keys, "block_id").agg(F.sum("n").alias("gone"))
    cubes = frame.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block_id"))
    out = frame.crossJoin(F.broadcast(cubes)).join(F.broadcast(totals), keys, "left").join(F.broadcast(gone), [*keys, "block_id"], "left")  # bins x blocks
    return out.select("block_id", *keys, (F.coalesce("total", F.lit(0)) - F.coalesce("gone", F.lit(0))).cast("long").alias("n"))


def leave_one_out(cat: DataFrame, cat2: DataFrame | None, bins: RadialBins, blocks: int) -> DataFrame:
    """(block_id, ir, n): pairs with no end in the block, for every block and bin.

    Each row of the catalogues has one block.
    """
    ends = count_r_between(cat, cat2, bins, "block_id")
    return _without(ends, spine(cat.sparkSession, bins).select("ir"), ["ir"], blocks)


def leave_one_out_smu(cat: DataFrame, bins: SmuBins, blocks: int, axis: str = "z") -> DataFrame:
    """(block_id, ir, imu, n) of one catalogue with the line-of-sight angle folded."""
    ends = count_smu(cat, None, bins, axis, "block_id")
    mus = cat.sparkSession.range(bins.n_mu).select(F.col("id").cast("int").alias("imu"))
    frame = spine(cat.sparkSession, bins.r).select("ir").crossJoin(F.broadcast(mus))  # bins x bins
    return _without(ends, frame, ["ir", "imu"], blocks)


def leave_one_out_spsp(cat: DataFrame, bins: SpspBins, blocks: int, axis: str = "z") -> DataFrame:
    """(block_id, iperp, ipar, n) of one catalogue with the part along the line of sight folded."""
    ends = count_spsp(cat, None, bins, axis, "block_id")
    across_bins, along_bins = (cat.sparkSession.range(n).select(F.col("id").cast("int").alias(c)) for n, c in ((bins.perp.n, "iperp"), (bins.n_par, "ipar")))
    return _without(ends, across_bins.crossJoin(F.broadcast(along_bins)), ["iperp", "ipar"], blocks)  # bins x bins


def xi_blocks(dd: DataFrame, rr: DataFrame, dr: DataFrame | None, data_sizes: DataFrame, random_sizes: DataFrame, n_data: int, n_random: int) -> DataFrame:
    """(block_id, ir, xi) from leave-one-out counts, RR without ``dr`` and LS with it (all D x R pairs)."""
    sizes = data_sizes.withColumnRenamed("m", "md").join(random_sizes.withColumnRenamed("m", "mr"), "block_id", "outer")
    nd, nr = F.lit(float(n_data)) - F.coalesce("md", F.lit(0)), F.lit(float(n_random)) - F.coalesce("mr", F.lit(0))
    table = dd.withColumnRenamed("n", "dd").join(rr.withColumnRenamed("n", "rr"), ["block_id", "ir"]).join(F.broadcast(sizes), "block_id", "left")
    f = F.try_divide(nr, nd)
    if dr is None:
        top = f * f * F.col("dd") - F.col("rr")
    else:
        table = table.join(dr.withColumnRenamed("n", "dr"), ["block_id", "ir"])
        top = f * f * F.col("dd") - f * F.col("dr") + F.col("rr")
    return table.select("block_id", "ir", F.when(F.col("rr") > 0, F.try_divide(top, F.col("rr"))).otherwise(F.lit(0.0)).alias("xi"))


def xi_blocks_cross(dd: DataFrame, rr: DataFrame, d1r2: DataFrame, d2r1: DataFrame, sizes: list[DataFrame], totals: list[int]) -> DataFrame:
    """(block_id, ir, xi) of two catalogues, Landy-Szalay; sizes and totals of data 1, data 2, randoms 1, randoms 2."""
    keys = ["block_id", "ir"]
    table = dd.withColumnRenamed("n", "dd")
    for name, counts in (("rr", rr), ("d1r2", d1r2), ("d2r1", d2r1)):
        table = table.join(counts.withColumnRenamed("n", name), keys)
    left = []
    for i, (size, total) in enumerate(zip(sizes, totals, strict=True)):
        table = table.join(F.broadcast(size.withColumnRenamed("m", f"m{i}")), "block_id", "left")  # a row a block
        left.append(F.lit(float(total)) - F.coalesce(f"m{i}", F.lit(0)))
    f1, f2 = F.try_divide(left[2], left[0]), F.try_divide(left[3], left[1])
    top = f1 * f2 * F.col("dd") - f1 * F.col("d1r2") - f2 * F.col("d2r1") + F.col("rr")
    return table.select(*keys, F.when(F.col("rr") > 0, F.try_divide(top, F.col("rr"))).otherwise(F.lit(0.0)).alias("xi"))


def _contrast_2d(dd: DataFrame, rr: DataFrame, sizes: tuple[DataFrame, DataFrame], totals: tuple[int, int], keys: list[str]) -> DataFrame:
    """(block_id, keys, rr, xi): each block's f^2 DD / RR - 1; sizes and totals of the data and the randoms."""
    size = sizes[0].withColumnRenamed("m", "md").join(sizes[1].withColumnRenamed("m", "mr"), "block_id", "outer")
    f = F.try_divide(F.lit(float(totals[1])) - F.coalesce("mr", F.lit(0)), F.lit(float(totals[0])) - F.coalesce("md", F.lit(0)))
    table = dd.withColumnRenamed("n", "dd").join(rr.withColumnRenamed("n", "rr"), ["block_id", *keys]).join(F.broadcast(size), "block_id", "left")  # a row a block
    xi = F.when(F.col("rr") > 0, f * f * F.col("dd") / F.col("rr") - F.lit(1.0)).otherwise(F.lit(0.0))
    return table.select("block_id", *keys, "rr", xi.alias("xi"))


def xi_smu_blocks(dd: DataFrame, rr: DataFrame, data_sizes: DataFrame, random_sizes: DataFrame, n_data: int, n_random: int) -> DataFrame:
    """(block_id, ir, xi): each block's contrast by (ir, imu), projected to xi(s) with its RR as weight."""
    return project_smu(_contrast_2d(dd, rr, (data_sizes, random_sizes), (n_data, n_random), ["ir", "imu"]), "block_id")


def wp_blocks(dd: DataFrame, rr: DataFrame, data_sizes: DataFrame, random_sizes: DataFrame, n_data: int, n_random: int, bins: SpspBins) -> DataFrame:
    """(block_id, iperp, wp): each block's contrast by (iperp, ipar), projected along the line of sight."""
    return project_spsp(_contrast_2d(dd, rr, (data_sizes, random_sizes), (n_data, n_random), ["iperp", "ipar"]), bins, "block_id")


def mean_and_error(xi: DataFrame, keys: list[str], value: str = "xi") -> DataFrame:
    """Mean over blocks and its jackknife error sqrt((n - 1) / n * sum of squared deviations)."""
    n = F.count(value)
    return xi.groupBy(*keys).agg(F.avg(value).alias("mean"), F.sqrt((n - 1) * F.var_pop(value)).alias("se"))

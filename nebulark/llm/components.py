"""Connected components of a link table by alternating large-star and small-star steps.

A step replaces links by links to the smallest neighbour; a round is two steps, and few rounds are
needed also for long chains.  Tables of minima are written before they are joined, so that both
sides of a join are plain exchanges whose skewed partitions Spark can split: a hub node's links do
not meet in one task.  Only a count and a checksum come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nebulark.llm._common import materialize


def _with_min(links: DataFrame) -> DataFrame:
    """links (u, v) with m, the smallest v of each u."""
    low = materialize(links.groupBy("u").agg(F.min("v").alias("m")), "cc-min").withColumnRenamed("u", "w")
    return links.join(low, F.col("u") == F.col("w")).drop("w")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, root being the component's smallest node; links are (a, b)."""
    links = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-links")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _with_min(materialize(large, "cc-large"))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("l")).select("l.*").where("u <> v").distinct()
        links = materialize(small, "cc-links")
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())
        if now == state:
            break
        state = now
    roots = links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

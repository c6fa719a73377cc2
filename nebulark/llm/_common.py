"""Shared helpers of the training-data operators: work tables, hot-group joins, ranks.

Work tables go to the folder that the session names in ``spark.checkpoint.dir``.
They are plain Parquet, so a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nebulark.plans.work import shared_folder

#: At most this many groups can hold more than 1/HOT_GROUPS of all rows each, so they may be broadcast.
HOT_GROUPS = 1000
#: A bitmap of surviving keys has 2**BITMAP_BITS bits: 16 MB at most, whatever the input.
BITMAP_BITS = 27
_BUCKET_BITS = 15  # bitmap_construct_agg holds 32768 bits a row


_scope: contextvars.ContextVar[str] = contextvars.ContextVar("scratch", default="")


def work_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one; inside :func:`scratch`, a folder of that."""
    return f"{shared_folder(spark)}/nebulark-{spark.sparkContext.applicationId}{_scope.get()}"


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and forgets the partitioning."""
    path = f"{folder or work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_work_tables(spark: SparkSession, path: str | None = None) -> None:
    """Remove this application's work tables (or those below ``path``); call when its results have been written."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path or work_dir(spark))
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Work tables that are made inside go when it ends; yields the folder around it, where results may stay."""
    outside = work_dir(spark)
    token = _scope.set(f"{_scope.get()}/scratch-{uuid.uuid4().hex}")
    try:
        yield outside
    finally:
        inside = work_dir(spark)
        _scope.reset(token)
        drop_work_tables(spark, inside)


def text_of(column: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def mapped(rows: DataFrame, function, schema: str) -> DataFrame:
    """mapInPandas over rows with a doc_id, which comes out in its own type.

    Ids travel as strings: pandas would make floats of integers beside a null.
    """
    kind = dict(rows.dtypes)["doc_id"]
    out = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(function, f"doc_id string, {schema}")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def id_key(column: str) -> Column:
    """An id as a string that is never null, for joins that must keep rows without id."""
    return F.coalesce(F.concat(F.lit("i"), F.col(column).cast("string")), F.lit("null"))


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart by id and text; never null."""
    return F.concat(F.xxhash64(text_of(text_col)).cast("string"), F.lit(":"), id_key(id_col))


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Column | None = None) -> DataFrame:
    """Left-join ``groups`` (one row a key, a written table) to ``rows`` without a hot task.

    A group with more than 1/HOT_GROUPS of the grouped rows is broadcast: there can be no more
    than HOT_GROUPS of those.  Its rows then go through the ordinary join under a key of their own
    that matches nothing, so they spread evenly.  ``size`` is the column with a group's row count;
    ``key`` is a string and may be null (no match).  ``spread`` tells the rows of a group apart; without
    it all columns of ``rows`` do, which are plain values then.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    values = [c for c in groups.columns if c != key]
    named = groups.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__g_{c}") for c in values])
    is_hot = F.col(f"__g_{size}") * HOT_GROUPS > F.lit(total)
    hot = F.broadcast(named.where(is_hot).select(F.col("__key").alias("__hot"), *[F.col(f"__g_{c}").alias(f"__h_{c}") for c in values]))
    cold = named.where(~is_hot)
    routed = rows.join(hot, F.col(key) == F.col("__hot"), "left").withColumn(
        "__route", F.when(F.col("__hot").isNull() & F.col(key).isNotNull(), F.concat(F.lit("k"), F.col(key))).otherwise(F.concat(F.lit("-"), (F.xxhash64(*rows.columns) if spread is None else spread).cast("string")))
    )
    joined = routed.join(cold.withColumn("__key", F.concat(F.lit("k"), "__key")), F.col("__route") == F.col("__key"), "left")
    return joined.select(*[rows[c] for c in rows.columns], *[F.coalesce(f"__h_{c}", f"__g_{c}").alias(c) for c in values])


def _slot(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - BITMAP_BITS)


def key_bitmap(keys: DataFrame, hashed: Column) -> DataFrame:
    """A fixed-size bitmap of hashed keys, one row for each 32768 bits; no false negatives."""
    slots = keys.select(_slot(hashed).alias("slot"))
    return slots.groupBy(F.shiftright("slot", _BUCKET_BITS).alias("__bucket")).agg(F.expr(f"bitmap_construct_agg(slot % {1 << _BUCKET_BITS})").alias("__bits"))


def keep_in_bitmap(df: DataFrame, hashed: Column, bitmap: DataFrame, flag: str) -> DataFrame:
    """Add the boolean ``flag``: whether the hashed key is in the (broadcast, bounded) bitmap."""
    out = df.withColumn("__slot", _slot(hashed)).withColumn("__at", F.shiftright("__slot", _BUCKET_BITS))
    out = out.join(F.broadcast(bitmap), F.col("__at") == F.col("__bucket"), "left")
    byte = F.conv(F.hex(F.expr(f"substring(__bits, cast((__slot % {1 << _BUCKET_BITS}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("cast(__slot % 8 as int)")
    return out.withColumn(flag, F.coalesce(F.getbit(byte, bit) == 1, F.lit(False))).drop("__slot", "__at", "__bucket", "__bits")


def split_rows(docs: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: rows that are surely not among ``keys``, and the rest with its key as ``__row``.

    ``keys`` is a written table with one string column; ``key`` is never null.  A broadcast bitmap of fixed
    size decides, so texts of rows in the first part move nowhere; the rest goes through a join, with
    little in it until the keys fill the bitmap (about 2**BITMAP_BITS of them).
    """
    name = keys.columns[0]
    rows = keep_in_bitmap(docs.withColumn("__row", key), F.xxhash64("__row"), key_bitmap(keys, F.xxhash64(name)), "__maybe")
    return rows.where(~F.col("__maybe")).select(*docs.columns), rows.where("__maybe").select(*docs.columns, "__row")


def without_rows(docs: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is not in the one column of the written table ``keys``."""
    clean, rest = split_rows(docs, key, keys)
    name = keys.columns[0]
    rest = rest.join(keys.select(F.col(name).alias("__gone")), F.col("__row") == F.col("__gone"), "left_anti")
    return clean.unionByName(rest.drop("__row"))


def ranked(df: DataFrame, by: list[Column], rank: str) -> DataFrame:
    """Add a global 0-based rank: a range partitioning, ranks inside each, and the partitions' offsets.

    The offsets are one row a partition, so they may be broadcast.
    """
    keyed = df.withColumn("__ord", F.struct(*by))
    spread = materialize(keyed.repartitionByRange(F.col("__ord").asc_nulls_first()).withColumn("__pid", F.spark_partition_id()).drop("__ord"), "ranked")
    counts = spread.groupBy("__pid").count()
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__off"))
    within = Window.partitionBy("__pid").orderBy(*by)
    return spread.join(F.broadcast(offsets), "__pid").withColumn(rank, F.col("__off") + F.row_number().over(within) - 1).drop("__pid", "__off")

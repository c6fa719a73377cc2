"""Exact dedup by progressive refinement, DataFrame functions only.

Rows are grouped by normalised length, then by a hash of a short prefix, and only the rows of
groups that still hold two or more are hashed in full.  The survivors of a step are handed to
the next scan as a bitmap of fixed size (``_common.key_bitmap``), so no text is ever shuffled:
a false positive costs one hash, never a wrong result, since the last step groups by the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nebulark.llm._common import attach_groups, id_key, keep_in_bitmap, key_bitmap, materialize, row_key, split_rows, text_of

PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """The text without the characters [\\x20\\x09-\\x0D]."""
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")


def _grouped(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...], digest: str | None = None, mark: bool = False) -> DataFrame:
    """doc_id, digest of the rows that may have copies, n and best (c, i, m) of their groups, ``carry`` and, asked for, mark."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("__text"), *carry)
    rows = rows.withColumn("__norm", normalised(F.col("__text")))
    extra = [*carry, *["mark"] * mark]
    keyed = rows.select("doc_id", F.length("__text").alias("chars"), F.length("__norm").cast("long").alias("norm_len"), F.xxhash64(F.substring("__norm", 1, PREFIX_CHARS)).alias("prefix"), "__norm", *carry, *[F.xxhash64("__text").alias("mark")] * mark)

    # 1 and 2: lengths, then prefixes, from a narrow table without texts.
    narrow = materialize(keyed.select("norm_len", "prefix"), "dedup-keys")
    by_len, by_prefix = F.xxhash64("norm_len"), F.xxhash64("norm_len", "prefix")
    lengths = narrow.groupBy("norm_len").count().where("count > 1")
    same_len = keep_in_bitmap(narrow, by_len, key_bitmap(lengths, by_len), "__maybe").where("__maybe")
    prefixes = same_len.groupBy("norm_len", "prefix").count().where("count > 1")

    # 3: the full content, of the surviving groups alone.
    marked = keep_in_bitmap(keyed, by_prefix, key_bitmap(prefixes, by_prefix), "__maybe")
    whole = F.sha2("__norm", 256) if digest is None else F.col(digest)
    full = materialize(marked.select("doc_id", "chars", *extra, F.when(F.col("__maybe"), whole).alias("digest")), "dedup-digests")
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").alias("i"), *[F.col("mark").alias("m")] * mark))
    groups = full.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
    groups = materialize(groups.where("n > 1"), "dedup-groups")
    return attach_groups(full, groups, "digest", "n")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), digest: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, and the narrow columns named in ``carry``.

    Texts are equal when equal without white space [\\x20\\x09-\\x0D]; the row with the most code
    points, then the smallest id, is kept.  A null text is empty, and empty texts equal each other.
    A null id is allowed and comes before every other id on a tie; of rows repeated with one id,
    each is a member and each row with the kept id is kept.  Empty input gives no rows; other
    columns are ignored.  A carried column that holds the normalised texts' SHA-256 may be named as
    ``digest``, and is then taken for it.
    """
    out = _grouped(docs, id_col, text_col, carry, digest)
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.i"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), *carry)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, one of each group, with all their columns.

    Rows are told apart by id and text, so an id used for two texts loses neither; of texts that tie
    with one id, and of rows repeated with one id and equal texts, one stays.  A null id counts as a
    value.  Decisions are narrow: only rows that may have to go move, for the join that confirms it.
    """
    found = _grouped(docs, id_col, text_col, (), mark=True).where("n is not null")
    stays = F.col("doc_id").eqNullSafe(F.col("best.i")) & (F.col("mark") == F.col("best.m"))
    key = F.concat(F.col("mark").cast("string"), F.lit(":"), id_key("doc_id"))
    copies = found.groupBy(key.alias("key")).agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("rows"))
    copies = materialize(copies.where("not stays or rows > 1"), "dedup-copies")
    clean, rest = split_rows(docs, row_key(id_col, text_col), copies.select("key"))
    gone = copies.where("not stays").select(F.col("key").alias("__gone"))
    rest = rest.join(gone, F.col("__row") == F.col("__gone"), "left_anti").dropDuplicates(["__row"])
    return clean.unionByName(rest.drop("__row"))

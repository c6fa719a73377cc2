"""SimHash near-dedup by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits and mapped to its counts of set bits.
The Manhattan distance of two count vectors never exceeds the Hamming distance, so it prunes first.
The counts are kept in unary (0, 01, 11): then the Manhattan distance is itself a popcount.

Range join: the segments form MAX_BITS + s groups; vectors within MAX_BITS of each other agree exactly
on at least s groups, so each choice of s groups is a grid whose cells hold all pairs in reach.  More
fingerprints get more groups: more grids, each much finer, so cells stay sparse.  Only distinct fingerprints enter; cells with one member are dropped; a cell with
more than BLOCK members is dealt out as pairs of blocks.  A task emits a link only between
fingerprints that its earlier links have not joined already, so a dense cell gives about as many
links as members, and components come out the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from nebulark.llm._common import attach_groups, id_key, keep_in_bitmap, key_bitmap, mapped, materialize, row_key, text_of, without_rows
from nebulark.llm.components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
#: Groups of segments beyond the bits that may differ, by the number of distinct fingerprints up to which they are used.
SPARE_GROUPS = ((1 << 23, 3), (1 << 29, 5), (1 << 63, 7))
BLOCK = 2048
_PART = 1 << 15  # shingles hashed at a time
_ODD = 0x5555555555555555


def fingerprint(text: str) -> int:
    """The fingerprint as a signed 64-bit integer; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and [\x20\x09-\x0D] only
    n = max(1, len(words) - SHINGLE_WORDS + 1) if words else 0
    if not n:
        return 0
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, _PART):
        part = words[at : at + _PART + SHINGLE_WORDS - 1]
        if len(part) < SHINGLE_WORDS:
            hashes = [xxh64_intdigest(b" ".join(part), 42)]
        else:
            hashes = [xxh64_intdigest(b" ".join(s), 42) for s in zip(*(part[i:] for i in range(SHINGLE_WORDS)), strict=False)]
        set_bits += np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: bool = False) -> DataFrame:
    """doc_id and fp (long) of every row, with ``mark`` also the text's hash; null texts count as empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), *[_mark(text_col).alias("mark")] * mark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b["text"]], np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp, **({"mark": b["mark"]} if mark else {})})

    return mapped(rows, run, "fp long, mark long" if mark else "fp long")


def _mark(text_col: str) -> Column:
    return F.xxhash64(text_of(text_col))


def segment_counts(fp: Column) -> Column:
    """Counts of set bits of the 32 two-bit segments, each in unary in its own two bits."""
    high = F.shiftrightunsigned(fp, 1)
    some, all_ = fp.bitwiseOR(high).bitwiseAND(F.lit(_ODD)), fp.bitwiseAND(high).bitwiseAND(F.lit(_ODD))
    return some.bitwiseOR(F.shiftleft(all_, 1))


def grid_masks(groups: int, max_bits: int) -> list[int]:
    """For each choice of groups - max_bits groups, the bits of their segments (signed 64-bit)."""
    bits = [0] * groups
    for s in range(32):
        bits[s * groups // 32] |= 3 << (2 * s)
    masks = [sum(c) for c in combinations(bits, groups - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _links_in_cells(batches: Iterator[pd.DataFrame], max_bits: int) -> Iterator[pd.DataFrame]:
    """Links among the rows of each cell; rows come sorted by cell."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def links(cell: np.ndarray, fp: np.ndarray, emb: np.ndarray) -> pd.DataFrame:
        n, out = len(cell), []
        label = np.arange(n)
        at = np.arange(n)
        for d in range(1, n):
            at = at[at + d < n]
            at = at[cell[at + d] == cell[at]]
            if not len(at):
                break
            near = at[label[at] != label[at + d]]
            near = near[np.bitwise_count(emb[near] ^ emb[near + d]) <= max_bits]
            near = near[np.bitwise_count(fp[near] ^ fp[near + d]) <= max_bits]
            if len(near):
                out.append((fp[near], fp[near + d]))
                for i, j in zip(near.tolist(), (near + d).tolist(), strict=True):
                    while label[i] != i:
                        label[i] = i = label[label[i]]
                    while label[j] != j:
                        label[j] = j = label[label[j]]
                    label[max(i, j)] = min(i, j)
                while not np.array_equal(up := label[label], label):
                    label = up
        if not out:
            return pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64)})
        return pd.DataFrame({"a": np.concatenate([a for a, _ in out]).view(np.int64), "b": np.concatenate([b for _, b in out]).view(np.int64)})

    def gathered() -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*held, strict=True)]

    for b in batches:
        if not len(b):
            continue
        held.append((b["cell"].to_numpy(np.int64), b["fp"].to_numpy(np.int64).view(np.uint64), b["emb"].to_numpy(np.int64).view(np.uint64)))
        if held[-1][0][-1] == held[0][0][0]:
            continue  # one cell so far
        cell, fp, emb = gathered()
        whole = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
        held = [(cell[whole:], fp[whole:], emb[whole:])]
        yield links(cell[:whole], fp[:whole], emb[:whole])
    if held:
        yield links(*gathered())


def groups_for(fingerprints: int, max_bits: int = MAX_BITS) -> int:
    """Groups of segments for so many distinct fingerprints; any number above ``max_bits`` finds all links."""
    return max_bits + next(s for n, s in SPARE_GROUPS if fingerprints <= n)


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS, groups: int | None = None, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints (column fp) within ``max_bits``, as components see them."""
    groups = groups or groups_for(distinct.count(), max_bits)
    emb = segment_counts(F.col("fp"))
    grids = F.array(*[F.xxhash64(F.lit(i), F.col("emb").bitwiseAND(F.lit(m))) for i, m in enumerate(grid_masks(groups, max_bits))])
    rows = distinct.select("fp", emb.alias("emb")).select("fp", "emb", F.explode(grids).alias("cell"))
    cells = materialize(rows.groupBy("cell").count().where("count > 1"), "simhash-cells")
    key = F.xxhash64("cell")
    rows = keep_in_bitmap(rows, key, key_bitmap(cells, key), "__maybe").where("__maybe").drop("__maybe")
    large = cells.where(F.col("count") > block)
    if not large.isEmpty():
        rows = attach_groups(rows.withColumn("key", F.col("cell").cast("string")), large.select(F.col("cell").cast("string").alias("key"), "count"), "key", "count")
        n = F.coalesce(F.ceil(F.col("count") / F.lit(block)), F.lit(1)).cast("int")
        rows = rows.withColumn("blocks", n).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("fp", "emb", F.when(F.col("blocks") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))).alias("cell"))
    rows = rows.repartition("cell").sortWithinPartitions("cell")
    return rows.mapInPandas(lambda batches: _links_in_cells(batches, max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, groups: int | None = None, id_col: str = "doc_id", text_col: str = "text", mark: bool = False) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, component_size; with ``mark`` also mark and stays.

    Fingerprints that differ in ``max_bits`` bits or fewer are linked; a component's id is its
    smallest doc_id.  Null and empty texts, and texts of white space, have fingerprint zero and link
    like any other.  A null id is a member but never a component's id unless no member has one.
    Repeated rows are members each.  Empty input gives no rows; other columns are ignored.  ``mark`` is
    the text's hash, ``stays`` true for the rows with the smallest id and, of those, the smallest mark.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, mark), "simhash-docs")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *["mark"] * mark))
    nodes = materialize(marked.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), first.alias("rep")), "simhash-nodes")
    linked = materialize(components(near_links(nodes.select("fp"), max_bits, groups)), "simhash-linked")
    members = materialize(linked.join(nodes, F.col("node") == F.col("fp")).select("fp", "root", "n", "rep"), "simhash-members")
    tops = materialize(members.groupBy("root").agg(F.min("rep").alias("top"), F.sum("n").alias("size")), "simhash-tops")
    joined = members.join(tops.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select("fp", "n", "top", "size")
    single = nodes.where("n > 1").join(linked.select("node"), F.col("fp") == F.col("node"), "left_anti").select("fp", "n", F.col("rep").alias("top"), F.col("n").alias("size"))
    groups_ = materialize(joined.unionByName(single).withColumn("key", F.col("fp").cast("string")).drop("fp"), "simhash-groups")
    out = attach_groups(marked.withColumn("key", F.col("fp").cast("string")), groups_, "key", "n")
    alone = F.col("n").isNull()
    stays = alone | (F.col("doc_id").eqNullSafe(F.col("top.id")) & (F.col("mark") == F.col("top.mark"))) if mark else None
    return out.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("top.id")).alias("component_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("size")).cast("long").alias("component_size"),
        *(["mark", stays.alias("stays")] if mark else []),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``, the one with the smallest id, with all its columns.

    Rows are told apart by id and text, so an id used for two texts, or a null id, loses only the
    rows whose own component has a smaller id (or, of one id, a text with a smaller hash).  Rows with
    equal ids and texts stay or go together: exact dedup tells those.  Only rows that may have to go move.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, mark=True).where("not stays")
    gone = found.select(F.concat(F.col("mark").cast("string"), F.lit(":"), id_key("doc_id")).alias("key"))
    return without_rows(docs, row_key(id_col, text_col), materialize(gone, "simhash-gone"))

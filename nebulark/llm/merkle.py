"""Merkle manifest of a dataset: leaves a row, a tree a group, a tree over the groups, and proofs of all rows.

Leaves get their position in the tree of their group and are dealt in aligned runs of 2**RUN_LEVELS, the
leaf partitions.  A partition builds its part of the tree, gives its top node, and lists the minimal
union of node coordinates that the proofs of its leaves lack (the octopus rule: level by level, the
siblings of known nodes that are not known themselves).  Top nodes climb in aligned runs again, a few
rounds whatever the size.  Each wanted coordinate is fetched once a partition; nodes near the root,
which many partitions want, are few and broadcast.  A partition then has its own interior nodes and
what it fetched, from which each leaf's proof is expanded and folded there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nebulark.llm._common import attach_groups, materialize, ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A leaf partition has 2**RUN_LEVELS leaves.
RUN_LEVELS = 10
_NODE = "tree string, level int, idx long, n long, hash string"


def digest(*parts: str) -> str:
    """Lowercase hex sha256 of the concatenated parts."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_hash(values: list[Column]) -> Column:
    """A row's leaf: each value as its length in bytes, a colon and itself, or - if it is null."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]).cast("binary"), 256)


def missing_nodes(positions: list[int], n: int) -> list[tuple[int, int]]:
    """(level, index) of the nodes that proofs of these leaves need besides them, of a tree with ``n`` leaves; each once."""
    known, need, level = np.unique(np.asarray(positions, np.int64)), [], 0
    while n > 1:
        sibling = known ^ 1
        lacking = sibling[(sibling < n) & ~np.isin(sibling, known, assume_unique=True)]
        need += [(level, int(i)) for i in lacking]
        known, n, level = np.unique(known >> 1), (n + 1) >> 1, level + 1
    return need


def levels_above(hashes: list[str], n: int, most: int) -> Iterator[tuple[int, list[str]]]:
    """(n at the level, nodes) of an aligned run of a tree and the levels above it, until one node or ``most`` levels."""
    yield n, hashes
    for _ in range(most):
        if n == 1:
            return
        hashes, n = [digest(*hashes[i : i + 2]) for i in range(0, len(hashes), 2)], (n + 1) >> 1
        yield n, hashes


def climb(base: DataFrame, name: str, run_levels: int = RUN_LEVELS) -> DataFrame:
    """All nodes from those of one level (tree, level, idx, n, hash) up to the roots, which have n = 1."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        level, at, out = int(rows["level"].iloc[0]), int(rows["idx"].iloc[0]), []
        for up, (n, hashes) in enumerate(levels_above(rows["hash"].tolist(), int(rows["n"].iloc[0]), run_levels)):
            if up:
                out += [(key[0], level + up, (at >> up) + i, n, h) for i, h in enumerate(hashes)]
        return pd.DataFrame(out, columns=["tree", "level", "idx", "n", "hash"])

    nodes, now = base, base
    while (now.agg(F.max("n")).first()[0] or 0) > 1:
        up = materialize(now.where("n > 1").groupBy("tree", F.shiftright("idx", run_levels)).applyInPandas(run, _NODE), name)
        top = up.groupBy("tree").agg(F.max("level").alias("level"))
        nodes, now = nodes.unionByName(up), materialize(up.join(top, ["tree", "level"]).select(*base.columns), name)
    return nodes


def _coordinate(tree: Column, level: Column, idx: Column) -> Column:
    return F.concat_ws(":", level, idx, tree)


def fetch(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """``wanted`` (owner, part, tree, level, idx) with the hash of the node; coordinates that many want are broadcast."""
    asked = materialize(wanted.withColumn("at", _coordinate(F.col("tree"), F.col("level"), F.col("idx"))), "merkle-wanted")
    asks = asked.groupBy("at").agg(F.count(F.lit(1)).alias("asks"))
    there = nodes.select(_coordinate(F.col("tree"), F.col("level"), F.col("idx")).alias("at"), "hash")
    found = materialize(asks.join(there, "at"), "merkle-fetched")
    return attach_groups(asked, found, "at", "asks").drop("at", "asks")


def _proved(rows: pa.Table, path: pa.Table, run_levels: int, with_siblings: bool, schema: T.StructType) -> pa.Table:
    rows = rows.sort_by("pos")
    n, first = rows.column("n")[0].as_py(), rows.column("pos")[0].as_py()
    local = list(levels_above(rows.column("leaf").to_pylist(), n, run_levels))
    fetched = path.to_pylist()[0]
    steps, level, at, m = [], len(local) - 1, first >> (len(local) - 1), local[-1][0]
    upper = {(s["level"], s["idx"]): s["hash"] for s in fetched["siblings"] or ()}
    while m > 1:
        steps.append((upper.get((level, at ^ 1)), at & 1))
        level, at, m = level + 1, at >> 1, (m + 1) >> 1
    upper, level, at, m = {(s["level"], s["idx"]): s["hash"] for s in fetched["tail"] or ()}, 0, fetched["place"], fetched["trees"]
    while m > 1:
        steps.append((upper.get((level, at ^ 1)), at & 1))
        level, at, m = level + 1, at >> 1, (m + 1) >> 1
    shared = [h for h, _ in steps if h]
    proofs, folds, lists = [], [], []
    for i, (leaf, changed) in enumerate(zip(rows.column("leaf").to_pylist(), rows.column("tampered").to_pylist(), strict=True)):
        folded, siblings = changed or leaf, []
        for up, (_, nodes) in enumerate(local[:-1]):
            j = (i >> up) ^ 1
            if j >= len(nodes):
                folded = digest(folded)
                continue
            siblings.append(nodes[j])
            folded = digest(nodes[j], folded) if j & 1 == 0 else digest(folded, nodes[j])
        for sibling, right in steps:
            folded = digest(folded) if sibling is None else digest(sibling, folded) if right else digest(folded, sibling)
        siblings += shared
        proofs.append(digest(*siblings))
        folds.append(folded)
        lists.append(siblings)
    root = fetched["root"]
    out = [rows.column("doc_id"), rows.column("leaf"), pa.array([fetched["subroot"]] * len(folds)), pa.array([root] * len(folds)), pa.array(proofs), pa.array(folds), pa.array([f == root for f in folds])]
    return pa.table(out + [pa.array(lists, pa.list_(pa.string()))] * with_siblings, names=schema.names)


def leaves(docs: DataFrame, tampered: Column | None = None, changed: dict[str, Column] | None = None, fields: tuple = FIELDS, id_col: str = "doc_id", group_col: str = "lang") -> DataFrame:
    """doc_id, tree (the group as a key), leaf, tampered (the leaf with the ``changed`` fields where ``tampered`` holds), pos, n."""
    values = [F.col(c) for c in fields]
    other = F.when(tampered, leaf_hash([(changed or {}).get(c, F.col(c)) for c in fields])) if tampered is not None else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit(""))  # the null group sorts first
    rows = docs.select(F.col(id_col).alias("doc_id"), tree.alias("tree"), leaf_hash(values).alias("leaf"), other.alias("tampered"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "merkle-leaves")
    placed = materialize(ranked(rows, [F.col(c) for c in ("tree", "doc_id", "leaf", "row")], "rank"), "merkle-ranked")
    trees = materialize(placed.groupBy("tree").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")), "merkle-trees")
    placed = attach_groups(placed, trees, "tree", "n", F.col("row"))
    return placed.select("doc_id", "tree", "leaf", "tampered", (F.col("rank") - F.col("first")).alias("pos"), "n")


def manifest(docs: DataFrame, tampered: Column | None = None, changed: dict[str, Column] | None = None, fields: tuple = FIELDS, id_col: str = "doc_id", group_col: str = "lang", with_siblings: bool = False, run_levels: int = RUN_LEVELS) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; on wish the proof's siblings.

    The leaves of a group ascend by id (null first, equal ids by leaf); groups ascend bytewise, null
    first.  Two nodes make their parent, a last odd one makes its own; a lone leaf is its tree's root.
    ``tampered`` says which rows are folded from a leaf with the ``changed`` fields; null is no.
    Repeated rows are leaves each.  Empty input gives no rows; columns that are no field are ignored.
    """
    rows = leaves(docs, tampered, changed, fields, id_col, group_col).withColumn("part", F.shiftright("pos", run_levels))
    rows = materialize(rows, "merkle-placed")

    def build(key: tuple, run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("pos")
        up = list(levels_above(run["leaf"].tolist(), int(run["n"].iloc[0]), run_levels))
        out = [(key[0], key[1], len(up) - 1, key[1], up[-1][0], up[-1][1][0])]
        out += [(key[0], key[1], level, idx, None, None) for level, idx in missing_nodes(run["pos"].tolist(), int(run["n"].iloc[0]))]
        return pd.DataFrame(out, columns=["tree", "part", "level", "idx", "n", "hash"]).astype({"n": "Int64"})

    built = materialize(rows.select("tree", "part", "pos", "n", "leaf").groupBy("tree", "part").applyInPandas(build, "tree string, part long, level int, idx long, n long, hash string"), "merkle-built")
    nodes = climb(built.where("hash is not null").drop("part"), "merkle-nodes", run_levels)
    subroots = ranked(nodes.where("n = 1").select("tree", F.col("hash").alias("subroot")), [F.col("tree")], "place")
    subroots = materialize(subroots, "merkle-subroots")
    count = subroots.count()
    top = climb(subroots.select(F.lit("top").alias("tree"), F.lit(0).alias("level"), F.col("place").alias("idx"), F.lit(count).cast("long").alias("n"), F.col("subroot").alias("hash")), "merkle-top", run_levels)
    root = (top.where("n = 1").first() or {"hash": ""})["hash"]

    lacks = F.udf(lambda place: missing_nodes([place], count), "array<struct<level:int,idx:long>>")  # a row a tree
    tails = subroots.select("tree", "place", F.explode(lacks("place")).alias("w")).select(F.col("tree").alias("owner"), F.col("place").alias("part"), F.lit("top").alias("tree"), "w.level", "w.idx")
    sibling = F.struct("level", "idx", "hash")
    tails = fetch(tails, top).groupBy("owner").agg(F.collect_list(sibling).alias("tail"))
    parts = built.where("hash is not null").groupBy("tree").agg(F.count(F.lit(1)).alias("parts"))
    facts = materialize(subroots.join(parts, "tree").join(tails.withColumnRenamed("owner", "tree"), "tree", "left"), "merkle-facts")
    fetched = fetch(built.where("hash is null").select(F.col("tree").alias("owner"), "part", "tree", "level", "idx"), nodes).groupBy("owner", "part").agg(F.collect_list(sibling).alias("siblings"))
    own = built.where("hash is not null").select("tree", "part")
    own = own.join(fetched.select(F.col("owner").alias("tree"), "part", "siblings"), ["tree", "part"], "left")
    paths = attach_groups(own, facts, "tree", "parts").select("tree", "part", "siblings", "tail", "place", "subroot", F.lit(root).alias("root"), F.lit(count).alias("trees"))

    names = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", siblings array<string>" * with_siblings
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string(names).fields])
    return rows.groupBy("tree", "part").cogroup(paths.groupBy("tree", "part")).applyInArrow(lambda left, right: _proved(left, right, run_levels, with_siblings, schema), schema)

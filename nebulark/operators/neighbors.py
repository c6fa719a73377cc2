"""Neighbour search: radius and k nearest, exact on grids, by metric in blocks, approximate by cells.

Ties go to the smaller id everywhere; fewer rows than k give fewer neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nebulark.functions import geometry as G
from nebulark.functions.metrics import BLOCK_METRICS, LEAST, l2, nearest_l2
from nebulark.operators.pairs import range_pairs
from nebulark.plans.work import cut

AXES = G.AXES
#: Query vectors and vectors of a block: every block of the ones meets every block of the others.
QUERY_BLOCK = 1024
VECTOR_BLOCK = 8192
#: Blocks of vectors from which on a first look bounds the distances.
BOUNDED = 16
#: Components up to which, all finite, queries go only to the boxes within their reach, by metrics whose least distance to a box is known.
FEW = 4
#: Vectors from which on that pays.
BOXED = 100_000
#: Metrics whose nearest vectors a product of matrices finds, and the components beyond which that is quicker than a sum by column.
PRODUCTS, MOST_BY_COLUMN = ("l2", "so3", "l2_bytes"), 8
#: Vectors of a box, about, and of a task at most; boxes at most; vectors from which their borders are drawn, about.
BOX_ROWS, BOX_MOST, BOXES, BORDER_ROWS = 8192, 65_536, 4096, 131_072
#: Queries and vectors that a task of a meeting by key holds, about, and queries that it measures together.
MET_QUERIES, MET_ROWS, MET_TOGETHER = 4096, 32_768, 32
#: Rows of an index that a task files, about.
CELL_TASK_ROWS = 1_000_000


def radius_search(queries: DataFrame, points: DataFrame, r: float, closed: bool = True, periodic: bool = False) -> DataFrame:
    """(qid, id, d2) of points at distance <= r (``closed``) or < r of each query."""
    pairs = range_pairs(queries, points, r, closed=closed, periodic=periodic)
    return pairs.select(F.col("id1").alias("qid"), F.col("id2").alias("id"), G.square(tuple(F.col(c) for c in ("dx", "dy", "dz"))).alias("d2"))


def top_k(candidates: DataFrame, k: int, key: str = "qid", distance: str = "d2") -> DataFrame:
    """The k nearest of each query with their rank from 1."""
    order = Window.partitionBy(key).orderBy(distance, "id")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_within(queries: DataFrame, points: DataFrame, k: int, r: float, periodic: bool = False) -> DataFrame:
    """At most k neighbours nearer than r."""
    return top_k(radius_search(queries, points, r, closed=False, periodic=periodic), k)


def knn(queries: DataFrame, points: DataFrame, k: int, periodic: bool = False, first_radius: float | None = None) -> DataFrame:
    """Exact k nearest neighbours (qid, id, d2, rank) of points in the unit box.

    Rounds of range joins: a query with k points nearer than the radius is done, the others go on with
    twice the radius, so dense regions never see far points.  Queries that are left when the grid would
    have few cells (outliers, or k near the number of points) meet all points in blocks.
    """
    n = points.count()
    if n == 0 or k < 1:
        return radius_search(queries, points, 0.1).withColumn("rank", F.lit(1)).limit(0)
    r = first_radius or 1.3 * (3.0 * k / (4.0 * np.pi * n)) ** (1 / 3)
    done, left = None, queries
    while r < 1 / 3:
        found = cut(top_k(radius_search(left, points, r, closed=False, periodic=periodic), k))
        full = found.groupBy("qid").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min(k, n)).select("qid")
        found = found.join(full, "qid", "left_semi")
        done = found if done is None else done.unionByName(found)
        left = cut(left.join(full, F.col("id") == F.col("qid"), "left_anti"))
        if left.isEmpty():
            return done
        r *= 2
    as_vector = lambda df: df.select("id", F.array(*AXES).alias("embedding"))
    rest = vector_knn(as_vector(left), as_vector(points), k, "box" if periodic else "l2").withColumnRenamed("distance", "d2")
    return rest if done is None else done.unionByName(rest)


def ghosts(points: DataFrame, pad: float) -> DataFrame:
    """The points and their images within ``pad`` outside the unit box (at most 7 each), ids kept."""
    shifts = F.array(*[F.struct(*[F.lit(float(s)).alias(c) for s, c in zip(o, AXES, strict=True)]) for o in product((-1, 0, 1), repeat=3)])
    out = points.withColumn("__s", F.explode(shifts))
    out = out.withColumns({c: F.col(c) + F.col(f"__s.{c}") for c in AXES})
    inside = None
    for c in AXES:
        ok = (F.col(c) >= -pad) & (F.col(c) < 1.0 + pad)
        inside = ok if inside is None else inside & ok
    image = (F.col("__s.x") != 0) | (F.col("__s.y") != 0) | (F.col("__s.z") != 0)
    return out.where(inside).withColumn("ghost", image).drop("__s")


def _blocks(rows: DataFrame, n: int, *columns: str, first: int | None = None) -> DataFrame:
    """Rows packed into the arrays of ``n`` blocks by a hash of their id, one row a block; with ``first`` only so many blocks."""
    packed = [F.collect_list(c).alias(c) for c in columns]
    block = F.pmod(F.xxhash64("id"), F.lit(n))
    rows = rows if first is None else rows.where(block < first)
    return rows.groupBy(block.alias("block")).agg(*packed).drop("block")


def vector_knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2", where: Column | None = None, vector: str = "embedding", keep: tuple[str, ...] = (), per: str | None = None, most: int | None = None) -> DataFrame:
    """(qid, id, distance, rank) of the k nearest vectors of each query (id, embedding), by brute force.

    ``where`` filters the vectors before they are ranked.  Both sides are packed into blocks, every
    query block meets every vector block in some task, and a meeting keeps its own k best of each query;
    only those are ranked together.  Where there are many blocks of vectors, a first look at a few of them bounds each query's
    k-th distance from above, and a meeting keeps what is not beyond the bound.  ``per`` names a kept column of whose values each gives its own k, and with
    ``most`` only so many values a meeting, the nearest ones.  Ids keep their types.
    Metrics: l2 (squared), box (the same to nearest images in the unit box), l1, ip (1 - inner product),
    so2 (wrapped angle, one component), so3 (quaternions, as l2), l2_bytes, and those that were registered.  Null vectors are left out; ``keep`` columns come along.
    """
    pool = vectors if where is None else vectors.where(where)
    pool = pool.select("id", vector, *keep).where(F.col(vector).isNotNull())
    asked = queries.select("id", vector).where(F.col(vector).isNotNull())
    kinds = dict(pool.dtypes)
    schema = f"qid {dict(asked.dtypes)['id']}, id {kinds['id']}, distance double" + "".join(f", {c} {kinds[c]}" for c in keep)
    rows = pool.count()
    blocks, query_blocks = (max(1, -(-n // size)) for n, size in ((rows, VECTOR_BLOCK), (asked.count(), QUERY_BLOCK)))
    pool = pool.withColumn("__keep", F.struct(F.lit(1).alias("one"), *keep))
    asked = asked.withColumn("__bound", F.lit(float("inf")))

    distances = BLOCK_METRICS[metric]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].values for name in batch.schema.names}
                qid, at = row["qid"], row["id"].to_numpy(zero_copy_only=False)
                at = at.astype(str) if at.dtype == object else at
                matrix = lambda c, n: row[c].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
                q, v = matrix("__q", len(qid)), matrix(vector, len(at))
                kept = row["__keep"]
                bound = row["__bound"].to_numpy(zero_copy_only=False)
                if per is None and k > 0 and metric in PRODUCTS and v.shape[1] > MOST_BY_COLUMN:
                    who, place, near = nearest_l2(q, v, at, k)
                    within = ~(near > bound[who])
                    who, place, near = who[within], place[within], near[within]
                    columns = [qid.take(pa.array(who)), row["id"].take(pa.array(place)), pa.array(near)]
                    columns += [kept.field(c).take(pa.array(place)) for c in keep]
                    yield pa.RecordBatch.from_arrays(columns, names=["qid", "id", "distance", *keep])
                    continue
                d = distances(q, v)
                group = np.zeros(len(at), np.int64) if per is None else pd.factorize(kept.field(per).to_pandas(), use_na_sentinel=False)[0]
                who, place, full = [], [], range(len(qid))
                if per is None and np.isfinite(bound).any():
                    within = d <= bound[:, None]
                    full = np.flatnonzero(~np.isfinite(bound) | (within.sum(1) > k))
                    within[full] = False
                    who, place = ([x] for x in np.nonzero(within))
                for j in range(len(qid) if most else 0):
                    order = np.lexsort((at, d[j]))
                    g = group[order]
                    for c in g[np.sort(np.unique(g, return_index=True)[1])[:most]]:
                        place.append(order[g == c][:k])
                        who.append(np.full(len(place[-1]), j))
                for members in () if most else (np.flatnonzero(group == g) for g in np.unique(group)):
                    m = min(k, len(members))
                    for j in full:
                        one = d[j, members]
                        p = np.flatnonzero(one <= np.partition(one, m - 1)[m - 1])
                        p = members[p[np.lexsort((at[members[p]], one[p]))[:m]]]
                        place.append(p)
                        who.append(np.full(m, j))
                who, place = np.concatenate(who), np.concatenate(place)
                columns = [qid.take(pa.array(who)), row["id"].take(pa.array(place)), pa.array(d[who, place])]
                columns += [kept.field(c).take(pa.array(place)) for c in keep]
                yield pa.RecordBatch.from_arrays(columns, names=["qid", "id", "distance", *keep])

    def ranked(asked: DataFrame, first: int | None = None) -> DataFrame:
        q = _blocks(asked, query_blocks, "id", vector, "__bound").withColumnsRenamed({"id": "qid", vector: "__q"})
        v = _blocks(pool, blocks, "id", vector, "__keep", first=first)
        near = q.crossJoin(v).mapInArrow(best, schema)  # blocks of the query set x blocks of the vectors
        order = Window.partitionBy("qid", *([per] if per else [])).orderBy("distance", "id")
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    if per is None and not keep and metric in LEAST and rows >= BOXED and (size := _few(pool, asked, vector)):
        return _knn_in_boxes(asked, pool, k, metric, vector, size, rows)
    if per is None and blocks >= BOUNDED:
        last = ranked(asked, math.isqrt(blocks)).where((F.col("rank") == k) & ~F.isnan("distance"))
        last = cut(last.select("qid", F.col("distance").alias("__last")))
        asked = asked.join(last, asked["id"] == last["qid"], "left").select("id", vector, F.coalesce("__last", "__bound").alias("__bound"))
    return ranked(asked)


def _few(pool: DataFrame, asked: DataFrame, vector: str) -> int:
    """The number of components if all vectors have the same few and finite ones, else 0."""
    whole = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < math.inf))
    both = pool.select(vector).unionByName(asked.select(vector))
    r = both.agg(F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high"), F.min(whole).alias("whole")).first()
    return r["high"] if r["whole"] and 0 < r["low"] == r["high"] <= FEW else 0


def _borders(rows: np.ndarray, boxes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Axis, border and first child of the nodes of a tree that halves the rows along their widest side (-1: a box)."""
    axis, border, child, waiting = [0], [0.0], [-1], [(0, rows, boxes)]
    while waiting:
        at, part, n = waiting.pop()
        if n < 2 or len(part) < 2:
            continue
        axis[at] = a = int(np.ptp(part, axis=0).argmax())
        border[at] = x = float(np.partition(part[:, a], len(part) // 2)[len(part) // 2])
        right = part[:, a] >= x
        if right.all():  # the middle value is the least: it goes alone to the left
            above = part[part[:, a] > x, a]
            if not len(above):
                continue
            border[at] = x = float(above.min())
            right = part[:, a] >= x
        child[at] = len(child)
        for side, m in ((part[~right], n // 2), (part[right], n - n // 2)):
            axis.append(0)
            border.append(0.0)
            child.append(-1)
            waiting.append((len(child) - 1, side, m))
    return np.array(axis), np.array(border), np.array(child)


def _knn_in_boxes(asked: DataFrame, pool: DataFrame, k: int, metric: str, vector: str, size: int, rows: int) -> DataFrame:
    """Exact nearest vectors of few components: a query's own box bounds its k-th distance, and it goes on to the boxes within it.

    The boxes' borders come from a bounded sample, their extents from all vectors.  A crowded box is met in shares by tasks
    of their own, so a task's rows stay bounded.
    """
    spark = pool.sparkSession
    some = pool.where(F.pmod(F.xxhash64("id"), F.lit(max(1, rows // BORDER_ROWS))) == 0).select(F.col(vector).cast("array<double>").alias("v"))
    drawn = np.array([r["v"] for r in some.collect()], np.float64).reshape(-1, size)  # the sample
    tree = spark.sparkContext.broadcast(_borders(drawn, min(BOXES, max(1, rows // BOX_ROWS))))  # a row a box

    @F.pandas_udf("int")
    def home(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        axis, border, child = tree.value
        for s in batches:
            v = np.stack(s.to_numpy()).astype(np.float64)
            at = np.zeros(len(v), np.int64)
            open_ = np.flatnonzero(child[at] >= 0)
            while len(open_):
                n = at[open_]
                at[open_] = child[n] + (v[open_, axis[n]] >= border[n])
                open_ = open_[child[at[open_]] >= 0]
            yield pd.Series(at.astype(np.int32))

    filed = cut(pool.select("id", F.col(vector).cast("array<double>").alias("v")).withColumn("box", home("v")))
    sides = [f(F.col("v")[i]).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(size)]
    found = filed.groupBy("box").agg(F.count(F.lit(1)).alias("n"), *sides).collect()  # a row a box
    low, high = (np.array([[r[f"{n}{i}"] for i in range(size)] for r in found]) for n in ("low", "high"))
    extents = spark.sparkContext.broadcast((np.array([r["box"] for r in found]), low, high))
    shares = {r["box"]: -(-r["n"] // BOX_MOST) for r in found}
    kind = f"qid {dict(asked.dtypes)['id']}, id {dict(pool.dtypes)['id']}, distance double"
    distances, least = BLOCK_METRICS[metric], LEAST[metric]

    def best(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"qid": q["qid"][:0], "id": p["id"][:0], "distance": np.zeros(0)})]
        if len(q) and len(p):
            at, v, who = p["id"].to_numpy(), np.stack(p["v"].to_numpy()), q["qid"].to_numpy()
            asked, m = np.stack(q["v"].to_numpy()), min(k, len(p))
            for first in range(0, len(who), 64):
                d = distances(asked[first : first + 64], v)
                for j, one in enumerate(d, first):
                    near = np.flatnonzero(one <= np.partition(one, m - 1)[m - 1])
                    near = near[np.lexsort((at[near].astype(str) if at.dtype == object else at[near], one[near]))[:m]]
                    parts.append(pd.DataFrame({"qid": who[[j] * m], "id": at[near], "distance": one[near]}))
        return pd.concat(parts)

    def ranked(sent: DataFrame) -> DataFrame:
        ways = {r["box"]: -(-r["count"] // BOX_MOST) for r in sent.groupBy("box").count().collect()}  # a row a box
        crowded = [(b, w, shares.get(b, 1)) for b, w in ways.items() if w > 1 or shares.get(b, 1) > 1] or [(-1, 1, 1)]
        plan = F.broadcast(spark.createDataFrame(crowded, "box int, ways int, shares int"))  # a row a crowded box
        sides = []
        for rows, mine, other in ((sent, "way", "share"), (filed, "share", "way")):
            rows = rows.join(plan, "box", "left")
            n = {c: F.coalesce(f"{c}s", F.lit(1)) for c in ("way", "share")}
            rows = rows.withColumn(mine, F.pmod(F.xxhash64("qid" if mine == "way" else "id"), n[mine]).cast("int"))
            rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), n[other] - 1))).drop("ways", "shares")
            sides.append(rows.repartition(max(1, min(2000, len(found))), "box", "way", "share").groupBy("box", "way", "share"))
        return top_k(sides[0].cogroup(sides[1]).applyInPandas(best, kind), k, "qid", "distance")

    @F.pandas_udf("array<int>")
    def reached(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        boxes, low, high = extents.value
        for s, limit in batches:
            out = []
            for v, x in zip(s, limit, strict=True):
                out.append(boxes[least(v, low, high) * (1 - 1e-9) <= x].astype(np.int32))
            yield pd.Series(out)

    q = cut(asked.select(F.col("id").alias("qid"), F.col(vector).cast("array<double>").alias("v")))
    last = cut(ranked(q.withColumn("box", home("v"))).where(F.col("rank") == k).select("qid", F.col("distance").alias("limit")))
    limited = q.join(last, "qid", "left").withColumn("limit", F.nanvl(F.coalesce("limit", F.lit(math.inf)), F.lit(math.inf)))
    return ranked(cut(limited.select("qid", "v", F.explode(reached("v", "limit")).alias("box"))))


def within_distance(ranked: DataFrame, eps: float, least: int = 0, most: int | None = None) -> DataFrame:
    """Stop condition: neighbours at distance <= eps, at least ``least`` and at most ``most`` of them."""
    out = ranked.where((F.col("distance") <= eps) | (F.col("rank") <= least))
    return out if most is None else out.where(F.col("rank") <= most)


def until_documents(ranked: DataFrame, documents: int, doc: str = "label") -> DataFrame:
    """Stop condition: the closest vectors that cover ``documents`` distinct documents."""
    first = F.min("rank").over(Window.partitionBy("qid", doc))
    by_doc = ranked.withColumn("__first", first)
    order = Window.partitionBy("qid").orderBy("__first")
    return by_doc.withColumn("doc_rank", F.dense_rank().over(order)).where(F.col("doc_rank") <= documents).drop("__first")


def in_documents(queries: DataFrame, vectors: DataFrame, documents: int, doc: str = "label", vector: str = "embedding") -> DataFrame:
    """All vectors of the ``documents`` nearest documents of each query: qid, id, doc, distance, doc_rank, in squared L2.

    A document is as near as its nearest vector (ties: the smaller vector id).  A meeting of blocks keeps one
    row for each of a query's ``documents`` nearest documents: a document among the nearest of all is among
    those of the meeting that holds its nearest vector.  The vectors of the documents found are joined back.
    """
    near = vector_knn(queries, vectors, 1, "l2", vector=vector, keep=(doc,), per=doc, most=documents).drop("rank")
    return document_vectors(near, queries, vectors, documents, doc, vector)


def document_vectors(near: DataFrame, queries: DataFrame, vectors: DataFrame, documents: int, doc: str, vector: str) -> DataFrame:
    """All vectors of the ``documents`` nearest documents, from each query's nearest vector of each document (or of those that can matter)."""
    order = Window.partitionBy("qid").orderBy("distance", "id")
    first = near.withColumn("doc_rank", F.row_number().over(order)).where(F.col("doc_rank") <= documents).select("qid", F.col(doc).alias("__doc"), "doc_rank")
    asked = queries.select(F.col("id").alias("qid"), F.col(vector).alias("__q"))
    there = vectors.where(F.col(vector).isNotNull())
    buckets = max(1, -(-there.count() // MET_ROWS))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int").alias("key")
    sent = cut(first.join(asked, "qid").select(bucket("__doc"), "qid", "__q", F.col("__doc").alias("__at"), "doc_rank"))
    filed = there.select(bucket(doc), "id", F.col(vector).alias("__v"), F.col(doc).alias("__in"), F.col(doc).alias(doc))

    def same(q: pa.Table, v: pa.Table, d: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ends = pa.chunked_array([*q["__at"].chunks, *v["__in"].chunks]).to_pandas()
        code = pd.factorize(ends, use_na_sentinel=False)[0]
        ask, have = code[: len(q)], code[len(q) :]
        members = np.argsort(have, kind="stable")
        upto = np.searchsorted(have[members], np.arange(code.max() + 2))
        for one in np.unique(ask):
            who, place = np.flatnonzero(ask == one), members[upto[one] : upto[one + 1]]
            for i in range(0, len(who), MET_TOGETHER):
                some = who[i : i + MET_TOGETHER]
                yield np.repeat(some, len(place)), np.tile(place, len(some)), d(some, place).ravel()

    return in_meetings(sent, filed, same, ("qid", "doc_rank"), ("id", doc)).select("qid", "id", doc, "distance", "doc_rank")


def in_meetings(sent: DataFrame, filed: DataFrame, choose: Callable, ask: tuple[str, ...], have: tuple[str, ...]) -> DataFrame:
    """Queries (key, __q and more) meet vectors (key, __v and more) of their key in tasks of bounded sizes.

    ``choose`` gets a task's queries, vectors and the squared distances of any of them to any of these, and yields (query, vector, distance)
    in parts; the result has the columns ``ask`` of the queries and ``have`` of the vectors, and distance.
    """
    spark = sent.sparkSession
    asks, rows = ({r["key"]: r["count"] for r in side.groupBy("key").count().collect()} for side in (sent, filed))  # a row a key
    plan = [(k, -(-n // MET_QUERIES), -(-rows[k] // MET_ROWS)) for k, n in asks.items() if k in rows]
    plan = F.broadcast(spark.createDataFrame(plan, "key int, ways int, shares int"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    sent = sent.join(plan, "key").withColumn("way", F.pmod(F.xxhash64("qid"), "ways").cast("int")).withColumn("share", every("shares"))
    filed = filed.join(plan, "key").withColumn("share", F.pmod(F.xxhash64("id"), "shares").cast("int")).withColumn("way", every("ways"))
    drop = ("ways", "shares")
    both = sent.drop(*drop).withColumn("__asks", F.lit(True)).unionByName(filed.drop(*drop).withColumn("__asks", F.lit(False)), allowMissingColumns=True)
    kinds = dict(both.dtypes)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        asking = table["__asks"].to_numpy()
        q, v = (table.filter(pa.array(m)).combine_chunks() for m in (asking, ~asking))
        if not len(q) or not len(v):
            return
        a, b = (np.ascontiguousarray(pc.list_flatten(t[c]).to_numpy()).astype(np.float64).reshape(len(t), -1) for t, c in ((q, "__q"), (v, "__v")))
        d = lambda who, place: BLOCK_METRICS["l2"](a[who], b[place])
        columns = [*[q[c].combine_chunks() for c in ask], *[v[c].combine_chunks() for c in have]]
        for who, place, distance in choose(q, v, d):
            taken = [c.take(pa.array(who if i < len(ask) else place)) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(distance)], names=[*ask, *have, "distance"])

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in (*ask, *have)], "distance double"])
    return both.groupBy("key", "way", "share").applyInArrow(meet, schema)


def octree_leaves(points: DataFrame, cap: int = 16, levels: int = 10) -> DataFrame:
    """(level, path, n): octants with at most ``cap`` points (or at the deepest level) whose parent has more.

    All levels are counted in one aggregation of path prefixes.
    """
    path = G.morton(levels)
    prefixes = F.array(*[F.struct(F.lit(v).alias("level"), F.shiftright("path", 3 * (levels - v)).alias("path")) for v in range(levels + 1)])
    cells = points.select(path.alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    counts = cells.select(F.explode(prefixes).alias("c"), "n").groupBy(F.col("c.level").alias("level"), F.col("c.path").alias("path")).agg(F.sum("n").alias("n"))
    parents = counts.where(F.col("n") > cap).select((F.col("level") + 1).alias("pl"), F.col("path").alias("pp"))
    leaves = counts.where((F.col("n") <= cap) | (F.col("level") == levels))
    inner = leaves.join(parents, (F.col("level") == F.col("pl")) & (F.shiftright("path", 3) == F.col("pp")), "left")
    return inner.where(F.col("pl").isNotNull() | (F.col("level") == 0)).select("level", "path", "n")


def bucketed(points: DataFrame, buckets: int) -> DataFrame:
    """Points range-partitioned on their octant path: files of a write hold near points and prune by min and max."""
    return points.withColumn("path", G.morton(16)).repartitionByRange(buckets, "path").sortWithinPartitions("path")


def train_cells(vectors: DataFrame, cells: int, rounds: int = 8, sample: int = 20_000, vector: str = "embedding", seed: int = 7) -> np.ndarray:
    """Centroids of an inverted-file index by k-means on a bounded sample of the vectors (``sample`` rows)."""
    rows = vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64("id", F.lit(seed))).limit(sample).select(vector)
    v = np.array([r[0] for r in rows.collect()], np.float64)  # the sample
    if not len(v):
        return np.zeros((0, 0))
    r = np.random.default_rng(seed)
    centres = v[r.choice(len(v), min(cells, len(v)), replace=False)]
    for _ in range(rounds):
        near = ((v[:, None, :] - centres[None]) ** 2).sum(2).argmin(1) if len(v) * len(centres) < 1e7 else np.array([((centres - x) ** 2).sum(1).argmin() for x in v])
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = v[near == c].mean(0)
    return centres


def nearest_cells(vectors: DataFrame, centres: np.ndarray, probe: int, vector: str = "embedding") -> DataFrame:
    """Each vector with its ``probe`` nearest centroids, nearest first, as column cells."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            d = BLOCK_METRICS["l2"](np.array(s.tolist(), np.float64), shared.value)
            yield pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :probe].astype(np.int32)))

    return vectors.withColumn("cells", nearest(F.col(vector)))


def with_cells(vectors: DataFrame, centres: np.ndarray, probe: int, vector: str = "embedding") -> DataFrame:
    """Each vector once for each of its ``probe`` nearest centroids, as column cell."""
    return nearest_cells(vectors, centres, probe, vector).withColumn("cell", F.explode("cells")).drop("cells")


def _probe(queries: DataFrame, centres: np.ndarray, probe: int, vector: str) -> DataFrame:
    q = nearest_cells(queries.select(F.col("id").alias("qid"), F.col(vector).alias("q")).where("q is not null"), centres, probe, "q")
    return q.withColumn("cell", F.explode("cells"))


def _filed(vectors: DataFrame, centres: np.ndarray, homes: int, vector: str, keep: tuple[str, ...] = ()) -> DataFrame:
    p = nearest_cells(vectors.select("id", vector, *keep).where(F.col(vector).isNotNull()), centres, homes, vector).withColumnRenamed("cells", "homes")
    return p.withColumn("cell", F.explode("homes"))


def _write_cells(filed: DataFrame, centres: np.ndarray, rows: int, path: str, vector: str) -> None:
    """Folders a cell, and beside them how far the vectors whose nearest centroid a cell has lie from it.

    A cell's rows go to as many tasks as they may need, by a salt of the id.
    """
    salt = F.pmod(F.xxhash64("id"), F.lit(max(1, rows // CELL_TASK_ROWS)))
    filed.repartition("cell", salt).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    spark = filed.sparkSession
    middle = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "__c int, centre array<double>")  # a row a cell
    own = spark.read.parquet(f"{path}/cells").where(F.col("homes")[0] == F.col("cell")).join(F.broadcast(middle), F.col("cell") == F.col("__c"))
    own.groupBy("cell").agg(F.max(F.sqrt(l2(F.col(vector), F.col("centre")))).alias("radius")).write.mode("overwrite").parquet(f"{path}/radii")


def _nearest_filed(q: DataFrame, p: DataFrame, k: int, vector: str) -> DataFrame:
    near = q.join(p, "cell").where(F.col("cell") == F.array_intersect("homes", "cells")[0])
    near = near.select("qid", "id", l2(F.col("q"), F.col(vector)).alias("distance"))
    order = Window.partitionBy("qid").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ivf_knn(queries: DataFrame, vectors: DataFrame, k: int, centres: np.ndarray, probe: int, vector: str = "embedding", homes: int = 2) -> DataFrame:
    """Approximate (qid, id, distance, rank): exact squared distances inside the probed cells; every vector is indexed.

    A vector is filed in its ``homes`` nearest cells, so one near a border is found from either
    side.  A pair that shares several cells is kept in the first of them, without a distinct.
    """
    if not len(centres):
        return vector_knn(queries, vectors, k, "l2", vector=vector)
    return _nearest_filed(_probe(queries, centres, probe, vector), _filed(vectors, centres, homes, vector), k, vector)


def save_index(vectors: DataFrame, centres: np.ndarray, path: str, homes: int = 2, vector: str = "embedding", keep: tuple[str, ...] = ()) -> None:
    """An inverted file on storage: ``path``/centres, and the filed vectors in ``path``/base/cells, a folder a cell.

    ``keep`` columns are filed along.
    """
    spark = vectors.sparkSession
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")
    _write_cells(_filed(vectors, centres, homes, vector, keep), centres, vectors.count() * homes, f"{path}/base", vector)


def load_centres(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])  # a row a cell


def add_to_index(vectors: DataFrame, path: str, batch: str, homes: int = 2, vector: str = "embedding", keep: tuple[str, ...] = ()) -> None:
    """File new vectors under the saved centres, as a batch that takes its own place when it is written again."""
    centres = load_centres(vectors.sparkSession, path)
    _write_cells(_filed(vectors, centres, homes, vector, keep), centres, vectors.count() * homes, f"{path}/added/{batch}", vector)


def delete_from_index(ids: DataFrame, path: str, batch: str) -> None:
    """Tombstones: these ids are left out of every search."""
    ids.select("id").write.mode("overwrite").parquet(f"{path}/deleted/{batch}")


def _folders(spark: SparkSession, path: str) -> list[str]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().toString() for x in fs.listStatus(root)] if fs.exists(root) else []


def filed_vectors(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a saved index, the base and the batches less what was deleted; a condition on cell leaves folders out."""
    filed = spark.read.parquet(f"{path}/base/cells")
    for batch in _folders(spark, f"{path}/added"):
        filed = filed.unionByName(spark.read.parquet(f"{batch}/cells"))
    if gone := _folders(spark, f"{path}/deleted"):
        ids = spark.read.parquet(*gone).select(F.col("id").alias("__gone")).distinct()
        filed = filed.join(ids, F.col("id") == F.col("__gone"), "left_anti")
    return filed


def cell_radii(spark: SparkSession, path: str, cells: int) -> np.ndarray:
    """How far the vectors of each cell lie from its centroid at most; -1 for a cell that is nobody's nearest."""
    out = np.full(cells, -1.0)
    for part in (f"{path}/base", *_folders(spark, f"{path}/added")):
        for r in spark.read.parquet(f"{part}/radii").collect():  # a row a cell
            out[r["cell"]] = max(out[r["cell"]], r["radius"])
    return out


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, probe: int, vector: str = "embedding") -> DataFrame:
    """The k nearest of each query in a saved index; the folders of cells that no query probes are not read."""
    return _nearest_filed(_probe(queries, load_centres(spark, path), probe, vector), filed_vectors(spark, path), k, vector)


def in_degrees(neighbours: DataFrame) -> DataFrame:
    """(id, n): how often each point is a neighbour; with self links and repeated links as checks."""
    return neighbours.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("id") == F.col("qid"), 1).otherwise(0)).alias("self_links"), (F.count(F.lit(1)) - F.countDistinct("qid")).alias("repeats"))

"""Registered queries of structures: splits that follow the data, the levelled table, tiled transforms, column files, metrics by name."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from nebulark.functions import metrics
from nebulark.functions.geometry import AXES
from nebulark.operators import fft, graph, levels, mesh, neighbors, splits
from nebulark.plans.fixtures import view, view_sql
from nebulark.plans.queries import ORACLE, N, _asked, _delta, _knn_sql, _rounded, _vec_sql, _vectors, d, query, rs
from nebulark.plans.work import work_path
from nebulark.sources import tables

# ---- splits: halos drawn towards a corner of the box, so that equal cells hold very unequal numbers

_CUBED = f"{view_sql('halos')}, c AS (SELECT id, x*x*x AS x, y*y*y AS y, z*z*z AS z FROM halos)"


def _cubed(spark, sf_dir):
    return view(spark, sf_dir, "halos").select("id", *[(F.col(c) * F.col(c) * F.col(c)).alias(c) for c in AXES])


CAP = 24
_SIDES = ", ".join(f"min({c}) OVER w AS low_{c}, max({c}) OVER w AS high_{c}" for c in AXES)
_WIDEST = "CASE WHEN high_x - low_x >= high_y - low_y AND high_x - low_x >= high_z - low_z THEN 'x' WHEN high_y - low_y >= high_z - low_z THEN 'y' ELSE 'z' END"
_HALF = " ".join(f"WHEN '{c}' THEN CAST({c} >= CASE WHEN (low_{c} + high_{c})/2 > low_{c} THEN (low_{c} + high_{c})/2 ELSE high_{c} END AS INT)" for c in AXES)
_SPLIT = f"""WITH RECURSIVE {_CUBED}, t AS (SELECT id, x, y, z, CAST('' AS VARCHAR) AS path, count(*) OVER w AS n, {_SIDES} FROM c WINDOW w AS (PARTITION BY 1)
    UNION ALL SELECT id, x, y, z, path, count(*) OVER w AS n, {_SIDES} FROM (SELECT id, x, y, z, path || CASE {_WIDEST} {_HALF} END AS path FROM t WHERE n > {CAP} AND (high_x > low_x OR high_y > low_y OR high_z > low_z)) u WINDOW w AS (PARTITION BY path)),
    f AS (SELECT * FROM t WHERE n <= {CAP} OR NOT (high_x > low_x OR high_y > low_y OR high_z > low_z))"""


@query("split_points", f"{_SPLIT} SELECT id, path FROM f")
def split_points(spark, sf_dir):
    """The box of each point; the top of the tree is grown over the data, the rest inside tasks."""
    return splits.split(_cubed(spark, sf_dir), CAP, 1000).select("id", "path")


_ROUNDED = [f"{n}_{c}" for n in ("low", "high") for c in AXES]


@query("split_leaves", f"{_SPLIT} SELECT path, n, {', '.join(f'{rs(f'any_value({c})', 12)} AS {c}' for c in _ROUNDED)} FROM f GROUP BY path, n")
def split_leaves(spark, sf_dir):
    return _rounded(splits.leaves(splits.split(_cubed(spark, sf_dir), CAP, 1000)), *_ROUNDED, digits=12)


@query("split_radius", f"WITH {_CUBED}, t AS (SELECT q.id AS qid, p.id, (q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z) AS d2 FROM c q, c p WHERE q.id % 100 = 0) SELECT qid, id, {rs('d2', 9)} AS d2 FROM t WHERE d2 <= {d(0.05 * 0.05)}")
def split_radius(spark, sf_dir):
    """Radius search of clustered points by boxes of like numbers of points."""
    points = _cubed(spark, sf_dir)
    return _rounded(splits.radius_search(_asked(points), points, 0.05, task_points=2000), "d2", digits=9)


# ---- a table that changes


@query("levels_knn", _knn_sql(10, "(p.id % 7 <> 0 OR p.id % 21 = 0)"))
def levels_knn(spark, sf_dir):
    """Neighbours in a levelled table: batches, a deletion, and rows that come back after it."""
    halos = view(spark, sf_dir, "halos").select("id", "x", "y", "z")
    table = levels.Levels(spark, work_path(spark, "levels"), least=500)
    for k in range(3):
        table.add(halos.where(F.col("id") % 3 == k))
    table.delete(halos.where("id % 7 = 0"))
    table.add(halos.where("id % 21 = 0"))
    return _rounded(neighbors.knn(_asked(halos), table.read(), 10), "d2", digits=9)


@query("levels_replace", f"WITH {view_sql('halos')} SELECT id, CASE WHEN id % 11 = 0 THEN mvir * 2 ELSE mvir END AS mvir FROM halos WHERE id % 7 <> 0 OR id % 11 = 0")
def levels_replace(spark, sf_dir):
    """Rows deleted, rows that take the place of others, and all merged into one part."""
    halos = view(spark, sf_dir, "halos").select("id", "mvir")
    table = levels.Levels(spark, work_path(spark, "levels"), least=500)
    table.add(halos)
    table.delete(halos.where("id % 7 = 0"))
    table.add(halos.where("id % 11 = 0").withColumn("mvir", F.col("mvir") * 2), instead=True)
    table.compact()
    return table.read()


# ---- transforms in tiles

for _layout in fft.TILED:

    @query(f"dft_{_layout}", ORACLE["dft_modes"])
    def dft_tiled(spark, sf_dir, layout=_layout):
        return _rounded(fft.forward(mesh.contrast(_delta(spark, sf_dir), N), N, layout), "re", "im")


# ---- column files


@query("zip_columns", f"WITH {view_sql('halos')} SELECT row_number() OVER (ORDER BY id) - 1 AS position, id, {', '.join(f'{rs(c, 9)} AS {c}' for c in AXES)}, vz, mvir FROM halos")
def zip_columns(spark, sf_dir):
    """Positions, velocities and masses in tables of their own, cut into files differently, side by side by place."""
    path = work_path(spark, "columns")
    halos = view(spark, sf_dir, "halos")
    for name, files, columns in (("pos", 4, ["id", *AXES]), ("vel", 3, ["vz"]), ("mass", 1, ["mvir"])):
        halos.repartitionByRange(files, "id").sortWithinPartitions("id").select(*columns).write.parquet(f"{path}/{name}")
    return _rounded(tables.zip_columns(spark, *[f"{path}/{n}" for n in ("pos", "vel", "mass")]), *AXES, digits=9)


# ---- metrics by name


def _nearest_sql(distance: str, digits: int = 9) -> str:
    return f"t AS (SELECT q.id AS qid, p.id, {distance} AS distance FROM v q, v p WHERE q.id % 100 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM t) SELECT qid, {rs('distance', digits)} AS distance, CAST(rank AS INT) AS rank FROM k WHERE rank <= 5"


_TURN = [f"sin(pi()*x)*cos({d(2 * math.pi)}*y)", f"sin(pi()*x)*sin({d(2 * math.pi)}*y)", f"cos(pi()*x)*cos({d(2 * math.pi)}*z)", f"cos(pi()*x)*sin({d(2 * math.pi)}*z)"]


@query("knn_so3", f"WITH {view_sql('halos')}, v AS (SELECT id, {', '.join(f'{e} AS q{i}' for i, e in enumerate(_TURN))} FROM halos), {_nearest_sql(' + '.join(f'(q.q{i} - p.q{i})*(q.q{i} - p.q{i})' for i in range(4)))}")
def knn_so3(spark, sf_dir):
    """Nearest rotations, as unit quaternions."""
    v = view(spark, sf_dir, "halos").select("id", F.expr(f"array({', '.join(_TURN)})").alias("embedding"))
    return _rounded(neighbors.vector_knn(_asked(v), v, 5, "so3").select("qid", "distance", "rank"), "distance", digits=9)


def _largest(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    columns = np.ascontiguousarray(v.T)
    return np.array([np.maximum.reduce([np.abs(c - x) for c, x in zip(columns, row, strict=True)]) for row in q]).reshape(len(q), len(v))


def _largest_gap(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.maximum(np.maximum(low - row, row - high), 0.0).max(1)


@query("knn_registered", f"WITH {view_sql('halos')}, v AS (SELECT id, x, y, z FROM halos), {_nearest_sql('greatest(abs(q.x - p.x), abs(q.y - p.y), abs(q.z - p.z))')}")
def knn_registered(spark, sf_dir):
    """Nearest by a metric of the caller's own: the largest difference of a component."""
    metrics.register_metric("largest", _largest, _largest_gap)
    v = view(spark, sf_dir, "halos").select("id", F.array(*AXES).alias("embedding"))
    return _rounded(neighbors.vector_knn(_asked(v), v, 5, "largest").select("qid", "distance", "rank"), "distance", digits=9)


@query("knn_bytes", f"WITH {view_sql('halos')}, v AS (SELECT id, {', '.join(f'CAST(floor({c}*256) AS INT) AS {c}' for c in AXES)} FROM halos), {_nearest_sql(' + '.join(f'(q.{c} - p.{c})*(q.{c} - p.{c})' for c in AXES))}")
def knn_bytes(spark, sf_dir):
    """Nearest vectors of small integers."""
    v = view(spark, sf_dir, "halos").select("id", F.array(*[F.floor(F.col(c) * 256).cast("short") for c in AXES]).alias("embedding"))
    return _rounded(neighbors.vector_knn(_asked(v), v, 5, "l2_bytes").select("qid", "distance", "rank"), "distance", digits=9)


# ---- the neighbour graph


_OTHERS = _vec_sql("l2", "q.id <> p.id")
_FOUND = f"SELECT qid, count(*) AS wanted, CAST(sum(id) AS BIGINT) AS ids, {rs('max(distance)')} AS reach, true AS enough FROM k WHERE rank <= 10 GROUP BY qid"


def _held_against(exact, found):
    """The exact neighbours of each query, and whether nine in ten of all of them were found."""
    sides = exact.join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    share = sides.agg((F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))
    each = sides.groupBy("qid").agg(F.count(F.lit(1)).alias("wanted"), F.sum("id").alias("ids"), F.max("distance").alias("reach"))
    return _rounded(each.crossJoin(F.broadcast(share)), "reach")  # one row


@query("graph_recall", f"{_OTHERS} {_FOUND}")
def graph_recall(spark, sf_dir):
    """Links of the descended graph against the exact neighbours."""
    asked, v = _vectors(spark, sf_dir)
    exact = neighbors.top_k(neighbors.vector_knn(asked, v, 11).drop("rank").where("qid <> id"), 10, "qid", "distance")
    return _held_against(exact, graph.build(v, 10).withColumnsRenamed({"src": "qid", "dst": "id"}))


@query("graph_search", f"{_vec_sql('l2')} {_FOUND}")
def graph_search(spark, sf_dir):
    """A search along the graph's diverse links, by a beam, against the exact neighbours."""
    asked, v = _vectors(spark, sf_dir)
    links = graph.both_ways(graph.build(v, 16), v, 16)
    return _held_against(neighbors.vector_knn(asked, v, 10), graph.search(asked, links, v, 10, width=64))


_SOUND = "CAST(0 AS BIGINT) AS own, CAST(0 AS BIGINT) AS twice, CAST(0 AS BIGINT) AS loose"


@query("graph_degrees", f"SELECT count(*) AS vectors, 10*count(*) AS links, CAST(10 AS BIGINT) AS least_out, CAST(10 AS BIGINT) AS most_out, CAST(10 AS DOUBLE) AS mean_in, {_SOUND} FROM embeddings")
def graph_degrees(spark, sf_dir):
    """The descended graph is whole: ten links out of each vector, none to itself, twice or to nothing."""
    v = view(spark, sf_dir, "vectors")
    return graph.degrees(graph.build(v, 10), v).drop("least_in", "most_in")


@query(
    "knn_degrees",
    f"""{_vec_sql('l2').replace('q AS (SELECT * FROM v WHERE id % 100 = 0)', 'q AS (SELECT * FROM v)').replace('WHERE true', 'WHERE q.id <> p.id')}, l AS (SELECT id, count(*) AS n FROM k WHERE rank <= 10 GROUP BY 1), o AS (SELECT qid, count(*) AS n FROM k WHERE rank <= 10 GROUP BY 1),
    a AS (SELECT coalesce(l.n, 0) AS n_in, o.n AS n_out FROM embeddings e LEFT JOIN l ON l.id = e.vec_id JOIN o ON o.qid = e.vec_id)
    SELECT count(*) AS vectors, CAST(sum(n_out) AS BIGINT) AS links, min(n_out) AS least_out, max(n_out) AS most_out, min(n_in) AS least_in, max(n_in) AS most_in, sum(n_in)/CAST(count(*) AS DOUBLE) AS mean_in, {_SOUND} FROM a""",
)
def knn_degrees(spark, sf_dir):
    """Degrees of the exact graph of ten neighbours."""
    v = view(spark, sf_dir, "vectors")
    near = neighbors.vector_knn(v, v, 11).drop("rank").where("qid <> id")
    return graph.degrees(neighbors.top_k(near, 10, "qid", "distance").withColumnsRenamed({"qid": "src", "id": "dst"}), v)

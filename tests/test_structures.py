"""Splits that follow the data, the levelled table, tiled transforms, column files and registered metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nebulark.functions import metrics
from nebulark.operators import catalog, fft, levels, neighbors, splits
from nebulark.sources import tables


def placed(spark, points):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, x double, y double, z double")


@pytest.mark.parametrize("task_points", [40, 10_000])
def test_boxes_do_not_depend_on_where_they_are_cut(spark, task_points):
    points = catalog.corner_clusters(spark, 400)
    got = {r.id: r.path for r in splits.split(points, 8, task_points).collect()}
    assert got == {r.id: r.path for r in splits.split(points, 8, 100).collect()} and len(got) == 800
    rows = splits.leaves(splits.split(points, 8, task_points)).collect()
    assert max(r.n for r in rows) <= 8 and sum(r.n for r in rows) == 800
    whole = {r.path for r in rows}
    assert not any(p[:k] in whole for p in whole for k in range(len(p)))


def test_points_at_one_place_stay_one_box_and_broken_ones_go(spark):
    points = placed(spark, [(0.5, 0.5, 0.5)] * 200 + [(0.1, 0.2, 0.3)] * 3 + [(0.5, 0.5, np.nextafter(0.5, 1))])
    points = points.unionByName(spark.createDataFrame([(900, None, 0.1, 0.1), (901, float("nan"), 0.1, 0.1)], points.schema))
    rows = splits.leaves(splits.split(points, 5, 50)).collect()
    assert sorted(r.n for r in rows) == [1, 3, 200]
    assert splits.split(points.where("false"), 5).count() == 0


def test_radius_search_by_boxes_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(splits, "TASK_QUERIES", 50)  # busy boxes are searched by several tasks
    r = np.random.default_rng(4)
    xyz = np.concatenate([0.02 * r.random((300, 3)), r.random((100, 3)), np.repeat([[0.5, 0.5, 0.5]], 150, axis=0)])
    points = placed(spark, xyz)
    got = sorted((x.qid, x.id) for x in splits.radius_search(points, points, 0.01, 8, 60).collect())
    d = xyz[:, None] - xyz[None]
    want = np.argwhere((d[..., 0] ** 2 + d[..., 1] ** 2 + d[..., 2] ** 2) <= 0.01 * 0.01)
    assert got == [tuple(w) for w in want.tolist()]
    assert splits.radius_search(points, points.where("false"), 0.1).count() == 0
    assert splits.radius_search(points.where("false"), points, 0.1).count() == 0


def test_what_a_radius_search_finds_leaves_a_task_in_parts(spark, monkeypatch):
    monkeypatch.setattr(splits, "MEASURED", 700)
    monkeypatch.setattr(splits, "TASK_PAIRS", 9000)
    monkeypatch.setattr(splits, "TOP_BOXES", 3)
    r = np.random.default_rng(9)
    xyz = np.concatenate([r.random((400, 3)) ** 3, np.repeat([[0.1, 0.1, 0.1]], 120, axis=0)])
    points = placed(spark, xyz)
    got = splits.radius_search(points.where("id % 3 = 0"), points, 0.2, 8, 20).collect()
    d = xyz[:, None] - xyz[None]
    d2 = d[..., 0] ** 2 + d[..., 1] ** 2 + d[..., 2] ** 2
    assert sorted((x.qid, x.id) for x in got) == [tuple(w) for w in np.argwhere(d2 <= 0.2 * 0.2).tolist() if w[0] % 3 == 0]
    assert all(x.d2 == d2[x.qid, x.id] for x in got)


def test_levels_against_a_dictionary(spark, tmp_path):
    table, want, r = levels.Levels(spark, f"file://{tmp_path}/t", least=20), {}, np.random.default_rng(2)
    with pytest.raises(ValueError):
        table.read()
    for step in range(9):
        ids = sorted({int(i) for i in r.integers(0, 120, 30)})
        if step % 3 == 2:
            table.delete(spark.createDataFrame([(i,) for i in ids] + [(None,)], "id long"))
            want = {k: v for k, v in want.items() if k not in ids}
        else:
            table.add(spark.createDataFrame([(i, step) for i in ids], "id long, step int"), instead=True)
            want |= dict.fromkeys(ids, step)
        assert {x.id: x.step for x in table.read().collect()} == want
        at = [table.level(p) for p in table.parts() if not p.deletion]
        assert len(at) == len(set(at))  # a part a level
    table.compact()
    assert len(table.parts()) == 1 and table.parts()[0].rows == len(want)
    assert table.expire() > 0 and {x.id: x.step for x in table.read().collect()} == want
    assert table.expire() == 0


def test_a_change_that_fails_is_not_seen(spark, tmp_path):
    table = levels.Levels(spark, f"file://{tmp_path}/t", least=20)
    table.add(spark.range(10))
    broken = spark.range(10, 20).select(F.when(F.col("id") == 19, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        table.add(broken)
    assert table.version() == 1 and table.read().count() == 10
    table.add(spark.range(10, 20))
    assert table.read().count() == 20


def test_a_second_writer_is_refused(spark, tmp_path):
    table = levels.Levels(spark, f"file://{tmp_path}/t", least=20)
    table.add(spark.range(10))
    number, parts = table._next()
    table.add(spark.range(10, 20))
    with pytest.raises(Exception, match="(?i)exists"):
        table._commit(number, parts)
    assert table.read().count() == 20


@pytest.mark.parametrize("layout", fft.TILED)
@pytest.mark.parametrize("n", [5, 6])
def test_tiled_transform_equals_numpy(spark, layout, n, monkeypatch):
    monkeypatch.setattr(fft, "TILE_CELLS", 30)  # tiles that do not divide the axes
    values = np.random.default_rng(1).normal(size=(2, n, n, n))
    rows = [(b, *map(int, i), float(values[(b, *i)])) for b in range(2) for i in np.ndindex(n, n, n)]
    field = spark.createDataFrame(rows, "b int, ix int, iy int, iz int, val double")
    modes = fft.forward(field, n, layout, "b")
    want = np.fft.fftn(values, axes=(1, 2, 3))
    got = modes.collect()
    assert len(got) == 2 * n**3
    assert all(abs(want[m.b, m.ix, m.iy, m.iz] - (m.re + 1j * m.im)) < 1e-9 for m in got)
    back = fft.inverse(modes, n, layout, "b").collect()
    assert all(abs(x.re / n**3 - values[x.b, x.ix, x.iy, x.iz]) < 1e-9 for x in back)


def test_zipped_columns_are_not_broadcast(spark, tmp_path):
    """A column that packs well has small files but many rows: it moves by position, never whole through the driver."""
    for name in ("a", "b"):
        spark.range(1000).select((F.col("id") % 3).alias(name)).write.parquet(f"{tmp_path}/{name}")
    plan = tables.zip_columns(spark, f"{tmp_path}/a", f"{tmp_path}/b")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [position" not in plan and "SortMergeJoin [position" in plan


def test_column_files_are_zipped_by_place(spark, tmp_path):
    rows = spark.range(1000).select("id", (F.col("id") * 2).alias("twice"), F.lit(1).alias("id2"))
    for name, files in (("id", 5), ("twice", 3)):
        rows.repartitionByRange(files, "id").sortWithinPartitions("id").select(name).write.parquet(f"{tmp_path}/{name}")
    out = tables.zip_columns(spark, f"{tmp_path}/id", f"{tmp_path}/twice")
    assert out.where("twice = 2 * id and position = id").count() == 1000
    rows.limit(999).select("id2").write.parquet(f"{tmp_path}/short")
    with pytest.raises(ValueError, match="999"):
        tables.zip_columns(spark, f"{tmp_path}/id", f"{tmp_path}/short")
    with pytest.raises(ValueError, match="share"):
        tables.zip_columns(spark, f"{tmp_path}/id", f"{tmp_path}/id")


def test_a_registered_metric_is_used(spark, monkeypatch):
    monkeypatch.setattr(metrics, "BLOCK_METRICS", metrics.BLOCK_METRICS)
    metrics.register_metric("first", lambda q, v: np.abs(q[:, :1] - v[None, :, 0]))
    v = spark.createDataFrame([(i, [float(i), float(-i)]) for i in range(20)], "id long, embedding array<double>")
    got = neighbors.vector_knn(v.where("id = 4"), v, 3, "first").collect()
    assert sorted(x.id for x in got) == [3, 4, 5]
    with pytest.raises(KeyError):
        neighbors.vector_knn(v, v, 3, "none such")

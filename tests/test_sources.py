import random

import numpy as np
from pyspark.sql import functions as F

from nebulark.operators import mesh, ordering
from nebulark.sources import snapshot, tables
from nebulark.streaming import mesh as streams


def test_snapshot_round_trip(spark, tmp_path):
    snapshot.register(spark)
    r = random.Random(1)
    rows = [(2**40 + i, r.uniform(0, 10), r.uniform(0, 10), r.uniform(0, 10), r.gauss(0, 5), 1.0, 2.0, -0.5) for i in range(500)]
    df = spark.createDataFrame(rows, snapshot.SCHEMA)
    prefix = f"file://{tmp_path}/snap"
    assert snapshot.write(df, prefix, 3, box=10.0, a=0.25) == 500
    back = spark.read.format("snapshot").load(prefix)
    got = {x.id: x for x in back.collect()}
    assert len(got) == 500 and back.rdd.getNumPartitions() == 3
    for i, x, _, _, vx, _, _, pot in rows[:50]:
        assert abs(got[i].x - x) < 1e-5 and abs(got[i].vx - vx) < 1e-4 and got[i].pot == pot
    few = spark.read.format("snapshot").option("velocities", "false").option("potentials", "false").load(prefix).where("x >= 2 and x < 3")
    assert {x.id for x in few.collect()} == {i for i, x, *_ in rows if 2 <= np.float32(x) < 3}
    assert few.where("vx is not null or pot is not null").count() == 0


def test_large_counts_and_file_names():
    h = snapshot.header_of(snapshot.pack_header(7, 2**33 + 5, 3e10, 0.5, 2000, 100.0, 0.3, 0.7, 0.7))
    assert h["total"] == 2**33 + 5 and h["count"] == 7 and h["files"] == 2000 and h["box"] == 100.0 and abs(h["mass"] - 3e10) < 1
    assert snapshot.file_name("p", 1234, 2000) == "p.1/1234" and snapshot.file_name("p", 3, 8) == "p.3"


def test_text_sources(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1 2 3\nbad line\n  4  5 6 \n7 8\n\n")
    assert sorted(tuple(r) for r in tables.read_points(spark, f"file://{tmp_path}/p.txt").collect()) == [(0.05, 0.1, 0.15), (0.2, 0.25, 0.3)]
    (tmp_path / "c.txt").write_text("# a = 0.5\n# Om: 0.3\n#id x mass\n1 0 5.5\n2 0 6.5\n3 0 none\n")
    assert {r.key: r.number for r in tables.read_text_header(spark, f"file://{tmp_path}/c.txt").collect()} == {"a": 0.5, "Om": 0.3}
    assert sorted(r.mass for r in tables.read_text_masses(spark, f"file://{tmp_path}/c.txt").collect()) == [5.5, 6.5]
    assert tables.labelled("a/file.dat", "x") == "a/file_x.dat" and tables.labelled("file", "x") == "file_x"


def test_tables(spark, tmp_path):
    path = f"file://{tmp_path}"
    halos = spark.createDataFrame([(1, 0.5, 1e13, 2)], "id int, x double, mvir double, child_level int")
    halos.write.parquet(f"{path}/h1")
    halos.write.parquet(f"{path}/h2")
    got = tables.read_halos(spark, f"{path}/h1", f"{path}/h2", fields=("id", "mvir"))
    assert got.count() == 2 and dict(got.dtypes)["id"] == "bigint"
    import pytest

    with pytest.raises(ValueError):
        tables.read_halos(spark, f"{path}/h1")
    (tmp_path / "head.json").write_text('{"NumHalos": 5, "BoxSize": 100.0}')
    assert tables.read_header(spark, f"{path}/head.json")["NumHalos"] == 5
    p = spark.createDataFrame([(1, 2.0, 50.0, 0.0, 0.0, 4.0, 0.0, 0.0, "nu"), (2, 2.0, 5.0, 0.0, 0.0, 4.0, 0.0, 0.0, "cdm")], "id long, mass double, x double, y double, z double, vx double, vy double, vz double, species string")
    p.write.partitionBy("species").parquet(f"{path}/p")
    one = tables.read_species(spark, f"{path}/p", "nu", 0.25, 100.0).collect()
    assert [(r.id, r.x, r.vx) for r in one] == [(1, 0.5, 8.0)]
    p.drop("species").withColumns({c: F.lit(k) for k, c in enumerate(("ix", "iy", "iz"))}).write.partitionBy("ix", "iy", "iz").parquet(f"{path}/d")
    assert tables.read_domains(spark, f"{path}/d").where("iz = 2").count() == 2
    tables.write_columns(spark.createDataFrame([(2, 0.5), (1, 0.25)], "ir int, xi double"), f"{path}/xi", "ir")
    assert [r.value for r in spark.read.text(f"{path}/xi").collect()] == ["1 0.25", "2 0.5"]


def test_streams(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.random(), r.random(), r.random(), 1.0) for _ in range(200)]
    df = spark.createDataFrame(rows, "x double, y double, z double, mass double")
    df.repartition(4).write.parquet(f"file://{tmp_path}/in")
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    streams.start_into_memory(streams.mesh_stream(live, 4, "tsc", "mass"), "mesh_test").awaitTermination()
    want = {(x.ix, x.iy, x.iz): x.val for x in mesh.assign(df, 4, "tsc", "mass").collect()}
    got = {(x.ix, x.iy, x.iz): x.val for x in spark.table("mesh_test").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    streams.append_batches(live, f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 200
    timed = df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    timed.write.parquet(f"file://{tmp_path}/timed")
    events = spark.readStream.schema(timed.schema).parquet(f"file://{tmp_path}/timed")
    streams.start_into_memory(streams.windowed_density(events, 2), "dens_test").awaitTermination()
    assert abs(spark.table("dens_test").agg(F.sum("val")).first()[0] - 200) < 1e-9


def test_orders(spark):
    df = spark.createDataFrame([(i, float(i * 37 % 101), [float(-i), float(i)]) for i in range(100)], "id long, v double, pos array<double>")
    assert [x.id for x in ordering.by_axis(df, 0, "pos").limit(2).collect()] == [99, 98]
    ranks = {x.id: x.position for x in ordering.numbered(df, F.col("v")).collect()}
    want = sorted(range(100), key=lambda i: (i * 37 % 101, i))
    assert [ranks[i] for i in want] == list(range(100))
    assert [x.id for x in ordering.by_key(df, "v", ascending=False).limit(1).collect()] == [want[-1]]

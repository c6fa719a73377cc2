"""Binary sinks: all files or none, also when a task's first attempt fails; the stream of arriving files."""

import os
import subprocess
import sys
import textwrap
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from nebulark.operators import mesh
from nebulark.sources import domains, fields, snapshot
from nebulark.streaming import mesh as streams


def particles(spark, n, first=0):
    at = [((F.col("id") * m + 7) % 1009 / F.lit(1009.0)).alias(c) for c, m in zip("xyz", (13, 57, 101), strict=True)]
    return spark.range(first, first + n).select("id", *at, *[F.lit(0.5).alias(c) for c in ("vx", "vy", "vz", "pot")])


def names(folder):
    return sorted(p.name for p in Path(folder).iterdir())


def test_snapshot_files_replace_each_other(spark, tmp_path):
    prefix = f"file://{tmp_path}/out/snap"
    assert snapshot.write(particles(spark, 1000), prefix, 5) == 1000
    assert names(tmp_path / "out") == [f"snap.{k}" for k in range(5)]
    assert snapshot.write(particles(spark, 10), prefix, 2) == 10
    assert names(tmp_path / "out") == ["snap.0", "snap.1"]
    assert spark.read.format("snapshot").load(prefix).count() == 10
    assert snapshot.write(particles(spark, 0), prefix, 3) == 0 and spark.read.format("snapshot").load(prefix).count() == 0
    with pytest.raises(Exception, match="exists"):
        rows = particles(spark, 3).withColumn("part", F.lit(0))
        rows.write.format("snapshot").mode("append").options(files=1, total=3).save(prefix)


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    snapshot.register(spark)
    prefix = f"file://{tmp_path}/out/snap"
    snapshot.write(particles(spark, 50), prefix, 2)
    rows = particles(spark, 100).withColumn("part", F.pmod("id", F.lit(4)).cast("int")).repartition(4, "part").sortWithinPartitions("part")
    bad = rows.withColumn("x", F.when(F.col("id") == 63, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("x")))
    for df, total in ((bad, 100), (rows, 99), (rows.drop("part").withColumn("part", F.lit(9)), 100), (rows.repartition(3), 100)):
        with pytest.raises(Exception):  # noqa: B017, PT011
            df.write.format("snapshot").mode("overwrite").options(files=4, total=total).save(prefix)
        assert names(tmp_path / "out") == ["snap.0", "snap.1"]
    assert spark.read.format("snapshot").load(prefix).count() == 50


def test_a_retried_task_writes_once(tmp_path):
    """A session of its own, where a task may fail twice: the first attempt of a file dies half-way."""
    code = f"""
        import sys
        sys.path.insert(0, {os.getcwd()!r})
        from pyspark import TaskContext
        from pyspark.sql import SparkSession, functions as F
        from nebulark.sources import snapshot
        from tests.test_staged import particles
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        snapshot.register(spark)

        def flaky(batches):
            for b in batches:
                yield b.slice(0, b.num_rows // 2)
                if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() == 1:
                    raise RuntimeError("first attempt")
                yield b.slice(b.num_rows // 2)

        rows = particles(spark, 4000).withColumn("part", F.pmod("id", F.lit(3)).cast("int")).repartition(3, "part").sortWithinPartitions("part")
        rows.mapInArrow(flaky, rows.schema).write.format("snapshot").mode("overwrite").options(files=3, total=4000).save("file://{tmp_path}/out/snap")
        back = spark.read.format("snapshot").load("file://{tmp_path}/out/snap")
        print("ROWS", back.count(), back.select("id").distinct().count())
    """
    run = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=300)
    assert "ROWS 4000 4000" in run.stdout, run.stderr[-2000:]
    assert "first attempt" in run.stderr
    assert names(tmp_path / "out") == ["snap.0", "snap.1", "snap.2"]


def test_domain_files(spark, tmp_path):
    cells = {f"i{c}": F.floor(F.col(c) * n).cast("int") for c, n in (("x", 2), ("y", 3), ("z", 1))}
    rows = particles(spark, 500).withColumn("mass", F.lit(2.0)).withColumns(cells).where("iy <> 1")
    n = domains.write(rows, f"file://{tmp_path}/d", (2, 3, 1), ".bin")
    back = spark.read.format("domains").option("suffix", ".bin").load(f"file://{tmp_path}/d").where("ix = 1").collect()
    assert n == rows.count() and {r.id for r in back} == {r.id for r in rows.where("ix = 1").collect()}
    assert (tmp_path / "d/x001/y001/z000.bin").stat().st_size == domains.HEADER.size


@pytest.mark.parametrize("files", [1, 3])
def test_mesh_and_moment_files(spark, tmp_path, files):
    n = 5
    cells = mesh.all_cells(spark, n).where("ix + iy > 0").withColumn("rho", (F.col("ix") * 25 + F.col("iy") * 5 + F.col("iz")).cast("double")).withColumn("ux", -F.col("rho"))
    path = f"file://{tmp_path}/m/f"
    fields.write(cells, path, n, 100.0, "rho", files=4, kind="f8")
    fields.write(cells, path, n, 100.0, "rho", files=files, kind="f8")  # replaces the four
    want = np.arange(n**3, dtype=float)
    want[:n] = 0.0
    if files == 1:
        raw = (tmp_path / "m/f").read_bytes()
        assert fields.MESH_HEADER.unpack_from(raw) == (n, n**3, 100.0) and np.array_equal(np.frombuffer(raw[20:], "<f8"), want)
    assert names(tmp_path / "m") == (["f"] if files == 1 else ["f.0", "f.1", "f.2"])
    place = lambda r: r.ix * 25 + r.iy * 5 + r.iz
    back = fields.read(spark, path, "rho", kind="f8")
    assert {place(r): r.rho for r in back.collect()} == dict(enumerate(want))
    few = back.where("ix >= 1 and ix <= 2")
    assert sorted(place(r) for r in few.collect()) == list(range(25, 75))
    assert few.rdd.getNumPartitions() == 1  # one file of three holds these slabs
    fields.write(cells, path, n, 100.0, "rho", "ux", layout="moment", files=files)
    got = fields.read(spark, path, "rho", "ux", layout="moment").collect()
    assert {place(r): (r.rho, r.ux) for r in got} == {i: (w, -w if w else 0.0) for i, w in enumerate(want)}
    with pytest.raises(ValueError, match="layout"):
        fields.write(cells, path, n, 1.0, "rho", "ux")


def test_stream_of_snapshot_files(spark, tmp_path):
    snapshot.register(spark)
    whole, live, sums, check = (f"file://{tmp_path}/{x}" for x in ("whole/s", "live/s", "sums", "check"))
    snapshot.write(particles(spark, 900), whole, 6)
    (tmp_path / "live").mkdir()

    def arrive(*numbers):
        for k in numbers:
            os.rename(tmp_path / f"whole/s.{k}", tmp_path / f"live/s.{k}")

    def put(batch, number):
        batch.groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")).write.mode("overwrite").parquet(f"{sums}/batch={number}")

    def run():
        stream = spark.readStream.format("snapshot").load(live)
        stream.writeStream.foreachBatch(put).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        got = spark.read.schema("n long, ids long, batch int").parquet(sums).agg(F.sum("n"), F.sum("ids")).first()
        return tuple(got)

    arrive(0, 1, 3)  # 3 waits for 2
    n = run()[0]
    files = spark.read.format("snapshot").load(live.replace("live", "live"))
    assert files.schema == snapshot.SCHEMA and 0 < n < 900
    assert run()[0] == n  # nothing new
    arrive(2, 4, 5)
    assert run() == (900, sum(range(900)))
    assert run() == (900, sum(range(900)))
    streams.start_into_memory(streams.mesh_stream(spark.readStream.format("snapshot").load(live), 4, "cic"), "live_mesh").awaitTermination()
    want = {(r.ix, r.iy, r.iz): r.val for r in mesh.assign(spark.read.format("snapshot").load(live), 4, "cic").collect()}
    got = {(r.ix, r.iy, r.iz): r.val for r in spark.table("live_mesh").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())

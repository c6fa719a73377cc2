"""The saved inverted file with its upkeep, block search, domain files, sliced snapshots and typed columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nebulark.operators import indexsearch, neighbors
from nebulark.sources import domains, snapshot, tables
from nebulark.streaming import mesh as streams


def vectors(spark, n, seed=1, first=0):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(first + i, r.normal(size=6).tolist(), i % 5) for i in range(n)], "id long, embedding array<double>, label int")


def plain(asked, rows, k):
    out = {}
    for q in asked:
        d = sorted((sum((a - b) ** 2 for a, b in zip(q.embedding, v.embedding, strict=True)), v.id) for v in rows)
        out[q.id] = [i for _, i in d[:k]]
    return out


def test_index_is_kept_up_to_date(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    base, more = vectors(spark, 300), vectors(spark, 40, 2, 1000)
    centres = neighbors.train_cells(base, 8)
    neighbors.save_index(base, centres, path)
    assert np.allclose(neighbors.load_centres(spark, path), centres)
    for _ in range(2):  # a batch that is written again takes its own place
        neighbors.add_to_index(more, path, "one")
    neighbors.delete_from_index(base.where("id % 3 = 0"), path, "first")
    asked = vectors(spark, 20, 3)
    got = {}
    for x in neighbors.search_index(spark, path, asked, 5, 8).collect():
        got.setdefault(x.qid, []).append((x["rank"], x.id))
    alive = base.where("id % 3 <> 0").unionByName(more).collect()
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == plain(asked.collect(), alive, 5)


@pytest.mark.parametrize("blocks", [(1024, 8192), (7, 23)])
def test_blocks_give_the_same_neighbours(spark, monkeypatch, blocks):
    monkeypatch.setattr(neighbors, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(neighbors, "VECTOR_BLOCK", blocks[1])
    pool, asked = vectors(spark, 150), vectors(spark, 30, 4)
    got = {}
    for x in neighbors.vector_knn(asked, pool, 4, keep=("label",)).collect():
        assert x.label == x.id % 5
        got.setdefault(x.qid, []).append((x["rank"], x.id))
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == plain(asked.collect(), pool.collect(), 4)
    per = neighbors.vector_knn(asked, pool, 1, keep=("label",), per="label").collect()
    assert len(per) == 30 * 5 and len({(x.qid, x.label) for x in per}) == 150
    assert neighbors.vector_knn(asked.limit(0), pool, 4).count() == 0 and neighbors.vector_knn(asked, pool.limit(0), 4).count() == 0


def test_domain_files(spark, tmp_path):
    domains.register(spark)
    r = random.Random(2)
    rows = [(2**40 + i, 1.0, r.random(), r.random(), r.random(), 3.0, 0.0, -1.0, i % 2, 0, i % 3 // 2) for i in range(200)]
    df = spark.createDataFrame(rows, domains.SCHEMA)
    prefix = f"file://{tmp_path}/p"
    assert domains.write(df, prefix, (2, 2, 2), ".bin") == 200
    read = spark.read.format("domains").option("suffix", ".bin").load(prefix)
    assert {x.id: (x.vx, x.ix, x.iz) for x in read.collect()} == {x[0]: (3.0, x[8], x[10]) for x in rows} and read.rdd.getNumPartitions() == 8
    some = read.where("ix = 1 and iy = 0")
    assert some.count() == 100 and some.rdd.getNumPartitions() == 2
    (tmp_path / "p/x001/y001/z001.bin").write_bytes((tmp_path / "p/x000/y000/z000.bin").read_bytes())
    with pytest.raises(Exception, match="holds domain"):
        spark.read.format("domains").option("suffix", ".bin").load(prefix).collect()
    head = domains.header_of(domains.pack_header((1, 1, 1), (0, 0, 0), 0, 0, 1, 2e5, 4.0, 2 / 3, 1.0, 0.0))
    assert domains.velocity_unit(head) == pytest.approx(0.5, rel=1e-6)  # a = 1 at t = 2/3 without a constant


def test_snapshots_in_slices(spark, tmp_path, monkeypatch):
    snapshot.register(spark)
    rows = [(i, i / 100, 1.0, 2.0, 0.5, 0.0, 0.0, -1.0) for i in range(900)]
    prefix = f"file://{tmp_path}/s"
    snapshot.write(spark.createDataFrame(rows, snapshot.SCHEMA), prefix, 2, box=10.0)
    reader = snapshot._Reader({"path": prefix})
    monkeypatch.setattr(snapshot, "SLICE", 64)
    parts = [b for s in reader.partitions() for b in reader.read(s)]
    assert max(b.num_rows for b in parts) == 64 and sorted(i for b in parts for i in b.column(0).to_pylist()) == list(range(900))
    assert {v for b in parts for v in b.column(7).to_pylist()} == {-1.0}


def test_columns_of_another_type_are_refused(spark, tmp_path):
    path = f"file://{tmp_path}/h"
    spark.createDataFrame([("1", 2.0, 1.5)], "id string, mvir double, child_level double").write.parquet(path)
    for field in ("id", "child_level"):
        with pytest.raises(ValueError, match=field):
            tables.read_halos(spark, path, fields=(field,))
    assert tables.read_halos(spark, path, fields=("mvir",)).first().mvir == 2.0


def test_a_replayed_batch_takes_its_own_place(spark, tmp_path):
    src, table = f"file://{tmp_path}/src", f"file://{tmp_path}/t"
    vectors(spark, 10).write.parquet(src)
    for run in range(2):  # the second stream lost its checkpoint and replays the batch
        streams.append_batches(spark.readStream.schema(vectors(spark, 1).schema).parquet(src), table, f"file://{tmp_path}/c{run}").awaitTermination()
    assert spark.read.parquet(table).select("id").orderBy("id").agg(F.count("id"), F.countDistinct("id")).first() == (10, 10)


def test_documents_meet_in_ways_and_shares(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(neighbors, "MET_ROWS", 40)
    monkeypatch.setattr(neighbors, "MET_QUERIES", 5)
    r = np.random.default_rng(12)
    v = r.integers(0, 3, (300, 4)).astype(float)  # many ties
    doc = [None if i % 11 == 0 else int(i % 5) for i in range(300)]
    table = spark.createDataFrame([(i, [float(x) for x in v[i]], doc[i]) for i in range(300)], "id long, embedding array<float>, label int")
    asked, path = table.where("id % 10 = 0"), f"file://{tmp_path}/index"
    neighbors.save_index(table, neighbors.train_cells(table, 4), path, keep=("label",))
    got = sorted((x.qid, x.id, x.distance, x.doc_rank) for x in indexsearch.documents(spark, path, asked, table, 2).collect())
    d, want = ((v[:, None] - v[None]) ** 2).sum(2), []
    for q in range(0, 300, 10):
        near = sorted((min((d[q, i], i) for i in range(300) if doc[i] == one), one) for one in {*doc} - {None}) + [(min((d[q, i], i) for i in range(300) if doc[i] is None), None)]
        for rank, (_, one) in enumerate(sorted(near, key=lambda x: x[0])[:2], 1):
            want += [(q, i, d[q, i], rank) for i in range(300) if doc[i] == one]
    assert got == sorted(want)

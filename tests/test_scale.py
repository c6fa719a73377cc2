"""Ranks, samples, random points and index searches where a plain plan would put all rows into one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nebulark.operators import catalog, indexsearch, neighbors, ordering


def test_random_points_do_not_repeat(spark):
    step = 10**12 // 1_000_000
    ids = spark.range(0, 10**12, step).select("id", *[catalog.row_hash(F.col("id") * 3 + k, 310 + k).alias(c) for k, c in enumerate("xyz")])
    assert ids.select("x", "y", "z").distinct().count() == 1_000_000
    pair = spark.createDataFrame([(700000000,), (1364829724,)], "id long")
    assert pair.select(*[catalog.row_hash(F.col("id") * 3 + k, 310 + k).alias(c) for k, c in enumerate("xyz")]).distinct().count() == 2


@pytest.mark.parametrize("ratio", [0.0, 1e-3, 0.37, 1.0])
def test_exact_sample_ranks_its_border_only(spark, ratio):
    df = spark.range(50_000).withColumn("other", F.col("id") % 7)
    got = catalog.sample_exact(df, ratio)
    assert got.columns == df.columns
    rows = df.withColumn("h", catalog.row_hash(F.col("id"), 100)).toPandas().sort_values(["h", "id"])
    assert {r.id for r in got.collect()} == set(rows["id"].head(int(50_000 * ratio)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    import re

    assert all(int(n) <= catalog.BORDER_ROWS for n in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", plan))
    assert catalog.sample_exact(df.limit(0), 0.5).count() == 0


def test_ranks_of_a_power_law(spark):
    """Equal-width ranges would put nearly all rows into one task."""
    df = spark.range(40_000).select("id", F.pow(F.lit(1.0) / ((F.col("id") * 7919 % 40_009) + 1), F.lit(3.0)).alias("v")).repartition(7)
    out = ordering.numbered(df, F.col("v"))
    rows = out.toPandas().sort_values("position")
    assert (rows["position"].to_numpy() == np.arange(40_000)).all() and rows["v"].is_monotonic_increasing
    sizes = df.repartitionByRange("v", "id").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.max() <= 2 * sizes.mean()
    ties = spark.createDataFrame([(i, None if i % 3 else 1.0) for i in range(9)], "id long, v double")
    assert [r.id for r in ordering.numbered(ties, F.col("v")).orderBy("position").collect()] == [1, 2, 4, 5, 7, 8, 0, 3, 6]


def clustered(spark, n, seed, first=0):
    r = np.random.default_rng(seed)
    middle = np.random.default_rng(0).uniform(-20, 20, (12, 3))
    at = r.integers(0, 12, n)
    return spark.createDataFrame([(first + i, (middle[at[i]] + r.normal(size=3)).tolist(), int(at[i]) * 10 + i % 4) for i in range(n)], "id long, embedding array<double>, label int")


def test_index_search_is_exact_and_reads_few_cells(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    base, more, asked = clustered(spark, 600, 1), clustered(spark, 90, 2, 1000), clustered(spark, 12, 3)
    neighbors.save_index(base, neighbors.train_cells(base, 24), path, keep=("label",))
    neighbors.add_to_index(more, path, "one", keep=("label",))
    neighbors.delete_from_index(base.where("id % 4 = 0"), path, "some")
    alive = base.where("id % 4 <> 0").unionByName(more)
    rows = [(np.array(r.embedding), r.id, r.label) for r in alive.collect()]
    plain = {q.id: sorted((float(((v - np.array(q.embedding)) ** 2).sum()), i, doc) for v, i, doc in rows) for q in asked.collect()}

    def found(stop):
        got, share = {}, []
        for r in indexsearch.search(spark, path, asked, stop).collect():
            got.setdefault(r.qid, []).append((r["rank"], r.id))
            share.append(r.cells_read)
        return {q: [i for _, i in sorted(v)] for q, v in got.items()}, share

    got, share = found(indexsearch.Nearest(7))
    assert got == {q: [i for _, i, _ in d[:7]] for q, d in plain.items()} and np.mean(share) < 0.6
    got, share = found(indexsearch.WithinDistance(2.5))
    assert got == {q: w for q, d in plain.items() if (w := [i for x, i, _ in d if x <= 2.5])} and np.mean(share) < 0.6
    got, _ = found(indexsearch.WithinDistance(0.4, 3, 5))
    assert got == {q: [i for k, (x, i, _) in enumerate(d) if k < 5 and (x <= 0.4 or k < 3)] for q, d in plain.items()}
    docs = {}
    for r in indexsearch.documents(spark, path, asked, alive, 2).collect():
        docs.setdefault(r.qid, set()).add((r.doc_rank, r.id))
    for q, d in plain.items():
        order = list(dict.fromkeys(doc for *_, doc in d))[:2]
        assert docs[q] == {(order.index(doc) + 1, i) for _, i, doc in d if doc in order}
    few = neighbors.filed_vectors(spark, path).where("cell = 3")
    assert 0 < len(few.inputFiles()) and "PartitionFilters: [isnotnull(cell" in few._jdf.queryExecution().toString()


def test_block_search_keeps_string_ids_and_few_documents(spark):
    pool = clustered(spark, 200, 5).withColumn("id", F.concat(F.lit("v"), "id"))
    asked = clustered(spark, 4, 6)
    got = neighbors.vector_knn(asked, pool, 3)
    assert dict(got.dtypes)["id"] == "string" and got.where("id is null").count() == 0 and got.count() == 12
    near = neighbors.vector_knn(asked, pool, 1, keep=("label",), per="label", most=2)
    assert near.count() == 8

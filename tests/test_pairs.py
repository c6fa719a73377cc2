import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from nebulark.config import AnalysisConfig, Box, RadialBins, SmuBins, SpspBins
from nebulark.operators import catalog, jackknife, neighbors, pairs
from nebulark.plans import programs

SCHEMA = "id long, x double, y double, z double"


def points(n, seed=1):
    r = random.Random(seed)
    return [(i, r.random(), r.random(), r.random()) for i in range(n)]


def image(d):
    return d - math.floor(d + 0.5)


def dist(a, b):
    return math.sqrt(sum(image(p - q) ** 2 for p, q in zip(a[1:], b[1:], strict=True)))


@pytest.mark.parametrize("reach", [0.05, 0.2, 0.32, 0.34, 0.45, 0.5])
def test_each_pair_once_at_any_reach(spark, reach):
    pts = points(120)
    df = spark.createDataFrame(pts, SCHEMA)
    want = sorted(tuple(sorted((a[0], b[0]))) for a, b in itertools.combinations(pts, 2) if dist(a, b) < reach)
    assert sorted(tuple(sorted((r.id1, r.id2))) for r in pairs.range_pairs(df, None, reach).collect()) == want
    other = points(60, 2)
    cross = sorted((a[0], b[0]) for a in pts for b in other if dist(a, b) < reach)
    assert sorted((r.id1, r.id2) for r in pairs.range_pairs(df, spark.createDataFrame(other, SCHEMA), reach).collect()) == cross


def test_edges_and_degenerate_rows(spark):
    pts = [(1, 0.0, 0.5, 0.5), (2, 1.0 - 2**-53, 0.5, 0.5), (3, 0.5, 0.5, 0.5), (4, 0.5, 0.5, 0.5), (5, 0.5, 0.5, 0.52)]
    df = spark.createDataFrame(pts, SCHEMA)
    assert [r.n for r in pairs.count_r(df, None, RadialBins(0.0, 0.03, 3)).orderBy("ir").collect()] == [2, 0, 2]
    smu = {(r.ir, r.imu): r.n for r in pairs.count_smu(df, None, SmuBins(RadialBins(0.0, 0.03, 3), 2)).collect()}
    assert smu == {(0, 0): 1}  # zero separations have no angle, mu = 1 has no bin
    assert sum(r.n for r in pairs.count_r(df.limit(0), None, RadialBins(0.0, 0.1, 2)).collect()) == 0
    assert sum(r.n for r in pairs.count_r(df.where("id = 1"), None, RadialBins(0.0, 0.1, 2)).collect()) == 0
    assert {r.xi for r in pairs.xi_auto(df.limit(0), RadialBins(0.0, 0.1, 2)).collect()} == {0.0}


def test_counts_do_not_change_under_a_shift(spark):
    df = spark.createDataFrame(points(200), SCHEMA)
    bins = RadialBins(0.0, 0.2, 4)
    moved = df.withColumns({c: (F.col(c) + 0.37) - F.floor(F.col(c) + 0.37) for c in "xyz"})
    assert [r.n for r in pairs.count_r(df, None, bins).orderBy("ir").collect()] == [r.n for r in pairs.count_r(moved, None, bins).orderBy("ir").collect()]


def test_cross_of_a_catalogue_with_itself(spark):
    df = spark.createDataFrame(points(100), SCHEMA)
    bins = RadialBins(0.0, 0.3, 3)
    auto = sum(r.n for r in pairs.count_r(df, None, bins).collect())
    assert sum(r.n for r in pairs.count_r(df, df, bins).collect()) == 2 * auto + 100


def test_leave_one_out_equals_recount(spark):
    df = jackknife.spatial_blocks(spark.createDataFrame(points(150), SCHEMA), 2)
    bins = RadialBins(0.0, 0.2, 3)
    got = {(r.block_id, r.ir): r.n for r in jackknife.leave_one_out(df, None, bins, 8).collect()}
    for b in (0, 3, 7):
        for r in pairs.count_r(df.where(F.col("block_id") != b), None, bins).collect():
            assert got[b, r.ir] == r.n
    slices = jackknife.shuffle_blocks(df.drop("block_id"), 4).groupBy("block_id").count().collect()
    assert {r["count"] for r in slices} == {38}


def test_knn_grows_and_ties_break_by_id(spark):
    pts = points(80) + [(100 + i, 0.5, 0.5, 0.5) for i in range(5)]
    df = spark.createDataFrame(pts, SCHEMA)
    q = df.where("id = 103")
    three = [r.id for r in neighbors.knn(q, df, 3).orderBy("rank").collect()]
    assert three == [100, 101, 102]
    seven = [r.id for r in neighbors.knn(q, df, 7).orderBy("rank").collect()]
    assert seven[:3] == three
    assert neighbors.knn(q, df, 1000).count() == len(pts)
    assert neighbors.knn(q, df.limit(0), 3).count() == 0


def test_ghosts_equal_nearest_images(spark):
    df = spark.createDataFrame(points(100), SCHEMA)
    shadow = neighbors.ghosts(df, 0.1)
    assert shadow.groupBy("id").count().agg(F.max("count")).first()[0] <= 8
    with_ghosts = {(r.id, s.id) for r in df.collect() for s in shadow.collect() if sum((r[c] - s[c]) ** 2 for c in "xyz") < 0.01}
    assert with_ghosts == {(r.qid, r.id) for r in neighbors.radius_search(df, df, 0.1, closed=False, periodic=True).collect()}


def test_samples_and_selections(spark):
    df = spark.createDataFrame([(i, float(i), i % 4) for i in range(1, 1001)], "id long, mvir double, child_level int")
    assert catalog.sample_exact(df, 0.3337).count() == 333
    assert 230 < catalog.sample_bernoulli(df, 0.3).count() < 370
    none = catalog.select_range(df, "mvir", -2, -1)
    assert catalog.select_range(none, "child_level", 0, 3).count() == 0
    assert catalog.select_range(df, "mvir", 10, 20).count() == 11 and catalog.select_range(df, "mvir", 10, 20, "left").count() == 10
    uniform = catalog.random_catalog(spark, 20000)
    assert all(abs(uniform.agg(F.avg(c)).first()[0] - 0.5) < 0.02 for c in "xyz")
    xi = pairs.xi_auto(uniform, RadialBins(0.02, 0.06, 2)).collect()
    assert all(abs(r.xi) < 0.05 for r in xi)


def test_options_are_checked():
    for bad in ({"scheme": "no"}, {"estimator": "no"}, {"axis": "w"}, {"jk_level": 2}, {"mesh": 0}):
        with pytest.raises(ValueError):
            AnalysisConfig(**bad)
    assert AnalysisConfig(rrange=(1.0, 900.0)).radial_bins().high == 0.5
    with pytest.raises(ValueError):
        RadialBins(1.0, 0.5, 3)
    with pytest.raises(ValueError):
        Box(size=-1)
    assert RadialBins(0.0, 1.0, 2, log=True).low == 1e-8


def test_programs_run(spark):
    r = random.Random(3)
    halos = spark.createDataFrame([(i, r.random(), r.random(), r.random(), r.gauss(0, 300), r.gauss(0, 300), r.gauss(0, 300), 1e-6, 10 ** r.uniform(3, 6), i % 3) for i in range(400)], "id long, x double, y double, z double, vx double, vy double, vz double, pot double, mvir double, child_level int")
    c = AnalysisConfig(mrange=(3.0, 6.0), rrange=(1.0, 200.0), nr=4, mesh=8, nk=3, krange=(0.004, 0.03), estimator="LS", jk_level=2)
    cat = programs.prepared(halos, c, True, True)
    assert programs.halo_xi(cat, c).count() == 4 and programs.halo_xi(cat, c, cat).count() == 4
    assert programs.halo_xi_jackknife(cat, c).count() == 4
    assert programs.halo_xi_2d(cat, c, "smu", 5).count() == programs.halo_xi_2d(cat, c, "spsp", 5).count() == 20
    assert programs.power(cat, c).where("p0 is not null").count() > 0
    assert programs.xi_by_transform(cat, c).count() > 0
    assert programs.moment(halos.withColumn("mass", F.lit(1.0)), c, "sigma").count() > 0


@pytest.mark.parametrize("split", [2])
@pytest.mark.parametrize("reach", [0.12, 0.34])
def test_split_cells_find_the_same_pairs(spark, split, reach):
    rows = points(120, 3)
    df, other = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(points(90, 4), SCHEMA)
    for right in (None, other):
        found = lambda s: sorted((*(sorted((r.id1, r.id2)) if right is None else (r.id1, r.id2)),) for r in pairs.range_pairs(df, right, reach, split=s).collect())
        assert found(split) == found(1)


def test_join_methods_stay_small_enough_to_be_compiled(spark):
    """The JVM never compiles methods of more than 8000 bytes."""
    df = spark.createDataFrame(points(50, 5), SCHEMA)
    bins = RadialBins(0.0, 0.05, 5)
    counts = [pairs.count_r(df, None, bins), pairs.count_smu(df, None, SmuBins(bins, 4)), pairs.count_smu(df, None, SmuBins(bins, 4, half=False)), pairs.count_spsp(df, None, SpspBins(bins, 0.03, 3)), jackknife.leave_one_out(jackknife.spatial_blocks(df, 2), None, bins, 8)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for c in counts:
            stages = c._jdf.queryExecution().debug().codegenToSeq()
            sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()) if "Join" in stages.apply(i)._1() or "Generate" in stages.apply(i)._1()]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")

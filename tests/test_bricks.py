import itertools
import random

import numpy as np
import pandas as pd
import pytest

from nebulark.config import RadialBins, SmuBins, SpspBins
from nebulark.operators import bricks, jackknife, neighbors, pairs, pairwise

SCHEMA = "id long, x double, y double, z double"


def near(a, b):
    d = [p - q for p, q in zip(a[1:], b[1:], strict=True)]
    d = [x - int((x + 0.5) // 1) for x in d]
    return (d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) ** 0.5


@pytest.mark.parametrize("reach", [0.04, 0.2, 0.45, 0.5])
def test_counts_in_crowded_bricks(spark, monkeypatch, reach):
    """Counts stay whole where crowded bricks are cut, and list no pairs: no join is asked for."""
    monkeypatch.setattr(bricks, "LEFT_ROWS", 40)
    monkeypatch.setattr(bricks, "RIGHT_ROWS", 30)
    monkeypatch.setattr(bricks, "CHUNK", 7)
    monkeypatch.setattr(bricks, "MEETING", 64)
    monkeypatch.setattr(pairs, "range_pairs", None)
    r = random.Random(3)
    pts = [(i, *(((0.98 + 0.06 * r.random()) % 1.0) if i % 2 else r.choice([r.random(), 0.25, 0.75]) for _ in "xyz")) for i in range(150)]
    other = [(i, *(r.random() for _ in "xyz")) for i in range(60)]
    bins = RadialBins(0.0, reach, 4)
    want = lambda ps: [sum(bins.edge(k) <= near(a, b) < min(bins.edge(k + 1), reach) for a, b in ps) for k in range(4)]
    df, two = spark.createDataFrame([*pts, (900, None, 0.5, 0.5), (901, float("nan"), 0.5, 0.5)], SCHEMA), spark.createDataFrame(other, SCHEMA)
    got = lambda df: [x.n for x in df.orderBy("ir").collect()]
    assert got(pairs.count_r(df, None, bins)) == want(list(itertools.combinations(pts, 2)))
    assert got(pairs.count_r(df, two, bins)) == want(list(itertools.product(pts, other)))
    blocks = jackknife.spatial_blocks(df.where("id < 900"), 2)
    home = {x.id: x.block_id for x in blocks.collect()}
    left = {(x.block_id, x.ir): x.n for x in jackknife.leave_one_out(blocks, None, bins, 8).collect()}
    for b in (0, 7):
        kept = [p for p in pts if home[p[0]] != b]
        assert [left[b, k] for k in range(4)] == want(list(itertools.combinations(kept, 2)))


def test_thresholds_are_the_bins(spark):
    bins = RadialBins(0.0, 0.05, 10)
    edges = pairs.square_edges(bins)
    for i, e in enumerate(edges[1:-1], 1):
        below = float(__import__("numpy").nextafter(e, 0))
        assert int((e**0.5 - bins.low) / bins.step) == i and int((below**0.5 - bins.low) / bins.step) == i - 1


def test_bounded_meetings_keep_the_nearest(spark, monkeypatch):
    """Many blocks of vectors: a first look bounds the distances; ties, copies and too few vectors in it lose nothing."""
    monkeypatch.setattr(neighbors, "VECTOR_BLOCK", 10)
    seen = []
    blocks = neighbors._blocks
    monkeypatch.setattr(neighbors, "_blocks", lambda *a, first=None: seen.append(first) or blocks(*a, first=first))
    r = random.Random(5)
    rows = [(i, [float(r.randrange(6)), float(r.randrange(6))]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    for k in (3, 100):
        got = {(x.qid, x["rank"]): x.id for x in neighbors.vector_knn(df.where("id % 50 = 0"), df, k).collect()}
        assert 5 in seen
        for q, v in rows[::50]:
            order = sorted(rows, key=lambda w: ((w[1][0] - v[0]) ** 2 + (w[1][1] - v[1]) ** 2, w[0]))[:k]
            assert [got[q, i + 1] for i in range(k)] == [w[0] for w in order]


@pytest.mark.parametrize("near", [False, True])
def test_counts_at_the_very_edges(near):
    """Pairs at a bin's edge, or one bit off it, fall where full precision puts them; few elements are met for a pair."""
    r = np.random.default_rng(4)
    edges = pairs.square_edges(RadialBins(0.0, 0.05, 10))
    n = 300
    place = {c: r.random(n) * 0.1 + 0.4 for c in "xyz"}
    left = pd.DataFrame({"id": np.arange(n), **place})
    lag = np.sqrt(r.choice(edges[1:], n)) if near else r.random(n) * 0.06
    right = pd.DataFrame({"id": np.arange(n) + n, **(place | {"z": np.nextafter(place["z"] + lag, r.choice([0.0, 1.0], n))})})
    met = list(bricks.visits(left, right, 0.05, 12, False, True))
    d = [left[c].to_numpy()[:, None] - right[c].to_numpy()[None] for c in "xyz"]
    d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    assert sum(bricks.count_below(v, edges) for v in met).tolist() == [int((d2 < e).sum()) for e in edges]


def test_few_elements_are_met_for_a_pair():
    """The stretches that a few points meet follow the reach closely: under three elements a pair, where there were four."""
    r = np.random.default_rng(4)
    left = pd.DataFrame({"id": np.arange(4000), **{c: r.random(4000) * 0.08 + 0.4 for c in "xyz"}})
    right = pd.DataFrame({"id": np.arange(46000), **{c: r.random(46000) * 0.18 + 0.35 for c in "xyz"}})
    met = list(bricks.visits(left, right, 0.05, 50, False, True))
    found = sum(bricks.count_below(v, pairs.square_edges(RadialBins(0.0, 0.05, 10)))[-1] for v in met)
    assert sum(len(v.a) * len(v.b) for v in met) < 3 * found


@pytest.mark.parametrize("auto", [False, True])
def test_counts_between_mixed_blocks_take_one_product_a_block(monkeypatch, auto):
    """Left rows of all blocks meet a right block at once: blocks that lie mixed do not cut a visit into a part a pair of blocks."""
    r = np.random.default_rng(11)
    some = lambda n, first: pd.DataFrame({"id": np.arange(n) + first, **{c: (r.random(n) * 0.1 + 0.95) % 1.0 for c in "xyz"}, "block": r.integers(0, 6, n).astype(np.int32)})
    one = some(500, 0)
    two = one if auto else some(400, 500)
    edges, calls, got = pairs.square_edges(RadialBins(0.0, 0.05, 5)), [], {}
    plain = bricks.count_below
    monkeypatch.setattr(bricks, "count_below", lambda *a: calls.append(1) or plain(*a))
    met = list(bricks.visits(one, two, 0.05, 10, auto, True))
    for v in met:
        for i, j, n in bricks.count_between(v, edges, "block"):
            got[i, j] = got.get((i, j), 0) + n
    assert len(calls) <= 6 * len(met)
    d = [one[c].to_numpy()[:, None] - two[c].to_numpy()[None] for c in "xyz"]
    d = [x - np.floor(x + 0.5) for x in d]
    d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    if auto:
        want = [int((d2[np.triu_indices(500, 1)] < e).sum()) for e in edges]
        assert sum(got.values()).tolist() == want
    else:
        for i, j in itertools.product(range(6), repeat=2):
            part = d2[(one["block"] == i).to_numpy()][:, (two["block"] == j).to_numpy()]
            assert list(got.get((i, j), [0] * 6)) == [int((part < e).sum()) for e in edges]


@pytest.mark.parametrize("metric", ["l2", "l2_bytes"])
def test_vectors_of_few_components_meet_in_near_boxes(spark, monkeypatch, metric):
    """Queries meet the vectors of the boxes in their reach, not all; crowded places, ties and fewer vectors than k lose nothing."""
    monkeypatch.setattr(neighbors, "VECTOR_BLOCK", 20)
    monkeypatch.setattr(neighbors, "BOXED", 400)
    monkeypatch.setattr(neighbors, "BOX_ROWS", 20)
    monkeypatch.setattr(neighbors, "BOX_MOST", 30)
    met = []
    boxes = neighbors._knn_in_boxes
    monkeypatch.setattr(neighbors, "_knn_in_boxes", lambda *a: met.append(1) or boxes(*a))
    r = random.Random(6)
    rows = [(i, [5, 5, 5] if i % 4 == 0 else [r.randrange(12) for _ in range(3)]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, embedding array<short>")
    for k in (4, 150):
        got = {(x.qid, x["rank"]): (x.id, x.distance) for x in neighbors.vector_knn(df.where("id % 25 = 0 or id = 3"), df, k, metric).collect()}
        assert len(got) == 17 * k
        for q, v in [*rows[::25], rows[3]]:
            order = sorted((sum((a - b) ** 2 for a, b in zip(w, v, strict=True)), i) for i, w in rows)[:k]
            assert [got[q, i + 1] for i in range(k)] == [(i, float(d)) for d, i in order]
    assert met == [1, 1]


def met_in_boxes(spark, monkeypatch, rows, metric, k):
    """(query, vector, distance) of a search whose 400 vectors are many enough for boxes, and whether it took them."""
    for name, n in (("VECTOR_BLOCK", 20), ("BOXED", 400), ("BOX_ROWS", 20), ("BOX_MOST", 30)):
        monkeypatch.setattr(neighbors, name, n)
    met = []
    boxes = neighbors._knn_in_boxes
    monkeypatch.setattr(neighbors, "_knn_in_boxes", lambda *a: met.append(1) or boxes(*a))
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    found = neighbors.vector_knn(df.where("id % 25 = 0 or id = 3"), df, k, metric).collect()
    return {(x.qid, x["rank"]): (x.id, x.distance) for x in found}, met


def test_long_vectors_meet_as_products(spark, monkeypatch):
    """Blocks of long vectors do not take every distance from differences; copies, ties, NaN and a bound lose nothing."""
    from nebulark.functions import metrics

    monkeypatch.setitem(metrics.BLOCK_METRICS, "l2", lambda q, v: 1 / 0)
    r = random.Random(9)
    rows = [(i, [float(r.randrange(2)) for _ in range(9)]) for i in range(200)]
    df = spark.createDataFrame([*rows, (900, [float("nan")] * 9)], "id long, embedding array<double>")
    for block in (1000, 10):
        monkeypatch.setattr(neighbors, "VECTOR_BLOCK", block)
        got = {(x.qid, x["rank"]): (x.id, x.distance) for x in neighbors.vector_knn(df.where("id % 40 = 0 and id < 900"), df, 6).collect()}
        assert len(got) == 30
        for q, v in rows[::40]:
            order = sorted((sum((a - b) ** 2 for a, b in zip(w, v, strict=True)), i) for i, w in rows)[:6]
            assert [got[q, j + 1] for j in range(6)] == [(i, d) for d, i in order]


def test_registered_metrics_meet_in_near_boxes(spark, monkeypatch):
    """A metric of the caller's own that bounds the distance to a box does not meet all vectors; l1 does neither."""
    from nebulark.functions import metrics
    from nebulark.plans import indexes

    for table in ("BLOCK_METRICS", "LEAST"):
        monkeypatch.setattr(metrics, table, getattr(metrics, table))
    metrics.register_metric("largest", indexes._largest, indexes._largest_gap)
    r = random.Random(7)
    rows = [(i, [5.0, 5.0, 5.0] if i % 4 == 0 else [float(r.randrange(12)) for _ in range(3)]) for i in range(400)]
    for metric, total in (("largest", max), ("l1", sum)):
        got, met = met_in_boxes(spark, monkeypatch, rows, metric, 4)
        assert met == [1]
        for q, v in [*rows[::25], rows[3]]:
            order = sorted((total(abs(a - b) for a, b in zip(w, v, strict=True)), i) for i, w in rows)[:4]
            assert [got[q, j + 1] for j in range(4)] == [(i, d) for d, i in order]
    metrics.register_metric("largest", indexes._largest)  # without a bound all vectors are met, with the same result
    plain, none = met_in_boxes(spark, monkeypatch, rows, "largest", 4)
    assert none == [] and all(plain[q, 1][1] == 0 for q, _ in rows[::25])


def test_angles_meet_in_near_boxes(spark, monkeypatch):
    """Angles go only to the boxes within reach, around the turn too, also angles beyond one turn and crowded ones."""
    r = random.Random(8)
    rows = [(i, [1.0] if i % 4 == 0 else [r.choice([r.random() * 6.28, 6.27 + 0.02 * r.random(), 0.01 * r.random(), 14.0 * r.random() - 7.0])]) for i in range(400)]
    got, met = met_in_boxes(spark, monkeypatch, rows, "so2", 4)
    assert met == [1]
    turned = lambda d: abs(d - 2 * np.pi) if d > np.pi else d
    for q, v in [*rows[::25], rows[3]]:
        order = sorted((turned(abs(w[0] - v[0])), i) for i, w in rows)[:4]
        assert [got[q, j + 1] for j in range(4)] == [(i, d) for d, i in order]


def test_kernel_sums_list_no_pairs(spark, monkeypatch):
    """Sums over neighbours are taken where they meet: a task gives a row a point, and crowded bricks lose nothing."""
    monkeypatch.setattr(bricks, "LEFT_ROWS", 40)
    monkeypatch.setattr(bricks, "RIGHT_ROWS", 30)
    assert not hasattr(pairwise, "range_pairs")  # that lists pairs
    r = random.Random(8)
    pts = [(i, *((0.97 + 0.1 * r.random()) % 1.0 for _ in "xyz"), 1.0 + r.random()) for i in range(150)]
    df = spark.createDataFrame(pts, SCHEMA + ", mass double")
    got = {x.id: x.phi for x in pairwise.gravity(df, df, 0.05, 1e-4).collect()}
    for a in pts[::10]:
        want = 0.0
        for b in pts:
            d = near(a, b)
            if 1e-15 < d < 0.05:
                x = 2 * d / 0.05
                g = x / 140 * (208 + 14 * (-8 * x**2 + 4 * x**4 - x**5 - 8 / 14 * x**6 + 3 / 14 * x**7) if x <= 1 else 12 / x + 128 + 14 * (16 * x - 32 * x**2 + 20 * x**3 - 4 * x**4 - x**5 + 8 / 14 * x**6 - x**7 / 14))
                want -= 0 if x > 1.999 else b[4] * (1 - g) / (d * d + 1e-4) ** 0.5
        assert got[a[0]] == pytest.approx(want, rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("auto", [False, True])
@pytest.mark.parametrize("lattice", [False, True])
def test_counts_by_two_bins_list_no_pairs(monkeypatch, lattice, auto):
    """Crowded visits get both bins of all their pairs at once; pairs at edges, copies and images fall as in full precision."""
    monkeypatch.setattr(bricks, "FEW", 0)
    r = np.random.default_rng(9)
    smu, spsp = SmuBins(RadialBins(0.0, 0.05, 5), 4), SpspBins(RadialBins(0.001, 0.05, 8), 0.05, 3)
    for start in (0.95, 0.45):
        some = lambda n, at=start: (r.integers(0, 10, (n, 3)) * 0.01 if lattice else r.random((n, 3)) * 0.1) + at
        one, two = (pd.DataFrame({"id": np.arange(n), **dict(zip("xyz", some(n).T % 1.0, strict=True))}) for n in (900, 700))
        two = one if auto else two
        d = [one[c].to_numpy()[:, None] - two[c].to_numpy()[None] for c in "xyz"]
        d = [x - np.floor(x + 0.5) for x in d]
        r2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
        for axis, bins in ((0, smu), (2, smu), (2, spsp)):
            if bins is smu:
                reach, binner, plane = 0.05, pairs.by_smu(smu, "xyz"[axis]), bricks.Plane(axis, False, 0.0, (smu.r.step, smu.mu_step), (5, 4))
            else:
                reach, binner, plane = spsp.reach, pairs.by_spsp(spsp, "z"), bricks.Plane(axis, True, 0.001, (spsp.perp.step, spsp.par_step), (8, 3))
            ok = r2 < reach * reach
            if auto:
                ok &= one["id"].to_numpy()[:, None] < one["id"].to_numpy()[None]
            (i, j), inside = binner(np.sqrt(r2[ok]), [x[ok] for x in d])
            want = np.zeros(plane.bins, np.int64)
            np.add.at(want, (i[inside], j[inside]), 1)
            met = list(bricks.visits(one, two, reach, 20, auto, True))
            got = np.zeros(plane.bins, np.int64)
            for x in pairs._plane_counts(iter(met), reach, binner, {"one": plane.bins[0], "two": plane.bins[1]}, plane).itertuples():
                got[x.one, x.two] += x.n
            assert (got == want).all()
            if start == 0.45:  # elsewhere a few visits hold points of both ends of the box
                assert all(bricks.count_plane(v, plane, lambda r2, d: np.zeros(0, np.int64)) is not None for v in met)

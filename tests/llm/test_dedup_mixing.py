import hashlib
import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from nebulark.llm import exact_dedup, mixing
from nebulark.llm._common import attach_groups, materialize, ranked

SF = "/root/testdata/sf0.001"


def plain_norm(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


def plain_dedup(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(plain_norm(t), []).append((-len(t or ""), i))
    return [(i, min(g)[1], len(g)) for i, t in rows for g in [groups[plain_norm(t)]]]


def test_exact_dedup_equals_brute_force(spark):
    r = random.Random(2)
    texts = ["same prefix " * 8 + str(r.randrange(40)) + " " * r.randrange(3) for _ in range(300)] + ["", None, " \t\n\x0b\x0c\r", "\xa0", "x" * 200_000, "x" * 200_000 + " "]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, digest string, n int")
    got = {x.doc_id: (x.keep_id, x.group_size, x.kept) for x in exact_dedup.exact_dedup(df).collect()}
    assert got == {i: (k, n, i == k) for i, k, n in plain_dedup(rows)}


def test_exact_dedup_null_ids_repeats_and_empty(spark):
    rows = [(None, "a"), (4, "a "), (4, "a "), (4, "b"), (9, "b"), (7, "c"), (7, "c")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, kept int")
    out = exact_dedup.exact_dedup(df).collect()
    assert len(out) == 7
    assert sorted((str(x.doc_id), str(x.keep_id), x.group_size, x.kept) for x in out) == sorted([("None", "4", 3, False), ("4", "4", 3, True), ("4", "4", 3, True), ("4", "4", 2, True), ("9", "4", 2, False), ("7", "7", 2, True), ("7", "7", 2, True)])
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns
    assert sorted((x.doc_id, x.text) for x in kept.collect()) == [(4, "a "), (4, "b"), (7, "c")]
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0 and exact_dedup.drop_exact_copies(df.limit(0)).count() == 0


def test_hot_groups_join_like_others(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 3000, "hot").when(F.col("id") < 4000, F.col("id").cast("string")).alias("key"))
    groups = materialize(rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")), "test")
    got = {x.id: (x.n, x.top) for x in attach_groups(rows, groups, "key", "n").collect()}
    assert got == {i: (3000, 2999) if i < 3000 else (1, i) if i < 4000 else (None, None) for i in range(5000)}


def test_global_ranks(spark):
    df = spark.range(2000).select((F.col("id") * 37 % 1000).alias("k"), "id")
    got = [x["rank"] for x in ranked(df, [F.col("k"), F.col("id")], "rank").orderBy("k", "id").collect()]
    assert got == list(range(2000))


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = total - sum(most * sizes[s] for s in capped)
        room = sum(w[s] for s in order if s not in capped)
        t = {s: most * sizes[s] if s in capped else free * w[s] / room for s in order}
        over = {s for s in order if t[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return t
        capped |= over


def plain_quotas(votes, seats):
    heap, quota = [(-v, k, 0) for k, v in enumerate(votes)], [0] * len(votes)
    heapq.heapify(heap)
    for _ in range(seats):
        _, k, n = heapq.heappop(heap)
        quota[k] += 1
        heapq.heappush(heap, (-votes[k] / (2 * n + 3), k, n + 1))
    return quota


def test_quotas_are_the_highest_quotients(spark):
    r = random.Random(4)
    sources = {"many": ([r.uniform(0, 900) for _ in range(60)], 400), "tiny": ([0.5, 1.25, 3.0], 2), "one": ([7.0], 5), "none": ([4.0, 2.0], 0), "zero": ([0.0, 0.0], 0), "wide": ([1e-3, 1e6, 40.0], 90)}
    sources["ties"] = ([2.5] * 41, 100)
    rows = [(k, i, v, seats, "x") for k, (votes, seats) in sources.items() for i, v in enumerate(votes)]
    got = {}
    for x in mixing.quotas(spark.createDataFrame(rows, "skey string, shard long, votes double, seats long, other string")).collect():
        got.setdefault(x.skey, {})[x.shard] = x.quota
    for k, (votes, seats) in sources.items():
        mine = [got[k][i] for i in range(len(votes))]
        assert sum(mine) == seats
        assert sorted(mine) == sorted(plain_quotas(votes, seats)) if k == "ties" else mine == plain_quotas(votes, seats)


def test_small_sources_come_near_their_targets(spark):
    """Sources of one to ten words beside each other and beside a large one."""
    for large in (0, 4000):
        texts = [(f"s{i:03d}", "w " * (1 + i % 10)) for i in range(300)] + [("big", "b " * 50)] * (large // 50)
        df = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(texts)], "doc_id long, text string, source string")
        sizes, longest, took = {}, {}, {}
        for s, t in texts:
            sizes[s] = sizes.get(s, 0) + len(t.split())
            longest[s] = len(t.split())
        want = plain_targets(sizes)
        for x in mixing.mix_sources(df).collect():
            assert x.taken <= 2 * x["size"] and x.target == pytest.approx(want[x.source])
            took[x.source] = took.get(x.source, 0) + x.taken
        assert all(abs(took[s] - t) <= min(longest[s], 1.0) for s, t in want.items() if s != "big")
        assert not large or abs(took["big"] - want["big"]) <= 50


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_mix_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mix_sources(docs).collect()
    sizes = {}
    for d in docs.collect():
        sizes[d.source] = sizes.get(d.source, 0) + len([w for w in re.split("[\x20\x09-\x0d]+", d.text or "") if w])
    want, took = plain_targets(sizes), {}
    for x in out:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source])
        assert 0 <= x.taken <= 2 * x.size
        assert x.taken == x.copies * x["size"] + sum(s.end - s.start for s in x.spans)
        assert all(0 <= s.start < s.end <= x["size"] for s in x.spans)
        took[x.source] = took.get(x.source, 0) + x.taken
    assert len(out) == docs.count()
    for s, t in want.items():
        assert abs(took[s] - t) <= 3 * mixing.BLOCK_WORDS + 0.01 * t
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert {x.doc_id: (x.taken, tuple(x.spans)) for x in out} == {x.doc_id: (x.taken, tuple(x.spans)) for x in again}


def test_mix_edge_cases(spark):
    rows = [(1, "a b c", None), (1, "a b c", None), (None, "d " * 5000, "s"), (2, None, "s"), (3, "", "empty"), (4, "x y", "t")]
    df = spark.createDataFrame([(i, t, s, 1, "q") for i, t, s in rows], "doc_id long, text string, source string, size int, skey string")
    out = mixing.mix_sources(df).collect()
    assert len(out) == 6
    for x in out:
        assert x.taken <= 2 * x["size"] and x.target <= 2 * x.source_size
    assert {x.source for x in out} == {None, "s", "empty", "t"}
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_whole_rows_and_rows_without_id(spark):
    r = random.Random(7)
    rows = [(None if k % 2 else 7, " ".join("w" * r.randint(1, 4) for _ in range(r.randint(1, 90))) + f" {k}", "s", k, {"k": k}) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, extra map<string,int>")
    whole = mixing.mix_sources(df, whole_rows=True)
    assert whole.columns == ["doc_id", "text", "source", "extra", "size", "source_size", "target", "taken", "copies", "spans"]
    got = whole.collect()
    assert sorted(x.text for x in got) == sorted(t for _, t, *_ in rows) and all(x["size"] == len(x.text.split()) for x in got)
    narrow = mixing.mix_sources(df).collect()
    assert sorted((str(x.doc_id), x["size"], x.taken) for x in got) == sorted((str(x.doc_id), x["size"], x.taken) for x in narrow)
    shard = F.pmod(F.xxhash64("text", "doc_id", F.lit(17)), F.lit(5))
    assert df.select(shard.alias("s")).distinct().count() == 5


def test_work_tables_go_with_their_scope(spark):
    from nebulark.llm import _common

    fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    with _common.scratch(spark) as outside:
        inside = _common.work_dir(spark)
        materialize(spark.range(3), "inside")
        kept = materialize(spark.range(3), "kept", f"{outside}/kept")
        assert fs(inside) and inside.startswith(outside)
    assert not fs(inside) and kept.count() == 3 and _common.work_dir(spark) == outside


def test_query_digests(spark):
    from nebulark.llm.queries import op2_exact_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {i: (k, n, i == k) for i, k, n in plain_dedup([(d.doc_id, d.text) for d in docs])}
    for x in op2_exact_dedup(spark, SF).collect():
        text = next(d.text for d in docs if d.doc_id == x.doc_id)
        assert (x.keep_id, x.group_size, x.kept) == want[x.doc_id]
        assert x.text_sha256 == hashlib.sha256(plain_norm(text).encode()).hexdigest()

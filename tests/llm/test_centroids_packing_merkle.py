import hashlib
import math
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nebulark.llm import centroids, merkle, packing, queries

SF = "/root/testdata/sf0.001"


def plain_clusters(rows, k, rounds, salt=3, size=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    at = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        own = [at(v) for _, v in kept]
        for j in set(own):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            c[j] = None or [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, at(v), far(v, c[at(v)])) for i, v in kept]
    total = sum(d for *_, d in found)
    return [(i, j, d, sum(x[2] for x in found if x[1] == j), total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found]


def as_rows(out):
    return sorted(((x.vec_id, x.cluster, x.distance, x.cluster_inertia, x.inertia, x.centroid_sha256) for x in out), key=repr)


def test_clusters_equal_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in r.normal(r.integers(0, 5), 0.3, 6)]) for i in range(300)]
    rows += [(300, rows[0][1]), (300, rows[0][1]), (None, rows[3][1]), (None, [0.0] * 6), (301, [-1.5] * 6), (302, None), (303, []), (304, [1.0] * 5), (305, [1.0] * 5 + [None]), (306, [1.0] * 5 + [math.nan]), (307, [1.0] * 5 + [-math.inf])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, cluster int, z double")
    for k, rounds, leading in ((4, 3, 2), (8, 2, 6), (1, 1, 1)):
        out = centroids.cluster(df, k, rounds, leading=leading, components=6).collect()
        assert as_rows(out) == sorted(plain_clusters(rows, k, rounds, size=6), key=repr)
        assert all(1 <= x.verified <= k for x in out)
    assert centroids.cluster(df.limit(0), components=6).count() == 0
    few = centroids.cluster(df.where("vec_id in (1, 2)"), components=6).collect()
    assert sorted((x.vec_id, x.distance) for x in few) == [(1, 0), (2, 0)]
    with pytest.raises(Exception, match="component beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e20] * 6)], "vec_id long, embedding array<double>"), components=6)


def test_bounds_are_below_distances_and_prune(spark):
    r = np.random.default_rng(1)
    x = r.integers(-900, 900, (500, 64))
    x[:, :8] *= 20
    second = np.cov(x.T)
    axes = np.linalg.eigh(second)[1][:, ::-1][:, :16]
    mean = x.mean(0)
    z, rest = centroids.rotate(x.astype(float), mean, axes)
    best, distance, verified = centroids.nearest(x, z, rest, x[:8], mean, axes)
    exact = ((x[:, None] - x[None, :8]) ** 2).sum(2)
    assert (best == exact.argmin(1)).all() and (distance == exact.min(1)).all() and verified.mean() < 3
    cz, crest = centroids.rotate(x[:8].astype(float), mean, axes)
    bound = ((z[:, None] - cz[None]) ** 2).sum(2) + (rest[:, None] - crest[None]) ** 2
    assert (bound * (1 - centroids.SLACK) - centroids.SLACK_LEAST <= exact).all()


ODD_TEXTS = [
    "", None, " \t\n", "Hello, WORLD's 12 apples!", "x<|endoftext|>y <|STARTOFTEXT|> Z<|startoftext|>", "a\x0bb\x0cc\x1cd\x85e\xa0f g", "ÀÉ é ΣΑΣ İI K ﬁ", "it's we'RE '' 's",
    "12345 ١٢ ½", "\U0001f600 \U0001f600\U0001f600a", "y" * 5000, "word " * 3000, "<| a |> B", "日本語 テキスト", "don't.stop,now;ok",
]


def library():
    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def test_ids_are_the_librarys(spark):
    texts = ODD_TEXTS + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    encoder = packing.Encoder(library().to_str())
    for t in texts + texts:
        t = t or ""
        assert np.frombuffer(encoder.ids(t.encode()), encoder.kind).tolist() == library_ids(t)


_LIBRARY = []


def library_ids(t):
    if not _LIBRARY:
        _LIBRARY.append(library())
    return _LIBRARY[0].encode(t, add_special_tokens=False).ids


def check_packing(rows, out, window):
    docs, seqs = {}, {}
    for x in out:
        ids = np.frombuffer(bytes(x.ids), "<u4").tolist()
        assert len(ids) == x.length > 0 and x.offset >= 0
        docs.setdefault(x.doc_id, []).append((x.start, ids, x.doc_tokens))
        seqs.setdefault(x.sequence_id, []).append((x.offset, x.length, x.source))
    for i, t in rows:
        want = library_ids(t or "") + [1]
        parts = sorted(docs[i])
        assert [s for s, *_ in parts] == np.cumsum([0] + [len(p) for _, p, _ in parts])[:-1].tolist()
        assert sum((p for _, p, _ in parts), []) == want and {n for *_, n in parts} == {len(want)}
    sizes = []
    for parts in seqs.values():
        parts.sort()
        assert [o for o, *_ in parts] == np.cumsum([0] + [n for _, n, _ in parts])[:-1].tolist()
        sizes.append(sum(n for _, n, _ in parts))
    assert all(n == window or n < window and n & (n - 1) == 0 for n in sizes)
    return seqs, sizes


def test_packing_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = packing.pack(docs).collect()
    seqs, sizes = check_packing(rows, out, 2048)
    total = sum(sizes)
    share = {}
    for x in out:
        share[x.source] = share.get(x.source, 0) + x.length / total
    whole = [s for s in seqs if sum(n for _, n, _ in seqs[s]) == 2048]
    early = sorted(whole)[: len(whole) // 2]  # before a queue runs out
    for s in early:
        for source, p in share.items():
            assert abs(sum(n for _, n, q in seqs[s] if q == source) - 2048 * p) <= packing.TURN + 2
    many = packing.pack(docs, block_bytes=60_000).collect()
    check_packing(rows, many, 2048)
    assert len({x.sequence_id >> 32 for x in many}) > 5
    whole = {x.sequence_id: bytes(x.ids) for x in packing.sequences(packing.pack(docs)).collect()}
    for x in out:
        assert whole[x.sequence_id][4 * x.offset : 4 * (x.offset + x.length)] == bytes(x.ids)
    digests = queries.op12_packing(spark, SF).collect()
    assert sorted((x.doc_id, x.start, x.ids_crc32) for x in digests) == sorted((x.doc_id, x.start, zlib.crc32(bytes(x.ids))) for x in out)


def test_packing_edge_cases(spark):
    rows = list(enumerate(ODD_TEXTS))
    df = spark.createDataFrame([(i, t, [None, "a", "b"][i % 3], 1, 2) for i, t in rows], "doc_id long, text string, source string, block int, n int")
    for weights in (None, {None: 1, "a": 3}, {}):
        check_packing(rows, packing.pack(df, weights, window=512, block_bytes=9000).collect(), 512)
    twice = packing.pack(spark.createDataFrame([(None, "a b", None)] * 3 + [(7, None, "s")] * 2, df.schema.__class__(df.schema.fields[:3]))).collect()
    assert sorted((str(x.doc_id), x.length) for x in twice if x.start == 0 and x.length == x.doc_tokens) and sum(x.length for x in twice) == 3 * 3 + 2
    assert packing.pack(df.limit(0)).count() == 0


def test_deficits_go_on_over_windows_and_blocks(spark):
    turns = list(packing.windows([9000, 900, 100], [0.9, 0.09, 0.01], [0.0, 0.0, 0.0], 1000, 8))
    assert [sum(t for _, t in w) for w in turns] == [1000] * 10
    for k in range(1, 10):
        got = [sum(t for w in turns[:k] for q, t in w if q == s) for s in range(3)]
        assert all(abs(g - 1000 * k * p) <= 10 for g, p in zip(got, (0.9, 0.09, 0.01), strict=True))
    owed = next(packing.windows([5000, 5000], [0.5, 0.5], [400.0, -400.0], 1000, 8))
    assert abs(sum(t for q, t in owed if q == 0) - 900) <= 10
    counts = spark.createDataFrame([(0, "sa", 100), (0, "sb", 300), (1, "sa", 300), (1, "sb", 100), (2, "sb", 200)], "block int, skey string, tokens long")
    got = {(x.block, x.skey): (round(x.weight, 6), round(x.deficit, 6)) for x in packing.block_state(counts, None).collect()}
    assert got == {(0, "sa"): (0.4, 0.0), (0, "sb"): (0.6, 0.0), (1, "sa"): (0.4, 60.0), (1, "sb"): (0.6, -60.0), (2, "sb"): (0.6, 80.0)}


def plain_hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return plain_hash(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(level):
    """All levels of a tree, and for every leaf its steps (sibling or None, whether it is on the left)."""
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([plain_hash(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    paths = []
    for i in range(len(level)):
        steps = []
        for nodes in levels[:-1]:
            j = i ^ 1
            steps.append((nodes[j] if j < len(nodes) else None, j < i))
            i >>= 1
        paths.append(steps)
    return levels[-1][0], paths


def plain_manifest(rows):
    groups, out = {}, []
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, tops = plain_tree([trees[g][0] for g in names])
    for g, top in zip(names, tops, strict=True):
        for (_, _, leaf, r), steps in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            steps = steps + top
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = plain_leaf((*r[:3], r[3] if r[3] is None else r[3] + 1, r[4])) if bad else leaf
            for sibling, left in steps:
                h = plain_hash(h) if sibling is None else plain_hash(sibling, h) if left else plain_hash(h, sibling)
            out.append((r[0], leaf, trees[g][0], root, plain_hash(*[s for s, _ in steps if s]), h, h == root))
    return out


def test_missing_nodes_are_minimal():
    assert merkle.missing_nodes([0], 1) == [] and merkle.missing_nodes([4], 5) == [(2, 0)]
    assert merkle.missing_nodes([0, 1, 2, 3], 4) == [] and merkle.missing_nodes([3, 1], 8) == [(0, 0), (0, 2), (2, 1)]
    assert merkle.missing_nodes(list(range(4, 8)), 100) == [(2, 0), (3, 1), (4, 1), (5, 1), (6, 1)]


@pytest.mark.parametrize("run_levels", [1, 3, 10])
def test_manifest_equals_brute_force(spark, run_levels):
    rows = [(i * 7 % 101, f"s{i % 3}" if i % 5 else None, ["en", "de", "é", None, "z"][min(i % 7, 4)], i if i % 4 else None, ["téxt", "", None, "x" * 3000][i % 4]) for i in range(101)]
    rows += [(None, None, None, None, None), (None, "a", "en", 1, "b"), (5, "a", "en", 1, "b"), (5, "a", "en", 1, "b"), (5, "a", "en", 1, "c"), (1, "a", "alone", 2**63 - 1, "b"), (2, "a", "", 3, "b")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, pos int, tree string")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = merkle.manifest(df, tampered, {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}, with_siblings=True, run_levels=run_levels).collect()
    got = [(x.doc_id, x.leaf, x.subroot, x.root, x.proof_sha256, x.folded_root, x.verified) for x in out]
    assert sorted(got, key=repr) == sorted(plain_manifest(rows), key=repr)
    assert all(plain_hash(*x.siblings) == x.proof_sha256 for x in out)
    assert any(not x.verified for x in out) and sum(x.verified for x in out) > len(out) / 2
    if run_levels == 1:
        assert merkle.manifest(df.limit(0)).count() == 0
        lone = merkle.manifest(df.where("doc_id = 1 and lang = 'alone'")).collect()
        assert [(x.leaf == x.root == x.subroot == x.folded_root, x.proof_sha256) for x in lone] == [(True, plain_hash())]


@pytest.mark.parametrize("name", ["op11_centroids", "op13_merkle"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = con.sql(queries.ORACLE[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall())

import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from nebulark.llm import simhash
from nebulark.llm.components import components


def plain_fingerprint(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [words] if len(words) < 4 else [words[i : i + 4] for i in range(len(words) - 3)]
    hashes = [xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, bits=4):
    """fps: list of (id, fp); the smallest reachable id of each row."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(fps):
        low[find(i)] = min(low.get(find(i), d), d)
    return [low[find(i)] for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", " \n", "One", "a b c", "a b c d", "A B c d e É", "x " * 50, "  a b c d e"])
def test_fingerprint_by_definition(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


def test_fingerprint_of_long_text_in_parts(monkeypatch):
    text = " ".join(random.Random(3).choice("abcdefgh") * 3 for _ in range(500))
    monkeypatch.setattr(simhash, "_PART", 37)
    assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


def test_embedding_is_a_lower_bound(spark):
    r = np.random.default_rng(1)
    fps = r.integers(-(2**63), 2**63 - 1, 300)
    rows = spark.createDataFrame([(int(x),) for x in fps], "fp long").select("fp", simhash.segment_counts(simhash.F.col("fp")).alias("e")).collect()
    for a in rows[:40]:
        for b in rows:
            counts = lambda v: [(v >> 2 * s & 3).bit_count() for s in range(32)]
            manhattan = sum(abs(x - y) for x, y in zip(counts(a.fp), counts(b.fp), strict=True))
            assert ((a.e ^ b.e) & (1 << 64) - 1).bit_count() == manhattan <= ((a.fp ^ b.fp) & (1 << 64) - 1).bit_count()


@pytest.mark.parametrize("block", [2048, 7])
def test_links_join_all_near_fingerprints(spark, block):
    r, fps = random.Random(5), set()
    for _ in range(12):  # clusters of near fingerprints, chains among them
        f = r.getrandbits(64)
        for _ in range(25):
            f ^= sum(1 << r.randrange(64) for _ in range(r.randint(1, 5)))
            fps.add(f)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), block=block)
    root = {x.node: x.root for x in components(links).collect()}
    unsigned = [(f, f & (1 << 64) - 1) for f in fps]
    assert [root.get(f, f) for f in fps] == plain_components(unsigned)


def test_any_number_of_groups_finds_the_same_components(spark):
    r, fps = random.Random(6), set()
    for _ in range(8):
        f = r.getrandbits(64)
        for _ in range(12):
            f ^= sum(1 << r.randrange(64) for _ in range(r.randint(1, 5)))
            fps.add(f)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = plain_components([(f, f & (1 << 64) - 1) for f in fps])
    assert [simhash.groups_for(n) for n in (0, 10**6, 10**8, 10**9)] == [7, 7, 9, 11]
    for groups in (7, 9):
        root = {x.node: x.root for x in components(simhash.near_links(df, groups=groups)).collect()}
        assert [root.get(f, f) for f in fps] == want


def test_near_duplicates_edge_cases(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away into the deep dark wood at night"
    rows = [(5, base), (3, base.upper()), (9, None), (2, ""), (7, " \t\n"), (None, base), (8, "word " * 30_000), (8, "word " * 30_000), (1, "nothing like the rest of these at all")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, fp string, n int")
    got = sorted(((x.doc_id is None, x.doc_id or 0), x.fingerprint, x.component_id, x.component_size) for x in simhash.near_duplicates(df).collect())
    known = [(i, plain_fingerprint(t)) for i, t in rows if i is not None]
    want = dict(zip([i for i, _ in known], plain_components(known), strict=True))
    assert len(got) == len(rows)
    for (null, i), f, c, _ in got:
        assert c == (3 if null else want[i])
        assert f == format(plain_fingerprint(base if null else dict(rows)[i]), "016x")
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == set(want.values())


def test_ids_used_twice_or_missing_lose_only_their_copies(spark):
    r = random.Random(9)
    a, b, c, d = (" ".join(r.choice("abcdefghijklm") * r.randint(2, 6) for _ in range(60)) for _ in range(4))
    rows = [(1, a), (4, a), (4, b), (None, a), (None, c), (6, d), (7, d)]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, mark int")
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(((x.doc_id or 0), x.text) for x in kept.collect()) == sorted([(1, a), (4, b), (0, c), (6, d)])


def test_query_equals_brute_force(spark):
    from nebulark.llm.queries import op1_simhash

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [(d.doc_id, plain_fingerprint(d.text)) for d in docs]
    want = {d: (format(f, "016x"), c) for (d, f), c in zip(fps, plain_components(fps), strict=True)}
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in op1_simhash(spark, sf).collect()}
    assert got == want

import corpus_pipeline as P
from nebulark.llm import decontam, queries, toxicity

from .test_dedup_mixing import plain_dedup, plain_targets
from .test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(P.STAGES)
    columns = docs.columns

    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), queries.train_rows())
    clean = stage["toxicity"](spark, docs, SF).cache()
    bad = {x.doc_id for x in toxicity.score(docs, model).where("predicted = 1").collect()}
    rows = {d.doc_id: d.text for d in docs.collect() if d.doc_id not in bad}
    assert clean.columns == columns and {d.doc_id: d.text for d in clean.collect()} == rows

    unique = stage["exact_dedup"](spark, clean, SF).cache()
    keep = {k for _, k, _ in plain_dedup(list(rows.items()))}
    assert unique.columns == columns and {d.doc_id for d in unique.collect()} == keep

    far = stage["simhash_near_dedup"](spark, unique, SF).cache()
    fps = [(i, plain_fingerprint(rows[i])) for i in sorted(keep)]
    keep = set(plain_components(fps))
    assert far.columns == columns and {d.doc_id for d in far.collect()} == keep

    held = stage["benchmark_decontamination"](spark, far, SF).cache()
    leaked = {x.doc_id for x in decontam.contaminated(far, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    items = [" ".join(b.text.split()) for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {i for i in keep if any(b in " ".join(rows[i].split()) for b in items)} <= leaked
    assert held.columns == columns and {d.doc_id for d in held.collect()} == keep - leaked

    mixed = stage["source_mixing"](spark, held, SF).collect()
    sizes = {}
    for d in held.collect():
        sizes[d.source] = sizes.get(d.source, 0) + len(d.text.split())
    want = plain_targets(sizes)
    for s, t in want.items():
        assert abs(sum(x.taken for x in mixed if x.source == s) - t) <= 200 + 0.01 * t
    assert all(0 < x.taken <= 2 * x["size"] for x in mixed) and len({x.doc_id for x in mixed}) == len(mixed)

    whole = {x.doc_id: x.taken for x in P.run(spark, SF).collect()}
    assert whole == {x.doc_id: x.taken for x in mixed}


def test_stages_take_empty_and_odd_tables(spark, tmp_path):
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "s", 0), (1, "a b", "en", None, 3), (1, "a b", "en", None, 3), (2, "a b", "en", "t", 3)], schema)
    for docs in (odd.limit(0), odd):
        for _, stage in P.STAGES:
            docs = stage(spark, docs, str(tmp_path)).cache()
            docs.count()
        assert docs.count() in (0, 1)

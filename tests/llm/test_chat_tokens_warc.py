import base64
import gzip
import hashlib
import random

import public_tokenizers
import pytest
import pyarrow.fs as pafs
from tokenizers import Tokenizer

from nebulark.llm import chat, token_count, warc

EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string, piece string"


def folded(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], EVENTS)
    back = chat.read_back(chat.format_chats(df)).collect()
    return {x.conv_id: ([(t.role, t.text) for t in x.turns], x.loss_text) for x in back}


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 1, 0, "message", "user", "Hi"), (1, 2, 1, "message", "assistant", ""), (1, 3, 1, "delta", None, "Hel"), (1, 4, 1, "delta", None, "lo"),
        (1, 5, 1, "regenerate", None, "Bye"), (1, 6, 1, "delta", None, "!"), (1, 7, 0, "edit", None, "Hi there"), (1, 8, 2, "delta", "assistant", "streamed"),
        (2, 1, 0, None, None, None), (None, 1, None, "message", "assistant", "no id"),
    ]
    random.Random(1).shuffle(rows)
    got = folded(spark, rows)
    assert got[1] == ([("user", "Hi there"), ("assistant", "Bye!"), ("assistant", "streamed")], "Bye!streamed")
    assert got[2] == ([("", "")], "") and got[None] == ([("assistant", "no id")], "no id")


def test_control_strings_and_backslashes_come_back(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\n<|end|>\\<|", "<|start|>user<|sep|>", "<<SYS>>", "a\n\nb", "<s><s", "[[INST]]", "x" * 300_000, "<\\|", "é𝒳"]
    rows = [(c, i, i, "message", "assistant" if i % 2 else "<|end|>us\\er", t) for c in (1, 2) for i, t in enumerate(texts)] + [(1, 3, 3, "message", "assistant", "tie")] * 2
    got = folded(spark, rows)
    assert got[2] == ([(r[4], r[5]) for r in rows if r[0] == 2], "".join(t for i, t in enumerate(texts) if i % 2))
    assert len(got[1][0]) == len(texts) + 2
    formatted = chat.format_chats(spark.createDataFrame([(*r, "x") for r in rows], EVENTS)).collect()
    assert all(x.formatted.count(chat.END) == len(got[x.conv_id][0]) for x in formatted)
    assert chat.format_chats(spark.createDataFrame([], EVENTS)).count() == 0


def test_token_counts_equal_the_library(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(1)
    texts = ["", " ", "  \n", "a  b", "<|endoftext|>", "x <|endoftext|> y<|endoftext|>", "don't we'll\x1c", "　a \xa0b", "a" * 3000, "½ ² ١٢ 漢字", "the cat. " * 20_000, "\x00", "👍🏽"]
    texts += ["".join(r.choice("ab 'st\n\t.,\x1c\xa0é漢<|endoftext|>12") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, None, 5)], "doc_id long, text string, n_tokens int")
    got = {x.doc_id: x for x in token_count.count_tokens(df).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert all(got[i].n_bytes == len(t.encode()) and got[i].over_limit == (want[i] > 512) for i, t in enumerate(texts))
    assert (got[None].n_tokens, got[None].n_bytes, got[None].over_limit) == (0, 0, False)
    assert token_count.count_tokens(df.limit(0)).count() == 0


def test_tokens_of_the_table(spark):
    from nebulark.llm.queries import op4_token_count

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {d.doc_id: len(e.ids) for d, e in zip(docs, lib.encode_batch([d.text for d in docs], add_special_tokens=False), strict=True)}
    assert {x.doc_id: x.n_tokens for x in op4_token_count(spark, "/root/testdata/sf0.001").collect()} == want


def sha32(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_archives_round_trip(spark, tmp_path):
    big = "Ü\r\n\r\nWARC/1.1\r\n" * 60_000
    rows = [(1, "http://a", "one"), (2, "http://b", "one"), (3, None, big), (4, "http://d", None), (5, "u", ""), (None, "n", "one"), (2, "again", "one"), (7, "u", "two\r\n\r\n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    manifest = warc.archive_pages(df.repartition(3), f"file://{tmp_path}/out")
    got = warc.read_records(manifest).collect()
    assert len(got) == len(rows) and sum(x.records for x in manifest.collect()) == len(rows)
    for x in got:
        data = next((h or "").encode() for i, _, h in rows if i == x.page_id)
        assert (x.payload_bytes, x.payload_digest) == (len(data), sha32(data))
    kinds = sorted((str(x.page_id), x.record_type, str(x.refers_to)) for x in got)
    assert kinds == sorted([("1", "revisit", "2"), ("2", "response", "None"), ("2", "revisit", "2"), ("None", "revisit", "2"), ("3", "response", "None"), ("4", "revisit", "5"), ("5", "response", "None"), ("7", "response", "None")])
    chunks = warc.read_archives(manifest, chunk_bytes=1000).where("page_id = 3").orderBy("chunk_no").collect()
    assert b"".join(bytes(c.data) for c in chunks) == big.encode() and len(chunks) > 100 and chunks[-1].digest == sha32(big.encode())
    assert chunks[0].digest == sha32(big.encode()[:1000])
    for m in manifest.collect():  # plain gzip members, one a record
        fs, name = pafs.FileSystem.from_uri(m.path)
        assert gzip.decompress(fs.open_input_stream(name).read()).startswith(b"WARC/1.1\r\n")
    assert warc.read_records(warc.archive_pages(df.limit(0), f"file://{tmp_path}/none")).count() == 0


def test_records_stay_whole_in_one_task_and_archives_spread(spark, tmp_path):
    big = "0123456789abcdef" * 40_000
    df = spark.createDataFrame([(i, "u", big + str(i)) for i in range(6)], "page_id long, url string, html string")
    chunks = warc.materialize(warc.record_chunks(df.repartition(3), chunk_bytes=20_000), "test-chunks")
    conf = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.autoBroadcastJoinThreshold": "100m"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        manifest = warc.write_archives(chunks, warc.record_types(chunks), f"file://{tmp_path}/split")
        got = {x.page_id: x.payload_digest for x in warc.read_records(manifest).collect()}
        assert got == {i: sha32((big + str(i)).encode()) for i in range(6)}
    finally:
        for k in conf:
            spark.conf.unset(k)
    back = warc.read_archives(manifest, with_data=False)
    parts = back.select(warc.F.spark_partition_id().alias("p")).distinct().count()
    assert manifest.count() > 1 and parts == manifest.count()
    with pytest.raises(Exception, match="begins with chunk"):
        warc.write_archives(chunks.where("chunk_no > 0"), warc.record_types(chunks), f"file://{tmp_path}/cut").count()


def test_large_ids_beside_null_ids_stay_exact(spark, tmp_path):
    big = 2**62 + 1
    df = spark.createDataFrame([(big, "a"), (None, "a"), (big + 2, "b c")], "doc_id long, text string").coalesce(1)
    assert {x.doc_id for x in token_count.count_tokens(df).collect()} == {big, None, big + 2}
    got = warc.read_records(warc.archive_pages(df, f"file://{tmp_path}/ids", "doc_id", "text", "text")).collect()
    assert sorted((str(x.page_id), str(x.refers_to)) for x in got) == sorted([(str(big), "None"), ("None", str(big)), (str(big + 2), "None")])

"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulark.llm import centroids, chat, decontam, exact_dedup, langid, license_scan, merkle, mixing, packing, simhash, token_count, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    digest = F.sha2(exact_dedup.normalised(F.coalesce("text", F.lit(""))), 256)
    return exact_dedup.exact_dedup(docs.withColumn("text_sha256", digest), carry=("text_sha256",), digest="text_sha256")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    back = chat.read_back(chat.format_chats(chat.events_of_turns(turns.unionByName(probe))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"))


def train_rows(doc_id: str = "doc_id") -> Column:
    """Rows that models may learn from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0


def _held_out() -> Column:
    """Whether that remainder is 0; a row without id is not held out, and nothing is learnt from it."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, train_rows())
    return toxicity.score(docs, model).select("doc_id", _held_out().alias("held_out"), "score", "predicted")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs, train_rows()))
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_records(warc.archive_pages(_table(spark, sf_dir, "pages")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.train(docs))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings")).drop("verified")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(_table(spark, sf_dir, "documents"), tampered, {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1})


_STRIP = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * g + 1}, 5))::INTEGER >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))

ORACLE = {
    "op2_exact_dedup": f"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256({_STRIP}) AS h FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
        FROM t WINDOW w AS (PARTITION BY h ORDER BY chars DESC, doc_id)""",
    "op3_chat_format": r"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (
          SELECT *, length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '(<)(\||/?s>|<SYS)', '\1\\\2', 'g'), '(\[)(/?INST\])', '\1\\\2', 'g')) AS n FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
               CAST(sum(9 + length(role) + 7 + n + 7) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op7_warc": f"""
        WITH t AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS best FROM t)
        SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
        FROM r""",
}


def _centroid_sql(clusters: int = centroids.CLUSTERS, rounds: int = centroids.ROUNDS) -> str:
    """The clustering as one common table expression a round: rows x centroids, sums by component."""
    steps = [f"""k AS MATERIALIZED (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
      c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS INT) AS c, v AS m FROM k QUALIFY c < {clusters})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
          SELECT vec_id, v, c, d FROM (
            SELECT vec_id, v, c, CAST(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS r FROM k, c{i}) WHERE r = 1)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
          SELECT c0.c, coalesce(n.m, c0.m) AS m FROM c{i} AS c0 LEFT JOIN (
            SELECT c, list(CAST(floor(s / n) AS BIGINT) ORDER BY j) AS m FROM (
              SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY c, j) GROUP BY c) n ON n.c = c0.c)""")
    return f"""WITH {", ".join(steps)}
      SELECT vec_id, a.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
             sha256(array_to_string(m, ',')) AS centroid_sha256
      FROM a{rounds} AS a JOIN c{rounds} USING (c)"""


def _merkle_sql(levels: int = 24, group_levels: int = 8) -> str:
    """The trees level by level: enough levels for 2**levels rows a language and 2**group_levels languages."""
    field = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')".format
    leaf = lambda n: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
    changed = "CASE WHEN crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END"
    poly = f"list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i + 1]) AS BIGINT))), lambda h, b: {_crc_byte('xor(h, b)')})"
    steps = [f"d AS MATERIALIZED (SELECT *, xor({poly}, 4294967295) AS crc FROM documents)",
             f"""l AS MATERIALIZED (SELECT doc_id, coalesce('s' || lang, '') AS t, {leaf("n_chars")} AS leaf, {leaf(changed)} AS f0, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, {leaf("n_chars")}) - 1 AS p,
                   count(*) OVER (PARTITION BY lang) AS n FROM d)""",
             "n0 AS MATERIALIZED (SELECT t, p AS idx, n, leaf AS h FROM l)"]

    def climb(name: str, top: int) -> None:
        for i in range(top):
            steps.append(f"{name}{i + 1} AS MATERIALIZED (SELECT t, idx // 2 AS idx, (any_value(n) + 1) // 2 AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h FROM {name}{i} GROUP BY t, idx // 2)")

    def fold(name: str, at: str, top: int) -> None:
        for i in range(top):
            steps.append(f"""{at}{i + 1} AS MATERIALIZED (
              SELECT a.* EXCLUDE (f, proof, n, idx), a.idx // 2 AS idx, (a.n + 1) // 2 AS n, proof || coalesce(s.h, '') AS proof,
                     CASE WHEN a.n = 1 THEN f WHEN a.idx % 2 = 0 THEN sha256(f || coalesce(s.h, '')) ELSE sha256(s.h || f) END AS f
              FROM {at}{i} AS a LEFT JOIN {name}{i} AS s ON s.t = a.t AND s.idx = xor(a.idx, 1))""")

    climb("n", levels)
    steps.append(f"r0 AS MATERIALIZED (SELECT '' AS t, row_number() OVER (ORDER BY t) - 1 AS idx, count(*) OVER () AS n, h, t AS tree FROM n{levels})")
    climb("r", group_levels)
    steps.append("p0 AS MATERIALIZED (SELECT doc_id, leaf, t, p AS idx, n, '' AS proof, f0 AS f FROM l)")
    fold("n", "p", levels)
    steps.append(f"q0 AS MATERIALIZED (SELECT p.doc_id, p.leaf, r.h AS subroot, '' AS t, r.idx, r.n, p.proof, p.f FROM p{levels} AS p JOIN r0 AS r ON r.tree = p.t)")
    fold("r", "q", group_levels)
    return f"""WITH {", ".join(steps)}
      SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified FROM q{group_levels}, r{group_levels} AS r"""


def _crc_byte(h: str) -> str:
    """One byte of a crc32: eight shifts, each with the polynomial where a bit falls out."""
    for _ in range(8):
        h = f"list_transform([{h}], lambda x: xor(x >> 1, 3988292384 * (x & 1)))[1]"
    return h


ORACLE["op11_centroids"] = _centroid_sql()
ORACLE["op13_merkle"] = _merkle_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_exact_dedup, op3_chat_format, op4_token_count, op5_toxicity, op6_language, op7_warc, op8_decontaminate, op9_license_scan, op10_mix_sources, op11_centroids, op12_packing, op13_merkle)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

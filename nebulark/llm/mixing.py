"""Mixing sources to target weights by Sainte-Lague apportionment, DataFrame functions only.

Words are cut into equal blocks, of BLOCK_WORDS words or, in a source whose target is below FINEST
such blocks, as many fewer as keep it at FINEST.  A source's seats are its target over its block, rounded: the
highest quotients votes / (2k + 1) above one divisor.  Every shard (a slice of about SHARD_DOCS
documents of one source) gets a whole number of them: the target is shared over the source's shards by
size, and its seats go to their highest quotients again.  Those are the quotients above a divisor of the
source; the divisors of all sources are found together, some dozen tries at a time, and seats
that tie for the last place go to shards in a seeded order, so a source gets its seats exactly.  Inside a
shard documents lie end to end in a seeded order, and a seeded affine permutation picks the quota of
blocks; quotas above the number of blocks take all of them once and the rest again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nebulark.llm._common import attach_groups, materialize, ranked, text_of

BLOCK_WORDS = 64
#: A source is mixed in at least so many blocks, if it has the words.
FINEST = 256
SHARD_DOCS = 128
#: Multipliers of the block permutation: primes above any shard's number of blocks.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)


def word_count(text_col: str) -> Column:
    return F.regexp_count(text_of(text_col), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def source_targets(sources: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of (skey, source, source_size): weights cycle in code-point order of the source, null last.

    The weights share ``share`` of all words; a source stops at ``most`` times its size, and what
    is over goes to the others by weight, again and again until none is above.  Only two sums a
    round come to the driver.
    """
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    order = [F.col("source").isNull(), F.col("source")]
    table = ranked(sources, order, "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = materialize(table.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most)), "sources")
    level = 0.0
    while True:
        capped = F.col("cap") <= F.col("weight") * F.lit(level)
        free, held = table.agg(F.sum(F.when(~capped, F.col("weight"))), F.sum(F.when(capped, F.col("cap")))).first()
        if not free:
            level = float("inf")
            break
        new = (total * share - (held or 0.0)) / free
        if new <= level:
            break
        level = new
    target = F.col("cap") if level == float("inf") else F.least("cap", F.col("weight") * F.lit(level))
    return table.withColumn("target", target.cast("double")).drop("weight", "cap", "rank")


def quotas(shards: DataFrame, rounds: int = 6, width: int = 32, seed: int = 17) -> DataFrame:
    """``shards`` (skey, shard, votes, seats, ...) with quota: the seats of each skey by its shards' highest quotients.

    ``seats`` is the same in all rows of a skey.  The quotas round(votes / d) fall as d grows; each round
    keeps, for every skey, the interval of d in which their sum passes its seats, starting from one where all
    quotas are 0 down to one where the largest alone has them all.  What is left at the end are ties.
    """
    votes = F.col("votes")
    ends = shards.groupBy("skey").agg((F.max(votes) / (F.first("seats") * 2 + 1)).alias("low"), (F.max(votes) * 2.5 + 1.0).alias("high"), F.first("seats").alias("seats"))
    bracket = materialize(ends, "mix-brackets")
    at = lambda i: F.col("low") + (F.col("high") - F.col("low")) * (i / width)
    seats_at = lambda d: F.when(d > 0, F.floor(votes / d + 0.5)).otherwise(F.lit(0)).cast("long")
    for _ in range(rounds):
        tries = F.array(*[F.sum(seats_at(at(i))) for i in range(width + 1)])
        own = ["skey", F.first("low").alias("low"), F.first("high").alias("high"), F.first("seats").alias("seats")]
        got = shards.drop("seats").join(bracket, "skey").groupBy("skey").agg(*own[1:], tries.alias("got"))
        over = F.size(F.filter("got", lambda n: n > F.col("seats")))  # the sums fall: these come first
        i = F.greatest(over - 1, F.lit(0))
        step = (F.col("high") - F.col("low")) / F.lit(width)
        bracket = materialize(got.select("skey", (F.col("low") + step * i).alias("low"), (F.col("low") + step * (i + 1)).alias("high"), "seats"), "mix-brackets")
    rows = shards.drop("seats").join(bracket, "skey").withColumns({"least": seats_at(F.col("high")), "most": seats_at(F.col("low"))})
    order = Window.partitionBy("skey").orderBy(F.xxhash64("skey", "shard", F.lit(seed + 3)), "shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tied = rows.where("most > least").withColumn("__up", F.sum(F.col("most") - F.col("least")).over(order))
    left = rows.groupBy("skey").agg((F.first("seats") - F.sum("least")).alias("__left"))
    tied = tied.join(left, "skey").select("skey", "shard", F.greatest(F.lit(0), F.least(F.col("most") - F.col("least"), F.col("__left") - F.col("__up") + F.col("most") - F.col("least"))).alias("__more"))
    rows = rows.join(tied, ["skey", "shard"], "left").withColumn("quota", (F.col("least") + F.coalesce("__more", F.lit(0))).cast("long"))
    return rows.drop("low", "high", "seats", "least", "most", "__more")


def mix_sources(docs: DataFrame, seed: int = 17, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, whole_rows: bool = False) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, copies, spans.

    With ``whole_rows`` the columns of ``docs`` come first instead of doc_id and source; they move once, with the
    shuffle that lays shards out, and one of theirs that has the name of a column added here gives way.

    ``copies`` is how often the whole document is taken, ``spans`` (start, end) are the word ranges
    taken once more; ``taken`` is the words of both.  A null text has size 0 and takes nothing; a
    null source is a source of its own, last in order.  Repeated rows count each (those equal in id and
    text may exchange what is taken of them); null ids are allowed.  Empty input gives no rows; other columns are ignored.  The same input and seed give
    the same mix whatever the partitioning.
    """
    mark = F.xxhash64(text_of(text_col), F.col(id_col), F.lit(seed))  # rows without id, or of one id, spread too
    skey = F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("s"), F.col("source")))
    row = [F.struct(*docs.columns).alias("__row")] * whole_rows
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), mark.alias("__mark"), *row).withColumn("skey", skey)
    sized = materialize(plain.drop("__row"), "mix-sizes")
    sources = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    per = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("target") / F.lit(FINEST)))).cast("long")
    targets = materialize(source_targets(sources, weights, share, most).withColumn("block", per), "mix-targets")
    slices = F.greatest(F.lit(1), F.ceil(F.col("source_docs") / F.lit(SHARD_DOCS)))

    def place(rows: DataFrame) -> DataFrame:
        rows = attach_groups(rows, targets.drop("source"), "skey", "source_docs", F.col("__mark"))
        return rows.withColumn("shard", F.pmod("__mark", slices).cast("long")).drop("source_docs")

    placed = place(sized)
    by_shard = ["skey", "shard"]
    shards = placed.groupBy(*by_shard).agg(F.sum("size").alias("shard_size"), F.first("target").alias("t"), F.first("source_size").alias("z"), F.first("block").alias("block"))
    votes = F.when(F.col("z") > 0, F.col("t") * F.col("shard_size") / F.col("z")).otherwise(F.lit(0.0))
    seats = F.round(F.col("t") / F.col("block")).cast("long")
    blocks = F.ceil(F.col("shard_size") / F.col("block")).cast("long")
    shards = materialize(shards.select(*by_shard, votes.alias("votes"), seats.alias("seats"), blocks.alias("blocks")), "mix-shards")
    quota = F.least("quota", F.floor(F.col("blocks") * F.lit(most)).cast("long"))
    shards = materialize(quotas(shards, seed=seed).select(*by_shard, "blocks", quota.alias("quota")), "mix-quotas")

    whole = Window.partitionBy(*by_shard)
    inside = whole.orderBy(F.xxhash64("__mark", F.lit(seed + 1)), "doc_id", "__mark", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = place(plain) if whole_rows else placed
    rows = placed.join(shards, by_shard)  # by the keys of the window, so rows move once
    rows = rows.withColumn("end_", F.sum("size").over(inside)).withColumn("start_", F.col("end_") - F.col("size"))
    rows = rows.withColumn("copies", F.when(F.col("blocks") > 0, F.expr("quota div blocks")).otherwise(F.lit(0)).cast("int")).withColumn("extra", F.when(F.col("blocks") > 0, F.col("quota") % F.col("blocks")).otherwise(F.lit(0)))
    mark = F.xxhash64("skey", "shard", F.lit(seed + 2))
    rows = rows.withColumn("step", F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.pmod(mark, F.lit(len(PRIMES))) + 1).cast("int")))
    rows = rows.withColumn("shift", F.when(F.col("blocks") > 0, F.pmod(F.shiftrightunsigned(mark, 8), F.col("blocks"))).otherwise(F.lit(0)))
    chosen = F.expr(
        """transform(
              filter(if(size = 0 or extra = 0, array(), sequence(start_ div block, (end_ - 1) div block)), j -> pmod(step * j + shift, blocks) < extra),
              j -> struct(greatest(j * block - start_, 0L) as start, least((j + 1) * block, end_) - start_ as end))"""
    )
    rows = rows.withColumn("spans", chosen)
    taken = F.col("size") * F.col("copies") + F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    added = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": taken.cast("long"), "copies": F.col("copies"), "spans": F.col("spans")}
    own = [F.col("__row").getField(c).alias(c) for c in docs.columns if c not in added] if whole_rows else ["doc_id", "source"]
    return rows.select(*own, *[v.alias(c) for c, v in added.items()])

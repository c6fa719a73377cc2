"""Language ID by n-gram filters that hold a bitmask of languages in every slot.

The Bloom filters of all languages are sliced by bit: slot j of one table has bit l set when slot j
of language l's filter is.  Looking an n-gram up ands HASHES slots and gives all languages that
(may) hold it.  A text's hits are counted per language and corrected for the filters' false
positives; the largest share decides.

Training reads about TRAIN_DOCS documents of each language, chosen by a hash of the id; an n-gram
goes into the filters of the languages where it is frequent enough beside the language that has it most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nebulark.llm._common import mapped, materialize, text_of

TRAIN_DOCS = 2000
SIZES = (3, 5)
HASHES = 2
SLOT_BITS = 20
#: N-grams kept in a language at most, the most frequent ones: bounds the filters' fill.
NGRAMS = 60_000
#: Share of the largest rate among languages from which an n-gram counts as a language's own.
OWN_SHARE = 0.3
UNKNOWN = "und"

_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])


def _clean(text: str) -> np.ndarray:
    """Code points in lower case; runs of other characters than letters become one space, also at both ends."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.where(points < 0x10000, _LETTER[np.minimum(points, 0xFFFF)], True)
    if (points >= 0x10000).any():
        letter = letter & np.array([p < 0x10000 or chr(p).isalpha() for p in points])
    points = np.where(letter, points, 32)
    return points[letter | np.r_[True, letter[:-1]]]


def ngram_hashes(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each n-gram of the sizes SIZES."""
    out = []
    for n in SIZES:
        m = len(points) - n + 1
        if m > 0:
            h = np.full(m, 0x9E3779B97F4A7C15 ^ n, np.uint64)
            for i in range(n):
                h = (h ^ points[i : i + m]) * np.uint64(0x100000001B3)
                h ^= h >> np.uint64(29)
            out.append(h * np.uint64(0xBF58476D1CE4E5B9))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _slots(hashes: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << SLOT_BITS) - 1)
    return [((hashes >> np.uint64(i * SLOT_BITS)) & mask).astype(np.int64) for i in range(1, HASHES + 1)]


@dataclass
class Filters:
    langs: list[str]
    table: np.ndarray  # slots x ceil(languages / 64), uint64
    rates: np.ndarray  # false-positive rate of each language's filter
    prior: int  # the language of texts that no filter decides

    def shares(self, texts: list[str]) -> np.ndarray:
        """Corrected hits of each text (row) and language (column)."""
        grams = [ngram_hashes(_clean(t)) for t in texts]
        out = np.zeros((len(texts), len(self.langs)))
        sizes = np.array([len(g) for g in grams])
        some = np.flatnonzero(sizes)
        if not len(some):
            return out
        hashes = np.concatenate([grams[i] for i in some])
        starts = np.r_[0, np.cumsum(sizes[some])[:-1]]
        slots = _slots(hashes)
        for word in range(self.table.shape[1]):
            column = self.table[:, word]
            found = column[slots[0]]
            for s in slots[1:]:
                found = found & column[s]
            for lang in range(64 * word, min(64 * word + 64, len(self.langs))):
                hits = np.add.reduceat((found >> np.uint64(lang - 64 * word)) & np.uint64(1), starts).astype(np.float64)
                rate = self.rates[lang]
                out[some, lang] = np.maximum(0.0, (hits - rate * sizes[some]) / (1.0 - rate))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        shares = self.shares(texts)
        total, best = shares.sum(axis=1), shares.argmax(axis=1)
        best = np.where(total > 0, best, self.prior)
        score = np.where(total > 0, shares.max(axis=1) / np.maximum(total, 1e-300), 1.0 / len(self.langs))
        known = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        return [self.langs[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)], np.where(known, np.minimum(score, 1.0), 0.0)


def train(docs: DataFrame, where: Column | None = None, most: int = TRAIN_DOCS, ngrams: int = NGRAMS) -> Filters:
    """Filters learned from (doc_id, text, lang); rows without lang, text or id are left out.

    ``where`` bounds the rows, ``most`` the documents of a language and ``ngrams`` its n-grams.  Without rows there are no languages and every text is unknown.
    """
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("doc_id is not null and text is not null and lang is not null")
    if where is not None:
        rows = rows.where(where)
    count = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    langs = sorted(count)
    if not langs:
        return Filters([], np.zeros((1 << SLOT_BITS, 1), np.uint64), np.zeros(0), 0)
    number = {lang: i for i, lang in enumerate(langs)}
    part = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, most / count[lang])))])
    mark = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = rows.where(mark < part[F.col("lang")])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                got, n = np.unique(np.concatenate([ngram_hashes(_clean(t)) for t in texts]), return_counts=True)
                yield pd.DataFrame({"lang": number[lang], "gram": got.view(np.int64), "n": n})

    grams = materialize(sample.select("lang", "text").mapInPandas(counted, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langid-grams")
    totals = {r["lang"]: r["t"] for r in grams.groupBy("lang").agg(F.sum("n").alias("t")).collect()}
    total = F.create_map(*[x for k, t in totals.items() for x in (F.lit(k), F.lit(float(t)))])
    rated = grams.withColumn("rate", F.col("n") / total[F.col("lang")])
    by_gram = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate", "n")).alias("in_langs"))  # a row a language at most
    own = by_gram.select("gram", "top", F.explode("in_langs").alias("x")).where((F.col("x.rate") >= OWN_SHARE * F.col("top")) & (F.col("x.n") >= 3)).select("gram", "x.lang", "x.n")
    # A language's n-grams come from its sample alone, so one window partition a language is bounded.
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    kept = own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= ngrams)
    places = [F.shiftrightunsigned("gram", i * SLOT_BITS).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)) for i in range(1, HASHES + 1)]
    bits = F.element_at(F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]), F.col("lang") % 64 + 1)
    slots = kept.select(F.explode(F.array(*places)).alias("slot"), F.floor(F.col("lang") / 64).cast("int").alias("word"), bits.alias("bits"))
    filled = slots.groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).toPandas()  # a row a slot and 64 languages at most
    table = np.zeros((1 << SLOT_BITS, (len(langs) + 63) // 64), np.uint64)
    table[filled["slot"], filled["word"]] = filled["bits"].to_numpy(np.int64).view(np.uint64)
    fill = np.array([((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
    return Filters(langs, table, fill**HASHES, number[max(langs, key=lambda x: count[x])])


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (the language's share of corrected hits, 0 to 1).

    A null text, or one without a letter, is ``und`` with score 0; on a tie the first language in
    order counts; a text that no filter knows gets the most frequent language.  Ids may be null or
    repeated; empty input gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 8 MB for each 64 languages
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = shared.value
        for b in batches:
            texts, langs, scores, at = b["text"].tolist(), [], [], 0
            while at < len(texts):  # about a million characters at a time
                end, held = at, 0
                while end < len(texts) and (held == 0 or held + len(texts[end]) < 1 << 20):
                    held += len(texts[end])
                    end += 1
                got, score = f.predict(texts[at:end])
                langs += got
                scores.append(score)
                at = end
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": langs, "score": np.concatenate(scores) if scores else []})

    return mapped(rows, run, "lang_pred string, score double")

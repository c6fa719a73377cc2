"""Toxicity: a logistic classifier with a counterfactual regulariser.

Features are a text's distinct words and their first PREFIXES letters, hashed; the model keeps the
FEATURES most associated with the label.  Training rows are a bounded sample of the labelled ones.
In their sentences identity terms are swapped within their group, and the squared change of the
score is added to the loss, so that a group's name by itself does not move a score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nebulark.llm._common import mapped, text_of

#: Labelled rows that training reads at most (each with its whole text).
TRAIN_ROWS = 20_000
#: Rows of ``docs`` that may share a labelled id.
REPEATS = 16
BUCKETS = 1 << 20
FEATURES = 4096
PREFIXES = (4, 5, 6, 7, 8)
#: Words that a task remembers at most (some 30 MB); then it forgets them all and starts again.
REMEMBER = 100_000
#: Weight of a toxic row in the loss: they are the fewer.
TOXIC_WEIGHT = 2.0
#: Swapped within a line.
IDENTITY_GROUPS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "refugees", "locals"),
    ("disabled", "blind", "deaf"),
    ("old", "young"),
)
_WORD = re.compile(r"[^\W\d_]+")


def _swaps() -> dict[str, str]:
    return {t: g[(i + 1) % len(g)] for g in IDENTITY_GROUPS for i, t in enumerate(g)}


def buckets(word: str) -> tuple[int, ...]:
    """The feature numbers of one word in lower case."""
    names = ["w" + word] + [f"{n}{word[:n]}" for n in PREFIXES if len(word) > n]
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for x in names)


class Reader:
    """Texts to sets of kept features; remembers words, up to a bound."""

    def __init__(self, kept: dict[int, int] | None):
        class Known(dict):
            def __missing__(self, word: str) -> tuple[int, ...]:
                got = buckets(word)
                if kept is not None:
                    got = tuple(kept[x] for x in got if x in kept)
                if len(self) >= REMEMBER:
                    self.clear()
                self[word] = got
                return got

        self.known = Known()

    def features(self, text: str) -> set[int]:
        words = set(_WORD.findall(text.lower()))
        return set().union(*filter(None, map(self.known.__getitem__, words)))


@dataclass
class Model:
    kept: np.ndarray  # bucket of each feature
    weights: np.ndarray
    bias: float

    def score(self, features: set[int]) -> float:
        z = self.bias + float(self.weights[list(features)].sum()) if features else self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0)))


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column | None, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, toxic) of at most ``most`` labelled rows, chosen by a hash of the id.

    Rows without id or label, and ids of more than REPEATS rows of ``docs``, are left out; of several labels of a document the largest counts.
    ``train`` is a condition on doc_id.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    if train is not None:
        known = known.where(train)
    known = known.join(docs.groupBy("doc_id").count().where(F.col("count") <= REPEATS), "doc_id", "left_semi")
    return known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(most)


def _bucket_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    reader, seen, toxic = Reader(None), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in batches:
        for text, label in zip(b["text"], b["toxic"], strict=True):
            at = np.fromiter(reader.features(text), np.int64)
            seen[at] += 1
            if label:
                toxic[at] += 1
    at = np.flatnonzero(seen)
    yield pd.DataFrame({"bucket": at, "seen": seen[at], "toxic": toxic[at]})


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, most: int = TRAIN_ROWS, penalty: float = 1.0, ridge: float = 2e-3, steps: int = 400, features: int = FEATURES) -> Model:
    """Fit on labelled rows of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); ``where`` bounds the ids,
    ``most`` the labelled ids and ``features`` the model's size.  A label holds for every row of its id, up to
    REPEATS of them; ids of more rows are left out.  No labelled rows give a model of score 0.
    """
    sample = labelled_sample(docs, labels, where, most)
    ids = sample.toPandas()  # TRAIN_ROWS pairs of numbers at most
    if ids.empty:
        return Model(np.zeros(0, np.int64), np.zeros(0), -40.0)
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame(ids, sample.schema))
    rows = docs.select("doc_id", text_of("text").alias("text")).join(chosen, "doc_id").select("doc_id", "text", "toxic")

    counts = rows.mapInPandas(_bucket_counts, "bucket long, seen long, toxic long").groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic"))
    n, p = F.lit(float(len(ids))), F.lit(float(max(1, int(ids["toxic"].astype(bool).sum()))))
    gap = F.col("toxic") / p - (F.col("seen") - F.col("toxic")) / F.greatest(n - p, F.lit(1.0))
    rate = F.col("seen") / n
    chi = gap * gap / (rate * (1.0 + 1.0 / n - rate))
    top = counts.where("seen >= 4").orderBy(chi.desc(), "bucket").limit(features).select("bucket").toPandas()["bucket"]  # so many numbers at most
    identity = [b for g in IDENTITY_GROUPS for t in g for b in buckets(t)[:1]]
    kept = np.array(list(dict.fromkeys([*top.tolist(), *identity])), np.int64)
    place = {int(b): i for i, b in enumerate(kept)}
    swap = _swaps()

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(place)
        pattern = re.compile(r"\b(" + "|".join(swap) + r")\b")
        for b in batches:
            pairs = []
            for text in b["text"]:
                changes = []
                for sentence in re.split(r"[.!?\n]+", text.lower()):
                    if pattern.search(sentence):
                        old, new = reader.features(sentence), reader.features(pattern.sub(lambda m: swap[m[0]], sentence))
                        changes.append(sorted(old - new) + [-1] + sorted(new - old))
                pairs.append(changes)
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "f": [sorted(reader.features(t)) for t in b["text"]], "swaps": pairs})

    kind = dict(docs.dtypes)["doc_id"]
    data = rows.mapInPandas(encoded, f"doc_id {kind}, toxic int, f array<int>, swaps array<array<int>>")
    data = data.orderBy("doc_id").toPandas()  # TRAIN_ROWS rows of kept feature numbers at most
    return _fit(kept, data, penalty, ridge, steps)


def _fit(kept: np.ndarray, data: pd.DataFrame, penalty: float, ridge: float, steps: int) -> Model:
    """Adam from fixed starts (the same rows give the same model) on the logistic loss + penalty x mean squared score change of the swaps + ridge."""
    y = data["toxic"].to_numpy(np.float64)
    n, row_weight = len(y), np.where(y > 0, TOXIC_WEIGHT, 1.0)
    row = np.repeat(np.arange(n), [len(f) for f in data["f"]])
    col = np.concatenate([np.asarray(f, np.int64) for f in data["f"]]) if len(row) else np.zeros(0, np.int64)
    s_row, s_col, s_sign, k = [], [], [], 0
    for swaps in data["swaps"]:
        for change in swaps:
            sign = 1.0
            for x in change:
                if x < 0:
                    sign = -1.0
                else:
                    s_row.append(k), s_col.append(x), s_sign.append(sign)
            k += 1
    s_row, s_col, s_sign = np.array(s_row, np.int64), np.array(s_col, np.int64), np.array(s_sign)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w, b = np.zeros(len(kept)), float(np.log(rate / (1 - rate)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = b + np.bincount(row, w[col], n)
        e = row_weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        g, gb = np.bincount(col, e[row], len(w)) + ridge * w, e.sum()
        if k:
            change = np.bincount(s_row, s_sign * w[s_col], k)
            g += penalty * 2 / k * np.bincount(s_col, s_sign * change[s_row], len(w))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate_t = 0.05 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w, b = w - rate_t * m / (np.sqrt(v) + 1e-8), b - rate_t * mb / (np.sqrt(vb) + 1e-8)
    return Model(kept, w, float(b))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), predicted (1 if score >= 0.5, else 0).

    Null and empty texts get the score of a text without known words.  Repeated rows and null ids
    are scored like others; empty input gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        reader = Reader({int(b): i for i, b in enumerate(m.kept)})
        for b in batches:
            s = np.array([m.score(reader.features(t)) for t in b["text"]], np.float64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    return mapped(rows, run, "score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not predict toxic, with all their columns, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        reader = Reader({int(b): i for i, b in enumerate(m.kept)})
        for texts in batches:
            yield pd.Series([bool(m.score(reader.features(t)) >= 0.5) for t in texts], dtype=bool)

    return docs.where(~toxic(text_of(text_col)))

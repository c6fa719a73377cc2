"""Benchmark decontamination by templates.

Words become literals or typed slots: numbers, names (a given name, or a capital inside a sentence)
and units.  Windows of WINDOW tokens are hashed, and a second time with capitals folded (no names but
given ones), so that a copy in other case matches; document windows that may be a benchmark's (a
bitmap of fixed size says) are joined with the benchmark's windows by hash.  Matches are grouped by
document, item and diagonal (the distance of the two positions); a diagonal counts only if each
slot value of the item meets one value in the document, so a question with new numbers or names is
caught and a chance template is not.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from nebulark.llm._common import materialize, row_key, text_of, without_rows

WINDOW = 5
#: A window has at least so many literals.
LITERALS = 3
#: Share of an item's windows that makes a document contaminated.
COVERAGE = 0.5
#: Bits of the bitmap of benchmark windows that every scanning task holds (2 MB).
BITMAP_BITS = 24
#: Benchmark windows up to this number are broadcast; beyond, the join shuffles.
BROADCAST_WINDOWS = 200_000
UNITS = frozenset(
    """mm cm dm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz ml cl l liter liters litre litres
    s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years ms ns
    hz khz mhz ghz w kw mw v kv a ma j kj kcal cal pa kpa bar n kn mph kmh kph rpm bit bits byte bytes kb mb gb tb
    usd eur gbp dollar dollars euro euros pound pounds cent cents percent pct degree degrees celsius fahrenheit kelvin""".split()
)
#: Spelled-out units: metric prefixes before base units, singular and plural.
UNITS |= {prefix + base + end for prefix in ("", "kilo", "mega", "giga", "centi", "milli", "micro", "nano") for base in "meter metre gram gramme liter litre watt volt hertz byte joule calorie second newton pascal".split() for end in ("", "s")}
UNITS |= frozenset("ounce ounces ton tons tonne tonnes decade decades century centuries fortnight acre acres hectare hectares gallon gallons yen rupee rupees peso pesos".split())
#: Spelled-out numbers that are no other word.
NUMBER_WORDS = frozenset(
    """two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty
    thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice thrice""".split()
)
NAMES = frozenset(
    """james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica
    thomas sarah charles karen daniel lisa matthew nancy anthony betty mark sandra paul ashley steven emily andrew donna
    kevin michelle brian carol george amanda peter laura anna maria alice bob tom tim sam jack emma olivia sophia liam noah
    ahmed fatima wei chen ivan olga pedro carlos luis jose juan pierre marie hans klaus yuki raj priya""".split()
)
_NUMBER = re.compile(r"[+-]?(?:\d+(?:[.,:/]\d+)*|\d*\.\d+)(?:st|nd|rd|th|%)?$")
_QUANTITY = re.compile(r"([+-]?\d+(?:[.,]\d+)*)([a-zµ°]+)$")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
#: Marks the first word of a line.
_LINE = "\0"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def sequences(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` literal words, from their hashes, in one pass whatever the length."""
    powers = np.full(len(words) + 1, _MULTIPLIER)
    powers[0] = 1
    inverse = np.full(len(words) + 1, np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64)))
    inverse[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(powers)[:-1], dtype=np.uint64)])
    h = (sums[length:] - sums[:-length]) * np.cumprod(inverse)[: len(words) - length + 1] + np.uint64(length)
    h = (h ^ h >> np.uint64(31)) * _MULTIPLIER
    return h ^ h >> np.uint64(29)


class Templates:
    """Tokens of texts: a template hash, a slot type (0 literal) and the word, for each.

    Raw words are remembered in growing arrays, up to a bound (some 55 MB).
    """

    MOST = 200_000

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        templates = self
        self.words: list[str] = []
        self.plain, self.inner, self.first, self.kinds, self.kinds_first, self.ends, self.starts, self.empty = (np.zeros(1024, t) for t in (np.uint64, np.uint64, np.uint64, np.int8, np.int8, bool, bool, bool))

        class Known(dict):
            def __missing__(self, raw: str) -> int:
                self[raw] = n = templates.learn(raw)
                return n

        self.known = Known()

    def learn(self, raw: str) -> int:
        n = len(self.words)
        if n == len(self.inner):
            self.plain, self.inner, self.first, self.kinds, self.kinds_first, self.ends, self.starts, self.empty = (np.concatenate([x, np.zeros_like(x)]) for x in (self.plain, self.inner, self.first, self.kinds, self.kinds_first, self.ends, self.starts, self.empty))
        bare = raw if raw.isalpha() else _EDGES.sub("", raw)
        word = bare.lower()
        kind, shape = 0, word
        if word in UNITS and len(word) > 1:
            kind, shape = 3, "\0unit"
        elif word in NAMES:
            kind, shape = 2, "\0name"
        elif word in NUMBER_WORDS:
            kind, shape = 1, "\0number"
        elif not word.isalpha():
            if _NUMBER.match(word):
                kind, shape = 1, "\0number"
            elif (q := _QUANTITY.match(word)) and q[2] in UNITS:
                kind, shape = 3, "\0quantity"
        inside, inside_kind = (shape, kind) if kind or not (bare[:1].isupper() and bare[1:].islower()) else ("\0name", 2)
        hashed = lambda x: xxh64_intdigest(x.encode("utf-8", "surrogatepass"))
        self.words.append(word)
        self.plain[n] = hashed("\0word" + word)
        self.first[n], self.inner[n], self.kinds_first[n], self.kinds[n] = hashed(shape), hashed(inside), kind, inside_kind
        self.ends[n] = raw.rstrip("\"')]»”’")[-1:] in (".", "!", "?", ":", "…")
        self.starts[n] = raw[0] == _LINE
        self.empty[n] = not word
        return n

    def windows(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each window, whether it counts, and of each token its slot kind, its word number; then hash, count and kind with capitals folded."""
        if len(self.words) > self.MOST:
            self.forget()
        raw = text.replace(_LINE, " ").replace("\n", "\n" + _LINE).split()
        ids = np.fromiter(map(self.known.__getitem__, raw), np.int64, len(raw))
        opening = self.starts[ids]
        opening[1:] |= self.ends[ids][:-1]
        opening[:1] = True
        full = np.flatnonzero(~self.empty[ids])
        if 0 < len(full) < len(ids):
            # A line or sentence that begins at a lone mark (indents, bullets, quotes) goes on to the next word.
            opening = np.logical_or.reduceat(opening[: full[-1] + 1], np.concatenate([[0], full[:-1] + 1]))
        else:
            opening = opening[full]
        ids = ids[full]
        token = np.where(opening, self.first[ids], self.inner[ids])
        kind = np.where(opening, self.kinds_first[ids], self.kinds[ids])
        h, counts = self.hashed(token, kind)
        if (kind == self.kinds_first[ids]).all():
            return h, counts, kind, ids, h, counts, kind
        folded = self.kinds_first[ids]
        return h, counts, kind, ids, *self.hashed(self.first[ids], folded), folded

    @staticmethod
    def hashed(token: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = max(0, len(token) - WINDOW + 1)
        h, slots = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        for i in range(WINDOW):
            h = (h ^ token[i : i + n]) * _MULTIPLIER
            h ^= h >> np.uint64(31)
            slots += kind[i : i + n] > 0
        return h, slots <= WINDOW - LITERALS

    def exact(self, text: str, ids: np.ndarray, length: int) -> np.ndarray:
        """Hash of each run of ``length`` words; 0 where a run shorter than LITERALS is not whole lines."""
        h = sequences(self.plain[ids], length)
        if length >= LITERALS:
            return h
        edges, at = {0}, 0
        for line in text.split("\n"):
            at += sum(not self.empty[self.known[w]] for w in line.replace(_LINE, " ").split())
            edges.add(at)
        whole = [i in edges and i + length in edges for i in range(len(h))]
        return np.where(whole, h, np.uint64(0))

    def slots(self, at: int, kind: np.ndarray, ids: np.ndarray) -> list[str]:
        return [f"{kind[i]}:{self.words[ids[i]]}" for i in range(at, at + WINDOW) if kind[i]]


@functools.lru_cache(maxsize=1)
def worker_templates() -> Templates:
    """One for a Python worker, so that its tasks share what they remember."""
    return Templates()


def _bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


_SCHEMA = "pos int, hash long, slots array<string>, total int, length int"


def template_windows(rows: DataFrame, wanted: np.ndarray | None, lengths: tuple[int, ...] = ()) -> DataFrame:
    """Windows (key, pos, hash, slots, total, length) of (key, text) rows; only those in the bitmap ``wanted``, if given.

    Without it, a text with words but no window that counts is one run of literal words, ``length``
    of them; with it, runs of the given ``lengths`` are looked up too.  Elsewhere ``length`` is 0.

    A window that capitals change comes with both hashes.  ``total`` is how many windows of the text
    count; where none does because of capitals, those that count with capitals folded.
    """
    shared = None if wanted is None else rows.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = worker_templates()
        bits = None if shared is None else np.unpackbits(shared.value).astype(bool)
        for b in batches:
            out = []
            for key, text in zip(b["key"], b["text"], strict=True):
                h, counts, kind, ids, folded, folded_counts, folded_kind = templates.windows(text)
                other = folded_counts & (folded != h)
                if bits is None:  # an item: both hashes stand for the same windows
                    total = int(counts.sum())
                    if total:
                        other &= counts
                    else:
                        total = int(folded_counts.sum())
                    ok = counts
                else:
                    ok, other, total = counts & bits[_bits(h)], other & bits[_bits(folded)], 0
                out += [(key, i, h[i].astype(np.int64), templates.slots(i, kind, ids), total, 0) for i in np.flatnonzero(ok).tolist()]
                out += [(key, i, folded[i].astype(np.int64), templates.slots(i, folded_kind, ids), total, 0) for i in np.flatnonzero(other).tolist()]
                if bits is None and not total and len(ids):
                    out.append((key, 0, sequences(templates.plain[ids], len(ids))[0].astype(np.int64), [], 1, len(ids)))
                for length in lengths:
                    if length <= len(ids):
                        g = templates.exact(text, ids, length)
                        out += [(key, i, g[i].astype(np.int64), [], 0, length) for i in np.flatnonzero(bits[_bits(g)] & (g > 0)).tolist()]
            if out:
                yield pd.DataFrame(out, columns=["key", "pos", "hash", "slots", "total", "length"])

    return rows.select("key", "text").mapInPandas(run, f"key string, {_SCHEMA}")


def _id_of(key: str, kind: DataType) -> Column:
    """The id in a row_key, null if the row has none."""
    named = F.expr(f"substring({key}, instr({key}, ':') + 1)")
    return F.when(named != "null", F.substring(named, 2, 1 << 30)).cast(kind)


def _found(docs: DataFrame, benchmark: DataFrame, coverage: float, id_col: str, text_col: str, item_id: str, item_text: str) -> DataFrame:
    """As ``contaminated``, with row_key as doc_id."""
    items = benchmark.select(row_key(item_id, item_text).alias("key"), text_of(item_text).alias("text")).dropDuplicates(["key"])
    known = materialize(template_windows(items, None), "benchmark-windows").withColumnsRenamed({"key": "item", "pos": "item_pos", "slots": "item_slots", "total": "n_windows"})
    n = known.count()
    # The bitmap has a fixed size: its set positions come a distinct slot at a time, 2**BITMAP_BITS at most.
    place = F.shiftrightunsigned("hash", 64 - BITMAP_BITS).cast("int")
    wanted = np.zeros(1 << BITMAP_BITS, bool)
    for part in known.select(place.alias("p")).distinct().toLocalIterator():
        wanted[part["p"]] = True
    lengths = tuple(sorted(x["length"] for x in known.where("length > 0").select("length").distinct().collect()))  # a number a length
    small = F.broadcast if n <= BROADCAST_WINDOWS else (lambda df: df)
    rows = docs.select(row_key(id_col, text_col).alias("key"), text_of(text_col).alias("text"))
    seen = materialize(template_windows(rows, wanted, lengths).withColumnRenamed("key", "doc_id").drop("total"), "benchmark-seen")

    # A document must hold some of the item's rarest windows: with n of them and k needed, one of the n - k + 1 rarest.
    # So boilerplate that many items and documents share brings no pair forward; it is only looked up for pairs found otherwise.
    often = seen.groupBy("hash", "length").agg(F.count(F.lit(1)).alias("often"))
    met = materialize(often.join(small(known.select("hash", "length", "item", "item_pos", "n_windows")), ["hash", "length"]), "benchmark-met")
    places = known.select("item", "item_pos", "n_windows").distinct().join(met.groupBy("item", "item_pos").agg(F.sum("often").alias("often")), ["item", "item_pos"], "left")
    rarest = Window.partitionBy("item").orderBy(F.coalesce("often", F.lit(0)), "item_pos")
    probes = places.withColumn("nth", F.row_number().over(rarest)).where(F.col("nth") <= F.col("n_windows") - F.ceil(F.col("n_windows") * F.lit(coverage - 1e-9)) + 1)
    probes = materialize(met.join(probes.where("often > 0").select("item", "item_pos"), ["item", "item_pos"]).select("hash", "length", "item").distinct(), "benchmark-probes")
    candidates = seen.select("doc_id", "hash", "length").join(small(probes), ["hash", "length"]).select("doc_id", "item").distinct()
    hits = seen.join(candidates, "doc_id").join(small(known), ["item", "hash", "length"])

    pairs = F.expr("arrays_zip(item_slots, slots)")
    diagonals = hits.groupBy("doc_id", "item", "n_windows", (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(F.collect_set("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    diagonals = diagonals.where("size(array_distinct(transform(pairs, p -> p.item_slots))) = size(pairs)")
    diagonals = diagonals.withColumn("changed", F.exists("pairs", lambda p: p["item_slots"] != p["slots"]))
    found = diagonals.select("doc_id", "item", "n_windows", "changed", F.explode("at").alias("p")).groupBy("doc_id", "item", "n_windows").agg(F.countDistinct("p").alias("found"), F.min("changed").alias("changed"))
    found = found.withColumn("coverage", F.col("found") / F.col("n_windows")).where(F.col("coverage") >= coverage)
    best = F.max(F.struct("coverage", (~F.col("changed")).alias("same"), "n_windows")).alias("b")  # of the texts of one item id
    return found.groupBy("doc_id", _id_of("item", benchmark.schema[item_id].dataType).alias("item_id")).agg(best).select("doc_id", "item_id", "b.coverage", "b.n_windows", (~F.col("b.same")).alias("changed"))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage, n_windows, changed) of each document that holds enough of an item.

    ``coverage`` is the share of the item's windows found on consistent diagonals, ``changed`` whether
    a slot differs on all of these.  Texts that share an item id are items each; the best one counts.  Null texts are empty.  An item without a window that counts (fewer than WINDOW
    words, or too many slots) matches its exact words in any case, one of fewer than LITERALS words
    only as whole lines; a text or item without words matches nothing.  Rows with one id are told
    apart by their texts, equal ones are one document; rows and items without id are rows and items like
    others, with a null.  Empty tables give no rows; other columns are ignored.
    """
    found = _found(docs, benchmark, coverage, id_col, text_col, item_id, item_text)
    return found.select(_id_of("doc_id", docs.schema[id_col].dataType).alias("doc_id"), "item_id", "coverage", "n_windows", "changed")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all their columns; nulls as in ``contaminated``."""
    found = _found(docs, benchmark, COVERAGE, id_col, text_col, "item_id", "text").select(F.col("doc_id").alias("key")).distinct()
    return without_rows(docs, row_key(id_col, text_col), materialize(found, "benchmark-found"))

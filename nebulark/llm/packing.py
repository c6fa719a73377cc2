"""Mixture-controlled packing of token ids into sequences by deficit round-robin over source queues.

Documents are tokenised once and dealt over blocks of a bounded size, each source evenly over all of
them.  In a block every source is a queue of token ids.  A window of ``window`` ids is filled by
turns: a source whose deficit (the ids due to it by its target proportion, less those it has had)
reaches a turn takes that many ids; when no source can, each is credited in proportion.  Deficits go
on from window to window.  They also go on from block to block without waiting: a block uses up all
its ids, so what a source is owed at its start follows from the counts of the blocks before.

What is left at the end of a block is cut at powers of two, so no sequence needs padding.
"""

from __future__ import annotations

import functools
import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from nebulark.llm._common import materialize, text_of

VOCABULARY, END_ID, WINDOW = "word_bpe_49k.json", 1, 2048
#: A source takes its turn when so many ids are due to it (or all that it has, or all that fit).
TURN = 32
#: Text of a block in bytes, about; a block is one task, and a document is never divided over blocks.
BLOCK_BYTES = 8 << 20
#: A document goes to the least filled of so many blocks that are drawn for it.
CHOICES = 8
#: Words remembered by a worker at most (about 200 MB); then it forgets them all and starts again.
REMEMBER = 1_000_000
_LONG_WORD = 48
_ENDS = b".,;:!?"


class Encoder:
    """Token ids of whole texts from the library, word by word with a memory.

    White space parts tokens in this vocabulary and ASCII letters are lower-cased by it, so a text's ids
    are those of its words; texts that may hold a special token are not lower-cased here.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_str(vocabulary)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.ends = {bytes([c]): self._of([bytes([c])])[0] for c in _ENDS}
        self.known: dict[bytes, bytes] = {}

    def _of(self, words: list[bytes]) -> list[bytes]:
        coded = self.library.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in words], add_special_tokens=False)
        letter = "H" if self.kind.itemsize == 2 else "I"
        return [struct.pack(f"<{len(e.ids)}{letter}", *e.ids) for e in coded]

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of new words; a mark after an ASCII letter is a token of its own, so the word without it is asked for."""
        stems = {w: w[:-1] if w[-1:] in self.ends and w[-2:-1].isalpha() else w for w in words}
        new = [s for s in set(stems.values()) if s not in self.known]
        found = dict(zip(new, self._of(new), strict=True))
        if len(self.known) + 2 * len(words) > REMEMBER:
            found |= {s: self.known[s] for s in stems.values() if s not in found}
            self.known.clear()
        for w, s in stems.items():
            if w is not s:
                found[w] = (found[s] if s in found else self.known[s]) + self.ends[w[-1:]]
        self.known.update((w, i) for w, i in found.items() if len(w) <= _LONG_WORD)
        return found

    def ids(self, text: bytes) -> bytes:
        """The ids of a text, without the end id, as little-endian integers of ``kind``."""
        words = (text if b"<|" in text else text.lower()).split()
        parts = list(map(self.known.get, words))
        if None in parts:
            found = self._learn({w for w, p in zip(words, parts, strict=True) if p is None})
            parts = [found[w] if p is None else p for w, p in zip(words, parts, strict=True)]
        return b"".join(parts)


@functools.lru_cache(maxsize=1)
def encoder_of(vocabulary: str) -> Encoder:
    """One encoder for a Python worker, so that its tasks share what they remember."""
    return Encoder(vocabulary)


def tokenized(docs: DataFrame, blocks: int, vocabulary: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, skey (the source as a key), row (unique), block, n and ids of every row; deals the rows over blocks."""
    skey = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null"))
    rows = docs.select(F.col(id_col).alias("doc_id"), skey.alias("skey"), text_of(text_col).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a few MB, fixed
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("skey string, row long, block int, n long, ids binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = encoder_of(shared.value), TaskContext.get().partitionId(), 0
        end, size = np.array([end_id], encoder.kind).tobytes(), encoder.kind.itemsize
        draw, filled = np.random.default_rng(part), {}
        for b in batches:
            ids, n, block = [], [], []
            choices = draw.integers(0, blocks, (b.num_rows, min(CHOICES, blocks))).tolist()
            for text, source, some in zip(b.column("text").to_pylist(), b.column("skey").to_pylist(), choices, strict=True):
                ids.append(encoder.ids(text) + end)
                n.append(len(ids[-1]) // size)
                best = min(some, key=lambda x: filled.get((source, x), 0))
                filled[source, best] = filled.get((source, best), 0) + n[-1]
                block.append(best)
            row = np.arange(at, at + b.num_rows, dtype=np.int64) + (part << 36)
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("skey"), pa.array(row), pa.array(block, pa.int32()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def block_state(counts: DataFrame, weights: dict | None) -> DataFrame:
    """weight and deficit of each source at the start of each block that holds it, from (block, skey, tokens).

    Without weights a source's target proportion is its share of all tokens.
    """
    totals = counts.groupBy("skey").agg(F.sum("tokens").alias("own"))
    whole = counts.agg(F.sum("tokens")).first()[0] or 1
    if weights is None:
        share = F.col("own") / F.lit(whole)
    else:
        named = {"null" if k is None else f"s{k}": float(w) for k, w in weights.items()}
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kw in named.items() for x in kw]), F.col("__s")), F.lit(0.0)) / F.lit(sum(named.values())) if named else F.lit(0.0)
    totals = totals.withColumnRenamed("skey", "__s").select("__s", share.cast("double").alias("weight"))
    before = lambda w: w.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    filled = counts.groupBy("block").agg(F.sum("tokens").alias("t")).select(F.col("block").alias("__b"), F.coalesce(F.sum("t").over(before(Window)), F.lit(0)).alias("all_before"))  # a row a block
    had = counts.withColumn("own_before", F.coalesce(F.sum("tokens").over(before(Window.partitionBy("skey"))), F.lit(0)))
    rows = had.join(totals, F.col("skey") == F.col("__s")).join(filled, F.col("block") == F.col("__b"))
    return rows.select("block", "skey", "weight", (F.col("weight") * F.col("all_before") - F.col("own_before")).alias("deficit"))


def windows(left: list[int], weight: list[float], deficit: list[float], window: int = WINDOW, turn: int = TURN) -> Iterator[list[tuple[int, int]]]:
    """The turns (queue, ids) that fill each window; the last one holds what is left and may be short."""
    left, deficit, weight = list(left), list(deficit), [max(w, 1e-12) for w in weight]
    alive = [q for q, n in enumerate(left) if n]
    at, room, turns = 0, window, []
    while alive:
        full = False
        for _ in range(len(alive)):
            q = alive[at]
            if deficit[q] >= (least := min(turn, left[q], room)):
                take = min(max(int(deficit[q]), least), left[q], room)
                deficit[q] -= take
                left[q] -= take
                room -= take
                turns.append((q, take))
                full = True
                if not left[q]:
                    del alive[at]
                    at -= 1
            at = (at + 1) % len(alive) if alive else 0
            if not room:
                yield turns
                room, turns = window, []
            if not alive:
                break
        if not full:  # nothing is due to anyone: what the window lacks is credited, and so much that one can take its turn
            due = min((min(turn, left[q], room) - deficit[q]) / weight[q] for q in alive)
            credit = max(due, (room - sum(deficit[q] for q in alive)) / sum(weight[q] for q in alive)) * (1 + 1e-9)
            for q in alive:
                deficit[q] += credit * weight[q]
    if turns:
        yield turns


def _pack(docs: pa.Table, state: pa.Table, kind: str, window: int, turn: int, schema: T.StructType) -> pa.Table:
    docs = docs.append_column("mix", pa.array(pd.util.hash_array(docs.column("row").to_numpy())))
    docs = docs.sort_by([("skey", "ascending"), ("mix", "ascending")])
    n = docs.column("n").to_numpy()
    ends = np.cumsum(n)
    begins = ends - n
    facts = {r["skey"]: (r["weight"], r["deficit"]) for r in state.to_pylist()}
    names = docs.column("skey").to_pylist()
    first = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
    own = np.add.reduceat(n, first).tolist()
    weight, deficit = zip(*[facts[names[i]] for i in first], strict=True)
    seq, off, start, stop = [], [], [], []
    reached = [int(begins[i]) for i in first]
    number = 0
    for turns in windows(own, weight, deficit, window, turn):
        size = sum(t for _, t in turns)
        cuts = [window] if size == window else [1 << k for k in reversed(range(size.bit_length())) if size >> k & 1]
        room, used = cuts.pop(0), 0
        for q, take in turns:
            while take:
                part = min(take, room - used)
                seq.append(number)
                off.append(used)
                start.append(reached[q])
                reached[q] += part
                stop.append(reached[q])
                used, take = used + part, take - part
                if used == room:
                    number, used = number + 1, 0
                    room = cuts.pop(0) if cuts else window
    seq, off, start, stop = (np.array(x, np.int64) for x in (seq, off, start, stop))
    order = np.argsort(start)
    seq, off, start, stop = seq[order], off[order], start[order], stop[order]
    a, z = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
    run = np.repeat(np.arange(len(start)), z - a + 1)
    doc = np.arange(len(run)) - np.repeat(np.cumsum(z - a + 1) - (z - a + 1), z - a + 1) + a[run]
    lo, hi = np.maximum(start[run], begins[doc]), np.minimum(stop[run], ends[doc])
    ids = np.frombuffer(b"".join(docs.column("ids").to_pylist()), kind).astype("<u4")
    edges = np.append(lo, ends[-1]).astype(np.int32) * 4
    out = [
        docs.column("doc_id").take(pa.array(doc)), lo - begins[doc], hi - lo, n[doc], seq[run] + (int(docs.column("block")[0].as_py()) << 32),
        off[run] + lo - start[run], docs.column("skey").take(pa.array(doc)), pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(edges), pa.py_buffer(ids)]),
    ]
    return pa.table([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in out], names=schema.names)


def pack(docs: DataFrame, weights: dict | None = None, window: int = WINDOW, turn: int = TURN, end_id: int = END_ID, vocabulary_path: str | None = None, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, source, ids (little-endian 32-bit).

    Every id of every document, and ``end_id`` after it, lies in exactly one piece; the pieces of a
    sequence fill it from offset 0 without a gap.  Sequences hold ``window`` ids, or a smaller power of
    two at the end of a block.  ``weights`` maps sources (None: rows without one) to target
    proportions, others to 0; a source that has run out in a block leaves its part to the rest, and one of
    weight 0 comes when no other is left.  A null text is empty and has the end id only; a null source
    is a source; ids may be null, and rows repeat.  Empty input gives no rows; other columns are ignored.
    """
    with open(vocabulary_path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        vocabulary = f.read()
    size = docs.agg(F.sum(F.octet_length(text_of(text_col)) + F.lit(64).cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    kind = Encoder(vocabulary).kind.str
    tokens = materialize(tokenized(docs, blocks, vocabulary, end_id, id_col, text_col, source_col), "packing-tokens")
    counts = materialize(tokens.groupBy("block", "skey").agg(F.sum("n").alias("tokens")), "packing-counts")
    schema = T.StructType([tokens.schema["doc_id"], *T._parse_datatype_string("start long, length long, doc_tokens long, sequence_id long, offset long, skey string, ids binary").fields])
    packed = tokens.groupBy("block").cogroup(block_state(counts, weights).groupBy("block")).applyInArrow(lambda left, right: _pack(left, right, kind, window, turn, schema), schema)
    source = F.when(F.col("skey") != "null", F.substring("skey", 2, 1 << 30))
    return packed.select(*schema.names[:6], source.alias("source"), "ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length and ids of each sequence, its pieces in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))

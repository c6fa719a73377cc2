"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made.

A piece of text starts as one symbol a byte.  The heap holds the adjacent pairs that the merge
table knows, lowest rank first and leftmost on a tie; popping one joins two symbols and offers the
new neighbours.  The count is the initial symbols minus the merges.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nebulark.llm._common import mapped, text_of

VOCABULARY = "byte_bpe_50k.json"
#: Words remembered by a worker at most (about 150 MB); then it forgets them all and starts again.
REMEMBER = 1_000_000
_SPACE = r"\p{White_Space}"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|{_SPACE}+(?![^{_SPACE}])|{_SPACE}+"
_SLOW = 1 << 50


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class Merges:
    """The merge table over numbered symbols: the rank of a pair, and the symbol that a rank makes."""

    def __init__(self, merges: list):
        number = {c: i for i, c in enumerate(byte_symbols())}
        self.rank, self.made = {}, []
        for r, (left, right) in enumerate(merges):
            made = number.setdefault(left + right, len(number))
            self.rank[number[left] << 24 | number[right]] = r
            self.made.append(made)

    def left_over(self, piece: bytes) -> int:
        """Symbols left of a piece after all merges: initial symbols minus merges."""
        sym, rank, made = list(piece), self.rank.get, self.made
        n = left = len(sym)
        at = [rank(a << 24 | b, -1) for a, b in zip(sym, sym[1:])]  # rank of the pair that starts here
        shift = n.bit_length()
        heap = [r << shift | i for i, r in enumerate(at) if r >= 0]
        if not heap:
            return n
        at.append(-1)
        heapq.heapify(heap)
        nxt, prv, low = list(range(1, n + 1)), list(range(-1, n - 1)), (1 << shift) - 1
        while heap:
            top = heapq.heappop(heap)
            i, r = top & low, top >> shift
            if at[i] != r:
                continue  # one side has been merged since
            j = nxt[i]
            s = sym[i] = made[r]
            at[j] = -1
            left -= 1
            nxt[i] = k = nxt[j]
            at[i] = -1
            if k < n:
                prv[k] = i
                r = at[i] = rank(s << 24 | sym[k], -1)
                if r >= 0:
                    heapq.heappush(heap, r << shift | i)
            h = prv[i]
            if h >= 0:
                r = at[h] = rank(sym[h] << 24 | s, -1)
                if r >= 0:
                    heapq.heappush(heap, r << shift | h)
        return left


class TokenCounter:
    """Counts tokens of whole texts.

    Words between single spaces repeat, so their counts are remembered; a text where white space
    stands otherwise than singly between words is cut by the full pattern instead.
    """

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        self.merges = Merges(spec["model"]["merges"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PIECES)
        left_over, cut = self.merges.left_over, self.cut

        class Words(dict):  # a word's tokens, with the space before it
            def __missing__(self, word: str) -> int:
                if word.isalpha():
                    n = left_over(b" " + word.encode())
                elif word[:-1].isalpha() and word[-1] in ".,":
                    return self[word[:-1]] + 1
                elif not word or word[0].isspace() or word[-1].isspace():
                    return _SLOW
                else:
                    n = cut(" " + word)
                if len(self) >= REMEMBER:
                    self.clear()
                self[word] = n
                return n

        self.words = Words()

    def cut(self, text: str) -> int:
        n = 0
        for piece in self.pattern.findall(text):
            word = piece[1:]
            n += self.words[word] if piece[0] == " " and word.isalpha() else self.merges.left_over(piece.encode("utf-8", "surrogatepass"))
        return n

    def plain(self, text: str) -> int:
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            n = sum(map(self.words.__getitem__, rest))
            if n < _SLOW:
                return n + self.cut(first)
        return self.cut(text)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)


@functools.lru_cache(maxsize=2)
def counter_of(vocabulary: str) -> TokenCounter:
    """One counter for a Python worker, so that its tasks share what they remember."""
    return TokenCounter(vocabulary)


def count_tokens(docs: DataFrame, vocabulary_path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text is empty and has no tokens; ids may be null or repeated; a special token inside a
    text counts as one.  Empty input gives no rows; other columns are ignored.
    """
    with open(vocabulary_path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())  # 1.5 MB, fixed
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = counter_of(vocabulary.value)
        for b in batches:
            n = [counter.count(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in b["text"]], "n_tokens": n, "over_limit": [x > limit for x in n]})

    return mapped(rows, counted, "n_bytes long, n_tokens long, over_limit boolean")

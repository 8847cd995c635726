"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pretokens as the tokenizer does; the bytes of a pretoken form
a doubly linked list; a heap holds its adjacent pairs by merge rank. The lowest
pair is popped, merged, and the two new neighbours are pushed, until no pair has
a rank. The count is the initial symbols less the merges; no id is made. The
cost is O(n log n) even for one endless pretoken.

Counts of pretokens are memoised in each worker, up to ``MEMO`` entries, after
which the memo starts anew; a long pretoken is never memoised.

Scale: one narrow pass, no shuffle, nothing sent but the path of the vocabulary.

Defined cases: null text is empty and has 0 tokens; special strings of the
vocabulary inside a text are one token each, as the library does by default;
repeated rows are counted one by one; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json

import regex
from pyspark.sql import DataFrame

from .common import arrow_map, utf8, values

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 1_000_000
MEMO_LENGTH = 64


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Merge ranks and special strings of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_symbols()
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[raw(a), raw(b)] = rank
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile(PATTERN)
        names = "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))
        self.special = regex.compile(names) if names else None
        self.memo: dict[str, int] = {}

    def merged(self, symbols: bytes) -> int:
        """Symbols of one pretoken after all merges."""
        n = len(symbols)
        if n < 2:
            return n
        ranks = self.ranks
        part: list[bytes | None] = [symbols[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            if (rank := ranks.get((part[i], part[i + 1]))) is not None:
                heap.append((rank, i, part[i], part[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if part[i] is not a and part[i] != a or j >= n or part[j] != b:
                continue  # one of the two has been merged since
            part[i], part[j] = a + b, None
            merges += 1
            after = right[i] = right[j]
            if after < n:
                left[after] = i
                if (rank := ranks.get((part[i], part[after]))) is not None:
                    heapq.heappush(heap, (rank, i, part[i], part[after]))
            before = left[i]
            if before >= 0 and (rank := ranks.get((part[before], part[i]))) is not None:
                heapq.heappush(heap, (rank, before, part[before], part[i]))
        return n - merges

    def _plain(self, text: str) -> int:
        memo, total = self.memo, 0
        for piece in self.split.findall(text):
            n = memo.get(piece)
            if n is None:
                n = self.merged(piece.encode())
                if len(piece) <= MEMO_LENGTH:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if self.special is None or not any(s in text for s in self.specials):
            return self._plain(text)
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(map(self._plain, pieces))


@functools.lru_cache(maxsize=2)
def merges_at(path: str) -> Merges:
    """Kept by the worker from one task to the next."""
    return Merges(path)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Per document: UTF-8 bytes and tokens of the byte-level BPE file at ``path``."""

    def make():
        merges = merges_at(path)

        def each(batch):
            texts = utf8(batch, "text")
            return {
                "doc_id": values(batch, "doc_id"),
                "n_bytes": [len(t) for t in texts],
                "n_tokens": [merges.count(t.decode("utf-8", "replace")) for t in texts],
            }

        return each

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, n_bytes long, n_tokens long")

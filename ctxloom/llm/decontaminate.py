"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ``window`` consecutive words of a benchmark item, or
the whole item if it has fewer. The patterns of one length share a shift table:
the last two words under the search head say how far the head may jump before
any pattern could end there. Where the shift is zero, the same two words pick a
bucket of patterns, the first word narrows it, and a direct comparison decides.

Scale: documents are scanned where they lie, without a shuffle. The benchmark is
the stated query set. It is sent to the workers in blocks of at most
``block_bytes`` of text each, so what is broadcast at once has a fixed bound;
each block is one pass over the documents, whose results are written before the next
block is sent, so no worker holds more than one index.

Defined cases: null or empty text has no words and no hits; an item without
words has no window; equal items are all reported; an item whose id is null
marks words but has no id to report; repeated document rows are scanned one by
one; an empty benchmark finds nothing; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, text_or_empty, utf8, values

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256)
)

COLUMNS = ("doc_id", "n_words", "n_hit", "items", "spans")
_FOUND = (
    "doc_id long, text_hash long, n_words long, n_hit long, items array<string>, "
    "spans array<struct<start:long,end:long>>"
)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of digits, letters and everything beyond ASCII."""
    return text.translate(_FOLD).split()


class WuManber:
    """Search for the windows of many items in lists of words."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = 10):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                owners.setdefault(tuple(words[i : i + size]), set()).update([item] if item is not None else [])
        by_size: dict[int, list] = defaultdict(list)
        for pattern, names in owners.items():
            by_size[len(pattern)].append((pattern, names))
        self.single = {p[0]: names for p, names in by_size.pop(1, [])}
        self.groups = [self._tables(size, patterns) for size, patterns in sorted(by_size.items())]

    @staticmethod
    def _tables(size: int, patterns: list) -> tuple:
        shift: dict[tuple[bytes, bytes], int] = {}
        buckets: dict[tuple[bytes, bytes], dict[bytes, list]] = {}
        for pattern, names in patterns:
            for end in range(2, size + 1):
                block = pattern[end - 2 : end]
                shift[block] = min(shift.get(block, size), size - end)
            by_first = buckets.setdefault(pattern[-2:], {})
            by_first.setdefault(pattern[0], []).append((list(pattern), names))
        return size, shift, buckets

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit spans of word positions (end exclusive), and the items that occur."""
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        if self.single:
            for i, word in enumerate(words):
                if (names := self.single.get(word)) is not None:
                    found.append((i, i + 1))
                    items |= names
        n = len(words)
        for size, shift, buckets in self.groups:
            head, jump, get = size - 1, size - 1, shift.get
            while head < n:
                block = (words[head - 1], words[head])
                step = get(block, jump)
                if step:
                    head += step
                    continue
                start = head - size + 1
                for pattern, names in buckets[block].get(words[start], ()):
                    if words[start : head + 1] == pattern:
                        found.append((start, head + 1))
                        items |= names
                head += 1
        return merge(found), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[int, Broadcast]]:
    """The number of blocks, with each block of about ``block_bytes`` of text as a broadcast, one after another."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), text_or_empty().alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 16).alias("n")).first().n or 0
    count = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for b in range(count):
        rows = [(r.item_id, r.text.encode()) for r in items.filter(block == b).toLocalIterator()]
        yield count, spark.sparkContext.broadcast(rows)


def _search(rows: DataFrame, block: Broadcast, window: int, hits_only: bool = False) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, items and spans of rows(doc_id, text, text_hash) for one block."""

    def make():
        index = WuManber(block.value, window)

        def each(batch: pa.RecordBatch) -> dict | None:
            found = []
            for text in utf8(batch, "text"):
                words = words_of(text)
                found.append((len(words), *index.search(words)))
            if hits_only:
                keep = pa.array([bool(spans) for _, spans, _ in found])
                batch, found = batch.filter(keep), [f for f in found if f[1]]
                if not found:
                    return None
            return {
                "doc_id": values(batch, "doc_id"),
                "text_hash": values(batch, "text_hash"),
                "n_words": [n for n, _, _ in found],
                "n_hit": [sum(e - s for s, e in spans) for _, spans, _ in found],
                "items": [sorted(items) for _, _, items in found],
                "spans": [[{"start": s, "end": e} for s, e in spans] for _, spans, _ in found],
            }

        return each

    return arrow_map(rows.select("doc_id", "text", "text_hash"), make, _FOUND)


def _merged(hits: DataFrame) -> DataFrame:
    """Hits of several blocks by document."""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            spans = [merge([(s["start"], s["end"]) for s in row]) for row in values(batch, "spans").to_pylist()]
            return {
                "doc_id": values(batch, "doc_id"),
                "text_hash": values(batch, "text_hash"),
                "n_words": values(batch, "n_words"),
                "n_hit": [sum(e - s for s, e in row) for row in spans],
                "items": [sorted(set(row)) for row in values(batch, "items").to_pylist()],
                "spans": [[{"start": s, "end": e} for s, e in row] for row in spans],
            }

        return each

    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("items", "spans")]
    grouped = hits.distinct().groupBy("doc_id", "text_hash").agg(F.max("n_words").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), *lists)
    return arrow_map(grouped, make, _FOUND)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 4 << 20
) -> DataFrame:
    """Per document: words, hit words, occurring item ids and merged hit spans in words."""
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    hits = every = None
    for count, block in _blocks(benchmark, block_bytes):
        if count == 1:
            return _search(rows, block, window).select(*COLUMNS)
        if every is None:
            every = materialize(_search(rows, block, window))
            found = every.filter("n_hit > 0")
        else:
            found = materialize(_search(rows, block, window, hits_only=True))
        block.destroy()
        hits = found if hits is None else hits.unionByName(found)
    merged = _merged(hits).withColumnsRenamed({c: f"m_{c}" for c in COLUMNS} | {"text_hash": "m_hash"})
    on = F.col("doc_id").eqNullSafe(F.col("m_doc_id")) & (F.col("text_hash") == F.col("m_hash"))
    return every.join(merged, on, "left").select(
        "doc_id", "n_words", *(F.coalesce(f"m_{c}", c).alias(c) for c in COLUMNS if c not in ("doc_id", "n_words"))
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 4 << 20
) -> DataFrame:
    """The documents without a hit word, with all their columns."""
    kept = docs
    for count, block in _blocks(benchmark, block_bytes):
        kept = _without_hits(kept, block, window)
        if count > 1:
            kept = materialize(kept)
            block.destroy()
    return kept


def _without_hits(docs: DataFrame, block: Broadcast, window: int) -> DataFrame:
    def make():
        index = WuManber(block.value, window)

        def each(batch: pa.RecordBatch) -> dict | None:
            clean = batch.filter(pa.array([not index.search(words_of(t))[0] for t in utf8(batch, "text")]))
            return dict(zip(clean.schema.names, clean.columns, strict=True)) if clean.num_rows else None

        return each

    return arrow_map(docs, make, docs.schema)

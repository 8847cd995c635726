"""Best-fit packing by a configuration linear program over the length histogram.

Documents become token ids and a closing id; only what is longer than a sequence
is cut, the first piece taking the remainder. The program has a variable for each
configuration (a multiset of lengths that fits a sequence) and a demand for each
length, and asks for the fewest sequences.

Multiplicative weights solve it. The price of a length is its share of a sequence,
which is the exact dual where nothing is wasted, raised by the share times a weight
that grows exponentially with how far the length's covered demand lags behind the
whole. In a round, an unbounded-knapsack dynamic program prices configurations, and
each length takes the dearest ones that hold it, until a fixed share of some demand in
them is covered, so that no round covers a length by more than that share. Rounds that
make little headway admit configurations with a few empty tokens; the last one
takes any, so the fractional solution covers every demand exactly. Columns that leave at most ``CLOSE``
tokens empty are then rounded at random, and best fit places what rounding leaves.

Scale: texts are tokenized once, in place; the pieces table (no text) is written
to the shared folder. The driver sees the histogram, at most ``capacity`` rows,
whatever the corpus; its work and the plan hardly depend on the counts.
Pieces are numbered within their length by counts of (length, salt), so a length
that a third of all pieces share is dealt over all salts.

Defined cases: null or empty text is the closing id alone; repeated rows are
packed one by one; null ids pass through; an empty table gives no pieces; other
columns are ignored.
"""

from __future__ import annotations

import contextlib
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import arrow_map, materialize, strings, values
from .tokencount import PATTERN, byte_symbols

#: Texts of other characters go to the tokenizers library itself; within these,
#: the faster merger is held to the same ids by tests over every character.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7E -ɏ]*")
#: Growth of a weight over a whole demand; the share of each demand that a round may
#: cover; configurations that a length may ask of one run of the dynamic program.
ETA, STEP, TRIES = 1.0, 0.25, 2
#: Demands below this share of what they were are met; empty tokens of a configuration
#: that is rounded rather than left to best fit; the seed of the rounding.
_NOTHING, CLOSE, SEED = 1e-6, 4, 1


class Encoder:
    """Token ids of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte, special = byte_symbols(), {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = lambda s: bytes(to_byte[c] for c in s)
        ranks = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merged = [ranks[raw("".join(m.split(" ") if isinstance(m, str) else m))] for m in spec["model"]["merges"]]
        self.fast = None
        if merged == sorted(merged):  # ids in the order of merges: one rank serves for both
            self.fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @functools.cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> list[int]:
        """The library's ids; the faster merger refuses runs of about a million white spaces."""
        if self.fast is not None and _PLAIN.fullmatch(text):
            with contextlib.suppress(ValueError):
                return self.fast.encode(text, allowed_special="all")
        return self.library.encode(text, add_special_tokens=False).ids


@functools.lru_cache(maxsize=2)
def encoder_at(path: str) -> Encoder:
    """Kept by the worker from one task to the next."""
    return Encoder(path)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter."""
    first = length % capacity or capacity
    return [(0, min(first, length)), *((s, capacity) for s in range(first, length, capacity))]


def pieces_of(docs: DataFrame, path: str, capacity: int, closing: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, a salt, and with ``with_ids`` the ids of each piece."""
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int" + ", ids array<int>" * with_ids

    def make():
        encoder, serial = encoder_at(path), 0

        def each(batch: pa.RecordBatch) -> dict:
            nonlocal serial
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "salt", "ids")}
            for doc, text in zip(values(batch, "doc_id").to_pylist(), strings(batch, "text"), strict=True):
                ids = np.array([*encoder.ids(text), closing], "<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    serial += 1
                    row = (doc, piece, start, length, zlib.crc32(own.tobytes()), serial & 0x7FFFFFFF)
                    for k, v in zip(out, row, strict=False):
                        out[k].append(v)
                    if with_ids:
                        out["ids"].append(own.astype(np.int32))
            return out

        return each

    return arrow_map(docs.select("doc_id", "text"), make, ddl)


def price(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack for all capacities at once.

    value[l] is the price of length l, -inf where there is none. Returns the best
    value by capacity, and the length to take there (0: leave one token empty).
    """
    size = len(value)
    best, take = np.zeros(size), np.zeros(size, np.int64)
    for c in range(1, size):
        options = best[c - 1 :: -1] + value[1 : c + 1]
        at = int(options.argmax())
        if options[at] > best[c - 1]:
            best[c], take[c] = options[at], at + 1
        else:
            best[c] = best[c - 1]
    return best, take


def _configuration(first: int, best, take, value, room: np.ndarray, capacity: int) -> dict[int, int]:
    """The best configuration with ``first`` in it of the lengths that still have room."""
    used = {first: 1}
    c = capacity - first
    while c > 0:
        length = int(take[c])
        if length == 0:
            c -= 1
            continue
        if room[length] <= 0:
            lengths = np.flatnonzero(room[: c + 1] > 0)
            if not len(lengths):
                break
            length = int(lengths[(best[c - lengths] + value[lengths]).argmax()])
        used[length] = used.get(length, 0) + 1
        c -= length
    return used


Column = tuple[tuple[int, int], ...]


def fractional(demand: np.ndarray) -> tuple[dict[Column, float], float]:
    """A fractional solution {configuration: sequences} that covers ``demand`` exactly, and a lower bound.

    The bound is that of the best prices tried: what the demand costs at them over
    the price of the dearest configuration, which no solution can beat.
    """
    capacity = len(demand) - 1
    wanted = demand.astype(float)
    known, left = demand > 0, wanted.copy()
    share = np.arange(capacity + 1) / capacity
    total = float((wanted * share).sum())
    found: dict[Column, float] = {}
    bound, slack = total, 0
    while (open_ := left > _NOTHING * wanted).any():
        rest = float((left * share).sum())
        done = np.divide(wanted - left, wanted, out=np.zeros(capacity + 1), where=known)
        weight = np.exp(ETA * (1 - rest / total - done))
        value = np.where(open_, share * (1 + share * weight), -np.inf)
        best, take = price(value)
        if open_.sum() == known.sum():
            bound = max(bound, float((wanted[known] * value[known]).sum() / best[capacity]))
        last = slack > CLOSE  # the rest is taken as it comes
        room = np.where(open_, left if last else np.minimum(left, STEP * wanted), 0.0)
        for first in np.flatnonzero(open_)[::-1].tolist():
            tries = 0
            while room[first] > _NOTHING * wanted[first] and (last or tries < TRIES):
                tries += 1
                config = _configuration(first, best, take, value, room, capacity)
                k, n = np.array(list(config)), np.array(list(config.values()))
                if not last and capacity - int(k @ n) > slack:
                    break
                amount = float((room[k] / n).min())
                room[k] -= amount * n
                left[k] -= amount * n
                room[k[room[k] <= _NOTHING * wanted[k]]] = 0.0
                column = tuple(sorted(config.items(), reverse=True))
                found[column] = found.get(column, 0.0) + amount
        if rest - float((left * share).sum()) < STEP * total / 4:
            slack = max(4 * slack, 1)
    return found, bound


def best_fit(demand: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """(sequences, configuration) of best-fit decreasing, over counts of equal sequences."""
    capacity = len(demand) - 1
    open_: dict[int, list[tuple[int, dict[int, int]]]] = {capacity: []}
    some = np.zeros(capacity + 1, bool)

    def put(free: int, times: int, config: dict[int, int]) -> None:
        if times:
            open_.setdefault(free, []).append((times, config))
            some[free] = True

    for length in np.flatnonzero(demand)[::-1].tolist():
        n = int(demand[length])
        while n:
            free = length + int(some[length:].argmax())
            if some[free]:
                times, config = open_[free].pop()
                some[free] = bool(open_[free])
            else:  # a fresh sequence for as many pieces as there are
                free, times, config = capacity, n, {}
            each = free // length
            whole = min(times, n // each)
            put(free - each * length, whole, config | {length: each})
            n -= whole * each
            if whole < times and n:
                put(free - n * length, 1, config | {length: n})
                whole, n = whole + 1, 0
            if config:
                put(free, times - whole, config)
    return [group for groups in open_.values() for group in groups]


def best_plan(demand: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """(sequences, configuration) that cover ``demand``, an array of counts by length.

    Columns of the fractional solution that leave at most ``CLOSE`` tokens empty are
    rounded up or down by seeded coins that are as likely as their fractions, within
    the demand; best fit places what the rounding leaves.
    """
    capacity = len(demand) - 1
    left, plan = demand.astype(np.int64).copy(), []
    if left[capacity]:
        plan.append((int(left[capacity]), {capacity: 1}))
        left[capacity] = 0
    if not left.any():
        return plan
    found, _ = fractional(left)
    coins = np.random.default_rng(SEED).random(len(found))
    for (column, amount), coin in zip(sorted(found.items(), key=lambda x: (-x[1], x[0])), coins, strict=True):
        if capacity - sum(k * n for k, n in column) <= CLOSE:
            times = min(int(amount + coin), *(int(left[k]) // n for k, n in column))
            if times:
                plan.append((times, dict(column)))
                for k, n in column:
                    left[k] -= times * n
    return plan + best_fit(left)


def _places(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, pieces a sequence, first sequence, offset), sorted."""
    rows, next_rank, sequence = [], {}, 0
    for times, config in plan:
        offset = 0
        for length, n in sorted(config.items(), reverse=True):
            at = next_rank.get(length, 0)
            rows.append((length, at, n, sequence, offset))
            next_rank[length] = at + times * n
            offset += length * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, capacity: int = 2048, closing: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with sequence_id and offset."""
    pieces = materialize(pieces_of(docs, path, capacity, closing, with_ids))
    histogram = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    demand = np.zeros(capacity + 1, np.int64)
    for length, n in histogram:
        demand[length] = n
    places = _places(best_plan(demand))
    salts = int(min(4096, max(64, demand.sum() // 100_000)))
    salted = pieces.withColumn("salt", F.pmod("salt", F.lit(salts)))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        salted.withColumn("r", F.row_number().over(order))
        .join(base, ["length", "salt"])
        .withColumn("rank", F.col("base") + F.col("r") - 1)
    )
    keep = [c for c in pieces.columns if c != "salt"]
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        key = table[:, 0] * (1 << 48) + table[:, 1] if len(table) else np.zeros(0, np.int64)
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = table[np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            arrays += [pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "sequence_id", "offset"])

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return ranked.select(*keep, "rank").mapInArrow(place, f"{ddl}, sequence_id long, offset long")

"""Near copies by SimHash and the overlap of word shingles, exact at any size.

Two texts are linked where the Jaccard overlap of their sets of ``SHINGLE``-word
shingles is 4/5 or more, and links are closed to components. Shingles stand as
64-bit hashes; texts of equal sets make one class, found by a hash of the set.

SimHash goes first: the classes' fingerprints (the majority bits of their shingles'
hashes) are searched by the generalised pigeonhole of ``simhash`` up to ``DISTANCE`` bits,
and what it finds is verified by overlap. No distance that can be searched finds all
of these pairs: at an overlap of 4/5 some ten of 64 bits differ in the mean. So the rest
is found by a prefix filter, among classes that are not linked yet. In any one order of all shingles, two sets of n
and m that overlap by 4/5 share a shingle among the first n - ceil(4n/5) + 1 of
the one and the first m - ceil(4m/5) + 1 of the other, so only what shares one is
compared. The order puts rare shingles first, by counts over all texts in a table of
``CELLS`` cells; the cells decide costs and no links. Of what shares a
shingle, pairs are left out whose sizes rule the overlap out, or the parities of
their sets' members over 512 cells: these differ in no more cells than the sets in
members, and at 4/5 those are a ninth of n + m at most. What is left is verified.

Scale: texts are read once; where pairs are verified, those documents' again. First
shingles are dealt out once, and those of one class alone dropped there. The rest
makes buckets. A pair meets in most of the shingles that it shares, but only the first
of them in the order counts: there the places of both say how little they can have in common,
and the buckets that they were in before differ. So a pair is made about once, and not
in each bucket. A round compares a few members of each bucket with the others and verifies one pair
of a member at most, so that a large group of near copies falls together without its pairs, and rounds go
on while each takes a tenth off the pairs of members in different components and many are left; then all of these are compared.
A forest of them is verified first, and then what it has not joined, so that a group costs sets
by its members and not by its pairs. Nothing is capped.

Defined cases: null or empty texts have the empty set and are one class; fewer
words than a shingle make one shingle; ids are treated as in ``simhash``.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import alone, arrow_map, bound_batches, materialize, release_memory, utf8, values
from .simhash import BROADCAST_BYTES, ROW_BYTES, SEED, connected, first_of_each, majority, near_links

SHINGLE = 5
#: Bits in which SimHash fingerprints of candidates differ at most.
DISTANCE = 3
CELLS, SLICES = 1 << 22, 64
#: Rounds go on while over this many pairs a row are left, and each leaves nine tenths of the last one's at most.
PAIRS_A_ROW = 8
#: Members of a bucket that a round compares with the others.
PIVOTS = 8
_BLOCK = 1 << 16
#: Pairs that a task holds, each once, before it sends them.
_HELD = 1 << 20


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The sorted set of hashes of a UTF-8 text's shingles, over lower-cased words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    line, width = b" ".join(words), min(width, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[s:e], SEED) for s, e in zip(first, last, strict=True)), np.uint64, len(first)).view(np.int64))


def set_class(found: np.ndarray) -> int:
    """A signed hash of a set of shingles."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


def classes(batch: pa.RecordBatch) -> pa.Array:
    return pa.array([set_class(shingles(t)) for t in utf8(batch, "text")], pa.int64())


def needed(n: int) -> int:
    """How many of a set's first shingles decide whether another overlaps it by 4/5."""
    return n + (-4 * n) // 5 + 1 if n else 0


def parities(found: np.ndarray) -> bytes:
    """512 bits: whether an odd number of the set's members falls to each."""
    odd = np.bincount((found >> 32) & 511, minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def simhash(found: np.ndarray) -> int:
    """The signed SimHash fingerprint of a set of shingles."""
    hashes = found.view(np.uint64)
    parts = (hashes[at : at + _BLOCK] for at in range(0, len(hashes), _BLOCK))
    return int(np.uint64(majority(len(hashes), parts)).view(np.int64))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """The class ``fp`` and the set of each document."""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            found = [shingles(t) for t in utf8(batch, "text")]
            return {"fp": pa.array([set_class(x) for x in found], pa.int64()), "shingles": _lists(found)}

        return each

    return arrow_map(docs.select("text"), make, "fp long, shingles array<long>")


def _lists(found: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found)))


def frequencies(docs: DataFrame) -> np.ndarray:
    """In how many texts each shingle stands, or more, by the low bits of its hash; a task's share of a cell ends at 255."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.uint32)
        for batch in batches:
            if batch.num_rows:
                cells = np.concatenate([shingles(t) for t in utf8(batch, "text")]) & (CELLS - 1)
                total += np.bincount(cells, minlength=CELLS).astype(np.uint32)
        for k, part in enumerate(np.minimum(total, 255).astype(np.uint8).reshape(SLICES, -1)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["k", "cells"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CELLS // SLICES, np.uint32)
        for cells in table.column("cells"):
            total += np.frombuffer(cells.as_buffer(), np.uint8)
        return pa.table({"k": pa.array([table.column("k")[0].as_py()], pa.int32()), "cells": pa.array([total.tobytes()], pa.binary())})

    bound_batches(docs.sparkSession)
    parts = docs.select("text").mapInArrow(count, "k int, cells binary")
    found = np.zeros((SLICES, CELLS // SLICES), np.uint32)
    for k, cells in parts.groupBy("k").applyInArrow(add, "k int, cells binary").collect():
        found[k] = np.frombuffer(cells, np.uint32)
    return found.ravel()


def marks(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """doc_id, class ``fp``, size ``n``, parities and SimHash of the set, and the shingles of which another must share one."""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            found = [shingles(t) for t in utf8(batch, "text")]
            firsts = [x[np.argsort(counts[x & (CELLS - 1)], kind="stable")[: needed(len(x))]] for x in found]
            return {
                "doc_id": values(batch, "doc_id"),
                "fp": pa.array([set_class(x) for x in found], pa.int64()),
                "n": pa.array([len(x) for x in found], pa.int64()),
                "bits": pa.array([parities(x) for x in found], pa.binary()),
                "sim": pa.array([simhash(x) for x in found], pa.int64()),
                "firsts": _lists(firsts),
            }

        return each

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, fp long, n long, bits binary, sim long, firsts array<long>")


def _by_bucket(rows: DataFrame, order: list[str], emit: Callable[[list[np.ndarray]], Iterator[list[np.ndarray]]], schema: str) -> DataFrame:
    """What ``emit`` makes of whole buckets, given their columns in order."""
    names = [x.split()[0] for x in schema.split(", ")]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            change = np.flatnonzero(np.diff(cols[0]))
            cut = int(change[-1]) + 1 if len(change) else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield from emit([c[:cut] for c in cols])
        if held is not None and len(held[0]):
            yield from emit(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for out in itertools.chain(whole(batches), [None]):
            if out is not None:
                found.append(out)
                size += len(out[0])
            if found and (out is None or size >= _HELD):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _once([np.concatenate(x) for x in zip(*found, strict=True)])], names=names)
                found, size = [], 0
        release_memory()

    return rows.repartition("h").sortWithinPartitions("h", *order).mapInArrow(run, schema)


def _once(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Each row once, in the order of its columns: a pair meets in most of the shingles that it shares."""
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([np.diff(c) != 0 for c in cols])
    return [c[new] for c in cols]


def _bounds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(h)) + 1
    return np.concatenate([[0], edge]), np.concatenate([edge, [len(h)]])


def _shared(cols: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Rows of buckets, in order of size, each class once, that stand beside another of a size near enough."""
    h, fp, _, _ = cols
    new = np.concatenate([[True], (np.diff(h) != 0) | (np.diff(fp) != 0)])
    h, fp, n, at = (c[new] for c in cols)
    near = (np.diff(h) == 0) & (5 * n[:-1] >= 4 * n[1:])
    many = np.concatenate([near, [False]]) | np.concatenate([[False], near])
    yield [h[many], fp[many], n[many], at[many]]


def _stars(cols: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Each member (b) with those of its bucket's ``PIVOTS`` first members (a) that it may be linked with."""
    h, fp, n, at, before, root, _ = cols
    starts, ends = _bounds(h)
    place, size = np.arange(len(h)) - np.repeat(starts, ends - starts), np.repeat(ends - starts, ends - starts)
    for k in range(PIVOTS):
        b = np.flatnonzero((place > k) & (size > k + 1))
        a = b - place[b] + k
        may = _may(h, n, at, before, root, a, b)
        yield [fp[b[may]], fp[a[may]]]


def _crossing(cols: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """All pairs of a bucket's members that may be linked; those of a component lie together."""
    h, fp, n, at, before, root, bits = cols
    words = _words(bits)
    new = np.concatenate([[True], (np.diff(h) != 0) | (np.diff(root) != 0)])
    group = np.flatnonzero(new)
    after = np.concatenate([group[1:], [len(h)]])[np.cumsum(new) - 1]  # the end of a member's component in its bucket
    starts, ends = _bounds(h)
    left = np.repeat(ends, ends - starts) - after
    here, done = 0, np.cumsum(left)
    while here < len(h):
        to = max(here + 1, int(np.searchsorted(done, (done[here - 1] if here else 0) + _BLOCK, "right")))
        many = left[here:to]
        if many.any():
            a = np.repeat(np.arange(here, to), many)
            b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(after[here:to], many)
            may = _may(h, n, at, before, root, a, b)
            a, b = a[may], b[may]
            may = _near(words[a], words[b], n[a] + n[b])
            one, other = fp[a[may]], fp[b[may]]
            yield [np.maximum(one, other), np.minimum(one, other)]
        here = to


def _may(h, n, at, before, root, a, b) -> np.ndarray:
    """Which pairs in different components may overlap by 4/5 and have here the first shingle that they share.

    They share none before if this is it, so what stands before their places in the order is
    not in both; and it is not the first one if the bucket that either was in before is the same.
    """
    both = 9 * np.minimum(n[a] - at[a], n[b] - at[b])
    return (root[a] != root[b]) & (both >= 4 * (n[a] + n[b])) & ((before[a] != before[b]) | (before[a] == h[a]))


def _words(bits) -> np.ndarray:
    """Parities as eight words a row."""
    return np.frombuffer(b"".join(bits), np.uint64).reshape(-1, 8)


def _near(one: np.ndarray, other: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which pairs the parities of two sets, whose sizes are given as sums, don't rule out."""
    return 9 * np.bitwise_count(one ^ other).sum(axis=1, dtype=np.int64) <= sizes


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() * ROW_BYTES <= BROADCAST_BYTES else df


def _likely(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """Of pairs (a, b), those that the parities don't rule out."""
    for end in "ab":
        pairs = pairs.join(named.select(F.col("fp").alias(end), F.col("n").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}")), end)

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            one, other = (_words(values(batch, f"bits_{x}").to_pylist()) for x in "ab")
            may = pa.array(_near(one, other, values(batch, "n_a").to_numpy() + values(batch, "n_b").to_numpy()))
            return {x: values(batch, x).filter(may) for x in "ab"}

        return each

    return arrow_map(pairs, make, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, named: DataFrame) -> DataFrame:
    """Of written pairs (a, b), those whose sets overlap by 4/5: both / (n + m - both) >= 4/5."""

    def links() -> DataFrame:
        fps = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        wanted = materialize(named.join(fps, "fp").select("fp", F.col("first_id").alias("__id")))
        texts = docs.select("doc_id", "text").join(_small(wanted.select("__id").distinct()), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
        held = materialize(shingle_sets(texts).join(_small(wanted.select("fp")), "fp", "left_semi").dropDuplicates(["fp"]))
        one = held.select(F.col("fp").alias("a"), F.col("shingles").alias("x"))
        other = held.select(F.col("fp").alias("b"), F.col("shingles").alias("y"))
        both = pairs.join(one, "a").join(other, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
        return both.filter(9 * F.col("both") >= 4 * (F.size("x") + F.size("y"))).select("a", "b")

    return alone(docs.sparkSession, links)


def _forest(pairs: DataFrame) -> DataFrame:
    """The least pair of each class b."""
    return materialize(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))


def _joined(pairs: DataFrame, links: DataFrame, docs: DataFrame, named: DataFrame) -> DataFrame:
    """``links`` and verified ones of ``pairs`` that connect what all links among the pairs would.

    Each class is verified with the least one of its pairs first; then pairs of classes that are
    joined are left out, and the rest is verified.
    """
    pairs = materialize(pairs.distinct())
    forest = _forest(pairs)
    links = links.unionByName(_verified(forest, docs, named))
    roots = _roots(links, docs)
    for end in "ab":
        of = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        pairs = pairs.join(_small(of), end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    rest = materialize(pairs.filter("root_a <> root_b").select("a", "b").join(forest, ["a", "b"], "left_anti"))
    return links.unionByName(_verified(rest, docs, named))


def _roots(links: DataFrame, docs: DataFrame) -> DataFrame:
    """What one turn joins; what it doesn't is only compared once more."""
    return alone(docs.sparkSession, lambda: connected(links, turns=1))


def simhash_links(docs: DataFrame, named: DataFrame) -> DataFrame:
    """Verified links (a, b) of classes whose SimHash fingerprints are equal or near."""
    probes = materialize(named.groupBy("sim").agg(F.min("fp").alias("rep")))
    found = near_links(probes.select(F.col("sim").alias("fp")), DISTANCE)
    ends = [probes.select(F.col("sim").alias(x), F.col("rep").alias(f"rep_{x}")) for x in "ab"]
    near = found.join(ends[0], "a").join(ends[1], "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    equal = named.join(probes, "sim").filter("fp <> rep").select(F.col("rep").alias("a"), F.col("fp").alias("b"))
    pairs = near.unionByName(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return _verified(materialize(pairs.distinct()), docs, named)


def bucket_rows(marked: DataFrame) -> DataFrame:
    """Members (h, fp, n, at, before) of buckets of two classes and more: the class's place of h, and its last bucket before."""
    firsts = marked.select(F.posexplode("firsts").alias("at", "h"), "fp", "n").select("h", "fp", "n", "at")
    shared = _by_bucket(firsts, ["n", "fp"], _shared, "h long, fp long, n long, at int")
    last = F.lag("h").over(Window.partitionBy("fp").orderBy("at"))
    return materialize(shared.withColumn("before", F.coalesce(last, "h")))


def overlap_links(docs: DataFrame, marked: DataFrame, named: DataFrame) -> DataFrame:
    """Verified links (a, b) that connect all classes whose sets overlap by 4/5 or more."""
    rows = bucket_rows(marked)
    links, before, turn = simhash_links(docs, named), None, 0
    while True:
        roots = _small(_roots(links, docs))
        now = rows.join(roots, rows["fp"] == roots["node"], "left").select(*rows.columns, F.coalesce("root", "fp").alias("root"))
        of = now.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("h")
        of = of.agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("same")).filter("c * c > same")
        n, left = of.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") * F.col("c") - F.col("same")) / 2), F.lit(0))).first()
        if left <= PAIRS_A_ROW * n or (before is not None and 10 * left > 9 * before):
            now = now.join(_small(named.select("fp", "bits")), "fp").select(*now.columns, "bits")
            return _joined(_by_bucket(now, ["root"], _crossing, "b long, a long"), links, docs, named)
        found = _by_bucket(now.withColumn("turn", F.xxhash64("fp", F.lit(turn))), ["turn", "fp"], _stars, "b long, a long")
        links = links.unionByName(_verified(_forest(_likely(found.distinct(), named)), docs, named))
        before, turn = left, turn + 1


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the class), component_id and root of every document."""
    marked = materialize(marks(docs, frequencies(docs)))
    named = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("sim").alias("sim")))
    links = alone(docs.sparkSession, lambda: overlap_links(docs, marked, named))
    roots = alone(docs.sparkSession, lambda: connected(links))
    linked = named.join(roots, named["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = materialize(linked.join(ids, "root").select("fp", "component_id", "root"))
    return marked.select("doc_id", "fp").join(known, "fp").select("doc_id", "fp", "component_id", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents of which each is the first of its component, with all their columns."""
    return first_of_each(docs, lambda: near_copies(docs), classes)

"""SimHash near-dedup with a generalised pigeonhole search.

A fingerprint bit is set where over half of the 64-bit hashes of a text's word
shingles have it set. Two different fingerprints are linked at ``distance`` or
fewer differing bits, and links are closed to components.

The search runs over distinct fingerprints. Correlated bits are grouped into m
partitions. If two fingerprints differ in at most tau bits, then for thresholds
t with sum(t) = tau - m + 1 some partition i differs in at most t[i] bits, where
t = -1 leaves a partition out. A dynamic program picks the thresholds, and m,
with the lowest estimated cost of keys and candidates. Partition i then yields a
key for each choice of t[i] masked bits, and what shares a key is verified.

Scale: texts are read once, in place. Copies collapse in an aggregated shuffle
before the search. A bucket is never expanded into pairs: it is searched breadth
first, one row of distances at a time, and yields a spanning forest, at most one
link a member. Buckets over ``bucket_limit`` are dealt anew: their members agree on the
key's bits and differ in at most tau of the rest, so the rest is cut into tau + 1
parts, one of which agrees; this goes on until the bucket is small or so few
bits are left that the number of distinct fingerprints is bounded. Nothing is
capped. Components of up to ``TASK_LINKS`` links, counted first, are found in one task;
of more by alternating large and small stars on Parquet tables in the shared folder.

Defined cases: null or empty text has fingerprint zero and is linked like any
other; fewer words than a shingle make one shingle; equal texts and repeated
rows share a fingerprint; null ids take part, and a component's id is its
smallest id that is not null; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alone, arrow_map, materialize, own_prefix, release_memory, utf8, values

_CHUNK = 1 << 16
SEED = 42
#: Estimated costs: of shuffling and sorting a key, and of comparing a pair.
KEY_COST, PAIR_COST = 20.0, 0.05
#: Up to this measured size the ids that stay go to every executor; beyond it texts meet them by id.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 100
#: Up to this many links are joined in one task, in some 50 MB.
TASK_LINKS = 1 << 19
#: Buckets stop being dealt anew when this few bits may still differ.
LAST_BITS = 12


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the lower-cased words of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(shingle, len(words))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    spans = zip(first, last, strict=True)
    return majority(len(first), (np.fromiter((digest(line[s:e], SEED) for s, e in itertools.islice(spans, _CHUNK)), np.uint64) for _ in range(0, len(first), _CHUNK)))


def majority(n: int, parts: Iterable[np.ndarray]) -> int:
    """The bits that over half of n unsigned 64-bit hashes have, given in parts of bounded size."""
    set_bits = np.zeros(64, np.int64)
    for hashes in parts:
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int32)
    return sum(1 << int(b) for b in np.flatnonzero(2 * set_bits > n))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, and the fingerprint as a signed long ``fp``."""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            found = np.array([fingerprint(t, shingle) for t in utf8(batch, "text")], np.uint64)
            return {"doc_id": values(batch, "doc_id"), "fp": pa.array(found.view(np.int64))}

        return each

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how often each pair of bits is set together, over all fingerprints."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            total += (bits.T @ bits).astype(np.int64)
            rows += batch.num_rows
        if rows:
            cells = np.append(total.ravel(), rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(cells)], names=["cell", "n"])

    cells = fps.select("fp").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(4097, np.int64)
    for cell, n in cells:
        flat[cell] = n
    return int(flat[4096]), flat[:4096].reshape(64, 64)


def _bits(fps: np.ndarray) -> np.ndarray:
    raw = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return raw.astype(np.float32)


def group_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal size; a bit joins those that it correlates with most."""
    strength = np.abs(correlation) - np.eye(64)
    free, groups = set(range(64)), []
    for i in range(m):
        size = len(free) // (m - i)
        rest = sorted(free)
        group = [max(rest, key=lambda b: (strength[b, rest].sum(), -b))]
        while len(group) < size:
            rest = sorted(free - set(group))
            group.append(max(rest, key=lambda b: (strength[b, group].sum(), -b)))
        free -= set(group)
        groups.append(sorted(group))
    return groups


def _within(differs: np.ndarray, most: int) -> float:
    """Chance that at most ``most`` of independent bits differ."""
    chance = np.zeros(most + 1)
    chance[0] = 1.0
    for q in differs:
        chance[1:] = chance[1:] * (1 - q) + chance[:-1] * q
        chance[0] *= 1 - q
    return float(chance.sum())


def allocate(groups: list[list[int]], differs: np.ndarray, rows: int, tau: int) -> tuple[float, list[int]]:
    """The cheapest thresholds t in -1..tau with sum(t) = tau - m + 1, and their estimated cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        after: dict[int, tuple[float, list[int]]] = {}
        for t in range(-1, min(tau, len(group) - 1) + 1):
            cost = 0.0
            if t >= 0:
                keys = sum(1 for _ in itertools.combinations(group, t))
                cost = keys * rows * KEY_COST + 0.5 * rows * rows * _within(differs[group], t) * PAIR_COST
            for spent, (before, chosen) in best.items():
                if spent + t not in after or before + cost < after[spent + t][0]:
                    after[spent + t] = (before + cost, [*chosen, t])
        best = after
    return best[tau - len(groups) + 1]


def plan_keys(rows: int, together: np.ndarray, tau: int) -> list[int]:
    """Bit masks; two fingerprints at most tau bits apart agree under at least one of them."""
    if rows == 0:
        return [0]
    p = np.diag(together) / rows
    cov, sd = together / rows - np.outer(p, p), np.sqrt(np.maximum(p * (1 - p), 1e-12))
    correlation, differs = cov / np.outer(sd, sd), 2 * p * (1 - p)
    plans = []
    for m in range(1, tau + 4):
        groups = group_bits(correlation, m)
        cost, thresholds = allocate(groups, differs, rows, tau)
        plans.append((cost, m, groups, thresholds))
    _, _, groups, thresholds = min(plans, key=lambda x: x[:2])
    return [
        _mask(set(group) - set(masked))
        for group, t in zip(groups, thresholds, strict=True)
        if t >= 0
        for masked in itertools.combinations(group, t)
    ]


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(rows: DataFrame, masks: list[int]) -> DataFrame:
    each = [F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for k, m in enumerate(masks)]
    return rows.select("fp", F.explode(F.array(*each)).alias("key")).select("key.k", "key.v", "fp")


def _dealt_anew(hot: DataFrame, masks: list[int], tau: int) -> tuple[DataFrame, list[int]]:
    """Finer keys for members of hot buckets: one of tau + 1 parts of the open bits agrees."""
    finer = []
    for m in masks:
        free = [b for b in range(64) if not m >> b & 1]
        finer += [m | _mask(free[j :: tau + 1]) for j in range(tau + 1)]
    table = F.array(*[F.lit(_signed(m)) for m in finer])
    return (
        hot.select("fp", "k", F.explode(F.sequence(F.lit(0), F.lit(tau))).alias("part"))
        .select("fp", (F.col("k") * (tau + 1) + F.col("part")).alias("k"))
        .select("k", F.col("fp").bitwiseAND(F.element_at(table, F.col("k") + 1)).alias("v"), "fp"),
        finer,
    )


def _forest(fps: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over what lies within tau bits, breadth first."""
    links: list[tuple[int, int]] = []
    rest = fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            near = np.bitwise_count(rest ^ node) <= tau
            if near.any():
                links += [(int(node.view(np.int64)), int(x)) for x in rest[near].view(np.int64)]
                queue += list(rest[near])
                rest = rest[~near]
    return links


def _bucket_links(rows: DataFrame, tau: int) -> DataFrame:
    """Verified links of buckets (k, v), which lie together and in order in each partition."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

        def links(k, v, fp) -> pa.RecordBatch:
            f = fp.view(np.uint64)
            edge = np.flatnonzero((np.diff(k) != 0) | (np.diff(v) != 0)) + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(k)]])
            pairs = starts[(ends - starts) == 2]
            near = pairs[np.bitwise_count(f[pairs] ^ f[pairs + 1]) <= tau]
            a, b = [fp[near]], [fp[near + 1]]
            for s, e in zip(starts, ends, strict=True):
                if e - s > 2 and (found := _forest(f[s:e], tau)):
                    one, two = zip(*found, strict=True)
                    a.append(np.array(one, np.int64))
                    b.append(np.array(two, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            cols = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, batch.columns, strict=True)]
            k, v, _ = cols
            if not len(k):
                continue
            change = np.flatnonzero((np.diff(k) != 0) | (np.diff(v) != 0))
            cut = int(change[-1]) + 1 if len(change) else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield links(*(c[:cut] for c in cols))
        if len(held[0]):
            yield links(*held)

    return rows.repartition("k", "v").sortWithinPartitions("k", "v").mapInArrow(search, "a long, b long")


def near_links(fps: DataFrame, tau: int = 2, bucket_limit: int = 2048) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within tau bits of each other."""
    masks = plan_keys(*bit_statistics(fps), tau)
    rows, found = _keyed(fps, masks), None
    while True:
        settled = all(64 - m.bit_count() <= LAST_BITS for m in masks)
        hot = None
        if not settled:
            hot = materialize(rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket_limit).select("k", "v"))
            hot = None if hot.isEmpty() else hot
        cold = rows if hot is None else rows.join(hot, ["k", "v"], "left_anti").select("k", "v", "fp")
        links = _bucket_links(cold, tau)
        found = links if found is None else found.unionByName(links)
        if hot is None:
            return found.distinct()
        rows, masks = _dealt_anew(rows.join(hot, ["k", "v"], "left_semi"), masks, tau)
        rows = materialize(rows.select("k", "v", "fp"))


def _settled(edges: DataFrame) -> bool:
    """Whether all edges (u, v) lead straight to a root: no node has two, and none that has one is led to."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 or (out = 1 and into = 1)").isEmpty()


def _least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (u, v), and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    root, (u, v) = np.arange(len(nodes)), ends.reshape(2, -1)
    while True:
        u, v = root[u], root[v]
        apart = u != v
        if not apart.any():
            return nodes, nodes[root]
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(root, up := root[root]):
            root = up


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, root) of edges (u, v) that one task can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            u, v = map(np.concatenate, zip(*held, strict=True))
            nodes, root = _least_reached(u, v)
            led = nodes != root
            yield pa.RecordBatch.from_arrays([pa.array(nodes[led]), pa.array(root[led])], names=["node", "root"])
        release_memory()

    return materialize(edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, root long"))


def connected(links: DataFrame, turns: int | None = None) -> DataFrame:
    """(node, root): the smallest node that each linked node but that one reaches; after ``turns``, if given, one that it reaches."""
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.count() <= TASK_LINKS:
        return _in_one_task(edges)
    while turns != 0 and not (turns is None and _settled(edges)):
        turns = None if turns is None else turns - 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join's sides are plain exchanges and Spark can split the centre of a large star
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges = materialize(small.filter("u <> v").distinct())
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, bucket_limit: int = 2048) -> DataFrame:
    """doc_id, fp (signed), component_id and root (the component's smallest fingerprint) of every document."""
    marked = materialize(fingerprints(docs, shingle))
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected(near_links(classes.select("fp"), distance, bucket_limit))
    linked = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    ids = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = materialize(linked.join(ids, "root").select("fp", "component_id", "root"))
    return marked.join(known, "fp").select("doc_id", "fp", "component_id", "root")


def _with_fingerprint(docs: DataFrame, mark: Callable[[pa.RecordBatch], pa.Array], name: str) -> DataFrame:
    """All columns and what ``mark`` makes of them."""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            return dict(zip(batch.schema.names, batch.columns, strict=True)) | {name: mark(batch)}

        return each

    return arrow_map(docs, make, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """The documents of which each is the first of its component, with all their columns."""

    def mark(batch: pa.RecordBatch) -> pa.Array:
        return pa.array(np.array([fingerprint(t, shingle) for t in utf8(batch, "text")], np.uint64).view(np.int64))

    return first_of_each(docs, lambda: near_duplicates(docs, shingle, distance), mark)


def first_of_each(docs: DataFrame, find: Callable[[], DataFrame], mark: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """The first document of each component that ``find`` gives (doc_id, fp, component_id, root).

    Documents whose id is theirs alone are told apart by it. Rows that share an id, or
    have none, are told apart by their fingerprints as well, which ``mark`` gives, and of
    several that could stand for a component one stays.
    """
    own = own_prefix(docs.columns, "__near_")

    def firsts() -> DataFrame:
        found = find()
        rows = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
        first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id").agg(F.min("fp").alias("fp"))
        first = first.withColumnsRenamed({"doc_id": "first_id"}).join(rows, F.col("first_id").eqNullSafe(F.col("doc_id")))
        shared = (F.col("rows") > 1) | F.col("first_id").isNull()
        first = first.select("first_id", "fp", "root", shared.alias("shared"))
        return first.withColumnsRenamed({c: own + c for c in first.columns})

    first = alone(docs.sparkSession, firsts)
    same = F.col("doc_id").eqNullSafe(F.col(f"{own}first_id"))
    single = first.filter(~F.col(f"{own}shared")).select(f"{own}first_id")
    if first.count() * ROW_BYTES <= BROADCAST_BYTES:
        single = F.broadcast(single)
    once = docs.join(single, same, "left_semi")
    again = first.filter(f"{own}shared")
    if again.isEmpty():
        return once
    columns = [F.col(f"`{c}`") for c in docs.columns]
    several = _with_fingerprint(docs.join(again.select(f"{own}first_id").distinct(), same, "left_semi"), mark, f"{own}mark")
    chosen = several.join(again, same & (F.col(f"{own}mark") == F.col(f"{own}fp"))).dropDuplicates([f"{own}root"]).select(*columns)
    return once.unionByName(chosen)

"""Exact cosine neighbours.

The targets are the stated query set (the changed files); they are sent to the
executors in blocks of at most ``block_bytes`` of vectors, whose size is measured,
and meet every vector once per block; of several, the rows of one are written and its
broadcast is destroyed before the next is sent. Each task keeps its best k of a target before
anything is shuffled, so what moves is targets x tasks x k rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written


def dot(a: Column, b: Column) -> Column:
    """Products added from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; 0 for nulls, unequal lengths and zero norms."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The best k of each target by score to four places, ties by id."""
    order = W.partitionBy("target").orderBy(F.desc("score"), "id")
    rounded = scored.withColumn("score", F.round("score", 4))
    return rounded.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("target", "rank", "id", "score")


def top_k(targets: DataFrame, vectors: DataFrame, k: int = 8, block_bytes: int = 32 << 20) -> DataFrame:
    """neighbors(target, rank, id, score).

    targets(target, vec) and vectors(id, vec), where target and id are of one type.
    """
    size = targets.agg(F.sum(8 * F.size("vec") + 64).alias("b"), F.count(F.lit(1)).alias("n")).first()
    blocks = max(1, -(-(size.b or 0) // block_bytes))
    block = F.pmod(F.xxhash64("target"), F.lit(blocks))
    best = None
    for i in range(blocks):
        part = targets if blocks == 1 else targets.filter(block == i)
        shared, found = _block_best(part.select("target", "vec"), vectors.select("id", "vec"), k)
        if blocks > 1:
            found = written(found)
            shared.destroy()
        best = found if best is None else best.unionByName(found)
    return ranked(best, k)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the lists of each length in a column."""
    lengths = np.array([len(v) if v.is_valid else -1 for v in column]) if column.null_count else np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    for size in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == size)
        yield rows, flat[begin[rows][:, None] + np.arange(size)]


def _block_best(targets: DataFrame, vectors: DataFrame, k: int) -> tuple[Broadcast, DataFrame]:
    """The targets as sent, and the best k of each target within each task; scores as the left-to-right sums give them."""
    spark = targets.sparkSession
    shared = spark.sparkContext.broadcast([(r.target, np.array(r.vec or [], np.float64)) for r in targets.toLocalIterator()])
    kind = targets.schema["target"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [(t, v, np.sqrt(_left_to_right(v[None] * v[None]))[0]) for t, v in shared.value if len(v)]
        held: dict = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for rows, matrix in _matrices(batch.column(1)):
                norms = np.sqrt(_left_to_right(matrix * matrix))
                for name, vector, norm in wanted:
                    if len(vector) != matrix.shape[1]:
                        continue
                    below = norm * norms
                    with np.errstate(divide="ignore", invalid="ignore"):
                        scores = np.where(below > 0, _left_to_right(matrix * vector) / below, 0.0)
                    found = [(float(scores[p]), ids[rows[p]]) for p in _promising(scores, k) if ids[rows[p]] != name]
                    held[name] = _best(held.get(name, []) + found, k)
        out = [(t, i, s) for t, found in held.items() for s, i in found]
        if out:
            t, i, s = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(i), pa.array(s, pa.float64())], names=["target", "id", "score"])

    return shared, vectors.mapInArrow(run, f"target {kind}, id {kind}, score double")


_PLACES = 1e4


def _promising(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of positive scores that may be among the best k + 1 after rounding."""
    places = np.flatnonzero(scores > 0)
    if len(places) > k + 1:
        least = np.partition(scores[places], -k - 1)[-k - 1]
        places = places[scores[places] >= least - 2 / _PLACES]
    return places


def _best(scored: list, k: int) -> list:
    """What may be among the best k by rounded score and then id: of each level of four places the
    k smallest ids, down to one level below the k-th, so that no way of rounding loses a row."""
    kept, levels, per_level = [], 0, {}
    for score, i in sorted(scored, key=lambda x: (-int(x[0] * _PLACES), x[1])):
        level = int(score * _PLACES)
        if level not in per_level:
            if len(kept) >= k:
                levels += 1
                if levels > 2:
                    break
            per_level[level] = 0
        if per_level[level] < k:
            per_level[level] += 1
            kept.append((score, i))
    return kept


def _left_to_right(products: np.ndarray) -> np.ndarray:
    total = np.zeros(len(products))
    for column in products.T:
        total += column
    return total


def content_key(model: Column | str, content: Column, max_chars: int = 5000) -> Column:
    """The content-addressed key of an embedding."""
    return F.sha2(F.concat(F.lit(model) if isinstance(model, str) else model, F.lit("\0"), F.substring(content, 1, max_chars)), 256)

"""A content-addressed cache of embeddings, and the embedding of what it lacks."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.similarity import content_key

Embedder = Callable[[list[str]], list[list[float]]]
RETRIES, FLOOR = 4, 256


class ContextLengthError(RuntimeError):
    """The text is too long for the model."""


def http_embedder(model: str, url: str, timeout: float = 120) -> Embedder:
    """An embedder that posts {model, input} to ``url``/api/embed."""

    def embed(texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": model, "input": texts}).encode()
        request = urllib.request.Request(f"{url.rstrip('/')}/api/embed", body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                found = json.load(answer).get("embeddings")
        except urllib.error.HTTPError as e:
            said = e.read().decode("utf-8", "replace")
            raise (ContextLengthError if "context length" in said else RuntimeError)(said) from e
        if not isinstance(found, list) or len(found) != len(texts):
            raise RuntimeError("the answer has no embeddings")
        return found

    return embed


def read_cache(spark: SparkSession, path: str, model: str) -> DataFrame:
    """The cached vectors of one model; an unreadable cache is empty."""
    try:
        return spark.read.schema(schemas.EMBEDDING_CACHE).parquet(path).filter(F.col("model") == model)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schemas.EMBEDDING_CACHE)


def probe(files: DataFrame, cache: DataFrame, model: str, max_chars: int = 5000) -> DataFrame:
    """files(path, content) with key and vec; texts that are empty are passed over."""
    keyed = files.filter(F.length("content") > 0).withColumn("key", content_key(model, F.col("content"), max_chars))
    return keyed.join(cache.dropDuplicates(["key"]).select("key", "vec"), "key", "left")


def counters(probed: DataFrame) -> DataFrame:
    return probed.agg(F.count("vec").alias("hits"), F.count_if(F.col("vec").isNull()).alias("misses"))


def embed_one(embed: Embedder, text: str) -> list[float] | None:
    """The vector of a text, which is halved while it is too long; None on any other failure."""
    for _ in range(RETRIES):
        try:
            return embed([text])[0]
        except ContextLengthError:
            text = text[: len(text) // 2]
            if len(text) < FLOOR:
                return None
        except Exception:  # noqa: BLE001  a failed item is counted, not fatal
            return None
    return None


def embed_missing(probed: DataFrame, embed: Embedder, model: str, max_chars: int = 5000, batch: int = 16) -> DataFrame:
    """(model, key, vec) of the distinct texts that the cache lacks; failures are left out."""
    pending = probed.filter(F.col("vec").isNull()).select("key", F.substring("content", 1, max_chars).alias("text")).dropDuplicates(["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            keys, texts, out = held.column(0).to_pylist(), held.column(1).to_pylist(), []
            for at in range(0, len(keys), batch):
                part = texts[at : at + batch]
                try:
                    vectors = embed(part)
                except Exception:  # noqa: BLE001  the batch is tried item by item
                    vectors = [embed_one(embed, t) for t in part]
                out += [(model, k, [float(x) for x in v]) for k, v in zip(keys[at : at + batch], vectors, strict=True) if v]
            if out:
                m, k, v = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(k), pa.array(v, pa.list_(pa.float64()))], names=["model", "key", "vec"])

    return pending.mapInArrow(run, schemas.EMBEDDING_CACHE)


def append_cache(found: DataFrame, path: str) -> None:
    """New vectors are appended; a key that is there twice has equal vectors."""
    found.write.mode("append").parquet(path)

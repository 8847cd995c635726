"""Stages of the corpus pipeline, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir), and all but the last return the columns
of ``docs``; what one returns is written as Parquet and read as the next one's
docs. The stages that drop documents are language ID (rejected documents), near
duplicates (all but the first of a component) and benchmarks (documents with a
hit); line dedup shortens texts, and packing places what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, scratch, table
from .decontaminate import drop_contaminated
from .langid import accept, address_suffix, train
from .linededup import drop_boilerplate
from .overlap import keep_one
from .packing import pack
from .queries import VOCABULARY


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in plain text of a trained language, by text and host.

    ``lang`` labels the training sample and is no evidence. Rejected are null and empty
    texts, texts of no trained language and texts full of signs.
    """
    host = F.col("source")
    return accept(docs, train(docs), host=host, suffix=address_suffix(host))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; n_chars follows the text. Null texts stay null."""
    return drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near copies: four fifths of their five-word shingles in common."""
    return keep_one(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in training sequences."""
    return pack(docs, VOCABULARY)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontamination", benchmarks),
    ("packing", sequences),
]

#: SQL expresses neither trained models nor components nor packing; tests hold the
#: stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents below ``sf_dir``.

    A stage's own tables are removed when its result is written, and that when the
    next one's is; the rows returned read tables of the last stage.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as write:
            path, docs = write(stage(spark, docs, sf_dir))
        if before is not None:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

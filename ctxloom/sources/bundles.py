"""Bundles as one-row DataFrames, and as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.BUNDLE).json(path, multiLine=True)


def bundle_json(bundle: DataFrame, pretty: bool = True) -> DataFrame:
    """value: the document; absent fields stay absent."""
    return bundle.select(F.to_json(F.struct(*bundle.columns), {"pretty": str(pretty).lower()}).alias("value"))


def write_bundle(bundle: DataFrame, path: str) -> None:
    """A folder with one JSON document."""
    bundle_json(bundle, pretty=False).coalesce(1).write.mode("overwrite").text(path)

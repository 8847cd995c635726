"""Extraction operators: sources to symbols and raw imports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..schemas import parse_ddl
from .scanner import analyze, strip_strings_and_comments

_ANALYSIS = parse_ddl(
    "path STRING, parse_ok BOOLEAN, symbols STRUCT<exports:ARRAY<STRING>,functions:ARRAY<STRING>,classes:ARRAY<STRING>>, "
    "imports ARRAY<STRUCT<specifier:STRING,type:STRING,named_symbols:ARRAY<STRING>>>"
)
_STRIPPED = parse_ddl("path STRING, stripped STRING")


def analyze_files(files: DataFrame) -> DataFrame:
    """path, parse_ok, symbols and imports of each file; a file that fails gives empty lists."""
    schema = _ANALYSIS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = analyze(content or "")
                rows.append(
                    {
                        "path": path,
                        "parse_ok": found.parse_ok,
                        "symbols": {"exports": list(found.exports), "functions": list(found.functions), "classes": list(found.classes)},
                        "imports": [{"specifier": s, "type": t, "named_symbols": n} for s, t, n in found.imports],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def raw_imports(analyzed: DataFrame) -> DataFrame:
    """One row per import in source order; not de-duplicated."""
    return analyzed.select("path", F.posexplode("imports").alias("ord", "i")).select(
        "path", "ord", "i.specifier", "i.type", "i.named_symbols"
    )


def stripped_sources(files: DataFrame) -> DataFrame:
    """path and content without string literals and comments."""
    schema = _STRIPPED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            contents = [strip_strings_and_comments(c or "") for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(contents, pa.string())], schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)

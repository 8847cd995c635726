"""Explicit schemas of the engine's relations and of the context bundle."""

from __future__ import annotations

import re

from pyspark.sql import types as T

_SIMPLE = {
    "STRING": T.StringType, "BIGINT": T.LongType, "INT": T.IntegerType, "DOUBLE": T.DoubleType, "BOOLEAN": T.BooleanType,
}


class _Ddl:
    """Types from text, without a session."""

    def __init__(self, text: str):
        self.words = re.findall(r"\w+|[<>,:]", text)

    def take(self) -> str:
        return self.words.pop(0)

    def type(self) -> T.DataType:
        word = self.take().upper()
        if word in _SIMPLE:
            return _SIMPLE[word]()
        self.take()
        if word == "ARRAY":
            out: T.DataType = T.ArrayType(self.type())
        elif word == "MAP":
            key = self.type()
            self.take()
            out = T.MapType(key, self.type())
        else:
            out = self.fields(":")
        self.take()
        return out

    def fields(self, colon: str = "") -> T.StructType:
        out = []
        while True:
            name = self.take()
            if colon:
                self.take()
            out.append(T.StructField(name, self.type()))
            if not self.words or self.words[0] != ",":
                return T.StructType(out)
            self.take()


def parse_ddl(ddl: str) -> T.StructType:
    return _Ddl(ddl).fields()


_HOP = "STRUCT<path:STRING,via:STRING,viaSymbols:ARRAY<STRING>,type:STRING>"
_IMPORT = "STRUCT<specifier:STRING,kind:STRING,type:STRING,resolvedPath:STRING,namedSymbols:ARRAY<STRING>>"
_CALLER = "STRUCT<path:STRING,importedSymbols:ARRAY<STRING>,type:STRING>"
_SYMBOLS = "STRUCT<exports:ARRAY<STRING>,functions:ARRAY<STRING>,classes:ARRAY<STRING>>"
_NEIGHBOR = "STRUCT<path:STRING,score:DOUBLE,alsoIn:ARRAY<STRING>>"
_DEPENDENCY = "MAP<STRING,STRUCT<content:STRING,truncated:BOOLEAN>>"

FILE_DDL = (
    "path STRING, prevPath STRING, status STRING, additions BIGINT, deletions BIGINT, patch STRING, "
    f"fullContent STRING, truncated BOOLEAN, symbols {_SYMBOLS}, directImports ARRAY<{_IMPORT}>, "
    f"directCallers ARRAY<{_CALLER}>, "
    f"multiHop STRUCT<forwardTiers:ARRAY<ARRAY<{_HOP}>>,reverseTiers:ARRAY<ARRAY<{_HOP}>>>, "
    f"semanticNeighbors ARRAY<{_NEIGHBOR}>, siblings ARRAY<STRING>, otherChangedFiles ARRAY<STRING>, "
    f"dependencyContents {_DEPENDENCY}"
)
META_DDL = (
    "repo STRING, base STRING, generatedAt STRING, changedFileCount BIGINT, indexedFileCount BIGINT, "
    "graphEdgeCount BIGINT, maxHops INT, "
    "embeddings STRUCT<model:STRING,url:STRING,cacheHits:BIGINT,cacheMisses:BIGINT>, diffMode STRING"
)

CHANGED = parse_ddl("ord INT, status STRING, path STRING, prev_path STRING")
SOURCE_FILES = parse_ddl("ord BIGINT, path STRING, content STRING")
RAW_IMPORTS = parse_ddl("path STRING, ord INT, specifier STRING, type STRING, named_symbols ARRAY<STRING>")
EDGES = parse_ddl(
    "src STRING, ord INT, specifier STRING, kind STRING, type STRING, resolved_path STRING, named_symbols ARRAY<STRING>"
)
HOPS = parse_ddl("start STRING, direction STRING, hop INT, pos INT, path STRING, via STRING, via_symbols ARRAY<STRING>, type STRING")
ISSUES = parse_ddl("severity STRING, category STRING, file STRING, message STRING")
FILE = parse_ddl(FILE_DDL)
META = parse_ddl(META_DDL)
_MEMORY = parse_ddl("path STRING, content STRING")
BUNDLE = T.StructType(
    [
        T.StructField("meta", META),
        T.StructField("rules", T.MapType(T.StringType(), T.StringType())),
        T.StructField("memory", _MEMORY),
        T.StructField("changedFiles", T.ArrayType(T.StringType())),
        T.StructField("files", T.ArrayType(FILE)),
    ]
)
EMBEDDING_CACHE = parse_ddl("model STRING, key STRING, vec ARRAY<DOUBLE>")
EDGE_IMPORT_TYPE = FILE["directImports"].dataType
CALLER_TYPE = FILE["directCallers"].dataType
TIERS_TYPE = FILE["multiHop"].dataType["forwardTiers"].dataType
NEIGHBORS_TYPE = FILE["semanticNeighbors"].dataType
DEPENDENCY_TYPE = FILE["dependencyContents"].dataType
SYMBOLS_TYPE = FILE["symbols"].dataType

"""Source trees as DataFrames."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P

#: Rule files at the root.
RULE_FILES = ("CLAUDE.md", "AGENTS.md", "AGENT.md", ".cursorrules", ".windsurfrules", "greptile.json", ".greptile.json")
#: Suffixes of files that hold no text; they are listed and read only where they are asked for.
BINARY_SUFFIXES = (
    ".7z", ".avif", ".bin", ".bmp", ".class", ".db", ".dll", ".dylib", ".eot", ".exe", ".gif", ".gz", ".ico", ".jar", ".jpeg",
    ".jpg", ".mov", ".mp3", ".mp4", ".node", ".otf", ".parquet", ".pdf", ".png", ".so", ".sqlite", ".tar", ".tgz", ".ttf",
    ".wasm", ".wav", ".webm", ".webp", ".woff", ".woff2", ".xz", ".zip", ".zst",
)
TASK_BYTES = 16 << 20


def _local(folder: str) -> Iterator[tuple[str, bool, int]]:
    """(name, is a folder, bytes) of what lies in a folder; links and what cannot be listed are passed over."""
    try:
        with os.scandir(folder) as held:
            for e in held:
                if e.is_dir(follow_symlinks=False):
                    yield e.name, True, 0
                elif e.is_file(follow_symlinks=False):
                    yield e.name, False, e.stat(follow_symlinks=False).st_size
    except OSError:
        return


def _remote(spark: SparkSession) -> Callable[[str], Iterator[tuple[str, bool, int]]]:
    """The same of a store that Hadoop reaches."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def listed(folder: str) -> Iterator[tuple[str, bool, int]]:
        where = jvm.org.apache.hadoop.fs.Path(folder)
        for status in where.getFileSystem(conf).listStatus(where):
            yield status.getPath().getName(), status.isDirectory(), status.getLen()

    return listed


def walk(root: str, below: str, listed: Callable[[str], Iterable[tuple[str, bool, int]]]) -> Iterator[tuple[str, int]]:
    """(path relative to ``root``, bytes) of all files below ``root``/``below``; ignored names are never entered."""
    waiting = [below]
    while waiting:
        at = waiting.pop()
        for name, folder, size in listed(posixpath.join(root, at) if at else root):
            if name in P.IGNORED_NAMES:
                continue
            path = f"{at}/{name}" if at else name
            if folder:
                waiting.append(path)
            else:
                yield path, size


def read_tree(spark: SparkSession, root: str, scope: str | None = None, also: Iterable[str] = ()) -> DataFrame:
    """files(path, content): the files below ``root``/``scope``, paths relative to ``root``.

    Folders with an ignored name are never entered. Paths are listed on the driver,
    whatever their names begin with; contents are read in tasks, from a folder that all
    executors see. Bytes that are no UTF-8 are replaced. The content of a file with a
    binary suffix is null unless its path is in ``also``, as is that of one that is gone.
    """
    far = "://" in root
    root = root.rstrip("/") if far else os.path.abspath(root)
    asked = set(also)
    found = sorted(walk(root, (scope or "").strip("/"), _remote(spark) if far else _local))
    rows = [(p, p in asked or not p.lower().endswith(BINARY_SUFFIXES), size) for p, size in found]
    tasks = max(1, min(len(rows), sum(n for _, wanted, n in rows if wanted) // TASK_BYTES + spark.sparkContext.defaultParallelism))
    listed = spark.createDataFrame(rows, "path string, wanted boolean, size long").repartition(tasks, "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pa.fs.FileSystem.from_uri(root) if far else (None, root)

        def content(path: str) -> str | None:
            try:
                with store.open_input_stream(f"{base}/{path}") if far else open(f"{base}/{path}", "rb") as f:
                    return f.read().decode("utf-8", "replace")
            except OSError:
                return None

        for batch in batches:
            paths, wanted = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for p, w in zip(paths, wanted, strict=True):  # one text at a time
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([content(p) if w else None], pa.string())], names=["path", "content"])

    return listed.mapInArrow(read, "path string, content string")


def entries_of(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """entries(path, indexed): files, and the directories above them, which exist as well."""
    dirs = files.select(F.explode(P.ancestors(F.col("path"))).alias("path")).distinct().withColumn("indexed", F.lit(False))
    marked = files.select("path").join(indexed.select("path", F.lit(True).alias("i")).distinct(), "path", "left")
    return marked.select("path", F.coalesce("i", F.lit(False)).alias("indexed")).unionByName(dirs)


def index_of(files: DataFrame, changed: DataFrame, scope: str | None = None, package_dirs: list[str] | None = None) -> DataFrame:
    """The files of the index with the source that admits them: scope (0), packages (1), changes (2)."""
    path = F.col("path")
    in_scope = path.startswith(scope.rstrip("/") + "/") if scope else F.lit(True)
    in_package = F.lit(False)
    for d in package_dirs or []:
        in_package = in_package | path.startswith(d.rstrip("/") + "/")
    walked = F.when(P.is_source(path) & in_scope, 0).when(P.is_source(path) & in_package, 1)
    forced = changed.filter("status <> 'deleted'").select("path").distinct().withColumn("forced", F.lit(True))
    both = files.join(forced, "path", "left")
    prio = F.coalesce(walked, F.when(F.col("forced") & P.has_source_extension(path), 2))
    return both.withColumn("source_prio", prio).filter("source_prio is not null").drop("forced")


def scope_counters(index: DataFrame) -> DataFrame:
    """How many files each source has added."""
    return index.agg(*(F.count_if(F.col("source_prio") == i).alias(n) for i, n in enumerate(("walked", "packages", "changes"))))


def rules(files: DataFrame) -> DataFrame:
    """rules(name, content) of the fixed rule files at the root."""
    return files.filter(F.col("path").isin(*RULE_FILES)).select(F.col("path").alias("name"), "content")

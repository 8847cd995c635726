"""Shared plumbing of the training-data operators.

Tables that one job reads more than once are written as Parquet below the
folder that the cluster names in ``spark.checkpoint.dir``, which every executor
shares, so a lost executor costs a recomputation of its tasks and nothing else. They
lie in a folder of the application, ``ctxloom/<application id>``, that can be removed
when it has ended; what is made inside ``scratch`` is removed where that ends.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, as in tests, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="ctxloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_scratch: list[list[str]] = []


def _write(df: DataFrame) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ctxloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return a frame over the written files."""
    path, out = _write(df)
    if _scratch:
        _scratch[-1].append(path)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Remove a written table."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], tuple[str, DataFrame]]]:
    """Tables written inside are removed at the end, but for those that the given function writes."""
    _scratch.append([])
    try:
        yield _write
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``materialize(make())``, after which the tables that ``make`` wrote are removed."""
    with scratch(spark) as write:
        path, out = write(make())
    if _scratch:
        _scratch[-1].append(path)
    return out


_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside are removed when it ends, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP_CONF, None)
    spark.conf.set(_CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP_CONF) if before is None else spark.conf.set(_CLEANUP_CONF, before)


def own_prefix(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores before it until no column begins with it."""
    while any(c.lower().startswith(wanted) for c in columns):
        wanted = f"_{wanted}"
    return wanted


#: Texts are large: this many bytes, and not a number of rows, bound what a task holds at once.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on Arrow batches to BATCH_BYTES, unless it is lower already."""
    now = spark.conf.get(_BATCH_CONF, None)
    if now is None or not now.rstrip("bB").isdigit() or int(now.rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def schema_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def release_memory() -> None:
    """Give back what a task has freed; workers live on, and an executor has several."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library is another
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, list] | None]],
    schema: T.StructType | str,
) -> DataFrame:
    """``df.mapInArrow`` whose function maps a batch to columns by name.

    ``make`` runs once in each task and returns the function for its batches, so
    that indexes and models are built in the worker and not once per batch.
    """
    bound_batches(df.sparkSession)
    if isinstance(schema, str):
        schema = schema_of(schema)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        arrow = to_arrow_schema(schema)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = each(batch)
            if columns is None:
                continue
            arrays = [
                columns[n].cast(arrow.field(n).type)
                if isinstance(columns[n], (pa.Array, pa.ChunkedArray))
                else pa.array(columns[n], type=arrow.field(n).type)
                for n in names
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        release_memory()

    return df.mapInArrow(run, schema)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def values(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))

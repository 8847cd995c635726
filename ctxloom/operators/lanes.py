"""Context lanes of changed files: direct edges, siblings, dependencies and overlap tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X


def ordered(order: list[str], value: Column) -> Column:
    """Aggregate: ``value`` of a group's rows as an array, in the order of columns ``order``."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], value.alias("__v")))), lambda x: x["__v"])


def ordered_rows(order: str, value: Column) -> Column:
    """As ``ordered`` by one column, for values that have no order of their own."""
    by_key = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), value.alias("v"))), by_key), lambda x: x["v"])


def first_n(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits the groups before the exchange."""
    ranked = rows.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("__r") <= n).drop("__r")


def direct_imports(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, imports): all forward edges of changed files, in order."""
    entry = F.struct(
        "specifier", "kind", "type", F.col("resolved_path").alias("resolvedPath"), F.col("named_symbols").alias("namedSymbols")
    )
    own = edges.join(changed.select(F.col("path").alias("src")).distinct(), "src", "left_semi")
    return own.groupBy(F.col("src").alias("path")).agg(ordered(["ord"], entry).alias("imports"))


def direct_callers(arcs: DataFrame, changed: DataFrame, limit: int = 15) -> DataFrame:
    """(path, callers): the first reverse arcs of changed files."""
    own = arcs.join(changed.select(F.col("path").alias("node")).distinct(), "node", "left_semi")
    entry = F.struct(F.col("next").alias("path"), F.col("symbols").alias("importedSymbols"), "type")
    return first_n(own, ["node"], [F.col("arc_ord")], limit).groupBy(F.col("node").alias("path")).agg(ordered(["arc_ord"], entry).alias("callers"))


def siblings(files: DataFrame, changed: DataFrame, limit: int = 20) -> DataFrame:
    """(path, siblings): other files of the same directory, in order of their paths.

    Each directory is listed once, ``limit`` + 1 files long, before it meets its files.
    """
    here = files.select(F.col("path").alias("other"), P.dirname(F.col("path")).alias("dir"))
    listed = first_n(here, ["dir"], [F.col("other")], limit + 1).groupBy("dir").agg(F.array_sort(F.collect_list("other")).alias("names"))
    own = changed.select("path", P.dirname(F.col("path")).alias("dir")).distinct()
    others = F.filter("names", lambda n: n != F.col("path"))
    return own.join(listed, "dir").select("path", F.slice(others, 1, limit).alias("siblings"))


def other_members(changed: DataFrame) -> DataFrame:
    """(path, others): all other changed files, in order; the result is quadratic by definition."""
    every = changed.agg(ordered(["ord"], F.col("path")).alias("every"))
    return changed.join(F.broadcast(every)).select("path", F.filter("every", lambda p: p != F.col("path")).alias("others"))


def dependency_contents(edges: DataFrame, files: DataFrame, changed: DataFrame, max_bytes: int) -> DataFrame:
    """(path, contents): numbered sources of the distinct internal direct dependencies."""
    own = edges.filter("kind = 'internal'").join(changed.select(F.col("path").alias("src")).distinct(), "src", "left_semi")
    wanted = own.groupBy("src", "resolved_path").agg(F.min("ord").alias("ord"))
    held = files.select(
        F.col("path").alias("resolved_path"),
        F.struct(X.with_line_numbers(F.col("content"), max_bytes).alias("content"), X.over_limit(F.col("content"), max_bytes).alias("truncated")).alias("value"),
    )
    found = wanted.join(held, "resolved_path").groupBy(F.col("src").alias("path"))
    return found.agg(F.map_from_entries(ordered(["ord"], F.struct(F.col("resolved_path").alias("key"), "value"))).alias("contents"))


def tag_overlap(neighbors: DataFrame, hops: DataFrame) -> DataFrame:
    """neighbors(target, rank, id, score) with also_in: the lanes whose tiers hold the neighbour."""
    lanes = hops.groupBy(F.col("start").alias("target"), F.col("path").alias("id")).agg(
        F.bool_or(F.col("direction") == "forward").alias("f"), F.bool_or(F.col("direction") == "reverse").alias("r")
    )
    tags = F.array_compact(F.array(F.when(F.col("f"), "forward"), F.when(F.col("r"), "reverse")))
    return neighbors.join(lanes, ["target", "id"], "left").withColumn("also_in", tags).drop("f", "r")


def first_seen(*sources: DataFrame, key: str) -> DataFrame:
    """Union of sources; of rows with one key the one of the earliest source stays."""
    every = None
    for i, s in enumerate(sources):
        tagged = s.withColumn("__source", F.lit(i))
        every = tagged if every is None else every.unionByName(tagged)
    rest = [c for c in sources[0].columns if c != key]
    picked = every.groupBy(key).agg(F.min_by(F.struct("__source", *rest), "__source").alias("row"))
    return picked.select(key, *[F.col(f"row.{c}") for c in rest], F.col("row.__source").alias("source_prio"))

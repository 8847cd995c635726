"""Line dedup by site-relative frequency.

Lines are counted within their host: the number of pages of the host that contain a
line, over the number of pages of the host. A line whose share exceeds ``ratio`` is
boilerplate of that host and is dropped from its pages. ``min_pages`` asks for a
least number of pages as well and is off (1) by default.

The share decides alone, so a host of fewer than 1 / ``ratio`` pages loses every line,
as does a page of which a host holds copies beyond the ratio; callers that want to
keep these dedup pages first, or set ``min_pages``.

Scale: only hashes of lines are shuffled, aggregated before the exchange; the
boilerplate of a host is at most its mean number of lines a page over ``ratio``,
whatever the number of pages, so one array of it meets each page in one join on
host, which Spark may split where a host is hot. All JVM-side.

Defined cases: null text stays null and counts as no page; an empty text is one
empty line; blank lines are never boilerplate; a page of boilerplate alone becomes
its blank lines, or empty; a null host is the host ''; lines repeated within a page
count once, and every one of them is dropped; repeated rows are pages; other columns
pass through, whatever their names, but with ``counts`` n_lines and n_dropped take the
place of columns so named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, own_prefix

#: Up to this measured size the boilerplate of all hosts goes to every executor;
#: beyond it the join is dealt by host, and Spark splits what is hot.
BROADCAST_BYTES = 32 << 20
_BLANK = r"^\s*$"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits: the second hash is seeded by the first."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _host(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = 0.1, min_pages: int = 1) -> DataFrame:
    """Per host with boilerplate: ``host`` (null is empty) and the array ``keys`` of its lines' hashes."""
    pages = docs.filter(F.col("text").isNotNull()).select(_host(host).alias("host"), "text")
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = pages.select(
        "host", F.explode(F.transform(F.filter(F.array_distinct(_lines(F.col("text"))), lambda x: ~x.rlike(_BLANK)), _key)).alias("line")
    )
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    return (
        counts.join(totals, "host")
        .filter(F.col("n") > ratio * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_list("line").alias("keys"))
    )


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = 0.1, min_pages: int = 1, counts: bool = False) -> DataFrame:
    """``docs`` without boilerplate lines; with ``counts`` also n_lines and n_dropped."""
    own = own_prefix(docs.columns, "__linededup_")
    found = materialize(boilerplate(docs, host, ratio, min_pages).select(F.col("host").alias(f"{own}host"), F.col("keys").alias(f"{own}keys")))
    size = found.agg(F.sum(F.octet_length(f"{own}host") + 32 * F.size(f"{own}keys"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        found = F.broadcast(found)
    keys, lines = F.col(f"{own}keys"), _lines(F.col("text"))
    kept = F.filter(lines, lambda x: ~F.array_contains(keys, _key(x)) | x.rlike(_BLANK))
    joined = docs.join(found, _host(host) == F.col(f"{own}host"), "left").withColumn(f"{own}kept", F.when(keys.isNotNull(), kept))
    kept = F.col(f"{own}kept")
    text = F.when(kept.isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text"))
    names, extra = docs.columns, []
    if counts:
        n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
        dropped = F.when(kept.isNotNull(), n - F.size(kept)).otherwise(0)
        extra = [n.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped")]
        names = [c for c in names if c.lower() not in ("n_lines", "n_dropped")]
    return joined.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names), *extra)

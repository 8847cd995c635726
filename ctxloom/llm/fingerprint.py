"""Document fingerprints: canonical exact digests, in built-in functions only.

The canonical form of a text is NFKC, full case folding, NFKC again, white space
folded to single spaces and trimmed; the Unicode steps call the ICU library that
Spark itself ships, through Spark's ``reflect`` function, and texts in ASCII skip
them. A fingerprint is two chained 64-bit xxhashes of the canonical form. Equal
fingerprints make a bucket; inside buckets of more than one document the bytes of
the canonical forms are grouped, so a collision cannot merge different texts.

Scale: hashing is narrow. Grouping shuffles digests; canonical texts travel only
for buckets that repeat, once for each map task and different text, as grouping on
them is aggregated before the exchange. The neighbour of each document by id comes
from one shuffle of the texts into ranges of ids of about ``RANGE_BYTES``, with the first
row of each range copied to the end of the range before it. Ranges are found in two
levels, so that neither a sketch nor a literal grows with their number: coarse bounds
over all ids, of which the driver sees ``COARSE`` at most, and fine bounds within each,
made by grouping and broadcast up to a measured size. An id that fills several ranges,
and rows without an id, are dealt over as many by a hash of their text.

Defined cases: null text is empty, and empty texts are equal; repeated rows are
members of one group; null ids come last in the order and take part in groups, a
group's id being its smallest id that is not null; rows of equal ids are ordered
by a hash of their text; one row is its own neighbour; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, schema_of, text_or_empty

RANGE_BYTES, COARSE = 8 << 20, 256
#: Up to this measured size the repeated buckets go to every executor.
BROADCAST_BYTES, ROW_BYTES, SALTS = 32 << 20, 100, 32
_WHITE = r"[\s\p{Z}\x85]"
#: Runs of white space other than a lone space.
_RUN = rf" ?[\s\p{{Z}}\x85&&[^ ]]{_WHITE}*| {{2}}{_WHITE}*"
_NORMALIZER, _CHARACTERS = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"


def _composed(text: Column) -> Column:
    return F.reflect(F.lit(_NORMALIZER), F.lit("compose"), text, F.lit(True))


def _folded(text: Column) -> Column:
    return F.reflect(F.lit(_CHARACTERS), F.lit("foldCase"), text, F.lit(True))


def canonical(text: Column) -> Column:
    """NFKC, case-folded, single-spaced and trimmed."""
    same = F.when(text.rlike(r"^[\x00-\x7F]*+$"), F.lower(text)).otherwise(_composed(_folded(_composed(text))))
    return F.trim(F.regexp_replace(same, _RUN, " "))


def digest(canon: Column) -> Column:
    """128 bits as two longs; the second hash is seeded by the first."""
    return F.struct(F.xxhash64(canon).alias("a"), F.xxhash64(F.lit("fingerprint"), canon).alias("b"))


def shown(pair: Column) -> Column:
    """A digest as 32 hex digits."""
    return F.lower(F.concat(F.lpad(F.hex(pair["a"]), 16, "0"), F.lpad(F.hex(pair["b"]), 16, "0")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, and ``fp`` as two longs, of each row."""
    canon = docs.select("doc_id", canonical(text_or_empty()).alias("canon"))
    return canon.select("doc_id", digest(F.col("canon")).alias("fp"))


def exact_groups(docs: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """doc_id, fp, group_id and group_size: documents of equal canonical bytes.

    ``marked`` is ``fingerprints(docs)`` where it is at hand, with more columns.
    """
    marked = materialize(fingerprints(docs)) if marked is None else marked
    buckets = marked.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lone_id"))
    repeated = materialize(buckets.filter("n > 1").select("fp"))
    canon = docs.select("doc_id", canonical(text_or_empty()).alias("canon")).withColumn("fp", digest(F.col("canon")))
    if repeated.count() * ROW_BYTES <= BROADCAST_BYTES:
        members = canon.join(F.broadcast(repeated), "fp", "left_semi")
    else:  # a bucket of very many copies is dealt over all salts
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        members = canon.withColumn("salt", salt).join(salted, ["fp", "salt"], "left_semi").drop("salt")
    groups = materialize(
        members.groupBy("fp", "canon")
        .agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("group_size"))
        .withColumn("canon", F.sha2("canon", 512))
    )
    collided = groups.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fp")
    collided = materialize(collided)
    plain = groups if collided.isEmpty() else groups.join(collided, "fp", "left_anti")
    plain = plain.select("fp", "group_id", "group_size")
    lone = buckets.filter("n = 1").select("fp", F.col("lone_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"))
    out = marked.join(materialize(plain.unionByName(lone)), "fp")
    if collided.isEmpty():
        return out
    apart = members.join(collided, "fp", "left_semi").select("doc_id", "fp", F.sha2("canon", 512).alias("canon"))
    ids = apart.join(groups, ["fp", "canon"]).select("doc_id", "fp", "group_id", "group_size").distinct()
    return out.unionByName(marked.join(collided, "fp", "left_semi").join(ids, ["doc_id", "fp"]), allowMissingColumns=True)


def _above(bounds: Column, value: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: b > value))


def _share(tie: Column, parts: Column) -> Column:
    """The place of a hash among ``parts`` equal shares of all hashes, the largest first."""
    place = (F.lit(float(1 << 63)) - tie.cast("double")) / F.lit(float(1 << 64)) * parts
    return F.least(F.floor(place).cast("int"), parts - 1)


def _with_place(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__tie``, and ``__at`` (coarse, fine): the place of its range in the order of falling ids, null last, then falling ties."""
    sizes = docs.agg(F.sum(F.octet_length("text") + 16).alias("b"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    ranges = max(1, math.ceil((sizes.b or 0) / RANGE_BYTES))
    coarse = min(COARSE, math.isqrt(ranges - 1) + 1)
    fine = math.ceil(ranges / coarse)
    cuts = lambda n: [i / n for i in range(1, n)]
    found = docs.agg(F.percentile_approx("doc_id", cuts(coarse), 10_000).alias("q")).first().q if coarse > 1 else None
    bounds = sorted(set(found or []), reverse=True)
    rows = docs.withColumn("__tie", F.xxhash64("text"))
    level = _above(F.array(*map(F.lit, bounds)), F.col("doc_id")) if bounds else F.lit(0)
    rows = rows.withColumn("__coarse", F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(level))
    none = max(1, math.ceil(ranges * sizes.none / sizes.n)) if sizes.n else 1
    if fine == 1:
        inner = F.lit(0)
    else:
        within = F.reverse(F.array_sort(F.percentile_approx("doc_id", cuts(fine), 100 * fine)))
        parts = materialize(rows.filter("doc_id is not null").groupBy(F.col("__coarse").alias("__level")).agg(within.alias("__bounds")))
        size = parts.agg(F.sum(8 * F.size("__bounds") + 32)).first()[0] or 0
        rows = rows.join(F.broadcast(parts) if size <= BROADCAST_BYTES else parts, F.col("__coarse") == F.col("__level"), "left")
        equal = F.size(F.filter("__bounds", lambda b: b == F.col("doc_id")))  # so many ranges less one that this id fills
        inner = _above(F.col("__bounds"), F.col("doc_id")) + F.when(equal > 0, _share(F.col("__tie"), equal + 1)).otherwise(0)
    inner = F.when(F.col("doc_id").isNull(), _share(F.col("__tie"), F.lit(none))).otherwise(inner)
    return rows.select(*docs.columns, "__tie", F.struct(F.col("__coarse").cast("int").alias("coarse"), inner.cast("int").alias("fine")).alias("__at"))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with ``next``: a struct of ``columns`` of the row with the next lower id.

    After the last row comes the first. ``docs`` has doc_id, text and ``columns``.
    """
    rows = _with_place(docs)
    # the first row of each range, and the range before it that it is copied to
    top = rows.groupBy("__at").agg(F.max(F.struct("doc_id", "__tie")).alias("top"))
    top = materialize(top.select(F.col("__at").alias("__own"), F.col("top.doc_id").alias("__id"), F.col("top.__tie").alias("__hash")))
    ends = sorted((r.c, r.f) for r in top.groupBy(F.col("__own.coarse").alias("c")).agg(F.max("__own.fine").alias("f")).collect())
    if not ends:
        return docs.withColumn("next", F.struct(*columns))
    ends = [(c, *ends[i - 1]) for i, (c, _) in enumerate(ends)]  # the last range of the level before; before the first comes the last
    ends = F.broadcast(docs.sparkSession.createDataFrame(ends, schema_of("__level int, coarse int, fine int")))
    before = F.lag("__own").over(W.partitionBy("__own.coarse").orderBy("__own.fine"))
    ghosts = top.join(ends, F.col("__own.coarse") == F.col("__level")).withColumn("__goes", F.coalesce(before, F.struct("coarse", "fine")))
    ghosts = materialize(ghosts.select("__own", "__id", "__hash", "__goes"))
    if ghosts.count() * ROW_BYTES <= BROADCAST_BYTES:
        ghosts = F.broadcast(ghosts)
    on = (F.col("__at") == F.col("__own")) & F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__tie") == F.col("__hash"))
    places = F.array_compact(
        F.array(
            F.struct(F.col("__at").alias("at"), F.lit(False).alias("ghost")),
            F.when(F.col("__goes").isNotNull(), F.struct(F.col("__goes").alias("at"), F.lit(True).alias("ghost"))),
        )
    )
    dealt = rows.join(ghosts, on, "left").select(*docs.columns, "__tie", F.explode(places).alias("__to"))
    order = W.partitionBy("__to.at").orderBy("__to.ghost", F.desc_nulls_last("doc_id"), F.desc("__tie"))
    after = F.lead(F.struct(*columns)).over(order)
    return dealt.withColumn("next", after).filter(~F.col("__to.ghost")).select(*docs.columns, "next")


def edited(text: Column, n: Column, following: Column) -> Column:
    """``text`` with its last floor(n / 2) code points replaced by the first of ``following``."""
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def neighbour_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness; then its group.

    An exact digest is like another (1) or not (0).
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = rows.withColumn("canon", canonical(F.col("text"))).select("doc_id", "text", digest(F.col("canon")).alias("fp"))
    paired = with_next(rows, ["text", "fp"])
    paired = paired.withColumn("n_chars", F.length("text"))
    paired = paired.withColumn("edited", edited(F.col("text"), F.col("n_chars"), F.col("next.text")))
    canon = canonical(F.col("edited"))
    report = paired.withColumn("edited_canon", canon).select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fp",
        digest(F.col("edited_canon")).alias("edited_fp"),
        F.col("next.fp").alias("next_fp"),
    )
    like = lambda other: F.when(F.col("fp") == F.col(other), 1.0).otherwise(0.0)
    grouped = exact_groups(docs, materialize(report))
    return grouped.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.col("fp")).alias("fingerprint"),
        shown(F.col("edited_fp")).alias("edited_fingerprint"),
        like("edited_fp").alias("near_edited"),
        like("next_fp").alias("near_next"),
        "group_id",
        "group_size",
    )

"""Bounded multi-start breadth-first traversal with caps and provenance.

All starts advance together, one join a hop. Candidates of a start are folded in
order of (frontier position, edge order) by a higher-order aggregate, because the
cap of a parent and the removal of nodes already taken depend on each other. Nodes
that the tier cap cuts off stay visited.

A hub may have any number of edges, but of a parent's children only the first few can
matter: each is skipped only for a node that was visited before or that another parent
of the tier has taken, and both are bounded by the caps. So a node's arcs are reduced
to distinct ones, and to that many, before they meet a start. The nodes that a hop
takes are written once, as the tier, the visited nodes and the next hop all read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import written

_NODE = "struct<path:string,via:string,via_symbols:array<string>,type:string>"


_STATE = f"struct<pos:int,taken:int,paths:array<string>,nodes:array<{_NODE}>>"


def capped_fold(candidates: Column, per_parent: int) -> Column:
    """The nodes that ordered candidates yield: none twice, at most ``per_parent`` new ones a parent.

    A parent's candidates lie together, by its place ``pos``, so one counter is enough.
    """
    start = F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("taken"), F.array().cast("array<string>").alias("paths"), F.array().cast(f"array<{_NODE}>").alias("nodes"))

    def step(acc: Column, e: Column) -> Column:
        taken = F.when(acc["pos"] == e["pos"], acc["taken"]).otherwise(0)
        node = F.struct(e["path"].alias("path"), e["via"].alias("via"), e["via_symbols"].alias("via_symbols"), e["type"].alias("type"))
        after = F.struct(e["pos"].alias("pos"), (taken + 1).alias("taken"), F.concat(acc["paths"], F.array(e["path"])).alias("paths"), F.concat(acc["nodes"], F.array(node)).alias("nodes"))
        return F.when((taken >= per_parent) | F.array_contains(acc["paths"], e["path"]), acc).otherwise(after)

    return F.aggregate(candidates, start.cast(_STATE), lambda acc, e: step(acc, e).cast(_STATE), lambda acc: acc["nodes"])


def traverse(
    starts: DataFrame, arcs: DataFrame, direction: str, max_hops: int = 2, per_parent: int = 6, per_tier: int = 15
) -> DataFrame:
    """hops(start, direction, hop, pos, path, via, via_symbols, type).

    starts(start); arcs(node, arc_ord, next, symbols, type), whose arc_ord orders the
    arcs of a node.
    """
    once = arcs.groupBy("node", "next").agg(F.min_by(F.struct("arc_ord", "symbols", "type"), "arc_ord").alias("first")).select("node", "next", "first.*")
    ranked = once.withColumn("nth", F.row_number().over(W.partitionBy("node").orderBy("arc_ord", "next")))
    frontier = starts.select("start", F.lit(0).alias("pos"), F.col("start").alias("path")).distinct()
    visited = frontier.select("start", "path")
    tiers: list[DataFrame] = []
    tasks = int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen, parents = 1, 1  # most nodes visited before a hop, and most parents of it
    for hop in range(1, max_hops + 1):
        few = ranked.filter(F.col("nth") <= seen + parents * per_parent)
        reached = frontier.join(few, frontier["path"] == few["node"]).select(
            "start", "pos", "arc_ord", F.col("next").alias("path"), F.col("node").alias("via"), F.col("symbols").alias("via_symbols"), "type"
        )
        fresh = reached.join(visited, ["start", "path"], "left_anti")
        # a number that is stated, as the fold's cost is not in the bytes by which partitions are joined
        folded = fresh.repartition(tasks, "start").groupBy("start").agg(
            capped_fold(F.array_sort(F.collect_list(F.struct("pos", "arc_ord", "path", "via", "via_symbols", "type"))), per_parent).alias("taken")
        )
        seen, parents = seen + parents * per_parent, per_tier
        if hop < max_hops:
            folded = written(folded)
        tier = folded.select("start", F.posexplode(F.slice("taken", 1, per_tier)).alias("pos", "n")).select(
            "start", F.lit(direction).alias("direction"), F.lit(hop).alias("hop"), "pos", "n.path", "n.via", "n.via_symbols", "n.type"
        )
        tiers.append(tier)
        visited = visited.unionByName(folded.select("start", F.explode("taken").alias("n")).select("start", "n.path"))
        frontier = tier.select("start", "pos", "path")
    out = tiers[0]
    for tier in tiers[1:]:
        out = out.unionByName(tier)
    return out


def forward_arcs(edges: DataFrame) -> DataFrame:
    return edges.filter("kind = 'internal'").select(
        F.col("src").alias("node"), F.col("ord").cast("long").alias("arc_ord"), F.col("resolved_path").alias("next"), F.col("named_symbols").alias("symbols"), "type"
    )


def reverse_arcs(edges: DataFrame) -> DataFrame:
    """Arcs from targets to importers, in order of the importers' paths and their imports."""
    return edges.filter("kind = 'internal'").select(
        F.col("resolved_path").alias("node"),
        F.struct(F.col("src").alias("file"), F.col("ord").alias("at")).alias("arc_ord"),
        F.col("src").alias("next"),
        F.col("named_symbols").alias("symbols"),
        "type",
    )


def tiers_of(hops: DataFrame, tiers_type: T.DataType) -> DataFrame:
    """(start, direction, tiers): nested tiers in order, without empty ones."""
    node = F.struct("pos", F.struct("path", "via", F.col("via_symbols").alias("viaSymbols"), "type").alias("n"))
    tier = hops.groupBy("start", "direction", "hop").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    tier = tier.select("start", "direction", "hop", F.transform("nodes", lambda x: x["n"]).alias("nodes"))
    tiers = tier.groupBy("start", "direction").agg(F.array_sort(F.collect_list(F.struct("hop", "nodes"))).alias("t"))
    return tiers.select("start", "direction", F.transform("t", lambda x: x["nodes"]).cast(tiers_type).alias("tiers"))

"""Assembly of a context bundle: one plan from files and changes to a nested document."""

from __future__ import annotations

import datetime as dt
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X
from ..operators import extract, graph, lanes, resolve, similarity
from ..sources import config, embeddings, memory, tree
from ..sources.diff import Git

_HOME = os.path.join(os.path.expanduser("~"), ".ctxloom")


@dataclass
class Options:
    """Defaults of a run."""

    base: str = "dev"
    root: str = field(default_factory=os.getcwd)
    scope: str | None = None
    out: str | None = None
    max_file_bytes: int = 60_000
    max_callers: int = 15
    max_siblings: int = 20
    max_hops: int = 2
    max_per_parent: int = 6
    max_neighbors: int = 8
    include_content_for_deps: bool = False
    include_workspaces: bool = True
    embeddings: bool = True
    embedding_url: str = field(default_factory=lambda: os.environ.get("OLLAMA_HOST") or "http://localhost:11434")
    embedding_model: str = "embeddinggemma:latest"
    embed_max_chars: int = 5000
    embed_batch_size: int = 16
    memory_path: str = os.path.join(_HOME, "memory.md")
    cache_path: str = os.path.join(_HOME, "embeddings")
    use_memory: bool = True
    inherit_dir: bool = True


@dataclass
class Inputs:
    """The relations that a bundle is made of.

    files(path, content); changed(ord, status, path, prev_path);
    details(path, patch, additions, deletions).
    """

    files: DataFrame
    changed: DataFrame
    details: DataFrame
    repo: str = ""
    memory: tuple[str, str] | None = None
    vectors: DataFrame | None = None  # (path, vec)
    embedding_counters: dict | None = None


def empty(kind) -> F.Column:
    return F.array().cast(kind) if kind.typeName() == "array" else F.lit(None).cast(kind)


def index_and_packages(files: DataFrame, changed: DataFrame, options: Options) -> tuple[DataFrame, DataFrame | None]:
    """The files that a bundle indexes and embeds, and the workspace packages if there are any."""
    packages = config.workspaces(files.sparkSession, files) if options.include_workspaces else None
    package_dirs = [r.dir for r in packages.select("dir").collect()] if packages is not None else []
    return tree.index_of(files, changed, options.scope, package_dirs), packages if package_dirs else None


def assemble(inputs: Inputs, options: Options, generated_at: str | None = None) -> DataFrame:
    """The one-row bundle."""
    files, changed = inputs.files, inputs.changed
    index, packages = index_and_packages(files, changed, options)
    index = index.persist()
    analyzed = extract.analyze_files(index).persist()
    edges = resolve.resolve_imports(
        extract.raw_imports(analyzed), tree.entries_of(files, index), config.configs(files, options.inherit_dir), packages
    ).persist()
    arcs_back = graph.reverse_arcs(edges)
    starts = changed.select(F.col("path").alias("start")).distinct()
    caps = {"max_hops": options.max_hops, "per_parent": options.max_per_parent, "per_tier": options.max_callers}
    hops = graph.traverse(starts, graph.forward_arcs(edges), "forward", **caps).unionByName(
        graph.traverse(starts, arcs_back, "reverse", **caps)
    ).persist()
    tiers = graph.tiers_of(hops, schemas.TIERS_TYPE)
    near = _neighbors(inputs, changed, hops, options)

    row = changed.join(inputs.details, "path", "left").join(files, "path", "left").join(analyzed.select("path", "symbols"), "path", "left")
    row = row.join(lanes.direct_imports(edges, changed), "path", "left")
    row = row.join(lanes.direct_callers(arcs_back, changed, options.max_callers), "path", "left")
    for direction in ("forward", "reverse"):
        own = tiers.filter(F.col("direction") == direction).select(F.col("start").alias("path"), F.col("tiers").alias(direction))
        row = row.join(own, "path", "left")
    row = row.join(near, "path", "left")
    row = row.join(lanes.siblings(index, changed, options.max_siblings), "path", "left")
    row = row.join(lanes.other_members(changed), "path", "left")
    if options.include_content_for_deps:
        row = row.join(lanes.dependency_contents(edges, files, changed, options.max_file_bytes), "path", "left")
    else:
        row = row.withColumn("contents", F.lit(None).cast(schemas.DEPENDENCY_TYPE))
    gone = (F.col("status") == "deleted") | F.col("content").isNull()
    no_symbols = F.struct(*(F.array().cast("array<string>").alias(n) for n in ("exports", "functions", "classes")))
    of = lambda name, kind: F.coalesce(F.col(name).cast(kind), F.array().cast(kind))
    strings = schemas.FILE["siblings"].dataType
    entry = F.struct(
        F.col("path"),
        F.col("prev_path").alias("prevPath"),
        F.col("status"),
        F.coalesce("additions", F.lit(0)).cast("long").alias("additions"),
        F.coalesce("deletions", F.lit(0)).cast("long").alias("deletions"),
        F.coalesce("patch", F.lit("")).alias("patch"),
        F.when(gone, "").otherwise(X.with_line_numbers(F.col("content"), options.max_file_bytes)).alias("fullContent"),
        F.coalesce(~gone & X.over_limit(F.col("content"), options.max_file_bytes), F.lit(False)).alias("truncated"),
        F.coalesce("symbols", no_symbols).alias("symbols"),
        of("imports", schemas.EDGE_IMPORT_TYPE).alias("directImports"),
        of("callers", schemas.CALLER_TYPE).alias("directCallers"),
        F.struct(of("forward", schemas.TIERS_TYPE).alias("forwardTiers"), of("reverse", schemas.TIERS_TYPE).alias("reverseTiers")).alias("multiHop"),
        of("neighbors", schemas.NEIGHBORS_TYPE).alias("semanticNeighbors"),
        of("siblings", strings).alias("siblings"),
        of("others", strings).alias("otherChangedFiles"),
        F.col("contents").alias("dependencyContents"),
    )
    body = row.agg(
        F.coalesce(lanes.ordered(["ord"], F.col("path")), F.array()).alias("changedFiles"),
        F.coalesce(lanes.ordered_rows("ord", entry).cast(schemas.BUNDLE["files"].dataType), F.array().cast(schemas.BUNDLE["files"].dataType)).alias("files"),
    )
    indexed = index.count()
    internal = edges.filter("kind = 'internal'").count()
    counted = inputs.embedding_counters
    embedded = (
        F.struct(F.lit(options.embedding_model), F.lit(options.embedding_url), F.lit(counted["hits"]), F.lit(counted["misses"]))
        if counted is not None
        else F.lit(None)
    )
    meta = F.struct(
        F.lit(inputs.repo).alias("repo"),
        F.lit(options.base).alias("base"),
        F.lit(generated_at or dt.datetime.now(dt.timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")).alias("generatedAt"),
        F.size("changedFiles").cast("long").alias("changedFileCount"),
        F.lit(indexed).cast("long").alias("indexedFileCount"),
        F.lit(internal).cast("long").alias("graphEdgeCount"),
        F.lit(options.max_hops).alias("maxHops"),
        embedded.cast(schemas.META["embeddings"].dataType).alias("embeddings"),
        F.lit("working-tree-vs-base").alias("diffMode"),
    )
    texts = sorted((r.name, r.content) for r in tree.rules(files).collect())  # a few fixed names at the root
    rules = F.create_map(*(F.lit(x) for pair in texts for x in pair)).cast(schemas.BUNDLE["rules"].dataType)
    held = inputs.memory
    note = F.struct(F.lit(held[0]).alias("path"), F.lit(held[1]).alias("content")) if held else F.lit(None).cast(schemas.BUNDLE["memory"].dataType)
    return body.select(meta.alias("meta"), rules.alias("rules"), note.alias("memory"), "changedFiles", "files")


def _neighbors(inputs: Inputs, changed: DataFrame, hops: DataFrame, options: Options) -> DataFrame:
    """(path, neighbors) of changed files that have a vector."""
    spark = changed.sparkSession
    if inputs.vectors is None:
        return spark.createDataFrame([], f"path string, neighbors {schemas.NEIGHBORS_TYPE.simpleString()}")
    vectors = inputs.vectors.select(F.col("path").alias("id"), "vec")
    targets = vectors.join(changed.select(F.col("path").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("target"), "vec")
    tagged = lanes.tag_overlap(similarity.top_k(targets, vectors, options.max_neighbors), hops)
    entry = F.struct(F.col("id").alias("path"), "score", F.col("also_in").alias("alsoIn"))
    return tagged.groupBy(F.col("target").alias("path")).agg(lanes.ordered(["rank"], entry).alias("neighbors"))


def gather(spark: SparkSession, options: Options, embed: embeddings.Embedder | None = None) -> Inputs:
    """The inputs of a git work tree; without an embedder there are no neighbours."""
    git = Git(options.root)
    if not git.has_ref(options.base):
        raise ValueError(f"no such ref: {options.base}")
    changed = git.changed(spark, options.base)
    paths = [r.path for r in changed.select("path").collect()]
    details = git.details(spark, options.base, paths)
    files = tree.read_tree(spark, options.root, also=paths).persist()
    note = (options.memory_path, memory.ensure(options.memory_path)) if options.use_memory else None
    inputs = Inputs(files, changed, details, git.name(), note)
    if options.embeddings and embed is not None:
        index, _ = index_and_packages(files, changed, options)
        attach_vectors(inputs, index.select("path", "content"), options, embed)
    return inputs


def attach_vectors(inputs: Inputs, indexed: DataFrame, options: Options, embed: embeddings.Embedder) -> None:
    """Vectors of the indexed files by way of the cache; new ones are appended to it."""
    spark = indexed.sparkSession
    cache = embeddings.read_cache(spark, options.cache_path, options.embedding_model)
    probed = embeddings.probe(indexed, cache, options.embedding_model, options.embed_max_chars).persist()
    inputs.embedding_counters = embeddings.counters(probed).first().asDict()
    found = embeddings.embed_missing(probed, embed, options.embedding_model, options.embed_max_chars, options.embed_batch_size)
    embeddings.append_cache(found, options.cache_path)
    cache = embeddings.read_cache(spark, options.cache_path, options.embedding_model)
    inputs.vectors = embeddings.probe(indexed, cache, options.embedding_model, options.embed_max_chars).filter("vec is not null").select("path", "vec")

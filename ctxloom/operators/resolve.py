"""Import resolution as one join: candidates in order of preference, first hit wins.

An import's candidate bases (relative path, alias targets, workspace packages) are
numbered; each distinct base is laddered once into the paths that it may stand
for; the ladder meets the relation of existing paths in an equi-join, and
aggregation keeps the least step. Everything is keyed by path, so it scales with
the number of distinct bases and not of imports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

#: Fixed values, in order of preference.
RESOLVE_EXTENSIONS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
INDEX_FILES = ("index.ts", "index.tsx", "index.js", "index.jsx", "index.mjs", "index.cjs")
ASSET_EXTENSIONS = (
    ".json", ".css", ".scss", ".sass", ".less", ".svg", ".png", ".jpg", ".jpeg", ".gif",
    ".webp", ".avif", ".ico", ".md", ".mdx", ".yaml", ".yml", ".txt", ".wasm", ".html",
)
TYPED_SOURCES = ((".js", (".ts", ".tsx")), (".mjs", (".mts",)), (".cjs", (".cts",)), (".jsx", (".tsx",)))


def ladder(base: Column) -> Column:
    """Array of (path, indexed_only) that ``base`` may stand for, best first."""
    step = lambda path, indexed: F.struct(path.alias("path"), F.lit(indexed).alias("indexed_only"))
    under = lambda name: F.when(base == "", F.lit(name)).otherwise(F.concat(base, F.lit("/" + name)))
    steps = [
        F.when(base.endswith(old), step(F.concat(F.expr("left(base, length(base) - {})".format(len(old))), F.lit(new)), False))
        for old, news in TYPED_SOURCES
        for new in news
    ]
    steps += [step(F.concat(base, F.lit(e)), True) for e in RESOLVE_EXTENSIONS]
    steps += [step(under(i), True) for i in INDEX_FILES]
    steps += [step(F.concat(base, F.lit(e)), False) for e in RESOLVE_EXTENSIONS if e]
    steps += [step(under(i), False) for i in INDEX_FILES]
    steps += [step(F.concat(base, F.lit(e)), False) for e in ASSET_EXTENSIONS]
    steps += [step(base, False)]
    return F.array(*steps)


def resolve_bases(bases: DataFrame, entries: DataFrame) -> DataFrame:
    """(base, resolved) of those bases that stand for something.

    entries(path, indexed): what exists below the root, files and directories;
    ``indexed`` marks the files of the index.
    """
    steps = bases.select("base").distinct().select("base", F.posexplode(ladder(F.col("base"))).alias("prio", "c"))
    steps = steps.filter(F.col("c").isNotNull()).select("base", "prio", "c.path", "c.indexed_only")
    hits = steps.join(entries, "path").filter(~F.col("indexed_only") | F.col("indexed"))
    # the root itself is no file: a base that resolves to it stays external
    return hits.groupBy("base").agg(F.min_by("path", "prio").alias("resolved")).filter("resolved <> ''")


def nearest_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """(path, config) of the nearest directory above each file that has a config; the root's is ''.

    ``configs(dir, config)``; a null config is one that could not be read, and hides those above.
    """
    above = files.select("path").distinct().select("path", F.posexplode(P.ancestors(F.col("path"))).alias("up", "dir"))
    found = above.join(configs.select("dir", F.struct("config").alias("held")), "dir")
    return found.groupBy("path").agg(F.min_by("held", "up").alias("held")).select("path", F.col("held.config").alias("config"))


def alias_targets(specifier: Column, config: Column) -> Column:
    """Bases that a config's patterns give a specifier, in the order of patterns and targets.

    config: struct<base_dir: string, patterns: array<struct<pattern, targets: array<string>>>>
    """

    def of(p: Column) -> Column:
        pattern = p["pattern"]
        stem = F.substring(pattern, F.lit(1), F.length(pattern) - 1)
        tail = F.substring(specifier, F.length(stem) + 1, F.length(specifier))
        cut = lambda t: F.when(t.endswith("/*"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
        wild = pattern.endswith("/*")
        return (
            F.when(wild & specifier.startswith(stem), F.transform(p["targets"], lambda t: P.join(config["base_dir"], F.concat(cut(t), tail))))
            .when(~wild & (specifier == pattern), F.transform(p["targets"], lambda t: P.join(config["base_dir"], t)))
            .otherwise(F.array().cast("array<string>"))
        )

    empty = F.array().cast("array<string>")
    return F.coalesce(F.flatten(F.transform(config["patterns"], of)), empty)


def workspace_targets(imports: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(specifier, w_ord, base) of workspace packages that a specifier names, in order.

    A package name is at most two segments of a specifier or the whole of it, so the
    join is an equi-join on the prefixes of the specifier.
    """
    s = F.col("specifier")
    parts = F.split(s, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    named = imports.select("specifier").distinct().select("specifier", F.explode(prefixes).alias("name"))
    joined = named.join(workspaces.select("name", "dir", F.col("ord").alias("w")), "name")
    at, sub = F.col("dir"), F.substring(s, F.length("name") + 2, F.length(s))
    whole = F.array(P.join(at, F.lit("src")), P.join(at, F.lit("src/index")), P.join(at), P.join(at, F.lit("index")))
    inner = F.array_compact(
        F.array(
            P.join(at, F.lit("src"), sub),
            F.when(sub.startswith("dist/"), P.join(at, F.regexp_replace(sub, "^dist/", "src/"))),
            P.join(at, sub),
        )
    )
    options = F.when(s == F.col("name"), whole).otherwise(inner)
    return joined.select("specifier", "w", F.posexplode(options).alias("b", "base")).select(
        "specifier", (F.col("w") * 8 + F.col("b")).alias("w_ord"), "base"
    )


def resolve_imports(imports: DataFrame, entries: DataFrame, configs: DataFrame | None = None, workspaces: DataFrame | None = None) -> DataFrame:
    """Forward edges: one row per raw import, internal with a path or external.

    imports(path, ord, specifier, type, named_symbols)
    """
    s = F.col("specifier")
    relative = s.startswith(".") | s.startswith("/")
    wanted = imports.select("path", "specifier").distinct()
    here = F.when(s.startswith("/"), P.normalize(s)).otherwise(P.join(P.dirname(F.col("path")), s))
    options = wanted.filter(relative).select("path", "specifier", F.lit(0).cast("long").alias("prio"), here.alias("base"))
    bare = wanted.filter(~relative)
    if configs is not None:
        configured = bare.join(nearest_config(bare, configs), "path")
        options = options.unionByName(
            configured.select("path", "specifier", F.posexplode(alias_targets(s, F.col("config"))).alias("prio", "base")).withColumn("prio", F.col("prio").cast("long"))
        )
    if workspaces is not None:
        packages = workspace_targets(bare, workspaces)
        options = options.unionByName(
            bare.join(packages, "specifier").select("path", "specifier", (F.lit(1 << 32) + F.col("w_ord")).alias("prio"), "base")
        )
    hits = options.join(resolve_bases(options, entries), "base")
    best = hits.groupBy("path", "specifier").agg(F.min_by("resolved", "prio").alias("resolved_path"))
    return imports.join(best, ["path", "specifier"], "left").select(
        F.col("path").alias("src"),
        "ord",
        "specifier",
        F.when(F.col("resolved_path").isNotNull(), "internal").otherwise("external").alias("kind"),
        "type",
        "resolved_path",
        "named_symbols",
    )


def reverse_edges(edges: DataFrame) -> DataFrame:
    """The internal edges seen from their targets; duplicates stay."""
    return edges.filter("kind = 'internal'").select(
        F.col("resolved_path").alias("path"), F.col("src").alias("importer"), "ord", "type", "named_symbols"
    )

"""Path algebra on '/'-separated paths relative to a root, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
SOURCE_EXTENSIONS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")
DECLARATION_SUFFIXES = (".d.ts", ".d.mts", ".d.cts")
IGNORED_NAMES = (
    ".cache", ".git", ".idea", ".next", ".parcel-cache", ".pnpm-store", ".svelte-kit", ".turbo", ".vercel",
    ".vscode", ".yarn", "build", "coverage", "dist", "node_modules", "out", "target", "tmp",
)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The directory of a path; '.' at the root."""
    return F.when(F.instr(path, "/") == 0, ".").otherwise(F.regexp_replace(path, r"/[^/]*$", ""))


def extname(path: Column) -> Column:
    """The last extension with its dot; '' for none and for dot files."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def prefix(path: Column, depth: int) -> Column:
    """The first ``depth`` segments, or the whole path if it has fewer."""
    return F.substring_index(path, "/", depth)


def normalize(path: Column) -> Column:
    """Without '.', '..' and empty segments; '..' above the root stays. The root is ''."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        up = F.when((F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        return F.when((s == "") | (s == "."), acc).when(s == "..", up.otherwise(F.concat(acc, F.array(s)))).otherwise(F.concat(acc, F.array(s)))

    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


def join(*parts: Column) -> Column:
    """Parts joined by '/' and normalized."""
    return normalize(F.concat_ws("/", *parts))


def is_source(path: Column) -> Column:
    """A source extension, and not a declaration file."""
    declared = F.lit(False)
    for suffix in DECLARATION_SUFFIXES:
        declared = declared | basename(path).endswith(suffix)
    return has_source_extension(path) & ~declared


def has_source_extension(path: Column) -> Column:
    return extname(path).isin(*SOURCE_EXTENSIONS)


def is_ignored(path: Column) -> Column:
    """Whether any segment bears an ignored name."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED_NAMES)))


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest first, '' (the root) last."""
    parts = F.split(path, "/")
    depths = F.when(F.size(parts) > 1, F.sequence(F.size(parts) - 1, F.lit(1))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.transform(depths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), F.array(F.lit("")))

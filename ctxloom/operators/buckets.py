"""First-match bucketing, signal predicates, totals and the pick of one row."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from .lanes import ordered


@dataclass(frozen=True)
class Bucket:
    """A bucket of paths; it takes what any of its tests takes and no exclusion does."""

    id: str
    name: str
    prefixes: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    contains: tuple[str, ...] = ()
    equals: tuple[str, ...] = ()
    without: tuple[str, ...] = ()

    def takes(self, path: Column) -> Column:
        tests = [path.startswith(p) for p in self.prefixes] + [path.endswith(s) for s in self.suffixes]
        tests += [path.contains(c) for c in self.contains] + [path == e for e in self.equals]
        hit = reduce(or_, tests, F.lit(False))
        for p in self.without:
            hit = hit & ~path.startswith(p)
        return hit


#: The default buckets, in order.
DEFAULT_BUCKETS = (
    Bucket("01", "db-migrations-and-schema", contains=("/prisma/migrations/",), suffixes=("schema.prisma", ".sql")),
    Bucket("02", "backend-api-routes", prefixes=("apps/backend/src/app/api/", "apps/backend/src/route-handlers/")),
    Bucket("03", "backend-lib", prefixes=("apps/backend/src/lib/", "apps/backend/scripts/"), equals=("apps/backend/prisma/seed.ts",)),
    Bucket("04", "dashboard-pages", prefixes=("apps/dashboard/src/app/",)),
    Bucket("05", "dashboard-components-and-lib", prefixes=("apps/dashboard/src/components/", "apps/dashboard/src/lib/")),
    Bucket("06", "e2e-tests", prefixes=("apps/e2e/",)),
    Bucket(
        "07",
        "shared-packages",
        prefixes=tuple(
            f"packages/{p}/" for p in ("stack-shared", "stack-cli", "stack", "template", "dashboard-ui-components", "react", "js", "stack-sc", "stack-ui")
        ),
    ),
    Bucket("08", "other-apps", prefixes=("apps/",), without=("apps/backend/", "apps/dashboard/", "apps/e2e/")),
    Bucket(
        "09",
        "config-ci-docs",
        prefixes=(".github/", "docs/", "docs-mintlify/", "docker/", "configs/", "claude/"),
        suffixes=(".md", ".css"),
        equals=("package.json", "pnpm-lock.yaml", "pnpm-workspace.yaml"),
    ),
)
MISC = Bucket("99", "misc")


def bucket_of(path: Column, buckets: tuple[Bucket, ...] = DEFAULT_BUCKETS) -> Column:
    """struct(id, name) of the first bucket that takes a path; one CASE expression."""
    as_struct = lambda b: F.struct(F.lit(b.id).alias("id"), F.lit(b.name).alias("name"))
    cases = None
    for b in buckets:
        cases = F.when(b.takes(path), as_struct(b)) if cases is None else cases.when(b.takes(path), as_struct(b))
    return as_struct(MISC) if cases is None else cases.otherwise(as_struct(MISC))


def bucket_key(bucket: Column) -> Column:
    return F.concat_ws("-", bucket["id"], bucket["name"])


def bucket_totals(files: DataFrame) -> DataFrame:
    """files(bucket, additions, deletions) by bucket."""
    return files.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions")
    )


def other_buckets(files: DataFrame) -> DataFrame:
    """(bucket, other, n_files): the sizes of the other buckets; the pairs are of buckets, whose list is fixed."""
    sizes = files.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_files"))
    mine = sizes.select(F.col("bucket").alias("mine"))
    return mine.join(F.broadcast(sizes), F.col("mine") != F.col("bucket")).select(
        F.col("mine").alias("bucket"), F.col("bucket").alias("other"), "n_files"
    )


def high_signal(path: Column, status: Column) -> Column:
    """Migrations, schemas, SQL and added sources."""
    return (
        path.contains("/prisma/migrations/")
        | path.endswith("schema.prisma")
        | path.endswith(".sql")
        | ((status == "added") & P.has_source_extension(path))
    )


def symbol_count(symbols: Column, *fields: str) -> Column:
    return reduce(lambda a, b: a + b, (F.size(symbols[f]) for f in fields))


def meaty() -> Column:
    """A file of the bundle that exercises every lane."""
    internal = F.size(F.filter("directImports", lambda i: i["kind"] == "internal"))
    return (
        (internal >= 3)
        & (F.size("directCallers") >= 1)
        & (F.size("multiHop.forwardTiers") >= 1)
        & (F.size("semanticNeighbors") >= 3)
        & (F.length("patch") > 200)
        & (F.length("patch") < 8000)
    )


def pick(files: DataFrame, requested: str | None = None, good: Column | None = None) -> DataFrame:
    """One row of files(ord, path, ...): the requested one, or else a good one, or else the first.

    A request that matches nothing falls through.
    """
    wanted = (F.col("path") == requested) | F.col("path").endswith(requested) if requested else F.lit(False)
    prio = F.when(wanted, 0).when(good if good is not None else meaty(), 1).otherwise(2)
    return files.withColumn("__prio", prio).orderBy("__prio", "ord").limit(1).drop("__prio")


def status_counts(files: DataFrame) -> DataFrame:
    """(status, n_files, paths) of files(ord, path, status)."""
    return files.groupBy("status").agg(F.count(F.lit(1)).alias("n_files"), ordered(["ord"], F.col("path")).alias("paths"))


def merge_external(imports: DataFrame) -> DataFrame:
    """(path, ord, specifier, named_symbols): external imports of a file with one specifier, names distinct in order.

    Names are made distinct in an aggregated shuffle before they are listed.
    """
    external = imports.filter("kind = 'external'")
    named = external.select("src", "specifier", "ord", F.posexplode_outer("named_symbols").alias("at", "name"))
    first = named.groupBy("src", "specifier", "name").agg(F.min(F.struct("ord", "at")).alias("seen"))
    listed = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("seen", "name"))), lambda x: x["name"].isNotNull()), lambda x: x["name"])
    merged = first.groupBy("src", "specifier").agg(F.min("seen.ord").alias("ord"), listed.alias("named_symbols"))
    return merged.select(F.col("src").alias("path"), "ord", "specifier", "named_symbols")

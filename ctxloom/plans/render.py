"""Documents rendered from a bundle, as columns; the writer lays out one file a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import buckets as B
from ..operators.lanes import ordered

#: Caps in characters.
BODY_CAP, PATCH_CAP, SHORT_BODY_CAP, RULE_CAP, PRELUDE_PATCH_CAP = 45_000, 12_000, 20_000, 8_000, 8_000
PROMPT_RULE_CAP, PROMPT_BODY_CAP, PROMPT_PATCH_CAP = 800, 14_000, 6_000
CALLERS_SHOWN, HOPS_SHOWN, NEIGHBORS_SHOWN, OTHERS_SHOWN = 8, 10, 6, 15
PASSES = {"pass1+3": "intent and quality", "pass2": "contracts between files", "pass4": "assumptions and outside context"}
RULE = "\n\n---\n\n"


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _num(column: Column) -> Column:
    return column.cast("string")


def _fenced(kind: str, body: Column, missing: str) -> Column:
    shown = F.coalesce(F.nullif(F.trim(body), F.lit("")), F.lit(missing))
    return _text(f"```{kind}\n", shown, "\n```")


def churn(file: Column) -> Column:
    return _text("+", _num(file["additions"]), " / -", _num(file["deletions"]))


def internal_imports(file: Column, lead: str = "- ", quoted: bool = True, none: str = X.NONE) -> Column:
    own = F.filter(file["directImports"], lambda i: i["kind"] == "internal")
    path = (lambda i: X.code(i["resolvedPath"])) if quoted else (lambda i: i["resolvedPath"])
    return X.lines_or(F.transform(own, lambda i: _text(lead, X.with_symbols(path(i), i["namedSymbols"]))), none)


def external_imports(file: Column) -> Column:
    """External specifiers once each, with their names merged in order."""
    own = F.filter(file["directImports"], lambda i: i["kind"] == "external")
    specs = F.array_distinct(F.transform(own, lambda i: i["specifier"]))
    names = lambda s: F.array_distinct(F.flatten(F.transform(F.filter(own, lambda i: i["specifier"] == s), lambda i: i["namedSymbols"])))
    return X.lines_or(F.transform(specs, lambda s: _text("- ", X.with_symbols(X.code(s), names(s)))))


def callers(file: Column, limit: int | None = CALLERS_SHOWN, lead: str = "- ", quoted: bool = True, none: str = "_(no known callers)_") -> Column:
    shown = F.slice(file["directCallers"], 1, limit) if limit else file["directCallers"]
    path = (lambda c: X.code(c["path"])) if quoted else (lambda c: c["path"])
    return X.lines_or(F.transform(shown, lambda c: _text(lead, X.with_symbols(path(c), c["importedSymbols"], " uses"))), none)


def second_tier(tiers: Column, limit: int | None = HOPS_SHOWN, quoted: bool = True, none: str = X.NONE) -> Column:
    nodes = F.coalesce(F.try_element_at(tiers, F.lit(2)), F.slice(F.flatten(tiers), 1, 0))
    shown = F.slice(nodes, 1, limit) if limit else nodes
    line = (lambda n: _text("- ", X.code(n["path"]), " via ", X.code(n["via"]))) if quoted else (lambda n: _text("  ", n["path"], "  via ", n["via"]))
    return X.lines_or(F.transform(shown, line), none)


def neighbors(file: Column, none: str = "  (none)") -> Column:
    also = lambda n: F.when(F.size(n["alsoIn"]) > 0, _text(" [also in ", F.array_join(n["alsoIn"], "+"), "]")).otherwise("")
    line = lambda n: _text("  ", F.format_string("%.3f", n["score"]), "  ", n["path"], also(n))
    return X.lines_or(F.transform(F.slice(file["semanticNeighbors"], 1, NEIGHBORS_SHOWN), line), none)


def _head(file: Column) -> Column:
    renamed = F.when(file["prevPath"].isNotNull(), _text("\nFormerly: ", X.code(file["prevPath"]))).otherwise("")
    return _text("## ", X.code(file["path"]), "\n\nStatus: **", file["status"], "**  ", churn(file), renamed)


def _symbols(file: Column) -> Column:
    s = file["symbols"]
    return _text("\n\nSymbols\n- exports: ", X.symbol_list(s["exports"]), "\n- functions: ", X.symbol_list(s["functions"]), "\n- classes: ", X.symbol_list(s["classes"]))


def _patch(file: Column) -> Column:
    return _text("\n\n### Patch\n\n", _fenced("diff", X.trimmed(file["patch"], PATCH_CAP), "(no patch)"))


def _body(file: Column, cap: int) -> Column:
    return _text("\n\n### Body\n\n", _fenced("", X.trimmed(file["fullContent"], cap), "(no body)"))


def file_section(file: Column, name: str) -> Column:
    """What a pass shows of one file."""
    if name == "pass1+3":
        return _text(_head(file), _symbols(file), _patch(file), _body(file, BODY_CAP), "\n")
    if name == "pass2":
        return _text(
            _head(file), _symbols(file), "\n\n### Imports within the repository\n", internal_imports(file), "\n\n### Callers\n", callers(file),
            "\n\n### Two hops forward\n", second_tier(file["multiHop"]["forwardTiers"]), "\n\n### Two hops back\n", second_tier(file["multiHop"]["reverseTiers"]), _patch(file), "\n",
        )
    return _text(_head(file), "\n\n### Outside dependencies\n", external_imports(file), _patch(file), _body(file, SHORT_BODY_CAP), "\n")


def bucketed(bundle: DataFrame, buckets: tuple[B.Bucket, ...] = B.DEFAULT_BUCKETS) -> DataFrame:
    """One row a file: meta, ord, bucket ('id-name'), f and its totals."""
    rows = bundle.select("meta", F.posexplode("files").alias("ord", "f"))
    rows = rows.withColumn("bucket", B.bucket_key(B.bucket_of(F.col("f.path"), buckets)))
    return rows.withColumn("additions", F.col("f.additions")).withColumn("deletions", F.col("f.deletions"))


def bucket_documents(bundle: DataFrame, buckets: tuple[B.Bucket, ...] = B.DEFAULT_BUCKETS) -> DataFrame:
    """(name, content): a document for each bucket and pass; paths that no bucket takes make a bucket, too."""
    rows = bucketed(bundle, buckets)
    others = B.other_buckets(rows).groupBy("bucket").agg(
        ordered(["other"], _text("- **", F.col("other"), "** (", _num(F.col("n_files")), " files)")).alias("others")
    )
    f = F.col("f")
    sections = [ordered(["ord"], file_section(f, p)).alias(p) for p in PASSES]
    listed = ordered(["ord"], _text("- ", X.code(f["path"]), "  (+", _num(f["additions"]), "/-", _num(f["deletions"]), ")")).alias("listed")
    groups = rows.groupBy("bucket").agg(F.first("meta").alias("meta"), F.count(F.lit(1)).alias("n"), listed, *sections).join(others, "bucket", "left")
    no_others = F.array().cast("array<string>")
    header = _text(
        "# Bucket ", X.code(F.col("bucket")), ": {}\n\nRepository: ", X.code(F.col("meta.repo")), "\nBase: ", X.code(F.col("meta.base")),
        "\nFiles here: **", _num(F.col("n")), "** of **", _num(F.col("meta.changedFileCount")), "** in ", _num(F.size(F.coalesce("others", no_others)) + 1),
        " buckets\n\n## Files\n", X.lines_or(F.col("listed")), "\n\n## Other buckets\n", X.lines_or(F.coalesce("others", no_others)),
    )
    out = None
    for name, title in PASSES.items():
        content = F.concat(F.replace(header, F.lit("{}"), F.lit(title)), F.lit(RULE), F.array_join(F.col(f"`{name}`"), RULE))
        part = groups.select(_text("buckets/", F.col("bucket"), f"/{name}.md").alias("name"), content.alias("content"))
        out = part if out is None else out.unionByName(part)
    return out


def overview(bundle: DataFrame, buckets: tuple[B.Bucket, ...] = B.DEFAULT_BUCKETS) -> DataFrame:
    rows = bucketed(bundle, buckets)
    f = F.col("f")
    line = _text("- ", X.code(f["path"]), "  (+", _num(f["additions"]), "/-", _num(f["deletions"]), ", ", f["status"], ")")
    parts = B.bucket_totals(rows).join(rows.groupBy("bucket").agg(ordered(["ord"], line).alias("lines")), "bucket")
    part = _text("### ", F.col("bucket"), " (", _num(F.col("n_files")), " files, +", _num(F.col("additions")), "/-", _num(F.col("deletions")), ")\n", F.array_join("lines", "\n"))
    body = parts.agg(F.array_join(ordered(["bucket"], part), "\n\n").alias("body"))
    m = F.col("meta")
    content = _text(
        "# Overview\n\nRepository: ", X.code(m["repo"]), "\nBase: ", X.code(m["base"]), "\nGenerated: ", X.code(m["generatedAt"]), "\nDiff: ", X.code(m["diffMode"]),
        "\n\n- files changed: **", _num(m["changedFileCount"]), "**\n- files indexed: ", _num(m["indexedFileCount"]), "\n- edges: ", _num(m["graphEdgeCount"]),
        "\n- hops: ", _num(m["maxHops"]), "\n\n## Buckets\n\n", F.coalesce("body", F.lit("")), "\n",
    )
    return bundle.join(body).select(F.lit("00-overview.md").alias("name"), content.alias("content"))


def rules_and_memory(bundle: DataFrame) -> DataFrame:
    held = F.when(F.col("memory").isNotNull(), _text("\n## Memory (", X.code(F.col("memory.path")), ")\n```\n", F.trim(F.col("memory.content")), "\n```\n")).otherwise("")
    one = lambda e: _text("\n## ", e["key"], "\n```\n", F.substring(F.trim(e["value"]), 1, RULE_CAP), "\n```\n")
    rules = F.array_join(F.transform(F.map_entries("rules"), one), "")
    return bundle.select(F.lit("rules-and-memory.md").alias("name"), _text("# Rules and memory\n", held, F.coalesce(rules, F.lit(""))).alias("content"))


def prelude(bundle: DataFrame) -> DataFrame:
    """Changes by status, patches of high-signal files, and the symbols of the others."""
    files = F.col("files")
    of = lambda status: F.filter(files, lambda f: f["status"] == status)
    added = lambda f: _text("- ", X.code(f["path"]), " (+", _num(f["additions"]), ", ", _num(B.symbol_count(f["symbols"], "exports", "functions")), " new symbols)")
    plain = lambda f: _text("- ", X.code(f["path"]), " (+", _num(f["additions"]), "/-", _num(f["deletions"]), ")")
    moved = lambda f: _text("- ", X.code(f["prevPath"]), " to ", X.code(f["path"]))
    bare = lambda f: _text("- ", X.code(f["path"]))
    signal = F.filter(files, lambda f: B.high_signal(f["path"], f["status"]))
    rest = F.filter(files, lambda f: ~B.high_signal(f["path"], f["status"]) & (B.symbol_count(f["symbols"], "exports", "functions", "classes") > 0))
    hunk = lambda f: _text("### ", X.code(f["path"]), " (", f["status"], ", ", churn(f), ")\n```diff\n", X.trimmed(f["patch"], PRELUDE_PATCH_CAP, "\n... [truncated]"), "\n```\n")

    def names(f: Column) -> Column:
        s = f["symbols"]
        shown = [F.when(F.size(s[k]) > 0, _text(f"{k}: ", F.array_join(F.slice(s[k], 1, n), ", "))) for k, n in (("exports", 8), ("functions", 8), ("classes", 4))]
        return _text("- ", X.code(f["path"]), ": ", F.concat_ws("; ", *shown))

    group = lambda title, rows, line: F.when(F.size(rows) > 0, _text(f"\n### {title} (", _num(F.size(rows)), ")\n", X.lines_or(F.transform(rows, line)), "\n")).otherwise("")
    content = _text(
        "# Prelude\n\nRepository: ", X.code(F.col("meta.repo")), "\nBase: ", X.code(F.col("meta.base")), "\nFiles changed: ", _num(F.col("meta.changedFileCount")), "\n\n## Changes\n",
        group("Added", of("added"), added), group("Modified", of("modified"), plain), group("Renamed", of("renamed"), moved), group("Deleted", of("deleted"), bare),
        F.when(F.size(signal) > 0, _text("\n## High-signal patches\n\n", F.array_join(F.transform(F.filter(signal, lambda f: f["patch"] != ""), hunk), "\n"))).otherwise(""),
        F.when(F.size(rest) > 0, _text("\n## Symbols of the other files\n", X.lines_or(F.transform(rest, names)), "\n")).otherwise(""),
    )
    return bundle.select(F.lit("prelude-context.md").alias("name"), content.alias("content"))


def documents(bundle: DataFrame, buckets: tuple[B.Bucket, ...] = B.DEFAULT_BUCKETS) -> DataFrame:
    """All documents of a bundle."""
    return overview(bundle, buckets).unionByName(rules_and_memory(bundle)).unionByName(prelude(bundle)).unionByName(bucket_documents(bundle, buckets))


def with_preamble(prompts: DataFrame, worktree: str | None) -> DataFrame:
    """prompts(name, content) with a line that says which work tree they are about."""
    if not worktree:
        return prompts
    return prompts.withColumn("content", _text(f"Work in `{worktree}`; all relative paths are below it.{RULE}", F.col("content")))


def file_prompt(bundle: DataFrame, requested: str | None = None) -> DataFrame:
    """(name, content): everything that the bundle knows of one file."""
    rows = bundle.select("meta", "rules", "memory", F.posexplode("files").alias("ord", "f")).select("meta", "rules", "memory", "ord", "f", "f.*")
    one = B.pick(rows, requested)
    f, m = F.col("f"), F.col("meta")
    none = "  (none)"
    listed = lambda k: F.coalesce(F.nullif(F.array_join(f["symbols"][k], ", "), F.lit("")), F.lit("(none)"))
    rules = F.array_join(F.transform(F.map_entries("rules"), lambda e: _text("### ", e["key"], "\n", F.substring(e["value"], 1, PROMPT_RULE_CAP))), "\n\n")
    content = _text(
        "# File under review: ", X.code(f["path"]), "\n\nRepository: ", m["repo"], "\nBase: ", m["base"], "\nFiles changed: ", _num(m["changedFileCount"]),
        "\nStatus: ", f["status"], " (", churn(f), ")", F.when(f["prevPath"].isNotNull(), _text("\nFormerly: ", f["prevPath"])).otherwise(""),
        "\n\n## Memory\n", F.coalesce(X.memory_lines(F.col("memory.content")), F.lit("(no memory)")), "\n\n## Rules\n", F.coalesce(rules, F.lit("")),
        "\n\n## Symbols\n- exports: ", listed("exports"), "\n- functions: ", listed("functions"), "\n- classes: ", listed("classes"),
        "\n\n## Imports\n", internal_imports(f, "  ", False, none), "\n\n## Callers\n", callers(f, None, "  ", False, none),
        "\n\n## Two hops forward\n", second_tier(f["multiHop"]["forwardTiers"], None, False, none), "\n\n## Two hops back\n", second_tier(f["multiHop"]["reverseTiers"], None, False, none),
        "\n\n## Similar files\n", neighbors(f), "\n\n## Other changed files\n",
        X.lines_or(F.slice(f["otherChangedFiles"], 1, OTHERS_SHOWN), "(none)"),
        "\n\n## Patch\n", _text("```diff\n", X.trimmed(f["patch"], PROMPT_PATCH_CAP, "\n... [truncated]"), "\n```"),
        "\n\n## Body\n```\n", X.trimmed(f["fullContent"], PROMPT_BODY_CAP, "\n... [truncated]"), "\n```\n",
    )
    return one.select(f["path"].alias("name"), content.alias("content"))

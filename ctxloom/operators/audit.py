"""Seven audits of a bundle: issues, counters and verdicts.

Each audit flattens the bundle's rows once and returns a relation; ``issues`` is
their union, and ``verdicts`` reads the counters. Deviation from a report that only
prints: ``failed`` says whether any category fails, so that a caller can act on it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X

CATEGORIES = ("existence", "resolution", "ast-recall", "multi-hop", "memory", "rules", "context-gap")


def _issue(severity: str | Column, category: str, file: Column, message: Column) -> list[Column]:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return [severity.alias("severity"), F.lit(category).alias("category"), file.alias("file"), message.alias("message")]


def flat_hops(files: DataFrame) -> DataFrame:
    """(start, direction, hop, pos, path, via) of all tiers."""
    both = None
    for direction, field in (("forward", "forwardTiers"), ("reverse", "reverseTiers")):
        tiers = files.select(F.col("path").alias("start"), F.posexplode(f"multiHop.{field}").alias("h", "tier"))
        nodes = tiers.select("start", F.lit(direction).alias("direction"), (F.col("h") + 1).alias("hop"), F.posexplode("tier").alias("pos", "n"))
        nodes = nodes.select("start", "direction", "hop", "pos", "n.path", "n.via")
        both = nodes if both is None else both.unionByName(nodes)
    return both


def flat_imports(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode("directImports").alias("ord", "i")).select("path", "ord", "i.*")


def path_references(files: DataFrame) -> DataFrame:
    """(file, ref): every path that the bundle names, repeats included; deleted files don't name themselves."""
    own = files.filter("status <> 'deleted'").select(F.col("path").alias("file"), F.col("path").alias("ref"))
    imports = flat_imports(files).filter("kind = 'internal'").select(F.col("path").alias("file"), F.col("resolvedPath").alias("ref"))
    callers = files.select(F.col("path").alias("file"), F.explode("directCallers").alias("c")).select("file", F.col("c.path").alias("ref"))
    hops = flat_hops(files).select(F.col("start").alias("file"), F.col("path").alias("ref"))
    near = files.select(F.col("path").alias("file"), F.explode("semanticNeighbors").alias("n")).select("file", F.col("n.path").alias("ref"))
    return own.unionByName(imports).unionByName(callers).unionByName(hops).unionByName(near)


def existence(files: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(issues, counters) of references against existing(path)."""
    marked = missing_marked(path_references(files), existing.select(F.col("path").alias("ref")), "ref")
    issues = marked.filter("missing").select(*_issue("error", "existence", F.col("file"), F.concat(F.lit("missing on disk: "), F.col("ref"))))
    return issues, existence_counters(marked)


def missing_marked(refs: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """``refs`` and whether ``existing`` lacks their key."""
    there = existing.select(key).distinct().withColumn("there", F.lit(True))
    return refs.join(there, key, "left").withColumn("missing", F.col("there").isNull()).drop("there")


def existence_counters(marked: DataFrame) -> DataFrame:
    return marked.agg(F.count(F.lit(1)).alias("checked"), F.count_if("missing").alias("missing"))


def resolution_class(specifier: Column) -> Column:
    """What an external specifier that should have been internal looks like; null otherwise."""
    return F.when(specifier.rlike(r"^(\./|\.\./|/)"), "relative").when(specifier.startswith("@/"), "alias")


def resolution(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    external = flat_imports(files).filter("kind = 'external'").withColumn("broken", resolution_class(F.col("specifier")))
    severity = F.when(F.col("broken") == "relative", "warning").otherwise("error")
    issues = external.filter("broken is not null").select(
        *_issue(severity, "resolution", F.col("path"), F.concat(F.lit("unresolved import: "), F.col("specifier")))
    )
    counters = external.agg(
        F.count(F.lit(1)).alias("external"),
        F.count_if(F.col("broken") == "relative").alias("relative_broken"),
        F.count_if(F.col("broken") == "alias").alias("alias_broken"),
    )
    return issues, counters


def symbol_recall(files: DataFrame, stripped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names that a plain pattern finds in stripped(path, stripped) and the scanner does not, and the reverse."""
    sources = files.filter((F.col("status") != "deleted") & P.has_source_extension(F.col("path")))
    read = sources.join(stripped, "path").select("path", "symbols", X.exported_names(F.col("stripped")).alias("plain"))
    known = F.array_union(F.array_union("symbols.exports", "symbols.functions"), "symbols.classes")
    diff = read.select(
        "path",
        F.array_except("plain", known).alias("missed"),
        F.array_remove(F.array_except("symbols.exports", "plain"), "default").alias("extra"),
    )
    sample = F.concat(F.array_join(F.slice("missed", 1, 4), ", "), F.when(F.size("missed") > 4, ", ...").otherwise(""))
    issues = diff.filter(F.size("missed") > 0).select(*_issue("warning", "ast-recall", F.col("path"), F.concat(F.lit("names not found: "), sample)))
    counters = diff.agg(
        F.count(F.lit(1)).alias("checked"),
        F.coalesce(F.sum(F.size("missed")), F.lit(0)).alias("missed"),
        F.coalesce(F.sum(F.size("extra")), F.lit(0)).alias("extra"),
    )
    return issues, counters


def hop_integrity(hops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes whose parent is neither the start nor in the tier before; starts within their own tiers.

    hops(start, direction, hop, path, via); the first tier's parents are not looked at.
    """
    before = hops.select("start", "direction", (F.col("hop") + 1).alias("hop"), F.col("path").alias("via")).distinct().withColumn("known", F.lit(True))
    later = hops.filter("hop > 1").join(before, ["start", "direction", "hop", "via"], "left")
    checked = later.withColumn("ok", F.coalesce("known", F.lit(False)) | (F.col("via") == F.col("start")))
    loops = hops.filter("path = start").select("start").distinct()
    issues = checked.filter("not ok").select(*_issue("error", "multi-hop", F.col("start"), F.concat(F.lit("parent not in the tier before: "), F.col("via"))))
    issues = issues.unionByName(loops.select(*_issue("error", "multi-hop", F.col("start"), F.lit("file in its own tiers"))))
    judged = checked.select("ok").unionByName(loops.select(F.lit(False).alias("ok")))
    return issues, judged.agg(F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"))


def coherence(pairs: DataFrame, left: str = "path", right: str = "neighbor") -> DataFrame:
    """How many pairs of paths share their first 3, 4 and 5 segments."""
    same = lambda n: F.count_if(P.prefix(F.col(left), n) == P.prefix(F.col(right), n))
    counted = pairs.agg(F.count(F.lit(1)).alias("total"), same(3).alias("same3"), same(4).alias("same4"), same(5).alias("same5"))
    return counted.select("*", *(X.percent(F.col(f"same{n}"), F.col("total")).alias(f"pct{n}") for n in (3, 4, 5)))


def drift(held: DataFrame, disk: DataFrame, category: str) -> tuple[DataFrame, DataFrame]:
    """held(name, content) against disk(name, content): equal, changed or unreadable."""
    both = held.join(disk.select("name", F.col("content").alias("now"), F.lit(True).alias("there")), "name", "left")
    state = F.when(F.col("there").isNull() | F.col("now").isNull(), "unreadable").when(F.col("content") == F.col("now"), "ok").otherwise("drift")
    both = both.withColumn("state", state)
    severity = F.when(F.col("state") == "drift", "warning").otherwise("error")
    issues = both.filter("state <> 'ok'").select(*_issue(severity, category, F.col("name"), F.col("state")))
    return issues, both.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("state") == "ok").alias("matching"))


def context_gaps(lanes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lanes(path, direct, hops, near) as sizes: rows with none at all, and rows with direct ones only."""
    none = (F.col("direct") == 0) & (F.col("hops") == 0) & (F.col("near") == 0)
    partial = (F.col("direct") > 0) & (F.col("hops") == 0) & (F.col("near") == 0)
    issues = lanes.filter(none).select(*_issue("warning", "context-gap", F.col("path"), F.lit("no context at all")))
    return issues, lanes.agg(F.count_if(none).alias("gaps"), F.count_if(partial).alias("partial"))


def lane_sizes(files: DataFrame) -> DataFrame:
    sources = files.filter((F.col("status") != "deleted") & P.has_source_extension(F.col("path")))
    hops = F.size(F.flatten("multiHop.forwardTiers")) + F.size(F.flatten("multiHop.reverseTiers"))
    return sources.select("path", (F.size("directImports") + F.size("directCallers")).alias("direct"), hops.alias("hops"), F.size("semanticNeighbors").alias("near"))


def issue_pivot(issues: DataFrame) -> DataFrame:
    """Counts by category and severity."""
    return issues.groupBy("category").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warning", "info")))


@dataclass
class Report:
    """Issues, counters and verdict of each category."""

    issues: DataFrame
    counters: dict[str, dict[str, int]]
    verdicts: dict[str, str]

    @property
    def failed(self) -> bool:
        return "FAIL" in self.verdicts.values()

    def text(self, sample: int = 20) -> str:
        lines = ["# Bundle audit", ""]
        for name, verdict in self.verdicts.items():
            numbers = ", ".join(f"{k}: {v}" for k, v in self.counters[name].items())
            lines.append(f"{name}: {verdict} ({numbers})")
        total = self.issues.count()
        lines += ["", f"Issues: {total}"]
        rows = self.issues.orderBy("category", "severity", "file", "message").limit(sample).collect()
        lines += [f"  {r.severity.upper():7} {r.category:12} {r.message} [{r.file or '-'}]" for r in rows]
        if total > sample:
            lines.append(f"  and {total - sample} more")
        return "\n".join(lines) + "\n"


def audit(bundle: DataFrame, existing: DataFrame, sources: DataFrame, rules: DataFrame, memory: DataFrame) -> Report:
    """All seven audits of a bundle against what is on disk.

    existing(path); sources(path, stripped); rules(name, content); memory(name, content).
    """
    files = bundle.select(F.explode("files").alias("f")).select("f.*")
    parts = {
        "existence": existence(files, existing),
        "resolution": resolution(files),
        "ast-recall": symbol_recall(files, sources),
        "multi-hop": hop_integrity(flat_hops(files)),
    }
    held_rules = bundle.select(F.explode("rules").alias("name", "content"))
    held_memory = bundle.filter("memory is not null").select(F.col("memory.path").alias("name"), F.col("memory.content").alias("content"))
    parts["memory"] = drift(held_memory, memory, "memory")
    parts["rules"] = drift(held_rules, rules, "rules")
    parts["context-gap"] = context_gaps(lane_sizes(files))
    near = files.select("path", F.explode("semanticNeighbors").alias("n")).select("path", F.col("n.path").alias("neighbor"))
    issues = None
    for found, _ in parts.values():
        issues = found if issues is None else issues.unionByName(found)
    counters = {name: counted.first().asDict() for name, (_, counted) in parts.items()}
    counters["coherence"] = coherence(near).first().asDict()
    c = counters
    passed = lambda ok, other="FAIL": "PASS" if ok else other
    verdicts = {
        "existence": passed(c["existence"]["missing"] == 0),
        "resolution": passed(c["resolution"]["relative_broken"] == 0 and c["resolution"]["alias_broken"] == 0),
        "ast-recall": passed(c["ast-recall"]["missed"] == 0, "PASS*" if c["ast-recall"]["missed"] < 10 else "FAIL"),
        "multi-hop": passed(c["multi-hop"]["invalid"] == 0),
        "coherence": "INFO",
        "memory": passed(c["memory"]["checked"] == c["memory"]["matching"]),
        "rules": passed(c["rules"]["checked"] == c["rules"]["matching"]),
        "context-gap": passed(c["context-gap"]["gaps"] == 0, "INFO"),
    }
    return Report(issues, counters, verdicts)

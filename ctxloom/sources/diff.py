"""Diffs: name-status and numstat texts, and the git commands that print them."""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

#: Fixed value: the last two segments of a remote address.
_REMOTE = r"[/:]([^/:]+/[^/:]+?)(?:\.git)?$"


def status_name(code: Column) -> Column:
    """The name of a status code by its first letter; unknown ones are modifications."""
    letter = F.substring(code, 1, 1)
    return (
        F.when(letter == "A", "added").when(letter == "D", "deleted").when(letter == "R", "renamed").when(letter == "C", "copied").otherwise("modified")
    )


def parse_name_status(lines: DataFrame) -> DataFrame:
    """changed(ord, status, path, prev_path) of lines(ord, value)."""
    parts = F.split("value", "\t")
    renamed = parts[0].startswith("R") & (F.size(parts) > 2)
    at = lambda i: F.try_element_at(parts, F.lit(i + 1))
    return lines.filter(F.length("value") > 0).select(
        F.col("ord").cast("int").alias("ord"),
        status_name(parts[0]).alias("status"),
        F.when(renamed, at(2)).otherwise(at(1)).alias("path"),
        F.when(renamed, at(1)).alias("prev_path"),
    )


def parse_numstat(lines: DataFrame) -> DataFrame:
    """(path, additions, deletions) of lines(value); what is no number counts as 0."""
    parts = F.split("value", "\t")
    number = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("long"), F.lit(0)).cast("long")
    return lines.select(F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("")).alias("path"), number(1).alias("additions"), number(2).alias("deletions"))


def repo_name(url: Column, fallback: str) -> Column:
    """The last two segments of a remote address without .git."""
    return F.coalesce(F.nullif(F.regexp_extract(url, _REMOTE, 1), F.lit("")), F.lit(fallback))


class Git:
    """Commands of one work tree, run on the driver."""

    def __init__(self, root: str):
        self.root = os.path.abspath(root)

    def run(self, *args: str) -> str:
        """What a command prints, whole; it raises where the command fails."""
        out = subprocess.run(["git", "-c", "core.quotepath=off", "-C", self.root, *args], capture_output=True, check=True).stdout
        return out.decode("utf-8", "replace")

    def safe(self, *args: str) -> str:
        """The same, and nothing where the command fails."""
        try:
            return self.run(*args)
        except (subprocess.CalledProcessError, OSError):
            return ""

    def has_ref(self, ref: str) -> bool:
        try:
            self.run("rev-parse", "--verify", "--quiet", ref)
        except (subprocess.CalledProcessError, OSError):
            return False
        return True

    def name(self) -> str:
        m = re.search(_REMOTE, self.safe("config", "--get", "remote.origin.url").strip())
        return m[1] if m else os.path.basename(self.root)

    def changed(self, spark: SparkSession, base: str) -> DataFrame:
        lines = self.run("diff", "--name-status", "--find-renames", base).splitlines()
        rows = spark.createDataFrame(list(enumerate(lines)), "ord int, value string")
        return spark.createDataFrame(parse_name_status(rows).collect(), schemas.CHANGED)

    def details(self, spark: SparkSession, base: str, paths: list[str]) -> DataFrame:
        """(path, patch, additions, deletions) of changed paths, from one patch and one list of counts.

        Both are made without renames, so that a path's part is what it is by itself,
        and name files in the same order.
        """
        counts = [x for x in self.run("diff", "--no-renames", "--numstat", "-z", base).split("\0") if x]
        patch = self.run("diff", "--no-renames", "--unified=3", base)
        parts = re.split(r"^(?=diff --git )", patch, flags=re.MULTILINE)[1:] if patch else []
        by_path = {c.split("\t", 2)[2]: (part, c) for part, c in zip(parts, counts, strict=True)}
        rows = [(p, *by_path.get(p, ("", ""))) for p in paths]
        raw = spark.createDataFrame(rows, "file string, patch string, value string")
        cells = F.split("value", "\t")
        number = lambda i: F.coalesce(F.try_element_at(cells, F.lit(i)).try_cast("long"), F.lit(0)).cast("long")
        return raw.select(F.col("file").alias("path"), "patch", number(1).alias("additions"), number(2).alias("deletions"))

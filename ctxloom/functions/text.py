"""Text functions: line numbers, caps, percentages and list rendering."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "_(none)_"


def escape_regex(literal: str) -> str:
    return re.escape(literal)


def over_limit(content: Column, max_bytes: int) -> Column:
    return F.octet_length(content) > max_bytes


def with_line_numbers(content: Column, max_bytes: int) -> Column:
    """Right-aligned numbers before each line; a text over the limit in bytes is first cut to as many characters."""
    shown = F.when(over_limit(content, max_bytes), F.substring(content, 1, max_bytes)).otherwise(content)
    lines = F.split(shown, "\n", -1)
    width = F.length(F.size(lines).cast("string"))
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((i + 1).cast("string"), width, F.lit(" ")), F.lit(": "), x)), "\n")


#: Fixed value: what stands for the rest of a text.
TRUNCATED = "\n... [truncated, file continues]"


def trimmed(content: Column, limit: int, marker: str = TRUNCATED) -> Column:
    """Cut to ``limit`` characters with a marker."""
    return F.when(F.length(content) > limit, F.concat(F.substring(content, 1, limit), F.lit(marker))).otherwise(content)


def percent(part: Column, whole: Column) -> Column:
    """One decimal and a percent sign; n/a of nothing."""
    return F.when(whole == 0, "n/a").otherwise(F.format_string("%.1f%%", part / F.nullif(whole, F.lit(0)) * 100))


def lines_or(items: Column, empty: str = NONE) -> Column:
    """Items as lines, or ``empty`` if there are none."""
    return F.when(F.size(items) > 0, F.array_join(items, "\n")).otherwise(empty)


def bullet_list(items: Column) -> Column:
    return lines_or(F.transform(items, lambda x: F.concat(F.lit("- "), x)))


def code(value: Column) -> Column:
    return F.concat(F.lit("`"), value, F.lit("`"))


def symbol_list(names: Column) -> Column:
    """Names in backticks, comma-separated."""
    return F.when(F.size(names) > 0, F.array_join(F.transform(names, code), ", ")).otherwise(NONE)


def with_symbols(path: Column, names: Column, word: str = "") -> Column:
    """``path word { a, b }``, or the path alone."""
    return F.when(F.size(names) > 0, F.concat(path, F.lit(f"{word} {{ "), F.array_join(names, ", "), F.lit(" }"))).otherwise(path)


def memory_lines(content: Column) -> Column:
    """The items and section headers of a memory text."""
    return F.array_join(F.filter(F.split(content, "\n", -1), lambda x: x.startswith("- ") | x.rlike(r"^##\s")), "\n")


def exported_names(content: Column) -> Column:
    """Distinct names that a plain pattern finds declared by export, in order."""
    # fixed value: the plain pattern
    pattern = r"(?:^|\s)export\s+(?:default\s+)?(?:async\s+)?(?:function\*?|class|const|let|var|interface|type|enum)\s+(\w+)"
    return F.array_distinct(F.regexp_extract_all(content, F.lit(pattern), 1))

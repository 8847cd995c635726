"""The memory file: a Markdown text with sections of items, kept on the driver."""

from __future__ import annotations

import os
import re

SECTIONS = {"rule": "Rules", "suppress": "Suppressed patterns", "note": "Notes"}
TEMPLATE = """# Memory

What reviews should keep in mind. Every bundle carries this text; edit it freely.

## Rules

## Suppressed patterns

## Notes
"""


def ensure(path: str) -> str:
    """The text of the memory file, which is made from the template if it is absent."""
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(TEMPLATE)
    with open(path, encoding="utf-8") as f:
        return f.read()


def with_item(text: str, section: str, item: str) -> str:
    """``text`` with ``- item`` at the end of a section, which is added if it is absent."""
    lines = text.rstrip("\n").split("\n")
    heading = re.compile(rf"##\s+{re.escape(section)}\s*$")
    at = next((i for i, line in enumerate(lines) if heading.match(line)), None)
    if at is None:
        return "\n".join([*lines, "", f"## {section}", "", f"- {item}", ""])
    end = next((i for i in range(at + 1, len(lines)) if re.match(r"##\s", lines[i])), len(lines))
    body = lines[at + 1 : end]
    while body and not body[0].strip():
        body.pop(0)
    while body and not body[-1].strip():
        body.pop()
    rest = lines[end:]
    return "\n".join([*lines[: at + 1], "", *body, f"- {item}", *(["", *rest] if rest else []), ""])


def append(path: str, section: str, item: str) -> None:
    text = with_item(ensure(path), section, item)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def items(text: str) -> list[tuple[str, int, str]]:
    """(section, ord, text) of all items."""
    out, section = [], ""
    for line in text.split("\n"):
        if m := re.match(r"##\s+(.*?)\s*$", line):
            section = m[1]
        elif line.startswith("- "):
            out.append((section, sum(1 for s, _, _ in out if s == section), line[2:]))
    return out

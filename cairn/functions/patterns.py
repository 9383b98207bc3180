"""Glob patterns as regular expressions and as filters that reach the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = set("+()$.{}|^")
_GLOB = set("*?[]\\")


def glob_to_regex(pattern: str) -> str:
    """`*` any run, `?` one character, `[...]` and `[^...]` classes, `\\x` the character x. A trailing backslash is an error."""
    out, at, in_class = ["^"], 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            if at + 1 == len(pattern):
                raise ValueError("pattern ends with an escape")
            at += 1
            out.append("\\" + pattern[at] if not pattern[at].isalnum() else pattern[at])
        elif in_class:
            first = pattern[at - 1] == "["
            in_class = c != "]"
            out.append(c if c in "]-" or (c == "^" and first) or c.isalnum() else "\\" + c)
        elif c == "[":
            in_class = True
            out.append(c)
        elif c in "*?":
            out.append(".*" if c == "*" else ".")
        else:
            out.append("\\" + c if c in _SPECIAL else c)
        at += 1
    return "".join(out) + "$"


def glob(column: Column, pattern: str) -> Column:
    """Literal patterns become equality and `literal*` a prefix test, which sources can use for pruning."""
    head = pattern[:-1] if pattern.endswith("*") else pattern
    if not _GLOB & set(head):
        return column.startswith(head) if pattern.endswith("*") and head else F.lit(True) & column.isNotNull() if pattern == "*" else column == head
    return column.rlike(glob_to_regex(pattern))

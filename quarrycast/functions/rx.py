"""Patterns in RE2's dialect for Spark's regular expressions.

java() rewrites what differs: `$` means the end of the text only, `\\b` is an ASCII boundary, and
case-insensitive patterns fold Unicode letters.
"""

from __future__ import annotations

import re

_W = "[0-9A-Za-z_]"
BOUNDARY = f"(?:(?<!{_W})(?={_W})|(?<={_W})(?!{_W}))"


def java(pattern: str, ignore_case: bool = True) -> str:
    """pattern for java.util.regex, `.` stopping at line feeds only."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            two = pattern[i : i + 2]
            out.append(BOUNDARY if two == r"\b" and not in_class else two)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        elif c == "$" and not in_class:
            c = r"\z"
        out.append(c)
        i += 1
    return ("(?iud)" if ignore_case else "(?d)") + "".join(out)


def re2(pattern: str, ignore_case: bool = True) -> str:
    """pattern for DuckDB, quoted as a SQL literal."""
    return "'" + (("(?i)" if ignore_case else "") + pattern).replace("'", "''") + "'"


def check(patterns: list[str]) -> list[str]:
    """The patterns, if all compile; a rule list with a bad pattern fails when it is loaded, not in a task."""
    for p in patterns:
        re.compile(p)
    return patterns

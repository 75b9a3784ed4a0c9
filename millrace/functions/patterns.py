"""First-match regular-expression replacement."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PlanError


def checked(pattern: str) -> str:
    """The pattern for Java: ``$`` is the very end, ``.`` any character; look-around and back-references are refused."""
    out, i, in_class = "", 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            nxt = pattern[i + 1 : i + 2]
            if not nxt:
                raise PlanError("regexp: a pattern ends in a backslash")
            if nxt.isdigit():
                raise PlanError("regexp: back-references are not supported")
            if nxt.isalpha() and nxt not in "dDwWsSntrfv":
                raise PlanError(f"regexp: \\{nxt} is not supported")
            out, i = out + c + nxt, i + 2
            continue
        if in_class:
            in_class = c != "]"
            out += "\\[" if c == "[" else c
        elif c == "[":
            in_class = True
            out += c
            if pattern[i + 1 : i + 2] == "^":
                out, i = out + "^", i + 1
            if pattern[i + 1 : i + 2] == "]":
                out, i = out + "\\]", i + 1
        elif c == "(" and pattern[i + 1 : i + 2] == "?" and pattern[i + 2 : i + 3] != ":":
            raise PlanError("regexp: only plain and (?:...) groups are supported")
        elif c == "$":
            out += r"\z"
        else:
            if c == "+" and out and pattern[i - 1] in "*+?}" and i:
                raise PlanError("regexp: possessive repetition is not supported")
            out += c
        i += 1
    if in_class:
        raise PlanError("regexp: unterminated character class")
    try:
        re.compile(pattern)
    except re.error as e:
        raise PlanError(f"regexp: {e}") from None
    return out


def first_match(c: Column, pattern: str, replacement: str) -> Column:
    """Replaces the first match; ``\\0`` to ``\\9`` are its groups. No match leaves the text."""
    body = checked(pattern)
    groups = re.compile(pattern).groups
    new, i = "", 0
    while i < len(replacement):
        ch = replacement[i]
        if ch == "\\" and replacement[i + 1 : i + 2].isdigit():
            k = int(replacement[i + 1])
            # Group 1 is what stands before the match and group 2 the whole of it.
            new += f"${k + 2}" if k <= groups else ""
            i += 2
            continue
        # An escaped digit is a literal one, and so never read as part of a group's number.
        new += "\\" + ch if ch in "\\$" or ch.isdigit() else ch
        i += 1
    return F.regexp_replace(c, f"(?s)^(.*?)({body})", "$1" + new)

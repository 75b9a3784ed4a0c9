"""Column types of CSV files from a sample of records, where quoting counts."""

from __future__ import annotations

import re

from ..lang import ast as A

SAMPLE = 1024
_INT = re.compile(r"-?(0|[1-9][0-9]*)\Z")
_FLOAT = re.compile(r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\Z")


def records(text: str, delimiter: str, most: int = SAMPLE + 1) -> list[list[tuple[str, bool]]]:
    """The first records of a text: cells with whether they were quoted. Quoted line ends stay inside their cell."""
    out: list[list[tuple[str, bool]]] = []
    row: list[tuple[str, bool]] = []
    cell, was_quoted, i, n = [], False, 0, len(text)
    while i < n and len(out) < most:
        c = text[i]
        if c == '"' and not cell and not was_quoted:
            was_quoted = True
            i += 1
            while i < n:
                if text[i] == '"':
                    if text[i + 1 : i + 2] != '"':
                        break
                    i += 1
                cell.append(text[i])
                i += 1
        elif c == delimiter:
            row.append(("".join(cell), was_quoted))
            cell, was_quoted = [], False
        elif c in "\r\n":
            if c == "\r" and text[i + 1 : i + 2] == "\n":
                i += 1
            row.append(("".join(cell), was_quoted))
            if row != [("", False)]:
                out.append(row)
            row, cell, was_quoted = [], [], False
        else:
            cell.append(c)
        i += 1
    if (cell or row or was_quoted) and len(out) < most:
        out.append([*row, ("".join(cell), was_quoted)])
    return out


def schema(rows: list[list[tuple[str, bool]]]) -> dict[str, A.Type]:
    """Names from the header, trimmed; types from the rest: int within float within text, any quoted cell makes text."""
    if not rows:
        return {}
    names = [c.strip().removeprefix("\ufeff") for c, _ in rows[0]]
    kinds = [A.UNKNOWN] * len(names)
    for row in rows[1:]:
        for i, (c, was_quoted) in enumerate(row[: len(names)]):
            if kinds[i] is A.STRING or c == "" and not was_quoted:
                continue
            if was_quoted:
                kinds[i] = A.STRING
            elif _INT.match(c) and abs(int(c)) < 1 << 63:
                kinds[i] = A.INT if kinds[i] in (A.UNKNOWN, A.INT) else kinds[i]
            elif _FLOAT.match(c):
                kinds[i] = A.FLOAT
            else:
                kinds[i] = A.STRING
    return {n: A.STRING if k is A.UNKNOWN else k for n, k in zip(names, kinds, strict=True)}

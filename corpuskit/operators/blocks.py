"""Where blocks of source code end, and what encloses them: one pass per file.

Definitions of a file are found by column expressions; their ends, sources and
enclosing scopes come from one scan of its lines, so a file with many
definitions costs its lines and definitions, not their product.  Braces,
brackets and indents are read from the lines that ``operators.lexer`` leaves,
so those in strings and comments count for nothing.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskit.operators.lexer import INSIDE

FIELDS = ("end", "source", "above", "class_name", "in_function")
BLOCK_TYPE = "struct<end:array<int>,source:array<string>,above:array<string>,class_name:array<string>,in_function:array<boolean>>"


def first_at_most(values: list, asked: list[tuple[int, float]]) -> list[int | None]:
    """For each ``(start, bound)`` the first place from ``start`` on whose value is at most ``bound``.

    Read backwards, the values lower than all before them form a stack that is
    sorted both ways, so each question is one binary search.
    """
    out: list[int | None] = [None] * len(asked)
    waiting = sorted(range(len(asked)), key=lambda k: -asked[k][0])
    lows, places = [], []  # lowest first; nearer places have higher values
    at = len(values)
    for k in waiting:
        start, bound = asked[k]
        while at > start:
            at -= 1
            while lows and lows[-1] >= values[at]:
                lows.pop()
                places.pop()
            lows.append(values[at])
            places.append(at)
        # Values rise towards the nearest place; the nearest one within the bound is the last.
        found = bisect_left(lows, True, key=lambda v: v > bound)
        if found:
            out[k] = places[found - 1]
    return out


def _ends(lines: list[str], language: str, starts: list[int], kinds: list[str]) -> list[int]:
    """Last line (from 0) of each definition that starts on a line of ``starts``; ``lines`` have no literals."""
    if language == "python":
        indents = [len(x) - len(x.lstrip(" ")) for x in lines]
        # A line inside of brackets or of a string ends nothing, however far left it begins.
        stops, open_ = [], 0
        for n, x in zip(indents, lines, strict=True):
            stops.append(n if x.strip() and not open_ and x[0] != INSIDE else float("inf"))
            open_ = max(0, open_ + sum(map(x.count, "([{")) - sum(map(x.count, ")]}")))
        solid, last = [], -1
        for i, x in enumerate(lines):
            last = i if x.strip() else last
            solid.append(last)
        leave = first_at_most(stops, [(s + 1, indents[s]) for s in starts])
        return [max(s, solid[(len(lines) if e is None else e) - 1]) for s, e in zip(starts, leave, strict=True)]
    depth, opener, level = [], [len(lines)] * (len(lines) + 1), 0
    for x in lines:
        level += x.count("{") - x.count("}")
        depth.append(level)
    for i in range(len(lines) - 1, -1, -1):
        opener[i] = i if "{" in lines[i] else opener[i + 1]
    before = lambda s: depth[s - 1] if s else 0
    asked = [(s + 1 if language == "proto" else opener[s], before(s)) for s in starts]
    found = first_at_most(depth, asked)
    return [s if e is None or (language == "proto" and kind == "function") else e for s, kind, e in zip(starts, kinds, found, strict=True)]


def _above(lines: list[str], start: int, mark: str = "//") -> str:
    """Comment lines right above a line (blank lines skipped), joined by spaces."""
    taken = []
    for i in range(start - 1, -1, -1):
        x = lines[i].strip()
        if x and not x.startswith(mark):
            break
        if x:
            taken.append(x[len(mark):].strip())
    return " ".join(reversed(taken))


def _scopes(language: str, starts: list[int], ends: list[int], kinds: list[str], names: list[str]) -> tuple[list[str | None], list[bool]]:
    """Innermost class around each definition, and if a Python function is around it."""
    owners: list[str | None] = [None] * len(starts)
    inside = [False] * len(starts)
    opened: list[int] = []
    for k in sorted(range(len(starts)), key=lambda k: (starts[k], -ends[k])):
        while opened and ends[opened[-1]] < starts[k]:
            opened.pop()
        around = [j for j in opened if starts[j] < starts[k] and ends[j] >= ends[k]]
        owners[k] = next((names[j] for j in reversed(around) if kinds[j] == "class"), None)
        inside[k] = language == "python" and any(kinds[j] == "function" for j in around)
        if kinds[k] == "class" or (language == "python" and kinds[k] == "function"):
            opened.append(k)
    return owners, inside


def _blocks(text: pd.Series, code: pd.Series, language: pd.Series, starts: pd.Series, kinds: pd.Series, names: pd.Series) -> pd.DataFrame:
    """Ends (from 1), sources, comments above, classes around and nesting of each file's definitions."""
    out = []
    for body, left, lang, first, kind, name in zip(text, code, language, starts, kinds, names, strict=True):
        if first is None or not len(first):
            out.append(([], [], [], [], []))
            continue
        lines, first = body.split("\n"), [int(s) - 1 for s in first]
        ends = _ends(left.split("\n"), lang, first, list(kind))
        owners, inside = _scopes(lang, first, ends, list(kind), list(name))
        out.append((
            [e + 1 for e in ends], ["\n".join(lines[s : e + 1]) for s, e in zip(first, ends, strict=True)],
            [_above(lines, s) if lang == "go" else "" for s in first], owners, inside))
    return pd.DataFrame(out, columns=FIELDS)


def blocks(*columns: Column | str) -> Column:
    """The above for columns text, text without literals, language, and arrays of start lines, kinds and names."""
    return F.pandas_udf(_blocks, BLOCK_TYPE)(*columns)

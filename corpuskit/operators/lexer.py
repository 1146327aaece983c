"""Literals and comments of source code, told apart by an automaton over lines.

What a line does depends on the state it is entered in: plain code, or inside a
comment, string, raw string or template that an earlier line left open.  Its
effect is an entry of a table from (line, state) to (what is left of the line,
state behind it); the effects of the lines of a file are composed one after
another.  Lines that come again in the same state are looked up, so a corpus
costs its distinct lines.  Every character is passed once, whatever the nesting.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a character of a literal, and for the first one of a line that begins inside of one.
FILL, INSIDE = "\x01", "\x02"
#: Effects of lines that a worker keeps; longer lines and deeper states are worked out each time.
KEPT, LONGEST, DEEPEST = 1 << 16, 256, 8

#: A state is what is open, the innermost first: ``(kind, what is around it, how many)``; nothing in plain code.
State = tuple | None
CODE: State = None
_STRING = {q: re.compile(rf"(?:[^{q}\\]|\\.)*") for q in "\"'"}
_LONG = {q * 3: re.compile(rf"(?:[^{q}\\]|\\.|{q}(?!{q}{q}))*") for q in "\"'"}
_TEMPLATE = re.compile(r"(?:[^`$\\]|\\.|\$(?!\{))*")
_PATTERN = re.compile(r"/(?:[^/\\\[]|\\.|\[(?:[^\]\\]|\\.)*\])+/[a-z]*")
#: A slash behind one of these starts a pattern, behind anything else it divides.
_BEFORE_PATTERN = re.compile(r"(?:^|[(,=:\[!&|?{};~+\-*%<>^]|\b(?:return|typeof|case|in|of|do|else|void|delete|throw|new))\s*$")

_LINE, _BLOCK, _TEXT = r"(?P<line>//)", r"(?P<block>/\*)", r"(?P<text>[\"'])"
_C_TEXT = r"(?P<text>\"|(?<![0-9])')"
_CPP_RAW = r"(?P<raw>\b(?:u8|[uUL])?R\"(?P<mark>[^()\\\s]{0,16})\()"
#: What leaves plain code, by language.
OPENERS = {
    "c": re.compile("|".join((_LINE, _BLOCK, _C_TEXT))),
    "cpp": re.compile("|".join((_LINE, _BLOCK, _CPP_RAW, _C_TEXT))),
    "go": re.compile("|".join((_LINE, _BLOCK, r"(?P<tick>`)", _TEXT))),
    "javascript": re.compile("|".join((_LINE, _BLOCK, r"(?P<template>`)", r"(?P<pattern>/)", r"(?P<brace>[{}])", _TEXT))),
    "proto": re.compile("|".join((_LINE, _BLOCK, _TEXT))),
    "python": re.compile("|".join((r"(?P<hash>#)", r"(?P<long>\"\"\"|''')", _TEXT))),
}
OPENERS["typescript"] = OPENERS["javascript"]


def _within(kind: str, state: State) -> State:
    return kind, state, state[2] + 1 if state else 1


def _closed(text: str, at: int, state: State) -> tuple[int, State]:
    """Where the literal or comment on top of ``state`` ends on this line, and the state from there."""
    kind, outer, _ = state
    if kind == "*" or kind == "`" or kind[0] == "R":
        mark = {"*": "*/", "`": "`"}.get(kind) or f'){kind[1:]}"'
        end = text.find(mark, at)
        return (len(text), state) if end < 0 else (end + len(mark), outer)
    if kind in _LONG:
        end = _LONG[kind].match(text, at).end()
        return (end + 3, outer) if text.startswith(kind, end) else (len(text), state)
    if kind == "T":
        end = _TEMPLATE.match(text, at).end()
        if text.startswith("`", end):
            return end + 1, outer
        return (end + 2, _within("{0", state)) if text.startswith("${", end) else (len(text), state)
    end = _STRING[kind].match(text, at).end()
    if text.startswith(kind, end):
        return end + 1, outer
    # Only a backslash carries a string over the end of its line.
    return len(text), state if text.endswith("\\") and end < len(text) else outer


def effect(language: str, text: str, state: State) -> tuple[str, State]:
    """``text``, one line, without its literals and comments, and the state behind it.

    Comments become spaces (in Python, where they have an indent, ``FILL``),
    literals become ``FILL``; the line keeps its length.
    """
    opener, out, at = OPENERS[language], [], 0
    inner = state is not CODE
    while at < len(text):
        nested = state is not CODE and state[0][0] == "{"
        if state and not nested:
            start, kind = at, state[0]
            at, state = _closed(text, at, state)
            out.append((" " if kind == "*" else FILL) * (at - start))
            continue
        found = opener.search(text, at)
        start = found.start() if found else len(text)
        out.append(FILL * (start - at) if nested else text[at:start])
        if not found:
            break
        kind, at = found.lastgroup, found.end()
        if kind == "mark":
            kind = "raw"
        if kind in ("line", "hash"):
            out.append((FILL if kind == "hash" else " ") * (len(text) - start))
            at = len(text)
        elif kind == "brace":
            open_ = int(state[0][1:]) + (1 if found[0] == "{" else -1) if nested else 0
            out.append(FILL if nested else found[0])
            if nested:
                state = state[1] if open_ < 0 else _within(f"{{{open_}", state[1])
        elif kind == "pattern":
            whole = _PATTERN.match(text, start) if _BEFORE_PATTERN.search("".join(out[-8:])[-64:]) else None
            at = whole.end() if whole else at
            out.append(FILL * (at - start) if whole or nested else "/")
        else:
            out.append((" " if kind == "block" else FILL) * (at - start))
            opened = {"block": "*", "tick": "`", "template": "T", "raw": f"R{found['mark'] if kind == 'raw' else ''}"}.get(kind, found[0])
            # A string that begins at the very end of a line ends there.
            state = state if kind == "text" and at == len(text) else _within(opened, state)
    left = "".join(out)
    # Such a line is no statement of its own.
    return (INSIDE + left[1:] if inner and left else left), state


_table = lru_cache(KEPT)(effect)


def without_literals(language: str, text: str) -> str:
    """``text`` with the same lines, in which only code is left; unknown languages are left as they are."""
    if language not in OPENERS:
        return text
    out, state = [], CODE
    for line in text.split("\n"):
        known = len(line) <= LONGEST and (state is CODE or state[2] <= DEEPEST)
        left, state = (_table if known else effect)(language, line, state)
        out.append(left)
    return "\n".join(out)


def code_only(text: Column | str, language: Column | str) -> Column:
    """The above as a column; NULL text stays NULL."""

    def of(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else without_literals(k, t) for t, k in zip(texts, languages, strict=True)], dtype=object)

    return F.pandas_udf(of, "string")(text, language)

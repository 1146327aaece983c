"""Benchmark decontamination by pigeonhole edit matching.

An item with a budget of k edits is split into k + 1 pieces; a passage within
the budget keeps at least one of them unchanged.  One automaton finds the
pieces of all items in a text; around each hit, Myers' bit-parallel distance
says if the whole item is there.

The benchmark is a stated set of queries: it is cut into blocks of a fixed
size, and every block is held against every text in place, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corpuskit.llm.sharding import running
from corpuskit.session import materialize

#: Share of an item's characters that may be edited.  Items below so many characters have no
#: budget: they are one piece, which counts where it stands between words.
RATE = 0.08
LEAST = 24
#: Characters of items in one block.
BLOCK = 1 << 21

_SPACE = re.compile(r"\s+")


def normal(text: str) -> tuple[str, list[tuple[int, int]]]:
    """Lower case, one space for each run of white space, none at the ends.

    Also the places where a shift begins: (offset there, offset in ``text``).
    """
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    parts, shifts, at = [], [], 0
    for m in re.finditer(r"\S+", lower):
        if parts:
            parts.append(" ")
            at += 1
        shifts.append((at, m.start()))
        parts.append(m.group())
        at += len(m.group())
    return "".join(parts), shifts


def plain(text: str) -> str:
    """As the first part of ``normal``, without the places."""
    lower = text.lower()
    return _SPACE.sub(" ", lower).strip() if len(lower) == len(text) else normal(text)[0]


def masks(pattern: str) -> dict[str, int]:
    """For each character, the bits of its places in ``pattern``."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_end(pattern: str, peq: dict[str, int], text: str) -> tuple[int, int]:
    """Least distance of ``pattern`` to a part of ``text``, and where that part first ends."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for i, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(across | plus))
        down = plus & across
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best:
            best, end = score, i
    return best, end


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple], rate: float, least: int):
        self.items: list[tuple] = []
        self.least = least
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            pattern = plain(text or "")
            if not pattern:
                continue
            k, which = int(len(pattern) * rate) if len(pattern) >= least else 0, len(self.items)
            self.items.append((item_id, pattern, k, masks(pattern), pattern[::-1], masks(pattern[::-1])))
            cuts = [i * len(pattern) // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(pattern[a:b], []).append((which, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple]:
        """``(item_id, distance, start, end)`` of each item in ``text``: its first best place."""
        if not self.items:
            return []
        body = plain(text)
        wanted: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(body):
            for which, at in where:
                wanted.setdefault(which, []).append(end + 1 - size - at)
        out, shifts = [], None
        for which, starts in wanted.items():
            item_id, pattern, k, peq, back, back_peq = self.items[which]
            best = None
            for low, high in self._windows(starts, k):
                start = max(0, low - k)
                part = body[start : high + len(pattern) + k]
                if len(pattern) < self.least and not self._apart(body, start, start + len(pattern)):
                    continue
                distance, end = best_end(pattern, peq, part)
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, start, end, part)
            if best is None:
                continue
            distance, start, end, part = best
            length = best_end(back, back_peq, part[max(0, end - len(pattern) - k) : end][::-1])[1]
            shifts = shifts or normal(text)[1]
            out.append((item_id, distance, _origin(shifts, start + end - length), _origin(shifts, start + end - 1) + 1))
        return out

    @staticmethod
    def _apart(body: str, start: int, end: int) -> bool:
        """If no word goes on over either end."""
        return not (start > 0 and body[start - 1].isalnum() and body[start].isalnum() or end < len(body) and body[end - 1].isalnum() and body[end].isalnum())

    @staticmethod
    def _windows(starts: list[int], k: int) -> Iterator[tuple[int, int]]:
        """Ranges of starts; those within the budget of each other share one."""
        low = high = None
        for s in sorted(set(starts)):
            if low is not None and s <= high + k:
                high = s
                continue
            if low is not None:
                yield low, high
            low = high = s
        yield low, high


def _origin(shifts: list[tuple[int, int]], at: int) -> int:
    low, high = 0, len(shifts)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if shifts[mid][0] <= at else (low, mid)
    return shifts[low][1] + at - shifts[low][0]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size; one block at a time is on the driver."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).distinct()
    placed = running(items, [], F.length("text").cast("long"), ["id", "text"], items.count(), "at").withColumn("block", F.floor(F.col("at") / BLOCK))
    placed = materialize(placed.select("id", "text", "block"), "benchmark-blocks")
    for (block,) in placed.select("block").distinct().orderBy("block").collect():
        yield [tuple(r) for r in placed.where(F.col("block") == block).select("id", "text").orderBy("id", "text").collect()]


def leaked(items: list[tuple], text: Column, rate: float = RATE, least: int = LEAST) -> Column:
    """If a text holds one of a block of items."""

    @pandas_udf("boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(items, rate, least)
        for texts in batches:
            yield pd.Series([bool(t) and bool(matcher.find(t)) for t in texts], dtype="bool")

    return of(text)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """A row per document and benchmark item that is in it within the budget.

    Returns ``id_col``, ``item_col``, ``distance`` (edits), ``start`` and
    ``end`` (code points of the passage in the text as it is).  Texts are
    compared in lower case with white space folded; the budget is ``rate`` of
    the item's characters.  Of several places the best counts, then the first.
    Items below ``least`` characters must be there unchanged and between words.
    NULL, empty and blank items and texts match nothing.
    Equal items with different ids are each reported, repeated rows of either
    table too (items once).  Other columns are ignored; an empty table on
    either side gives an empty table.
    """
    kinds = docs.select(id_col).dtypes[0][1], benchmark.select(item_col).dtypes[0][1]
    schema = f"id {kinds[0]}, item {kinds[1]}, distance int, start long, end long"
    rows = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def found(items: list[tuple]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = Matcher(items, rate, least)
            for batch in batches:
                out = [(rid, *m) for rid, text in zip(batch["id"].astype(object), batch["text"], strict=True) for m in matcher.find(text)]
                yield pd.DataFrame(out, columns=["id", "item", "distance", "start", "end"])

        return rows.mapInPandas(run, schema)

    out = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark, item_col, "text"):
        out = out.unionByName(found(items))
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns as they were.

    A row with a NULL or empty text holds none and stays; so does every repeated
    row.  An empty benchmark takes nothing out.
    """
    for items in _blocks(benchmark, "item_id", "text"):
        docs = docs.where(~leaked(items, F.col("text"), rate, least))
    return docs

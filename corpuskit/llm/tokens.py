"""Token counts by rank-synchronous merging over ragged numpy arrays.

Pre-tokens of many texts lie one after another in flat arrays.  Each step finds
the lowest-ranked pair of every sequence and merges all its places at once;
sequences without a pair left retire with the number of symbols that survive.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corpuskit.llm.vocabulary import Vocabulary

LIMIT = 512
#: Characters of text whose pre-tokens are held at once, and counts kept by a worker.
HELD = 1 << 21
KEPT = 1 << 19


def merge(vocabulary: Vocabulary, sequences: list[bytes], symbols_too: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Symbols left of all byte sequences, one after another, and how many of each.

    No sequence may be empty.  Without ``symbols_too`` only the numbers count.
    """
    left = np.zeros(len(sequences), np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
    symbols = vocabulary.of_byte[np.frombuffer(b"".join(sequences), np.uint8)]
    which = np.arange(len(sequences))
    never = vocabulary.n_merges
    while len(which):
        ends = np.cumsum(sizes) - 1
        at = vocabulary.find_pairs(symbols * vocabulary.size + np.append(symbols[1:], 0))
        rank = vocabulary.rank[at]
        rank[ends] = never
        best = np.minimum.reduceat(rank, ends - sizes + 1)
        going = best < never
        left[which[~going]] = sizes[~going]
        owner = np.repeat(np.arange(len(which)), sizes)
        stays = going[owner]
        if symbols_too:
            done.append((which[owner[~stays]], symbols[~stays]))
        chosen = np.flatnonzero((rank == best[owner]) & (rank < never))
        # Overlapping places ("aaa") are taken from the left, every other one.
        run = np.flatnonzero(np.diff(chosen, prepend=-2) != 1)
        lengths = np.diff(np.append(run, len(chosen)))
        chosen = chosen[(chosen - np.repeat(chosen[run], lengths)) % 2 == 0]
        symbols[chosen] = vocabulary.merged[at[chosen]]
        stays[chosen + 1] = False
        sizes = np.bincount(owner[stays], minlength=len(which))[going]
        symbols, which = symbols[stays], which[going]
    if not symbols_too or not done:
        return np.zeros(0, np.int64), left
    owners = np.concatenate([d[0] for d in done])
    return np.concatenate([d[1] for d in done])[np.argsort(owners, kind="stable")], left


class Counter:
    """Counts tokens of texts, remembering the counts of recent pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}

    def _count(self, texts: list[str]) -> list[int]:
        parts = [list(self.vocabulary.pre_tokens(t)) for t in texts]
        words = set().union(*(p for doc in parts for p in doc if isinstance(p, list)))
        new = list(words.difference(self.known))
        if new and len(self.known) > KEPT:
            self.known.clear()
            new = list(words)
        if new:
            self.known.update(zip(new, merge(self.vocabulary, [w.encode() for w in new], False)[1].tolist(), strict=True))
        get = self.known.__getitem__
        return [sum(sum(map(get, p)) if isinstance(p, list) else 1 for p in doc) for doc in parts]

    def count(self, texts: list[str]) -> list[int]:
        out, start, size = [], 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size > HELD:
                out += self._count(texts[start : i + 1])
                start, size = i + 1, 0
        return out + self._count(texts[start:])


def token_count(path: str, text: Column) -> Column:
    """Tokens that the vocabulary file at ``path`` gives for each whole text.

    No begin, end or added tokens; special strings inside a text are one token,
    as the library takes them by default.  NULL counts as empty: no tokens.
    """
    content = Path(path).read_bytes()

    @pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(Vocabulary.load(content))
        for texts in batches:
            yield pd.Series(counter.count(texts.fillna("").tolist()), dtype="int64")

    return of(text)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    All input columns stay; one that has an added name is replaced.  NULL and
    empty texts have no bytes and no tokens.  Rows are counted one by one, so
    repeated rows and empty tables need no care.
    """
    return docs.withColumns({
        "n_bytes": F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long"),
        "n_tokens": token_count(path, F.col(text_col)),
    }).withColumn("over_limit", F.col("n_tokens") > limit)

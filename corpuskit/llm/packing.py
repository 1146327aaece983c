"""Vector bin packing of tokenised examples into training sequences.

A piece asks for tokens, one segment and some loss-bearing tokens; a sequence
has limits on all three.  Every task packs the rows of its input split: a piece
goes to the open sequence whose remaining room points most the way of its
demand (largest dot product of the two, each in shares of the limits).  Where a
piece fits nowhere whole, it is cut.  No rows move between tasks; a task leaves
at most one sequence with room for more tokens, unless another limit binds.
"""

from __future__ import annotations

import itertools
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.tokens import merge
from corpuskit.llm.vocabulary import Vocabulary

#: Word-to-ids entries that a worker keeps.
KEPT = 1 << 19
#: Characters of text whose ids are held at once.
HELD = 1 << 20


@dataclass(frozen=True)
class Limits:
    """Of a sequence; ``open`` is how many sequences take pieces at a time."""

    tokens: int = 2048
    segments: int = 512
    loss_tokens: int = 2048
    open: int = 48


class Encoder:
    """Token ids of texts, equal to those that the vocabulary's library gives."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}

    def _learn(self, words: list[str]) -> None:
        symbols, sizes = merge(self.vocabulary, [w.encode() for w in words])
        flat, ends = symbols.astype("<u4").tobytes(), (np.cumsum(sizes) * 4).tolist()
        self.known.update(zip(words, map(flat.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the pre-tokens of all texts are merged together."""
        parts = [list(self.vocabulary.pre_tokens(t)) for t in texts]
        words = set().union(*(p for doc in parts for p in doc if isinstance(p, list)))
        new = list(words.difference(self.known))
        if new and len(self.known) > KEPT:
            self.known.clear()
            new = list(words)
        if new:
            self._learn(new)
        get = self.known.__getitem__
        join = lambda doc: b"".join(b"".join(map(get, p)) if isinstance(p, list) else p.to_bytes(4, "little") for p in doc)
        return [np.frombuffer(join(doc), "<u4") for doc in parts]


class Packer:
    """Open sequences of one task; ``place`` and ``finish`` yield finished ones.

    A piece is ``(row, start, ids, loss)``, ``loss`` its number of loss-bearing
    tokens, which are its last ones.  A finished sequence is a list of pieces.
    """

    def __init__(self, limits: Limits):
        self.limits = limits
        self.most = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.float64)
        self.room = np.zeros((0, 3))
        self.held: list[list[tuple]] = []

    def _open(self) -> int:
        self.room = np.vstack([self.room, self.most])
        self.held.append([])
        return len(self.held) - 1

    def _put(self, at: int, piece: tuple) -> list[list[tuple]]:
        self.held[at].append(piece)
        self.room[at] -= (len(piece[2]), 1, piece[3])
        return [self._close(at)] if self.room[at, :2].min() < 1 else []

    def _close(self, at: int) -> list[tuple]:
        self.room = np.delete(self.room, at, axis=0)
        return self.held.pop(at)

    def _cut(self, piece: tuple, at: int) -> tuple[tuple, tuple] | None:
        """The longest head of ``piece`` that sequence ``at`` has room for, and the rest."""
        row, start, ids, loss = piece
        tokens, segments, losses = self.room[at]
        # The head's loss-bearing tokens are those behind the ones without loss.
        head = int(min(tokens, len(ids) - loss + losses, len(ids)))
        if head < 1 or segments < 1:
            return None
        first = max(0, head - (len(ids) - loss))
        return (row, start, ids[:head], first), (row, start + head, ids[head:], loss - first)

    def place(self, piece: tuple) -> Iterator[list[tuple]]:
        while True:
            need = np.array([len(piece[2]), 1, piece[3]], np.float64)
            fits = (self.room >= need).all(axis=1)
            if fits.any():
                score = ((self.room / self.most) @ (need / self.most)) * fits
                yield from self._put(int(score.argmax()), piece)
                return
            if len(self.held) < self.limits.open:
                at = self._open()
                if (self.room[at] >= need).all():
                    yield from self._put(at, piece)
                    return
            else:  # fill the fullest one that can take any of it
                order = np.argsort(self.room[:, 0], kind="stable")
                at = next((int(k) for k in order if self._cut(piece, int(k))), None)
                if at is None:
                    yield self._close(int(order[0]))
                    continue
            head, piece = self._cut(piece, at)
            yield from self._put(at, head)

    def finish(self) -> Iterator[list[tuple]]:
        """Closes what is open: the pieces of the emptiest ones fill up the others."""
        while len(self.held) > 1:
            at = int(np.argmax(self.room[:, 0]))
            left = self._close(at)
            while left and self.held:
                piece = left.pop()
                order = np.argsort(self.room[:, 0], kind="stable")
                to = next((int(k) for k in order if self._cut(piece, int(k))), None)
                if to is None:
                    left.append(piece)
                    break
                head, rest = self._cut(piece, to)
                if len(rest[2]):
                    left.append(rest)
                yield from self._put(to, head)
            if left:
                yield left
        yield from (self._close(0) for _ in range(len(self.held)))


def pack(docs: DataFrame, path: str, end_id: int, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", context_col: str | None = None) -> DataFrame:
    """Pieces of ``docs`` in sequences: spans, ids and places.

    A row is the ids of its context (if ``context_col`` is given), of its text
    and ``end_id``; the text's ids and the end bear loss.  Returns per piece:
    ``id_col``, ``start`` (ids of the row before it), ``length``, ``ids``
    (binary, little-endian unsigned 32-bit), ``loss_tokens``, ``doc_tokens``,
    ``sequence_id`` and ``offset`` (ids before it in its sequence).

    NULL and empty texts are one piece of the end alone; a NULL id stays NULL.
    Repeated rows are packed like any other.  Other columns are ignored, an
    empty table gives no pieces.  Ids of sequences are unique, not gapless: the
    task's number in the upper bits.  A task that is run again packs the same
    way, as its rows come from the input in the same order.
    """
    content = Path(path).read_bytes()
    columns = [F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    columns.append((F.coalesce(F.col(context_col), F.lit("")) if context_col else F.lit("")).alias("context"))
    fields = ["id", "start", "length", "ids", "loss_tokens", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, packer = Encoder(Vocabulary.load(content)), Packer(limits)
        number = itertools.count(TaskContext.get().partitionId() << 32)
        out: list[tuple] = []
        end = np.array([end_id], "<u4")

        def encoded(encoder: Encoder, batch: pd.DataFrame) -> Iterator[tuple]:
            rows = deque(zip(batch["id"].astype(object), batch["context"], batch["text"], strict=True))
            while rows:
                some = [rows.popleft()]
                size = len(some[0][2])
                while rows and size + len(rows[0][2]) <= HELD:
                    some.append(rows.popleft())
                    size += len(some[-1][2])
                ids = encoder.ids([x for row in some for x in row[1:]])
                yield from zip((row[0] for row in some), ids[::2], ids[1::2], strict=True)

        def done(sequence: list[tuple]) -> None:
            which, offset = next(number), 0
            for (rid, total), start, ids, loss in sequence:
                out.append((rid, start, len(ids), ids.tobytes(), loss, total, which, offset))
                offset += len(ids)

        def flush() -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=fields)
            out.clear()
            return frame

        for batch in batches:
            for rid, ahead, body in encoded(encoder, batch):
                ids = np.concatenate([ahead, body, end])
                for start in range(0, len(ids), limits.tokens):
                    part = ids[start : start + limits.tokens]
                    piece = ((None if pd.isna(rid) else rid, len(ids)), start, part, min(len(part), max(0, start + len(part) - len(ahead))))
                    for sequence in packer.place(piece):
                        done(sequence)
                if len(out) >= 2048:
                    yield flush()
        for sequence in packer.finish():
            done(sequence)
        yield flush()

    kind = docs.select(id_col).dtypes[0][1]
    schema = f"id {kind}, start long, length long, ids binary, loss_tokens long, doc_tokens long, sequence_id long, offset long"
    return docs.select(*columns).mapInPandas(run, schema).withColumnRenamed("id", id_col)

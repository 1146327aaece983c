"""Cross-tokenizer alignment with a fast path for ids of the same bytes.

A text is encoded by a byte-level vocabulary (A) and a piece model (B).  Both
cut the same bytes, so the places where both end a token cut a text into
groups, and every interval between two token ends is one link, a pair of an A
token and a B token that overlap.

For every A id the B id of the same bytes is worked out ahead.  Links of that
kind, which exact one-to-one groups consist of, are counted in one vector of the
vocabulary's length per task.  Only the other links of irregular groups go
through a shuffle as pairs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from sentencepiece import SentencePieceProcessor

from corpuskit.llm.packing import Encoder
from corpuskit.llm.vocabulary import Vocabulary, _byte_symbols
from corpuskit.session import materialize

#: Characters of text that are aligned at once, and of a part that the piece model takes at once.
HELD, PART = 1 << 19, 1 << 20
#: Pre-tokens above so many bytes are left to the library, whose merging is not slowed by length.
LONG = 1 << 11
#: The most frequent pairs, whose counts every task holds (3 MB); all others are joined.
FREQUENT = 1 << 17
_GAP = re.compile(r"(?<=\S)(?= )")
_HELD: dict[tuple[int, int], Aligner] = {}


class PlainVocabulary(Vocabulary):
    """A vocabulary for which special strings inside a text are plain text."""

    def __init__(self, content: bytes):
        super().__init__(content)
        self._cut = None
        self.library.encode_special_tokens = True


class PlainEncoder(Encoder):
    def _learn(self, words: list[str]) -> None:
        short = [w for w in words if len(w) <= LONG]
        if short:
            super()._learn(short)
        for w in words:
            if len(w) > LONG:
                self.known[w] = np.array(self.vocabulary.library.encode(w, add_special_tokens=False).ids, "<u4").tobytes()


def bytes_of_a(content: bytes) -> list[bytes]:
    """The bytes of every A id."""
    library = Vocabulary.load(content).library
    byte = {s: bytes([b]) for b, s in enumerate(_byte_symbols())}
    out = [b""] * library.get_vocab_size()
    for token, i in library.get_vocab(with_added_tokens=False).items():
        out[i] = b"".join(map(byte.__getitem__, token)) if all(c in byte for c in token) else token.encode()
    return out


def bytes_of_b(model: SentencePieceProcessor) -> list[bytes]:
    """The bytes of every B id; none for control and unknown pieces."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(piece[3:-1], 16)]))
        else:
            out.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace("▁", " ").encode())
    return out


class Aligner:
    """Both vocabularies, the identity map and the alignment of batches of texts."""

    def __init__(self, a_content: bytes, b_content: bytes):
        self.encoder = PlainEncoder(PlainVocabulary(a_content))
        self.model = SentencePieceProcessor(model_proto=b_content)
        self.a_bytes, self.b_bytes = bytes_of_a(a_content), bytes_of_b(self.model)
        self.n_a, self.n_b = len(self.a_bytes), len(self.b_bytes)
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        # Byte pieces first, so that an ordinary piece of the same bytes is taken.
        order = sorted(range(self.n_b), key=lambda i: not self.model.is_byte(i))
        of_bytes = {self.b_bytes[i]: i for i in order if self.b_bytes[i]}
        self.same = np.array([of_bytes.get(x, -1) for x in self.a_bytes])
        ended = lambda n, last: [f"{i}{end}".encode() for i in range(n) for end in (",", last)]
        self.written = ended(self.n_a, "|") + ended(self.n_b, ";")

    @staticmethod
    def load(a_content: bytes, b_content: bytes) -> Aligner:
        """One per Python worker."""
        key = hash(a_content), hash(b_content)
        if key not in _HELD:
            _HELD[key] = Aligner(a_content, b_content)
        return _HELD[key]

    def _pieces(self, text: str) -> np.ndarray:
        if len(text) <= PART:
            return np.array(self.model.encode(text), np.int64)
        parts, start = [], 0
        while start < len(text):
            cut = _GAP.search(text, start + PART)
            end = cut.start() if cut else len(text)
            # No piece goes over a space behind other text; the model puts the space itself.
            parts.append(self.model.encode(text[start + (start > 0) : end]))
            start = end
        return np.concatenate([np.array(p, np.int64) for p in parts])

    def _encoded(self, texts: list[str]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """Texts that both cut without loss, and their ids."""
        there = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in there]
        kept, a_ids, b_ids = [], [], []
        for i, text, a in zip(there, spaced, self.encoder.ids(spaced), strict=True):
            b, want = self._pieces(text[1:]), text.encode()
            # Byte by byte A loses nothing, as its symbols stand for bytes; B has characters it takes for others.
            if int(self.a_size[a].sum()) == len(want) and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == want:
                kept.append(i)
                a_ids.append(a.astype(np.int64))
                b_ids.append(b)
        return kept, a_ids, b_ids

    def align(self, texts: list[str]) -> list[tuple]:
        """Per text ``(n_a, n_b, n_groups, n_links, groups_sha256, own, own_n, pair, pair_n)``.

        ``own`` are the distinct A ids linked with the B id of their bytes,
        ``pair`` the other distinct linked pairs as ``a * n_b + b``, each with
        how many links they have.
        """
        nothing = np.zeros(0, np.int64)
        out = [(0, 0, 0, 0, "", nothing, nothing, nothing, nothing)] * len(texts)
        kept, a_ids, b_ids = self._encoded(texts)
        if not kept:
            return out
        a, b = np.concatenate(a_ids), np.concatenate(b_ids)
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_last, b_last = np.cumsum([len(x) for x in a_ids]), np.cumsum([len(x) for x in b_ids])
        doc_end = a_end[a_last - 1]
        # For every byte: 1 if an A token ends behind it, 2 if a B token does.
        marks = np.zeros(int(doc_end[-1]) + 1, np.uint8)
        marks[a_end] |= 1
        marks[b_end] |= 2
        ends = np.flatnonzero(marks)
        marks = marks[ends]
        in_a, in_b, in_both = (marks & 1) > 0, (marks & 2) > 0, marks == 3
        before = lambda m: np.cumsum(m) - m
        link_a, link_b, group = a[before(in_a)], b[before(in_b)], before(in_both)
        last = np.searchsorted(ends, doc_end, "right")
        links, groups = np.diff(last, prepend=0), np.diff(np.cumsum(in_both)[last - 1], prepend=0)
        doc = np.repeat(np.arange(len(kept)), links)
        own = self.same[link_a] == link_b
        width = self.n_a * self.n_b
        owns, own_n = _distinct(doc[own] * width + link_a[own])
        pairs, pair_n = _distinct(doc[~own] * width + link_a[~own] * self.n_b + link_b[~own])
        starts = np.arange(len(kept) + 1) * width
        own_at, pair_at = np.searchsorted(owns, starts), np.searchsorted(pairs, starts)
        written = self._written(a, b, group[in_a], group[in_b], in_both[in_a], in_both[in_b])
        for k, i in enumerate(kept):
            o, p = slice(own_at[k], own_at[k + 1]), slice(pair_at[k], pair_at[k + 1])
            n_a, n_b = len(a_ids[k]), len(b_ids[k])
            start = int(a_last[k] + b_last[k]) - n_a - n_b
            said = b"".join(map(self.written.__getitem__, written[start : start + n_a + n_b].tolist()))[:-1]
            out[i] = (n_a, n_b, int(groups[k]), int(links[k]), hashlib.sha256(said).hexdigest(),
                      owns[o] % width, own_n[o], pairs[p] % width, pair_n[p])
        return out

    def _written(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> np.ndarray:
        """Indexes into ``written`` of all tokens, the A tokens of a group ahead of its B tokens."""
        a_upto, b_upto = np.cumsum(np.bincount(a_group)), np.cumsum(np.bincount(b_group))
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.append(0, b_upto)[a_group]] = a * 2 + a_last
        out[np.arange(len(b)) + a_upto[b_group]] = (self.n_a + b) * 2 + b_last
        return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each comes."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.diff(np.append(first, len(keys)))


_COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "own", "own_n", "pair", "pair_n"]
_SCHEMA = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, own array<int>, own_n array<int>, pair array<long>, pair_n array<int>"


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > HELD:
            yield texts[start : i + 1]
            start, size = i + 1, 0
    yield texts[start:]


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row``, ``id`` and what ``Aligner.align`` gives of every text of ``docs``."""
    a_content, b_content = Path(a_path).read_bytes(), Path(b_path).read_bytes()

    @pandas_udf(_SCHEMA)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        aligner = Aligner.load(a_content, b_content)
        for texts in batches:
            found = [r for block in _blocks(texts.fillna("").tolist()) for r in aligner.align(block)]
            yield pd.DataFrame(found, columns=_COLUMNS)

    cut = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), of(F.col(text_col)).alias("s"))
    return cut.select("row", "id", "s.*")


def _own_counts(rows: DataFrame, n_a: int) -> np.ndarray:
    """Documents that link each A id with the B id of its bytes: a vector per task, then their sum."""

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(n_a, np.int64)
        for batch in batches:
            if len(batch):
                seen += np.bincount(np.concatenate(batch["own"].tolist()).astype(np.int64), minlength=n_a)
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"a": at, "n": seen[at]})

    counts = np.zeros(n_a, np.int64)
    for a, n in rows.select("own").mapInPandas(vectors, "a long, n long").groupBy("a").agg(F.sum("n")).collect():
        counts[a] = n
    return counts


def tokenizer_alignment(docs: DataFrame, a_path: str, b_path: str, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Alignment figures of every document between the vocabularies at ``a_path`` and ``b_path``.

    A reads a space and the text, B the text, special strings being plain text.
    Returns ``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``
    (links whose pair no other pair of the same A id exceeds in documents that
    hold it), ``count_sum`` (documents that hold the pair, summed over links)
    and ``groups_sha256``.

    NULL and empty texts, and those that either tokenizer does not give back
    byte by byte, have no tokens: zeros and an empty ``groups_sha256``.
    Repeated rows are documents of their own, NULL ids stay, other columns are
    ignored, an empty table gives an empty table.  Counts of pairs are of all
    documents; the number of distinct pairs sets the size of the shuffle, and
    ``frequent`` only how many of them are kept out of the last join.
    """
    spark = docs.sparkSession
    n_a, n_b = Vocabulary.load(Path(a_path).read_bytes()).library.get_vocab_size(), SentencePieceProcessor(model_file=b_path).get_piece_size()
    rows = materialize(align_documents(docs, a_path, b_path, id_col, text_col), "alignments")
    own = _own_counts(rows, n_a)
    pairs = materialize(rows.select(F.explode("pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "alignment-pairs")
    best = own.copy()
    for a, n in pairs.groupBy(F.floor(F.col("pair") / n_b).alias("a")).agg(F.max("n")).collect():
        best[a] = max(best[a], n)
    top = pairs.orderBy(F.desc("n"), "pair").limit(frequent).toPandas().sort_values("pair")
    held = spark.sparkContext.broadcast((own, best, top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64)))

    @pandas_udf("n_best long, count_sum long, rest array<long>, rest_n array<int>")
    def score(own: pd.Series, own_n: pd.Series, pair: pd.Series, pair_n: pd.Series) -> pd.DataFrame:
        of_own, best, known, count = held.value
        out = []
        for ids, times, codes, links in zip(own, own_n, pair, pair_n, strict=True):
            n = of_own[ids]
            n_best, total = int(times[n == best[ids]].sum()), int((n * times).sum())
            at = np.minimum(np.searchsorted(known, codes), max(0, len(known) - 1))
            hit = known[at] == codes if len(known) else np.zeros(len(codes), bool)
            n = count[at[hit]]
            n_best += int(links[hit][n == best[codes[hit] // n_b]].sum())
            out.append((n_best, total + int((n * links[hit]).sum()), codes[~hit], links[~hit]))
        return pd.DataFrame(out, columns=["n_best", "count_sum", "rest", "rest_n"])

    keep = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    scored = materialize(rows.select(*keep, score("own", "own_n", "pair", "pair_n").alias("s")).select(*keep, "s.*"), "alignment-scores")
    # At most as many rows as the vocabulary has ids.
    highest = spark.createDataFrame(pd.DataFrame({"a": np.arange(n_a), "best": best}))
    judged = pairs.withColumn("a", F.floor(F.col("pair") / n_b)).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("best")).alias("is_best"))
    rest = scored.select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.rest_n").alias("links"))
    sums = rest.join(judged, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("is_best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum"))
    total = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).cast("long").alias(c)
    return scored.join(sums, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", total("n_best", "more_best"), total("count_sum", "more_sum"), "groups_sha256")

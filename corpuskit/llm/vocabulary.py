"""A byte-level BPE vocabulary file and the pre-tokens of a text.

The file's bytes travel to the tasks (a vocabulary file is a few MB whatever
the corpus), so executors need no copy of it on their disks.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import regex
from tokenizers import Tokenizer

# The pre-token pattern of byte-level BPE vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

BLOCK = 1 << 19
_LOADED: dict[int, Vocabulary] = {}


# The same for texts of characters whose classes mean the same to both modules; the standard one is faster.
_SIMPLE = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall


def _kinds() -> np.ndarray:
    """For every code point: 0 simple, 1 a number or space of its own kind, 2 without a category."""

    def kind(c: str) -> int:
        category = unicodedata.category(c)
        if category == "Cn":
            return 2
        return int(c.isalnum() and category[0] != "L" and category != "Nd" or "\x1c" <= c <= "\x1f")

    return np.array([kind(chr(c)) for c in range(sys.maxunicode + 1)], np.uint8)


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """Vocabulary, merge ranks and special strings of one file."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level BPE vocabulary without normalizer is needed")
        self.library = Tokenizer.from_str(content.decode())
        vocab = model["vocab"]
        self.size = len(vocab)
        self.of_byte = np.array([vocab[s] for s in _byte_symbols()], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self._hash_merges(np.array([(vocab[a] * self.size + vocab[b], vocab[a + b]) for a, b in pairs], dtype=np.int64).reshape(-1, 2))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self._cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self._find = regex.compile(PRE_TOKEN).findall
        self._space = re.compile(r"(?<=\S)\s")
        self._kinds = _kinds()

    def _hash_merges(self, merges: np.ndarray) -> None:
        """An open-addressed table of pairs; at most one slot in four is taken."""
        self.n_merges = len(merges)
        bits = max(8, int(self.n_merges * 4).bit_length())
        self._shift, self._last = np.uint64(64 - bits), (1 << bits) - 1
        self._pair = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, self.n_merges, np.int64)
        self.merged = np.zeros(1 << bits, np.int64)
        for rank, (slot, (pair, merged)) in enumerate(zip(self._slots(merges[:, 0]).tolist(), merges.tolist(), strict=True)):
            while self._pair[slot] >= 0:
                slot = (slot + 1) & self._last
            self._pair[slot], self.rank[slot], self.merged[slot] = pair, rank, merged

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def find_pairs(self, pairs: np.ndarray) -> np.ndarray:
        """The slot of each pair in ``rank`` and ``merged``; an empty slot (no rank) for none."""
        slots = self._slots(pairs)
        there = self._pair[slots]
        lost = np.flatnonzero((there != pairs) & (there >= 0))
        while len(lost):
            slots[lost] = (slots[lost] + 1) & self._last
            there = self._pair[slots[lost]]
            lost = lost[(there != pairs[lost]) & (there >= 0)]
        return slots

    @staticmethod
    def load(content: bytes) -> Vocabulary:
        """One per Python worker."""
        key = hash(content)
        if key not in _LOADED:
            _LOADED[key] = Vocabulary(content)
        return _LOADED[key]

    def _blocks(self, text: str) -> Iterator[str]:
        """Cuts in front of white space that follows other text; a pre-token always ends there."""
        start = 0
        while len(text) - start > BLOCK:
            m = self._space.search(text, start + BLOCK)
            if not m:
                break
            yield text[start : m.start()]
            start = m.start()
        yield text[start:]

    def pre_tokens(self, text: str) -> Iterator[list[str] | int]:
        """Lists of pre-tokens, and the id of each special string between them."""
        for i, part in enumerate(self._cut.split(text) if self._cut else [text]):
            if i % 2:
                yield self.special[part]
            else:
                for block in self._blocks(part):
                    kind = self._kinds[np.frombuffer(block.encode("utf-32-le"), np.uint32)].max(initial=0)
                    if kind == 0:
                        yield _SIMPLE(block)
                    elif kind == 1:
                        yield self._find(block)
                    else:  # the libraries know different editions of Unicode
                        yield [block[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(block)]

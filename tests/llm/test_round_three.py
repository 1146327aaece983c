"""Mixing, the prefix trie and alignment against brute force, and their edge cases."""

import collections
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from corpuskit.llm import alignment, mixing, trie
from corpuskit.llm.queries import queries
from tests.conftest import SF

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASH = ("size", "n", "x", "row", "id", "none", "rate", "copies", "target", "depth", "conv", "up", "pair", "own", "at", "range", "s")


def clashing(df):
    return df.withColumns({c: F.lit(7) for c in CLASH if c not in df.columns})


# --- mixing


def targets(sizes):
    """{source: words} by sharing out what the capped ones cannot take until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, full = {s: 0.0 for s in sizes}, {s for s, n in sizes.items() if not n}
    rest = float(sum(sizes.values()))
    while rest > 1e-9 and len(full) < len(sizes):
        share = rest / sum(weight[s] for s in sizes if s not in full)
        for s in sizes:
            if s not in full:
                out[s] += share * weight[s]
        rest = 0.0
        for s in sizes:
            if s not in full and out[s] >= 3 * sizes[s]:
                rest += out[s] - 3 * sizes[s]
                out[s] = 3.0 * sizes[s]
                full.add(s)
    return out


def holds(rows, source_of):
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        sizes[source_of[r.doc_id]] += r.size
        taken[source_of[r.doc_id]] += r.taken
    want = targets({s: sizes[s] for s in set(source_of.values())})
    by = collections.defaultdict(list)
    for r in rows:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) <= 1e-6 * max(1, want[s])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        by[s].append(r)
    for s, own in by.items():
        # The rates are the exponential tilt that meets the number: one lambda fits all documents.
        lambdas = [math.log(r.rate) / r.size for r in own if r.size and 0 < r.rate < 3]
        if lambdas and want[s] < 3 * sizes[s]:
            assert max(lambdas) - min(lambdas) < 1e-6 * max(1e-3, abs(lambdas[0]))
        assert abs(sum(r.rate * r.size for r in own) - want[s]) <= 1 + 1e-6 * want[s]
        assert abs(taken[s] - want[s]) <= max([r.size for r in own]) / 2 + 1
    return taken, want


def test_mixing_of_the_table(spark, con):
    source_of = dict(con.execute("SELECT doc_id, source FROM documents").fetchall())
    rows = queries()["op11_entropy_balancing"](spark, SF).collect()
    sizes = {d: sum(bool(w) for w in __import__("re").split(r"[\x20\x09-\x0D]+", t)) for d, t in con.execute("SELECT doc_id, text FROM documents").fetchall()}
    assert {r.doc_id: r.size for r in rows} == sizes
    taken, want = holds(rows, source_of)
    assert all(abs(taken[s] - want[s]) <= 0.005 * want[s] + 2 for s in want)
    again = queries()["op11_entropy_balancing"](spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mixing_edges(spark):
    rng = random.Random(3)
    rows, source_of = [], {}
    for i in range(900):
        source = "big" if i < 400 else rng.choice([None, "", "a", "é", "zz", "blank", "one"])
        words = 0 if source == "blank" else 40 if i < 200 else rng.choice([1, 2, 5, 300])
        rows.append((i, None if i % 97 == 0 else " ".join(["w"] * words), source, ))
        source_of[i] = source
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    holds(mixing.mix_sources(docs).collect(), source_of)
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    twice = docs.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long"))
    assert mixing.mix_sources(twice.unionByName(twice)).count() == 6
    assert {r.taken for r in mixing.mix_sources(docs.withColumn("text", F.lit(" "))).collect()} == {0}


# --- prefix trie


def brute_trie(rows):
    import zlib

    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn), (role or "", text or "")))
    plain = {c: [x for _, x in sorted(t, key=lambda p: p[0])] for c, t in turns.items()}
    again = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 6
        again[c] = plain.get(c - c % 100, [])[:h] + own[h:]
    nodes = collections.defaultdict(list)
    for c, t in again.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    children = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(m) if len(again[c]) == len(k))
        out.append((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def random_conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        c = c * 7 % 340
        rows += [(c, None if i == 0 and rng.random() < 0.2 else i, rng.choice([None, "user", "assistant"]), rng.choice([None, "", "a", "b", "yes é"])) for i in range(rng.randrange(1, longest))]
    one = {}
    for r in rows:
        one.setdefault(r[:2], r)
    return list(one.values())


@pytest.mark.parametrize("small", [1, 20, 4096])
def test_trie_is_brute_force(spark, small):
    rows = random_conversations(1, 150, 7)
    got = trie.conversation_trie(clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), small).collect()
    assert sorted(map(tuple, got), key=repr) == brute_trie(rows)


def test_trie_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "BUCKET", 16)
    rows = random_conversations(2, 12, 4) + [(c, i, "user", f"t{i % 9}") for c in (3, 4, 305) for i in range(10, 160)] + [(700, i, "user", f"{i}") for i in range(300)]
    got = trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 40).collect()
    assert sorted(map(tuple, got), key=repr) == brute_trie(rows)


def test_trie_edges(spark):
    rows = [(5, 1, "user", "x"), (5, 1, "user", "x"), (None, 1, "user", "x"), (-7, None, None, None), (9, 2, "user", "y" * 500_000)]
    turns = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.depth): r for r in trie.conversation_trie(turns).collect()}
    assert got[-7, 0].n_convs == 3 and sum(r.depth == 0 for r in got.values()) == 1
    assert trie.conversation_trie(turns.limit(0)).count() == 0


# --- alignment


def brute_alignment(texts):
    library, model = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    a_bytes, b_bytes = alignment.bytes_of_a(open(A, "rb").read()), alignment.bytes_of_b(model)
    cut = []
    for t in texts:
        a, b = (library.encode(" " + t, add_special_tokens=False).ids, model.encode(t)) if t else ([], [])
        whole = (" " + (t or "")).encode()
        if b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            a, b = [], []
        cut.append((a, b))
    spans, count = [], collections.Counter()
    for a, b in cut:
        at, ends = 0, [[], []]
        for side, ids, table in ((0, a, a_bytes), (1, b, b_bytes)):
            at = 0
            for i in ids:
                ends[side].append((at, at + len(table[i]), i))
                at += len(table[i])
        links, j = [], 0
        for s, e, i in ends[0]:
            while j < len(ends[1]) and ends[1][j][1] <= s:
                j += 1
            k = j
            while k < len(ends[1]) and ends[1][k][0] < e:
                links.append((i, ends[1][k][2]))
                k += 1
        both = sorted({x[1] for x in ends[0]} & {x[1] for x in ends[1]})
        groups, x, y = [], 0, 0
        for end in both:
            one, two = [], []
            while x < len(a) and ends[0][x][1] <= end:
                one.append(str(a[x]))
                x += 1
            while y < len(b) and ends[1][y][1] <= end:
                two.append(str(b[y]))
                y += 1
            groups.append(",".join(one) + "|" + ",".join(two))
        count.update(set(links))
        spans.append((a, b, links, groups))
    best = collections.Counter()
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [(len(a), len(b), len(g), len(x), sum(count[p] == best[p[0]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for a, b, x, g in spans]


def test_alignment_of_the_table(spark, con):
    texts = con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    want = {d: w for (d, _), w in zip(texts, brute_alignment([t for _, t in texts]), strict=True)}
    got = {r.doc_id: tuple(r)[1:] for r in queries()["op13_identity_alignment"](spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("frequent", [0, 7, 1 << 17])
def test_alignment_edges(spark, frequent, monkeypatch):
    monkeypatch.setattr(alignment, "PART", 200)
    rng = random.Random(5)
    texts = [None, "", " ", "a▁b", "<|endoftext|> <s> </s> <0x41>", "é😀 \x1c½ Ⅷ ՘\x00", "the same", "the same", "aaa" * 40, "\n\n x  y \t", " lead and trail  ", "word " * 300]
    texts += ["".join(rng.choice("ab cTh'\n\t1é!日 .in") for _ in range(rng.randrange(60))) for _ in range(150)]
    docs = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: tuple(r)[1:] for r in alignment.tokenizer_alignment(docs, A, B, frequent).collect()}
    want = dict(enumerate(brute_alignment(texts)))
    assert got == want and want[3] == (0, 0, 0, 0, 0, 0, "")
    assert alignment.tokenizer_alignment(docs.limit(0), A, B).count() == 0


def test_long_pieces_are_cut_where_nothing_goes_over(monkeypatch):
    monkeypatch.setattr(alignment, "LONG", 8)
    monkeypatch.setattr(alignment, "PART", 50)
    aligner = alignment.Aligner(open(A, "rb").read(), open(B, "rb").read())
    text = "a long   text\n of words, unbrokenandunbrokenandunbroken  and more. " * 20
    assert aligner._pieces(text).tolist() == aligner.model.encode(text)
    library = aligner.encoder.vocabulary.library
    assert aligner.encoder.ids([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert np.array_equal(aligner.a_size, [len(x) for x in alignment.bytes_of_a(open(A, "rb").read())])

"""Registered queries over whole small tables against SQL or brute force."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from corpuskit.llm import decontamination, pii
from corpuskit.llm.queries import queries, sql
from tests.conftest import SF
from tests.oracle import compare


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.fixture(scope="module")
def ids(texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = library.encode_batch([t or "" for t in texts.values()], add_special_tokens=False)
    return {d: e.ids for d, e in zip(texts, found, strict=True)}


def luhn(number):
    d = [int(c) for c in reversed(number)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def rows(spark, key):
    return queries()[key](spark, SF).collect()


@pytest.mark.parametrize("key", sorted(sql()))
def test_sql(spark, con, key):
    ok, message = compare(spark, con, key, queries()[key], sql()[key], SF)
    assert ok and "EMPTY" not in message, message


def test_op1(spark, texts):
    got = {r.doc_id: r for r in rows(spark, "op1_feistel_pseudonyms")}
    assert got.keys() == texts.keys()
    shape = re.compile(r"\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b(?:\d{1,3}\.){3}\d{1,3}\b|[\w.]+@[\w.]+\.com")
    maps = collections.defaultdict(set)
    for d, t in texts.items():
        old, new = shape.findall(t), shape.findall(got[d].text)
        assert len(old) == len(new) and (got[d].n_pseudonyms > 0 or got[d].text == t)
        for a, b in zip(old, new, strict=True):
            maps[a].add(b)
    assert maps and all(len(v) == 1 and (k not in v or k.isdigit() and not luhn(k)) for k, v in maps.items())
    assert len(set.union(*maps.values())) == len(maps)


def test_op2(spark, texts, ids):
    for r in rows(spark, "op2_token_counts"):
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (len(ids[r.doc_id]), len(texts[r.doc_id].encode()), len(ids[r.doc_id]) > 512)


def least_distances(patterns, text):
    """Edits between each pattern and the part of the text next to it, by the table of all cells, a column a character."""
    long = max(map(len, patterns))
    masks = {c: np.array([[x == c for x in p.ljust(long, "\0")] for p in patterns]) for c in set("".join(patterns))}
    none, steps = np.zeros((len(patterns), long), bool), np.arange(long + 1)
    column = np.tile(steps, (len(patterns), 1))
    last = np.array([len(p) for p in patterns])
    best = last.copy()
    for c in text:
        cells = np.minimum(column[:, 1:] + 1, column[:, :-1] + ~masks.get(c, none))
        column[:, 1:] = cells
        column = np.minimum.accumulate(column - steps, axis=1) + steps
        best = np.minimum(best, column[np.arange(len(patterns)), last])
    return best


def folded(text):
    return " ".join("".join(c.lower() if len(c.lower()) == 1 else c for c in text).split())


def test_op3(spark, con, texts):
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    got = {(r.doc_id, r.item_id): r.distance for r in rows(spark, "op3_benchmark_decontamination")}
    some = sorted({d for d, _ in got} | set(sorted(texts, key=lambda d: zlib.crc32(str(d).encode()))[:40]))
    patterns, want = [folded(t) for _, t in items], {}
    for d in some:
        for (i, _), p, n in zip(items, patterns, least_distances(patterns, folded(texts[d])), strict=True):
            if n <= int(len(p) * decontamination.RATE):
                want[d, i] = n
    assert want and got == want


def test_short_items_word_for_word():
    matcher = decontamination.Matcher([(1, "Who is it?"), (2, "7 x 6"), (3, " "), (4, None), (5, "cat")], decontamination.RATE, decontamination.LEAST)
    found = lambda text: sorted((i, n, text[a:b]) for i, n, a, b in matcher.find(text))
    assert found("So who  is it? A cat.") == [(1, 0, "who  is it?"), (5, 0, "cat")]
    assert found("concatenate 17 x 6 and 7 x 65, who is it") == [] and found("7 x 6") == [(2, 0, "7 x 6")] and found("cats, cat") == [(5, 0, "cat")]


def test_op4(spark, ids):
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows(spark, "op4_vector_packing"):
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, own in ids.items():
        whole, at = np.array([*own, 1], "<u4"), 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(whole)) and r.ids_crc32 == zlib.crc32(whole[at : at + r.length].tobytes())
            at += r.length
        assert at == len(whole)
    for s in sequences.values():
        ends = list(itertools.accumulate(r.length for r in sorted(s, key=lambda r: r.offset)))
        assert [r.offset for r in sorted(s, key=lambda r: r.offset)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert sum(len(i) + 1 for i in ids.values()) > 0.95 * 2048 * len(sequences)


def test_op6(spark, con):
    larger = SF.replace("0.001", "0.1")
    got = {r.doc_id: r for r in queries()["op6_pu_toxicity"](spark, larger).collect()}
    labels = con.execute(f"SELECT doc_id, toxic FROM read_parquet('{larger}/labels.parquet')").fetchall()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in got.items())
    held = [(got[d].score, t) for d, t in labels if got[d].held_out]
    toxic, clean = (np.array([s for s, t in held if t == side]) for side in (1, 0))
    over, equal = toxic[:, None] > clean, toxic[:, None] == clean
    assert (over + 0.5 * equal).mean() > 0.9


def test_op7_by_hand(spark, con):
    turns = collections.defaultdict(list)
    for conv, _, role, text in con.execute("SELECT conv_id, turn, role, coalesce(text, '') FROM conversations ORDER BY 1, 2").fetchall():
        turns[conv].append((role, text))
    for r in rows(spark, "op7_prefix_target_chat"):
        if r.conv_id >= 0:
            loss = "".join(t for role, t in turns[r.conv_id] if role == "assistant")
            assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and r.loss_chars == len(loss)
            assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns[r.conv_id]).encode()).hexdigest()


def test_op8(spark, texts):
    got = rows(spark, "op8_label_propagation_shards")
    shards, groups = collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        shards[r.shard].append(r.slot)
        groups[texts[r.doc_id]].add(r.shard)
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode()), "rows")
    assert len(got) == len(texts) and sorted(shards) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(len(g) == 1 for g in groups.values())


def test_op10(spark, texts):
    def print_of(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {d: print_of(t) for d, t in texts.items()}
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = rows(spark, "op10_simhash_near_dedup")
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{p:016x}", find(d)) for d, p in prints.items()}


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    assert [name for name, _ in pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "feistel_pseudonyms", "vector_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == columns, name
        after = spark.createDataFrame(after.collect(), docs.schema)
        assert 0 < after.count() <= docs.count()
        docs = after
    kept = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in pipeline.run(spark, SF).select("doc_id").collect()} == kept
    assert not {r.doc_id for r in rows(spark, "op3_benchmark_decontamination")} & kept
    assert pii.pseudonymise(docs, "other").where("n_pseudonyms > 0").count() > 0  # pseudonyms keep the format

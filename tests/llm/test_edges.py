"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import itertools
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpuskit.llm import chat, decontamination, packing, pii, rules, sharding, simhash, tokens, toxicity, warc
from corpuskit.llm.components import components
from corpuskit.llm.queries import KEY
from corpuskit.llm.vocabulary import Vocabulary
from corpuskit.session import run_dir

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i % 977} and the" for i in range(10_000))
ROWS = [(1, "the same text of a few words, no more and no less than that"), (1, "the same text of a few words, no more and no less than that"),
        (2, None), (3, ""), (4, " \n\t"), (5, LONG), (None, "an id is not there and that is that for the end"), (6, "é😀 <|endoftext|> \x1c½ Ⅷ ՘")]
# Columns that clash with added or inner names.
CLASH = ("n_words", "kept", "fp", "id", "row", "shard", "n_tokens", "score", "key", "__w", "block", "start")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit(7) for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_rules(docs, none):
    got = {r.doc_id: r for r in rules.quality_rules(docs).collect()}
    assert got[2].n_words == got[3].n_words == got[4].n_words == 0 and got[2].base_failed and not got[2].kept
    assert got[1].n_words == 14 and got[1].kept and got[5].n_words == 30_000
    assert rules.quality_rules(docs).count() == len(ROWS) and rules.quality_rules(none).count() == 0
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 2


def test_repeated_words(spark):
    rng = random.Random(4)
    lines = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    got = rules.quality_rules(spark.createDataFrame(list(enumerate(lines)), "doc_id int, text string")).collect()
    for r in got:
        w = lines[r.doc_id].split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        want = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
        assert r.n_repeat_words == len(want)


def test_tokens_and_packing(docs, none):
    library = Vocabulary.load(open(VOCABULARY, "rb").read()).library
    want = sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t in ROWS)
    assert sorted(r.n_tokens for r in tokens.token_counts(docs, VOCABULARY).collect()) == want
    assert tokens.token_counts(none, VOCABULARY).count() == packing.pack(none, VOCABULARY, 1).count() == 0
    limits = packing.Limits(tokens=64, segments=3, loss_tokens=40)
    pieces = packing.pack(docs.withColumn("ask", F.lit("a question ahead")), VOCABULARY, 1, limits, context_col="ask").collect()
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    assert all(sum(p.length for p in s) <= 64 and len(s) <= 3 and sum(p.loss_tokens for p in s) <= 40 for s in by.values())
    assert sum(p.loss_tokens for p in pieces) == sum(want) + len(ROWS)


def test_merging_is_the_library(spark):
    vocabulary = Vocabulary.load(open(VOCABULARY, "rb").read())
    rng = random.Random(1)
    odd = ["a" * 3000, "aaa", "ab<|endoftext|>c  <|endoftext|><|endoftext|>", " \n\n  x \t y　z", "x" * 600_001 + " y", "l'été don't I'LL 'S", "\x1c\x1d a\x85b"]
    odd += ["".join(rng.choice("ab c'\n\t1é!<|>日́ s½_") for _ in range(rng.randrange(40))) for _ in range(500)]
    want = [e.ids for e in vocabulary.library.encode_batch(odd, add_special_tokens=False)]
    assert [i.tolist() for i in packing.Encoder(vocabulary).ids(odd)] == want
    assert tokens.Counter(vocabulary).count(odd) == [len(i) for i in want]


def test_near_duplicates(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].fingerprint == by[4].fingerprint == "0" * 16 and by[2].component_id == by[3].component_id == by[4].component_id == 2
    assert by[None].component_id is None and simhash.near_duplicates(none).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 6]
    assert simhash.drop_near_duplicates(none).count() == 0


def test_wide_links(spark):
    """All pairs up to the bits that the segments guarantee, each once."""
    rng = random.Random(2)
    base = [rng.getrandbits(128) for _ in range(20)]
    prints = {}
    for b in base:
        for n in (0, 3, 9, 11):
            v = b
            for bit in rng.sample(range(128), n):
                v ^= 1 << bit
            prints[len(prints)] = v
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(k, signed(v & (1 << 64) - 1), signed(v >> 64)) for k, v in prints.items()]
    found = [tuple(sorted(r)) for r in simhash.links(spark.createDataFrame(rows, "node int, a long, b long"), "node", ("a", "b"), (21, 21, 22), 11).collect()]
    want = {(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 11}
    assert len(found) == len(set(found)) and set(found) == want


def test_near_copies_by_brute_force(spark):
    """All links of similarity 0.8 or more, and no other, with the constants of the pipeline."""
    rng = random.Random(11)
    texts = []
    for k in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((8, 60, 150, 300)))]
        texts += [base, *([(f"x{rng.randrange(10**6)}" if rng.random() < share else w) for w in base] for share in (0.005, 0.015, 0.02, 0.023, 0.027, 0.03, 0.04))]
    texts += [[*(f"n{i}" for i in range(84 + 4 * k)), "extra"] for k in range(6)]  # neighbours in a chain
    texts += [[f"q{i}" for i in range(n)] for n in (84, 104, 131)]  # 80, 100, 127 shingles: 0.8 exactly, then less
    line = [f"l{i}" for i in range(30)]
    texts += [line + [f"z{k}_{i}" for i in range(k % 7 + 1)] for k in range(40)]
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both * 5 >= 4 * (len(sets[i]) + len(sets[j]) - both):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    want = [i for i in range(len(texts)) if find(i) == i]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(rows).collect()) == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(200 + i, 201 + i) for i in range(40)] + [(5, 5)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    root.pop(5) if all(5 not in e for e in edges if e != (5, 5)) else None
    alone = {x for x in root if not any(x in e and e[0] != e[1] for e in edges)}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {k: v for k, v in root.items() if k not in alone}
    assert components(spark.createDataFrame([], "u int, v int")).count() == 0


def test_leaks(spark, docs, none):
    item = "what is the name of the river that runs through the old town"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "too short"), (4, item.upper())], "item_id int, text string")
    texts = [(10, f"Before. {item.replace('river', 'rivr')}, after"), (11, item.replace(" ", "\n  ").upper()), (12, "nothing of it at all"), (13, None)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"item": F.lit(1), "id": F.lit("x")})
    got = {(r.doc_id, r.item_id): r for r in decontamination.find_leaks(rows, bench).collect()}
    assert sorted(got) == [(10, 1), (10, 4), (11, 1), (11, 4)] and got[10, 1].distance == 1 and got[11, 1].distance == 0
    assert texts[0][1][got[10, 1].start : got[10, 1].end] == item.replace("river", "rivr")
    assert decontamination.find_leaks(none, bench).count() == decontamination.find_leaks(docs, bench.limit(0)).count() == 0
    kept = decontamination.without_leaks(rows, bench)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [12, 13]


@pytest.mark.parametrize("text, n, want", [
    ("card 4041894974608795.", 1, None), ("1234567812345678 4041894974608795 12345678", 1, None), ("1234567812345678", 0, None), ("256.1.1.1 and 1.2.3.4.5 v4.0.", 0, None), ("2001-02-29 1850-01-01", 0, None),
    ("2004-02-29 31.12.1999 12/31/1999 1999/12/31", 4, None), ("666-12-1234 123-45-6789", 1, None), ("DE89370400440532013000", 1, None),
    ("DE88370400440532013000", 0, None), ("a@b.co +1 (988) 555-2485", 2, None), ("plain words 12 and 3.5", 0, None), ("", 0, None), (None, 0, None),
])
def test_pseudonyms(spark, text, n, want):
    row = pii.pseudonymise(spark.createDataFrame([(text,)], "text string"), KEY).first()
    assert row.n_pseudonyms == n and (n > 0 or row.text == text)
    again = pii.pseudonymise(spark.createDataFrame([(row.text,)], "text string"), KEY).first()
    assert again.n_pseudonyms == n  # what comes out is valid in its format


def test_pseudonyms_are_linked_and_permutations(spark):
    values = ["4041-8949-7460-8795", "4041 8949 7460 8795", "4041894974608795", "(212) 555-0199", "212-555-0199"]
    out = [r.text for r in pii.pseudonymise(spark.createDataFrame([(v,) for v in values], "text string"), KEY).collect()]
    digits = lambda s: "".join(c for c in s if c.isdigit())
    assert digits(out[0]) == digits(out[1]) == out[2] and digits(out[3]) == digits(out[4])
    assert [[c for c in o if not c.isdigit()] for o in out] == [[c for c in v if not c.isdigit()] for v in values]
    numbers = spark.range(35).select(pii.permuted("k", "t", F.col("id"), 5, 7).alias("p"))
    assert sorted(r.p for r in numbers.collect()) == list(range(35))


def test_toxicity(spark, docs, none):
    rng = random.Random(5)
    words = ["stone", "river", "cloud", "green", "house", "light", "table", "paper"]
    texts = [(i, " ".join(rng.choices(words, k=20) + (["vilesome"] if i % 5 == 0 else []))) for i in range(300)] + [(None, None), (1000, "")]
    rows = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"held_out": F.lit(1), "features": F.lit(2)})
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 300, 3)] + [(None, 1), (5000, 1), (7, None), (0, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(rows, labels).collect()
    assert len(got) == len(texts)
    assert min(r.score for r in got if r.text and "vilesome" in r.text) > max(r.score for r in got if not r.text or "vilesome" not in r.text)
    assert toxicity.toxicity(none, labels).count() == 0
    flat = {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()}
    assert len(flat) == 1


def test_chat(spark):
    turns = [(1, None, None, None), (1, 0, "assistant", '&lt;</turn>\n&amp;"><turn role="x">'), (1, 0, "assistant", ""), (1, 0, 'us"er\n<&', "é😀<"),
             (None, 0, "user", "a"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    examples = chat.expand(rows)
    back = {r.conv_id: [tuple(t) for t in r.turns] for r in examples.where("last").select("conv_id", chat.parsed(F.col("formatted")).alias("turns")).collect()}
    assert back[1] == [("", ""), ("assistant", ""), ("assistant", turns[1][3]), ('us"er\n<&', "é😀<")] and back[None] == [("user", "a")]
    got = {r.conv_id: r for r in chat.digest(examples).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[2].loss_chars, got[None].loss_chars) == (4, len(turns[1][3]), 2, 0)
    assert chat.expand(rows.limit(0)).count() == chat.digest(examples.limit(0)).count() == 0


def test_shards(docs, none):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(ROWS) and {r.shard for r in got} == set(range(8)) and all(r.slot == 0 for r in got)
    assert sharding.shard_documents(none).count() == 0


def test_shards_hold_a_hot_group(spark):
    """A third of the rows are one text, the rest pairs: even counts, few cut pairs."""
    rows = spark.range(1200).select(F.col("id").alias("row"), F.when(F.col("id") < 400, F.lit(-1)).otherwise(F.col("id") % 400).alias("key"))
    got = sharding.balanced_shards(rows).join(rows, "row").collect()
    sizes, groups = {}, {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r.slot)
        groups.setdefault(r.key, []).append(r.shard)
    assert all(sorted(s) == list(range(150)) for s in sizes.values())
    assert sum(len(set(g)) == 1 for k, g in groups.items() if k >= 0) >= 300
    assert max(groups[-1].count(s) for s in range(8)) >= 75


def test_shards_keep_what_fits(spark):
    """A group of 10 % of the rows stays whole; groups of four and edges without slack are cut only where they must be."""
    tenth = spark.range(1000).select(F.col("id").alias("row"), F.when(F.col("id") < 100, F.lit(1)).alias("key"))
    fours = spark.range(1000).select(F.col("id").alias("row"), F.floor(F.col("id") / 4).alias("key"))
    shard = {r.row: r.shard for r in sharding.balanced_shards(tenth).collect()}
    assert len({shard[i] for i in range(100)}) == 1
    got = sharding.balanced_shards(fours).collect()
    by, sizes = {}, {}
    for r in got:
        by.setdefault(r.row // 4, set()).add(r.shard)
        sizes.setdefault(r.shard, []).append(r.slot)
    assert sum(len(s) > 1 for s in by.values()) <= 2 and all(sorted(s) == list(range(125)) for s in sizes.values())
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 199)] + [(0, 150)], "u long, v long")
    shard = {r.row: r.shard for r in sharding.balanced_shards(tenth.withColumn("key", F.when(F.col("row") < 20, F.lit(1))), edges=edges).collect()}
    assert len(shard) == 1000 and len({shard[i] for i in [*range(20), *range(100, 200)]}) == 1


def test_warc(spark):
    body = "<p>" + "same body " * 20 + "</p>"
    pages = [(3, "http://a/b\r\nX: 1%", body), (1, None, body), (2, "http://c", "short"), (4, "http://d", "short"), (5, "http://e", None), (6, "http://f", LONG), (7, "u", body)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"id": F.lit(0), "digest": F.lit(1)})
    index = warc.write_archive(rows, run_dir(spark, "warc"))
    got = {r.page_id: r for r in warc.read_archive(index).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        1: ("response", None), 3: ("revisit", 1), 7: ("revisit", 1), 2: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert got[3].url == pages[0][1] and got[3].payload_bytes == len(body) and got[6].payload.decode() == LONG and got[1].url == ""
    one = warc.fetch(index, spark.createDataFrame([(6,)], "page_id long")).collect()
    assert len(one) == 1 and bytes(one[0].record).endswith(LONG.encode() + b"\r\n\r\n")
    empty = warc.write_archive(rows.limit(0), run_dir(spark, "warc"))
    assert empty.count() == warc.read_archive(empty).count() == 0

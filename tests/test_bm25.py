"""The stored index: exact whatever is skipped, and grown without being written again."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from corpuskit.functions.text import search_tokens
from corpuskit.operators import bm25 as B
from corpuskit.session import run_dir


def plain_search(docs, queries, k):
    """{(query, rank): (doc, score)} by scoring every document."""
    words = {d: t.split() for d, t in docs if t and t.strip()}
    n, avgdl = len(words), sum(map(len, words.values())) / max(1, len(words))
    df = collections.Counter(w for ws in words.values() for w in set(ws))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = B.EPSILON * sum(raw.values()) / len(raw)
    idf = {w: floor if r < 0 else r for w, r in raw.items()}
    out = {}
    for q, text in queries:
        scores = {}
        for d, ws in words.items():
            tf = collections.Counter(ws)
            s = sum(idf.get(w, 0) * tf[w] * (B.K1 + 1) / (tf[w] + B.K1 * (1 - B.B + B.B * len(ws) / avgdl)) for w in text.split() if tf[w])
            if round(s, 9) > 0:
                scores[d] = round(s, 9)
        for rank, d in enumerate(sorted(scores, key=lambda d: (-scores[d], d))[:k], 1):
            out[q, rank] = (d, scores[d])
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([5, 40, 120])))) for i in range(1500)] + [(9000, None), (9001, " ")]
    queries = [(q, " ".join(rng.choices(vocabulary, weights, k=8) + rng.choices(vocabulary, k=4))) for q in range(40)] + [(100, "nowhere"), (101, "w0"), (102, "w0 w1 w2 w0")]
    return docs, queries


@pytest.mark.parametrize("k", [1, 10])
def test_search_is_plain_search(spark, corpus, k, monkeypatch):
    monkeypatch.setattr(B, "FIRST", 60)
    docs, queries = corpus
    table = spark.createDataFrame(docs, "doc_id long, content string")
    path = run_dir(spark, "bm25-test")
    B.create_index(table.where("doc_id % 3 = 0"), path)
    before = sorted(r.folder for r in B.read_table(spark, f"{path}/list").collect())
    B.add_documents(table.where("doc_id % 3 = 1"), path)
    index = B.add_documents(table.where("doc_id % 3 = 2"), path)
    after = sorted(r.folder for r in B.read_table(spark, f"{path}/list").collect())
    assert set(before) < set(after) and len(after) == 3
    terms = B.query_terms(spark.createDataFrame(queries, "q long, text string"), "q", "text")
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in B.search(index, terms, k).collect()}
    want = plain_search(docs, queries, k)
    assert got.keys() == want.keys()
    assert all(abs(got[x][1] - want[x][1]) < 2e-9 and (got[x][0] == want[x][0] or abs(got[x][1] - want[x][1]) < 2e-9) for x in want)
    read, every = B.postings_read(index, terms, k)
    assert read < 0.6 * every, (read, every)


def test_one_index_or_many_segments(spark, corpus):
    table = spark.createDataFrame(corpus[0], "doc_id long, content string")
    whole = B.create_index(table, run_dir(spark, "bm25-whole"))
    path = run_dir(spark, "bm25-parts")
    B.create_index(table.limit(0), path)
    parts = B.add_documents(table, path)
    assert (whole.n_docs, whole.avgdl) == (parts.n_docs, parts.avgdl) == (1500, whole.avgdl)
    rows = lambda index: sorted((r.term, r.df, round(r.idf, 9)) for r in index.terms().collect())
    assert rows(whole) == rows(parts)
    asked = B.query_terms(spark.createDataFrame(corpus[1][:5], "q long, text string"), "q", "text")
    assert sorted(map(tuple, B.search(whole, asked).collect())) == sorted(map(tuple, B.search(parts, asked).collect()))
    assert B.search(B.create_index(table.limit(0), run_dir(spark, "bm25-none")), asked).count() == 0


def test_negative_weights(spark):
    """In a small corpus of common words the mean weight is below zero."""
    docs = [(i, "a b" + (" c" if i < 7 else "") + (" d" if i == 3 else "")) for i in range(10)]
    queries = [(0, "a c d"), (1, "d"), (2, "a b c d")]
    index = B.create_index(spark.createDataFrame(docs, "doc_id long, content string"), run_dir(spark, "bm25-small"))
    terms = B.query_terms(spark.createDataFrame(queries, "q long, text string"), "q", "text")
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in B.search(index, terms, 3).collect()}
    assert index.terms().where(F.col("idf") < 0).count() > 0 and search_tokens is not None
    assert got == plain_search(docs, queries, 3)


def test_what_was_read_leaves_few_documents_to_complete(spark, corpus, monkeypatch):
    """Unread terms are added to the documents that can still reach the k-th score of what was read, not to most."""
    monkeypatch.setattr(B, "FIRST", 5)
    written, plain = {}, B.materialize
    monkeypatch.setattr(B, "materialize", lambda df, label: written.setdefault(label, plain(df, label)))
    docs, queries = corpus
    index = B.create_index(spark.createDataFrame(docs, "doc_id long, content string"), run_dir(spark, "bm25-few"))
    terms = B.query_terms(spark.createDataFrame(queries, "q long, text string"), "q", "text")
    got = {(r.query_id, r["rank"]): r.score for r in B.search(index, terms).collect()}
    assert {k: v[1] for k, v in plain_search(docs, queries, 10).items()} == pytest.approx(got, abs=2e-9)
    able = written["bm25-able"].count()
    assert able < 0.3 * written["bm25-found"].count(), (able, written["bm25-found"].count())

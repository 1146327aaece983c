"""BM25 (Okapi) over a stored index of postings, searched without reading what cannot matter.

An index is a list of segments; documents are added as one more segment and the
list is published in one step.  The postings of a term lie in levels of impact.
A level knows its largest frequency and its shortest document, which bound its
scores whatever the corpus has become since, so no segment is ever written again.

A batch of queries is answered exactly in three steps.  The best levels of all
terms give each query a score that its k-th document surely reaches.  Terms that
together stay below it cannot bring in a document alone: their postings are left
unread, and of the others those levels that stay below it with all other terms at
their best.  Documents that can still reach it get the rest of their score from
their own list of terms.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskit.functions.text import search_tokens
from corpuskit.operators.scan import top_rows
from corpuskit.session import materialize
from corpuskit.sources.versions import append_rows, create_table, read_table

# The usual Okapi parameters.
K1, B, EPSILON = 1.5, 0.75, 0.25


#: Levels of impact, the best one first, and postings of a term that set a first score.
LEVELS, FIRST = 16, 256
#: Room for the rounding of sums.
SLACK = 1e-6


@dataclass(frozen=True)
class Bm25Index:
    """The segments of a stored index as one.

    ``postings(term, level, doc_id, tf, dl)``; ``levels(term, level, n, max_tf, min_dl)``, one row per segment;
    ``docs(doc_id, dl, words)`` with ``words`` an array of ``term`` and ``tf``.
    """

    postings: DataFrame
    levels: DataFrame
    docs: DataFrame
    n_docs: int
    avgdl: float

    def terms(self) -> DataFrame:
        """``term``, ``df``, ``idf``; a term in over half of the documents has a share of the mean instead of a negative weight."""
        counted = self.levels.groupBy("term").agg(F.sum("n").alias("df"))
        plain = counted.withColumn("raw", F.log(self.n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        floor = plain.agg(F.avg("raw") * EPSILON).first()[0]
        return plain.select("term", "df", F.when(F.col("raw") < 0, F.lit(floor)).otherwise(F.col("raw")).alias("idf"))


def _write_segment(docs: DataFrame, path: str, doc_id: str, fields: tuple[str, ...], tokens) -> DataFrame:
    """Postings, levels and term lists of documents with any text; the segment's row for the list of segments."""
    spark, folder = docs.sparkSession, f"{path}/segments/{uuid.uuid4().hex}"
    text = F.concat_ws(" ", *[F.nullif(F.col(f), F.lit("")) for f in fields])
    # Texts move once, by document; its words are counted and listed where they are split.
    live = docs.select(F.col(doc_id).alias("doc_id"), text.alias("__t")).where(F.trim("__t") != "").repartition("doc_id").select("doc_id", tokens(F.col("__t")).alias("w"))
    listed = live.select("doc_id", F.size("w").alias("dl"), F.explode_outer("w").alias("term"))
    counted = listed.groupBy("doc_id", "dl", "term").agg(F.count("term").alias("tf"))
    # A term and its frequency are one entry of the document's list, and later one posting.
    entry = F.when(F.col("term").isNotNull(), F.struct("term", "tf"))
    counted.groupBy("doc_id", "dl").agg(F.collect_list(entry).alias("words")).write.parquet(f"{folder}/docs")
    docs = spark.read.parquet(f"{folder}/docs")
    n, total = docs.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    impact = F.col("w.tf") / (F.col("w.tf") + K1 * (1 - B + B * F.col("dl") / max(1e-9, total / max(1, n))))
    level = F.least(F.lit(LEVELS - 1), F.greatest(F.lit(0), F.floor((1 - impact) * LEVELS))).cast("int")
    rows = docs.select("doc_id", "dl", F.explode("words").alias("w")).select(F.col("w.term").alias("term"), level.alias("level"), "doc_id", F.col("w.tf").alias("tf"), "dl")
    # Ranges keep a term's rows near each other and spread a term that is in every document.
    rows.repartitionByRange("term", "level", "doc_id").sortWithinPartitions("term", "level").write.parquet(f"{folder}/postings")
    postings = spark.read.parquet(f"{folder}/postings")
    postings.groupBy("term", "level").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl")).write.parquet(f"{folder}/levels")
    return spark.createDataFrame([(folder, n, int(total))], "folder string, n_docs long, words long")


def create_index(docs: DataFrame, path: str, doc_id: str = "doc_id", fields: tuple[str, ...] = ("content",), tokens=search_tokens) -> Bm25Index:
    """A new index at ``path`` over the joined ``fields`` of documents with any text."""
    create_table(_write_segment(docs, path, doc_id, fields, tokens), f"{path}/list", "folder")
    return open_index(docs.sparkSession, path)


def add_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", fields: tuple[str, ...] = ("content",), tokens=search_tokens) -> Bm25Index:
    """Documents with new ids as one more segment; what is there is not read."""
    append_rows(_write_segment(docs, path, doc_id, fields, tokens), f"{path}/list")
    return open_index(docs.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> Bm25Index:
    segments = read_table(spark, f"{path}/list").collect()
    part = lambda name: spark.read.parquet(*[f"{s.folder}/{name}" for s in segments])
    n = sum(s.n_docs for s in segments)
    return Bm25Index(part("postings"), part("levels"), part("docs"), n, sum(s.words for s in segments) / max(1, n))


def term_score(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def query_terms(queries: DataFrame, query_id: str, text: str, tokens=search_tokens) -> DataFrame:
    rows = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(text))).alias("term"))
    return rows.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _bounds(index: Bm25Index, terms: DataFrame) -> DataFrame:
    """``query_id, term, weight, level, n, top`` (the most a posting of the level can add) and ``best`` (of the term)."""
    asked = materialize(terms.join(index.terms(), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")), "bm25-asked")
    most = term_score(F.col("max_tf"), F.col("min_dl"), index.avgdl)
    known = index.levels.join(asked.select("term").distinct(), "term").groupBy("term", "level").agg(F.sum("n").alias("n"), F.max(most).alias("most"))
    top = F.greatest(F.lit(0.0), F.col("weight") * F.col("most"))
    rows = asked.join(known, "term").select("query_id", "term", "weight", "level", "n", top.alias("top"))
    return materialize(rows.withColumn("best", F.max("top").over(Window.partitionBy("query_id", "term"))), "bm25-bounds")


def _scored(index: Bm25Index, chosen: DataFrame) -> DataFrame:
    """Sums over the postings of the chosen ``(query_id, term, weight, level)`` per query and document."""
    hits = index.postings.join(chosen.select("query_id", "term", "weight", "level"), ["term", "level"])
    return hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * term_score(F.col("tf"), F.col("dl"), index.avgdl)).alias("s"))


def _chosen(index: Bm25Index, bounds: DataFrame, k: int) -> DataFrame:
    """``bounds`` with ``floor`` (what the k-th document reaches), ``rest`` (all that unread terms can add) and ``read``."""
    ahead = Window.partitionBy("query_id", "term").orderBy("level")
    first = bounds.withColumn("upto", F.sum("n").over(ahead)).where(F.col("upto") <= FIRST)
    # What a term with a negative weight can take away.
    below = bounds.groupBy("query_id", "term").agg(F.min(F.least(F.lit(0.0), F.col("weight") * (K1 + 1))).alias("low")).groupBy("query_id").agg(F.sum("low").alias("low"))
    reached = top_rows(_scored(index, first), ["query_id"], [F.desc("s"), F.col("doc_id")], k, "r").where(F.col("r") == k)
    floors = below.join(reached.select("query_id", "s"), "query_id", "left").select("query_id", "low", (F.coalesce(F.col("s") + F.col("low"), F.lit(0.0)) - SLACK).alias("floor"))
    per_term = bounds.select("query_id", "term", "best").distinct()
    order = Window.partitionBy("query_id").orderBy("best", "term")
    sums = per_term.withColumns({"upto": F.sum("best").over(order), "all": F.sum("best").over(Window.partitionBy("query_id"))}).join(floors, "query_id")
    # The weakest terms whose bests together stay below the floor bring in nothing alone.
    sums = sums.withColumn("unread", F.col("upto") < F.col("floor"))
    rest = sums.groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("unread"), F.col("upto"))), F.lit(0.0)).alias("rest"))
    put = bounds.join(sums.select("query_id", "term", "all", "floor", "low", "unread"), ["query_id", "term"]).join(rest, "query_id")
    read = ~F.col("unread") & (F.col("top") + F.col("all") - F.col("best") >= F.col("floor"))
    return materialize(put.withColumn("read", read), "bm25-choice")


def postings_read(index: Bm25Index, terms: DataFrame, k: int = 10) -> tuple[int, int]:
    """How many postings a search scores, the first step included, and how many its terms have."""
    bounds = _bounds(index, terms)
    ahead = Window.partitionBy("query_id", "term").orderBy("level")
    first = bounds.withColumn("upto", F.sum("n").over(ahead)).where(F.col("upto") <= FIRST).agg(F.sum("n")).first()[0] or 0
    read, every = _chosen(index, bounds, k).agg(F.sum(F.when(F.col("read"), F.col("n")).otherwise(0)), F.sum("n")).first()
    return first + (read or 0), every or 0


def search(index: Bm25Index, terms: DataFrame, k: int = 10) -> DataFrame:
    """Best ``k`` documents per query with a positive score, exactly.

    A document whose score reaches the query's floor has none of its postings
    in a level left out, so its sum is whole; what has one left out stays below.
    """
    chosen = _chosen(index, _bounds(index, terms), k)
    found = materialize(_scored(index, chosen.where("read")), "bm25-found")
    kth = top_rows(found, ["query_id"], [F.desc("s"), F.col("doc_id")], k, "r").where(F.col("r") == k).select("query_id", F.col("s").alias("kth"))
    per_query = chosen.groupBy("query_id").agg(F.max("rest").alias("rest"), F.max("floor").alias("floor"), F.max("low").alias("low"))
    # What was read so far raises the floor: few documents are left that unread terms can bring above it.
    floors = per_query.join(kth, "query_id", "left").select("query_id", "rest", F.greatest("floor", F.col("kth") + F.col("low") - SLACK).alias("floor"))
    able = materialize(found.join(floors, "query_id").where(F.col("s") + F.col("rest") >= F.col("floor")).select("query_id", "doc_id", "s"), "bm25-able")
    unread = chosen.where("unread").groupBy("query_id", "term").agg(F.max("weight").alias("weight"))
    # Each document's list is opened once; terms meet the queries that left them unread.
    own = index.docs.join(able.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "dl", F.explode("words").alias("w"))
    own = own.select("doc_id", "dl", "w.term", "w.tf").join(unread, "term")
    added = own.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * term_score(F.col("tf"), F.col("dl"), F.lit(index.avgdl))).alias("added"))
    whole = able.join(added, ["query_id", "doc_id"], "left")
    scored = whole.select("query_id", "doc_id", F.round(F.col("s") + F.coalesce("added", F.lit(0.0)), 9).alias("score")).where("score > 0")
    return top_rows(scored, ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def fuse(first: DataFrame, second: DataFrame, k: int = 10, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two rankings ``(query_id, doc_id, rank)``."""
    def part(rows, name):
        return rows.select("query_id", "doc_id", (1.0 / (constant + F.col("rank"))).alias(name))

    both = part(first, "a").join(part(second, "b"), ["query_id", "doc_id"], "full")
    scored = both.select("query_id", "doc_id", F.round(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), 9).alias("score"))
    return top_rows(scored, ["query_id"], [F.desc("score"), F.col("doc_id")], k)

"""Retrieval: vector search, budgets, quotas, BM25, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.catalog.inputs import oracle_table
from corpuskit.catalog.registry import query
from corpuskit.functions import text as S
from corpuskit.functions.formats import score_of
from corpuskit.operators import bm25 as B
from corpuskit.operators import embedding as E
from corpuskit.operators.vectors import nearest
from corpuskit.plans import answers as A
from corpuskit.plans import retrieval as R
from corpuskit.session import run_dir

oracle_table("dists", """
    SELECT q.query_id, v.vec_id, v.collection, v.repo AS vrepo, q.repo AS qrepo, q.wanted, v.symbol_name, v.file,
      round(1 - list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.query_vec AS DOUBLE[])), 9) AS d FROM @vectors@ v CROSS JOIN @vector_queries@ q""")
oracle_table("top_each", """
    SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY d, vec_id) AS rc FROM @dists@""")


@query("J15_query_vector_join", "SELECT query_id, vec_id, collection AS grp, round(d, 6) AS distance, rc AS rank FROM @top_each@ WHERE rc <= 10")
def j15(t):
    return nearest(t.vectors, t.vector_queries, 10).withColumn("distance", F.round("distance", 6))


oracle_table("retrieved", """
    SELECT * FROM (SELECT query_id, vec_id, collection, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM @top_each@ WHERE rc <= 3) WHERE rank <= 8""")


@query("R1_multi_collection_retrieval", "SELECT query_id, rank, vec_id, collection, round(greatest(0, 1 - d), 3) AS score FROM @retrieved@")
def r1(t):
    return R.retrieve(t.vectors, t.vector_queries).select("query_id", "rank", "vec_id", F.col("grp").alias("collection"), "score")


@query("T1_two_phase_top_k", """
    SELECT * FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM @top_each@ WHERE rc <= 5) WHERE rank <= 20""")
def t1(t):
    return R.retrieve(t.vectors, t.vector_queries, 20).select("query_id", "vec_id", "rank")


oracle_table("filtered", """
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY collection = 'trm_notes' DESC, d, vec_id) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY d, vec_id) AS rf FROM @dists@ WHERE collection <> 'repo_code' OR vrepo = qrepo) WHERE rf <= 3""")


@query("T2_notes_first_ranking", "SELECT query_id, vec_id, collection AS grp, rank FROM @filtered@")
def t2(t):
    return R.filtered_search(t.vectors, t.vector_queries).select("query_id", "vec_id", "grp", "rank")


oracle_table("shown", """
    SELECT f.query_id, f.vec_id, f.rank, CAST(floor(length(substr(text, 1, CASE collection WHEN 'trm_notes' THEN 400 WHEN 'repo_code' THEN 120 WHEN 'trm_tables' THEN 300 WHEN 'trm_code' THEN 300 ELSE 200 END)) / 3.5) AS INTEGER) AS tokens
    FROM @filtered@ f JOIN documents ON doc_id = f.vec_id""")


@query("R2_filtered_budgeted_search", """
    SELECT query_id, vec_id, rank, tokens, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM @shown@) WHERE used <= 700 OR rank = 1""")
def r2(t):
    contents = t.documents.select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    found = R.budgeted_search(t.vectors, t.vector_queries, contents, 2000)
    return R.within_budget(found.drop("used"), "tokens", 700).select("query_id", "vec_id", "rank", "tokens", "used")


@query("W12_budget_prefix", """
    SELECT conv_id, rank, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY rank) AS used FROM (
      SELECT conv_id, turn + 1 AS rank, CAST(floor(length(text) / 3.5) AS INTEGER) AS tokens FROM conversations)) WHERE used <= 300 OR rank = 1""")
def w12(t):
    rows = t.conversations.select("conv_id", (F.col("turn") + 1).alias("rank"), S.estimated_tokens(F.col("text")).alias("tokens"))
    return R.within_budget(rows, "tokens", 300, "conv_id").select("conv_id", "rank", "used")


oracle_table("exact_syms", """
    SELECT * FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS rank FROM @dists@ WHERE collection = 'repo_code' AND symbol_name = wanted AND vrepo = qrepo) WHERE rank <= 5""")
_LOOKUP_SQL = """
    SELECT query_id, vec_id, rank, 'exact' AS how FROM @exact_syms@ UNION ALL
    SELECT * FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank, 'similar' FROM @dists@ WHERE collection = 'repo_code' AND vrepo = qrepo
      AND query_id NOT IN (SELECT query_id FROM @exact_syms@)) WHERE rank <= 3"""


@query("R3_symbol_lookup", _LOOKUP_SQL)
def r3(t):
    return R.symbol_lookup(t.vectors, t.vector_queries)


@query("T9_exact_else_similar", f"SELECT how, count(*) AS n, count(DISTINCT query_id) AS asked FROM ({_LOOKUP_SQL}) GROUP BY how")
def t9(t):
    return R.symbol_lookup(t.vectors, t.vector_queries).groupBy("how").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("asked"))


def _quota_sql(rules):
    test = " OR ".join(f"(collection = '{c}' AND rc <= {n} AND 1 - d > {th})" for c, (n, th) in rules.items())
    return f"SELECT query_id, collection AS grp, vec_id, rc AS rank, round(1 - d, 6) AS score FROM @top_each@ WHERE {test}"


def _quota(t, rules):
    return R.quota_search(t.vectors, t.vector_queries, rules).select("query_id", "grp", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("R4_component_context", _quota_sql(R.COMPONENT_CONTEXT))
def r4(t):
    return _quota(t, R.COMPONENT_CONTEXT)


@query("R5_task_briefing", _quota_sql(R.BRIEFING))
def r5(t):
    return _quota(t, R.BRIEFING)


_LOOSE = {c: (n, -1.0) for c, (n, _) in R.BRIEFING.items()}


@query("T4_collection_quotas", _quota_sql(_LOOSE))
def t4(t):
    return _quota(t, _LOOSE)


_LAYERS = {"definition": ("repo0", "repo1", "repo2"), "server": ("repo1", "repo2"), "client": ("repo3", "repo4")}


def _layer_sql(threshold):
    values = ", ".join(f"('{layer}', '{r}')" for layer, names in _LAYERS.items() for r in names)
    return f"""
    SELECT query_id, layer, grp, vec_id, rank FROM (SELECT query_id, layer, vrepo AS grp, vec_id, row_number() OVER (PARTITION BY query_id, layer ORDER BY d, vec_id, vrepo) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, vrepo ORDER BY d, vec_id) AS rr FROM @dists@ WHERE collection = 'repo_code') h JOIN (VALUES {values}) l(layer, repo) ON h.vrepo = l.repo
      WHERE rr <= 3 AND 1 - d > {threshold}) WHERE rank <= 2"""


@query("R6_layered_service_map", _layer_sql(0.0))
def r6(t):
    return R.layered_search(t.vectors, t.vector_queries, _LAYERS, 0.0).select("query_id", "layer", "grp", "vec_id", "rank")


@query("T3_per_repo_then_layer", _layer_sql(0.30))
def t3(t):
    return R.layered_search(t.vectors, t.vector_queries, _LAYERS).select("query_id", "layer", "grp", "vec_id", "rank")


@query("R7_spotlight_search", """
    SELECT query_id, v.vec_id, rank, round(greatest(0, 1 - d / 2), 3) AS score, replace(substr(text, 1, 120), chr(10), ' ') AS snippet FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (
        SELECT q.query_id, v.vec_id, round(list_distance(CAST(v.embedding AS DOUBLE[]), CAST(q.query_vec AS DOUBLE[])) ** 2, 9) AS d FROM @vectors@ v CROSS JOIN @vector_queries@ q WHERE v.collection = 'repo_code')) v
    JOIN documents ON doc_id = v.vec_id WHERE rank <= 20""")
def r7(t):
    hits = nearest(t.vectors, t.vector_queries, {"repo_code": 20}, metric="l2")
    texts = t.documents.select(F.col("doc_id").alias("vec_id"), S.one_line(F.col("text"), 120).alias("snippet"))
    return hits.join(texts, "vec_id").select("query_id", "vec_id", "rank", F.round(score_of(F.col("distance"), "l2"), 3).alias("score"), "snippet")


@query("R8_injected_context", """
    WITH inj AS (SELECT item_id AS query_id, unnest(ls) AS content, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT item_id, string_split(text, chr(10)) AS ls FROM benchmark WHERE item_id % 4 = 0))
    SELECT query_id, rank, CAST(vec_id AS VARCHAR) AS source, round(greatest(0, 1 - d), 3) AS score FROM @retrieved@ WHERE query_id NOT IN (SELECT query_id FROM inj)
    UNION ALL SELECT query_id, i + 1, 'injected_' || i, 1.0 FROM inj""")
def r8(t):
    lines = t.benchmark.where("item_id % 4 = 0").select(F.col("item_id").alias("query_id"), F.posexplode(F.split("text", "\n")).alias("i", "content"))
    return R.with_injected(R.retrieve(t.vectors, t.vector_queries), lines)


oracle_table("postings", r"""
    SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE trim(text) <> '')) GROUP BY ALL""")
oracle_table("bm_totals", r"""
    SELECT count(*) AS n_docs, avg(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS avgdl FROM documents WHERE trim(text) <> ''""")
oracle_table("bm_raw", "SELECT term, count(*) AS df, ln((SELECT n_docs FROM @bm_totals@) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM @postings@ GROUP BY term")
oracle_table("bm_terms", "SELECT term, df, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM @bm_raw@) ELSE raw END AS idf FROM @bm_raw@")
oracle_table("bm_hits", r"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
      SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM @bm_totals@)))), 9) AS score
      FROM (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark) GROUP BY ALL) q
      JOIN @bm_terms@ USING (term) JOIN @postings@ USING (term) GROUP BY ALL) WHERE score > 0) WHERE rank <= 10""")


def bm25_index(t):
    """Two segments: half of the documents, then the others added."""
    path = run_dir(t.spark, "bm25")
    B.create_index(t.documents.where("doc_id % 2 = 0"), path, fields=("text",))
    return B.add_documents(t.documents.where("doc_id % 2 = 1"), path, fields=("text",))


@query("R9_bm25_index", "SELECT term, df, round(idf, 6) AS idf, (SELECT n_docs FROM @bm_totals@) AS n_docs, round((SELECT avgdl FROM @bm_totals@), 6) AS avgdl FROM @bm_terms@")
def r9(t):
    index = bm25_index(t)
    return index.terms().select("term", "df", F.round("idf", 6).alias("idf"), F.lit(index.n_docs).cast("long").alias("n_docs"), F.round(F.lit(index.avgdl), 6).alias("avgdl"))


@query("R10_bm25_search", "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM @bm_hits@")
def r10(t):
    return B.search(bm25_index(t), B.query_terms(t.benchmark, "item_id", "text")).withColumn("score", F.round("score", 6))


@query("R11_hybrid_fusion", """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
      SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.vec_id) AS doc_id, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS score
      FROM @bm_hits@ a FULL JOIN @retrieved@ b ON a.query_id = b.query_id AND a.doc_id = b.vec_id)) WHERE rank <= 10""")
def r11(t):
    words = B.search(bm25_index(t), B.query_terms(t.benchmark, "item_id", "text"))
    near = R.retrieve(t.vectors, t.vector_queries).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    return B.fuse(words, near)


@query("R13_pca_map")
def r13(t):
    points, _ = E.map_points(t.vectors)
    return points.select("vec_id", *[F.round(c, 4).alias(c) for c in ("x", "y", "z")], "name", "repo", "symbol")


_VERDICT = """CASE WHEN h.ctx_id IS NULL THEN 'bypass' WHEN NOT contains(generation, '## Stack Trace & Sources') THEN 'missing_sources_section'
      WHEN NOT contains(generation, '[[') OR NOT contains(generation, ']]') THEN 'missing_wikilinks' WHEN {0} THEN 'hallucinated_source' ELSE 'pass' END"""
_ANY = "NOT EXISTS (SELECT 1 FROM @contexts@ c WHERE c.ctx_id = g.ctx_id AND contains(g.generation, '[[' || c.source || ']]'))"
oracle_table("verdicts", f"SELECT g.gen_id, g.attempts, g.generation, {_VERDICT.format(_ANY)} AS verdict FROM @generations@ g LEFT JOIN (SELECT DISTINCT ctx_id FROM @contexts@) h ON g.ctx_id = h.ctx_id")


@query("R14_citation_validation", "SELECT gen_id, verdict FROM @verdicts@")
def r14(t):
    return A.validate(t.generations, t.contexts).select("gen_id", "verdict")


@query("R14_strict_citation_validation", rf"""
    SELECT g.gen_id, CASE WHEN h.ctx_id IS NULL THEN 'bypass' WHEN NOT contains(generation, '## Stack Trace & Sources') THEN 'missing_sources_section'
      WHEN NOT contains(generation, '[[') OR NOT contains(generation, ']]') THEN 'missing_wikilinks'
      WHEN len(cited) = 0 OR len(list_filter(cited, lambda x: NOT list_contains(h.have, x))) > 0 THEN 'hallucinated_source' ELSE 'pass' END AS verdict
    FROM (SELECT *, regexp_extract_all(generation, '\[\[([^\]|#]+)', 1) AS cited FROM @generations@) g LEFT JOIN (SELECT ctx_id, list(source) AS have FROM @contexts@ GROUP BY ctx_id) h ON g.ctx_id = h.ctx_id""")
def r14_all(t):
    return A.validate(t.generations, t.contexts, mode="all").select("gen_id", "verdict")


@query("R15_retry_decision", "SELECT gen_id, verdict NOT IN ('pass', 'bypass') AND attempts < 3 AS needs_retry FROM @verdicts@")
def r15(t):
    rows = A.validate(t.generations, t.contexts)
    return rows.select("gen_id", A.needs_retry(F.col("verdict"), F.col("attempts")).alias("needs_retry"))


def _ranked_contents(t):
    hits = R.retrieve(t.vectors, t.vector_queries).select("query_id", "rank", F.col("vec_id").alias("doc_id"))
    texts = t.chunk_rows.select("doc_id", "content", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("file")).alias("file"), F.col("repo").alias("source"))
    return hits.join(texts, "doc_id")


oracle_table("ranked_contents", r"""
    SELECT query_id, rank, content, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE file END, ''), nullif(repo, ''), 'Unknown') AS source, greatest(1, len(regexp_extract_all(content, '\S+'))) AS tokens
    FROM @retrieved@ r JOIN @chunk_rows@ c ON c.doc_id = r.vec_id""")
oracle_table("kept_contents", """
    SELECT *, least(tokens, 300 - running + tokens) AS kept FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS running FROM @ranked_contents@) WHERE 300 - running + tokens > 0""")


@query("W13_context_truncation", "SELECT query_id, rank, tokens, CAST(kept AS BIGINT) AS kept_tokens FROM @kept_contents@")
def w13(t):
    return A.budget_context(_ranked_contents(t), 300).select("query_id", "rank", "tokens", "kept_tokens")


@query("R16_context_assembly", r"""
    SELECT query_id, sha256(string_agg('--- SOURCE FILE: ' || source || ' ---' || chr(10) || CASE WHEN tokens <= kept THEN content ELSE array_to_string(regexp_extract_all(content, '\s*\S+')[1:CAST(kept AS INTEGER)], '') END, chr(10) ORDER BY rank)) AS context_hash,
      CAST(sum(kept) AS BIGINT) AS context_tokens, count(*) AS sources FROM @kept_contents@ GROUP BY query_id""")
def r16(t):
    return A.assemble_context(_ranked_contents(t), 300).select("query_id", F.sha2("context", 256).alias("context_hash"), "context_tokens", "sources")


@query("W15_first_by_file", """
    SELECT query_id, filename, min(rank) AS rank FROM (SELECT query_id, rank, 'file_' || vec_id % 5 AS filename FROM @retrieved@) GROUP BY ALL""")
def w15(t):
    ranked = R.retrieve(t.vectors, t.vector_queries).withColumn("filename", F.concat(F.lit("file_"), F.col("vec_id") % 5))
    return R.first_by_file(ranked)


@query("R17_batch_embedding")
def r17(t):
    rows = E.embed(t.documents.select("doc_id", "text"))
    return rows.select("doc_id", F.size("embedding").alias("dims"), F.round(F.aggregate(
        F.transform("embedding", lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x), 3).alias("norm"))


@query("V2_pluggable_embedder", "SELECT doc_id, length(text) AS first_value, 2 AS dims FROM documents")
def v2(t):
    from corpuskit.operators.udfs import length_embedder

    rows = E.embed(t.documents.select("doc_id", "text"), embedder=length_embedder())
    return rows.select("doc_id", F.col("embedding")[0].cast("int").alias("first_value"), F.size("embedding").alias("dims"))


@query("V1_pluggable_token_counter", r"SELECT doc_id, greatest(1, len(regexp_extract_all(text, '\S+'))) AS by_words, length(text) AS by_chars FROM documents")
def v1(t):
    from corpuskit.operators.udfs import char_counter

    return t.documents.select("doc_id", S.token_count(F.col("text")).alias("by_words"), S.token_count(F.col("text"), char_counter()).alias("by_chars"))


@query("P4_failed_vectors_kept_in_metadata", """
    SELECT count(*) AS metadata_rows, count(*) FILTER (doc_id % 7 <> 0) AS vector_rows FROM documents""")
def p4(t):
    vector = F.when(F.col("doc_id") % 7 != 0, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>"))
    rows = t.documents.select("doc_id", vector.alias("embedding"))
    return rows.agg(F.count("*").alias("metadata_rows"), F.count_if(F.size("embedding") > 0).alias("vector_rows"))

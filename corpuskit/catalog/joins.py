"""Joins between symbols, links, files, generations and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.catalog import scalars as C
from corpuskit.catalog.inputs import oracle_table
from corpuskit.catalog.registry import query
from corpuskit.functions.text import clip, full_hash, normalize_identifier
from corpuskit.operators import substring as B
from corpuskit.plans import linking as L
from corpuskit.plans import manual as M
from corpuskit.plans import vault as V

NORM_SQL = r"regexp_replace(lower({0}), '[_\-\s]+', '', 'g')"
oracle_table("sym_keys", f"""
    SELECT DISTINCT repo, file, name, key FROM (SELECT repo, file, name, {NORM_SQL.format('unnest(list_concat([name], regexp_extract_all(source, $$[A-Z][A-Z_]{{2,}}$$)))')} AS key FROM @symbols@) WHERE key <> ''""")
oracle_table("words_asked", r"SELECT DISTINCT w AS needle FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS w FROM benchmark)")
oracle_table("words_known", r"SELECT DISTINCT w AS hay FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS w FROM documents)")


@query("J5_symbol_name_join", f"""
    SELECT doc_id, name_asked, k.repo, k.file, k.name, CASE WHEN k.repo = a.repo_hint THEN 0.95 ELSE 0.90 END AS confidence
    FROM (SELECT doc_id, upper(name) AS name_asked, CASE WHEN doc_id % 2 = 0 THEN repo END AS repo_hint FROM @symbols@) a
    JOIN @sym_keys@ k ON k.key = {NORM_SQL.format('name_asked')}""")
def j5(t):
    asked = t.symbols.select(
        "doc_id", F.upper("name").alias("name_asked"), F.when(F.col("doc_id") % 2 == 0, F.col("repo")).alias("repo_hint"))
    return L.exact_symbols(asked, t.symbols).drop("repo_hint")


@query("J6_substring_join", """
    SELECT hay, needle FROM @words_known@ JOIN @words_asked@ ON contains(hay, needle) AND hay <> needle""")
def j6(t):
    def words(df, name):
        return df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]{2,}"), F.lit(0))).alias(name)).distinct()

    return B.contains_join(words(t.documents, "hay"), words(t.benchmark, "needle"))


oracle_table("identifiers", rf"""
    SELECT doc, page, snippet_id AS item_id, nullif(function_name, '') AS identifier, 1.0 AS weight, 'function_name' AS match_type FROM @snippet_names@ WHERE function_name <> ''
    UNION ALL SELECT doc, page, snippet_id, unnest(string_split(struct_names, '|')), 0.8, 'struct_name' FROM @snippet_names@ WHERE struct_names <> ''
    UNION ALL SELECT doc, page, snippet_id, unnest(list_distinct(regexp_extract_all({C.ASCII_SQL.format('content')}, '\b([A-Z][A-Z_]{{3,}})\b', 1))), 0.5, 'constant_name' FROM @snippet_names@
    UNION ALL SELECT doc, page, table_id, unnest(list_sort(list_distinct(flatten(list_transform(list_concat(headers, flatten(list_transform(rows, lambda r: list_transform(r, lambda c: c.value)))),
       lambda x: regexp_extract_all({C.ASCII_SQL.format('x')}, '\b([A-Z][A-Z_0-9]{{2,}})\b', 1)))))), 0.6, 'table_identifier' FROM @manual_tables@""")
oracle_table("snippet_names", r"""
    SELECT *, CASE language WHEN 'c' THEN regexp_extract(line, '^(?:\w[\w\s*]+\s+)(\w+)\s*\(', 1) WHEN 'go' THEN regexp_extract(line, '^func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\(', 1)
        WHEN 'python' THEN regexp_extract(line, '^def\s+(\w+)\s*\(', 1) END AS function_name FROM @snippets@""")
oracle_table("term_keys", f"""
    WITH t AS (SELECT DISTINCT {NORM_SQL.format('identifier')} AS term FROM @identifiers@), k AS (SELECT DISTINCT key FROM @sym_keys@)
    SELECT term, key, CASE WHEN key = term THEN 0.9 WHEN contains(key, term) THEN 0.65 ELSE 0.6 END AS confidence
    FROM t JOIN k ON term <> '' AND (key = term OR (length(term) > 4 AND (contains(key, term) OR contains(term, key))))""")
oracle_table("term_symbols", """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY confidence DESC, repo, file, name) AS rn FROM (
      SELECT term, repo, file, name, max(confidence) AS confidence FROM @term_keys@ t JOIN @sym_keys@ s ON t.key = s.key GROUP BY ALL)) WHERE rn <= 5""")
oracle_table("links", f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, item_id ORDER BY confidence DESC, repo, file, name) AS rank FROM (
      SELECT doc, page, item_id, repo, file, name, max(CAST(confidence AS DOUBLE) * weight) AS confidence, max_by(match_type, (CAST(confidence AS DOUBLE) * weight, match_type)) AS match_type
      FROM (SELECT i.*, s.repo, s.file, s.name, CAST(s.confidence AS DOUBLE) AS confidence, FROM (SELECT doc, page, item_id, identifier, CAST(weight AS DOUBLE) AS weight, match_type FROM @identifiers@) i
            JOIN @term_symbols@ s ON s.term = {NORM_SQL.format('i.identifier')}) GROUP BY doc, page, item_id, repo, file, name)) WHERE rank <= 5""")


def links(t):
    return L.manual_links(M.extract_snippets(t.block_table), M.extract_tables(t.block_table), t.symbols)


@query("X8_manual_link_job", "SELECT doc, page, item_id, repo, file, name, round(confidence, 6) AS confidence, match_type, rank FROM @links@")
def x8(t):
    return links(t).withColumn("confidence", F.round("confidence", 6))


@query("W16_best_match_dedup", "SELECT term, repo, file, name, CAST(confidence AS DOUBLE) AS confidence FROM @term_symbols@")
def w16(t):
    found = L.snippet_identifiers(M.extract_snippets(t.block_table)).unionByName(L.table_identifiers(M.extract_tables(t.block_table)))
    return L.search_symbols(found.select(normalize_identifier(F.col("identifier")).alias("term")), t.symbols)


@query("J3_symbol_link_join", """
    SELECT s.doc_id, l.item_id IS NOT NULL AS has_trm_link, l.item_id, l.page, round(l.confidence, 6) AS confidence FROM @symbols@ s
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, lower(name) ORDER BY confidence DESC, doc, page, item_id) AS rn FROM @links@) WHERE rn = 1) l
      ON s.repo = l.repo AND lower(s.name) = lower(l.name)""")
def j3(t):
    refs = L.first_links(links(t))
    return t.symbols.withColumn("name_key", F.lower("name")).join(refs, ["repo", "name_key"], "left").select(
        "doc_id", F.col("trm_reference").isNotNull().alias("has_trm_link"), "trm_reference.item_id", "trm_reference.page",
        F.round("trm_reference.confidence", 6).alias("confidence"))


@query("E28_link_quality", """
    SELECT count(*) AS links, count(*) FILTER (best >= 0.5) AS high_confidence FROM (SELECT doc, item_id, max(confidence) AS best FROM @links@ GROUP BY ALL)""")
def e28(t):
    return L.link_quality(links(t), 0.5)


@query("E32_page_coverage", """
    SELECT p.doc, count(*) AS pages, count(l.page) AS linked_pages, round(count(l.page) / count(*), 6) AS coverage FROM @page_ctx@ p
    LEFT JOIN (SELECT DISTINCT doc, page FROM @links@) l ON p.doc = l.doc AND p.page = l.page GROUP BY p.doc""")
def e32(t):
    return V.page_coverage(M.page_context(t.block_table), links(t))


@query("J22_snippet_link_join", """
    SELECT s.doc, s.page, s.snippet_id, l.repo, l.name, round(l.confidence, 6) AS confidence FROM @snippets@ s LEFT JOIN (SELECT * FROM @links@ WHERE rank <= 3) l
      ON s.doc = l.doc AND s.page = l.page AND s.snippet_id = l.item_id""")
def j22(t):
    snippets = M.extract_snippets(t.block_table)
    best = links(t).where("rank <= 3").select("doc", "page", F.col("item_id").alias("snippet_id"), "repo", "name", F.round("confidence", 6).alias("confidence"))
    return snippets.select("doc", "page", "snippet_id").join(best, ["doc", "page", "snippet_id"], "left")


@query("J13_unseen_chunks", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j13(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


oracle_table("annotations", """
    SELECT content_hash, max(quality) AS quality, max(toxic) AS toxic FROM (SELECT sha256(d.text) AS content_hash, l.quality, l.toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id) GROUP BY 1""")


def annotation_cache(t):
    rows = t.labels.join(t.documents, "doc_id").select(full_hash(F.col("text")).alias("content_hash"), "quality", "toxic")
    return rows.groupBy("content_hash").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))


@query("J14_cache_hit_split", """
    SELECT s.doc_id, a.content_hash IS NOT NULL AS hit, a.quality FROM @symbols@ s LEFT JOIN @annotations@ a ON sha256(s.source) = a.content_hash""")
def j14(t):
    return V.with_cache(t.symbols, annotation_cache(t)).select("doc_id", "hit", "quality")


@query("X13_annotation_apply", r"""
    SELECT s.doc_id, CASE WHEN type NOT IN ('function', 'method', 'class') THEN 'other_kind' WHEN length(regexp_replace(source, '^\s+|\s+$', '', 'g')) < 30 THEN 'too_short'
      WHEN a.content_hash IS NOT NULL THEN 'cached' ELSE 'to_annotate' END AS state,
      CASE WHEN type IN ('function', 'method', 'class') AND length(regexp_replace(source, '^\s+|\s+$', '', 'g')) >= 30 THEN a.quality END AS quality
    FROM @symbols@ s LEFT JOIN @annotations@ a ON sha256(s.source) = a.content_hash""")
def x13(t):
    return V.annotation_state(t.symbols, annotation_cache(t)).select("doc_id", "state", "quality")


@query("J16_citation_semi_join", """
    SELECT DISTINCT g.gen_id FROM @generations@ g JOIN @contexts@ c ON g.ctx_id = c.ctx_id AND contains(g.generation, '[[' || c.source || ']]')""")
def j16(t):
    from corpuskit.plans.answers import cited_in_context

    return cited_in_context(t.generations, t.contexts).select("gen_id")


_DRIFT_FILES = "SELECT c_custkey AS file_id, c_name AS file, c_custkey % 900 * 10 AS size FROM customer"
oracle_table("index_times", """
    SELECT o_custkey AS file_id, CASE WHEN o_custkey % 10 = 4 THEN NULL ELSE min(o_orderdate) END AS indexed_at, max(o_orderdate) AS mtime FROM orders GROUP BY o_custkey""")
oracle_table("drift", """
    SELECT c_name AS file, CASE WHEN i.file_id IS NULL THEN 'never_indexed' WHEN indexed_at IS NULL THEN 'fresh'
        WHEN (epoch_us(mtime) - epoch_us(indexed_at)) / 86400e6 > 1 THEN 'drifted' ELSE 'fresh' END AS status,
      CASE WHEN (epoch_us(mtime) - epoch_us(indexed_at)) / 86400e6 > 1 THEN round((epoch_us(mtime) - epoch_us(indexed_at)) / 86400e6, 1) END AS delta_days
    FROM customer LEFT JOIN @index_times@ i ON c_custkey = i.file_id""")


def drift(t):
    times = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("mtime"))
    files = t.customer.select("c_custkey", F.col("c_name").alias("file")).join(times.select("c_custkey", "mtime"), "c_custkey", "left")
    indexed = times.select("c_custkey", F.lit(True).alias("indexed"), F.when(F.col("c_custkey") % 10 != 4, F.col("first")).alias("indexed_at"))
    return V.index_drift(files, indexed, "c_custkey").select("file", "status", "delta_days")


@query("J17_index_drift", "SELECT * FROM @drift@")
def j17(t):
    return drift(t)


@query("E30_drift_summary", """
    SELECT status, count(*) AS n, round(max(delta_days), 1) AS worst_days FROM @drift@ GROUP BY status""")
def e30(t):
    return drift(t).groupBy("status").agg(F.count("*").alias("n"), F.round(F.max("delta_days"), 1).alias("worst_days"))


@query("U3_work_queue", """
    SELECT file, 'stale' AS kind, true AS selected FROM @drift@ WHERE status = 'drifted' UNION ALL SELECT file, 'never_indexed', false FROM @drift@ WHERE status = 'never_indexed'""")
def u3(t):
    return V.work_queue(drift(t))


@query("J18_spotlight_flag", """
    SELECT v.vec_id, h.vec_id IS NOT NULL AS spotlight FROM @vectors@ v LEFT JOIN (SELECT DISTINCT item_id * 3 AS vec_id FROM benchmark) h ON v.vec_id = h.vec_id""")
def j18(t):
    hits = t.benchmark.select((F.col("item_id") * 3).alias("vec_id")).distinct()
    return V.spotlight(t.vectors.select("vec_id"), hits, "vec_id")


oracle_table("sym_files", "SELECT repo, file, min(language) AS language, count(*) AS chunks FROM (SELECT repo, file, language FROM @symbols@ UNION ALL SELECT repo, 'extra/' || lang, lang FROM (SELECT DISTINCT source AS repo, lang FROM documents)) GROUP BY ALL")


def symbol_files(t):
    extra = t.documents.select(F.col("source").alias("repo"), F.concat(F.lit("extra/"), "lang").alias("file"), F.col("lang").alias("language")).distinct()
    return t.symbols.select("repo", "file", "language").unionByName(extra).groupBy("repo", "file").agg(
        F.min("language").alias("language"), F.count("*").alias("chunks"))


@query("J19_file_symbol_join", """
    SELECT f.repo, f.file, s.doc_id, s.line_start, CASE WHEN s.doc_id IS NOT NULL THEN row_number() OVER (PARTITION BY f.repo, f.file ORDER BY s.line_start, s.doc_id) END AS place
    FROM @sym_files@ f LEFT JOIN @symbols@ s ON f.repo = s.repo AND f.file = s.file""")
def j19(t):
    return V.file_symbols(symbol_files(t), t.symbols).select("repo", "file", "doc_id", "line_start", "place")


@query("J20_broken_links", r"""
    SELECT DISTINCT gen_id, target FROM (SELECT gen_id, unnest(regexp_extract_all(generation, '\[\[([^\]|#]+)', 1)) AS target FROM @generations@)
    WHERE target NOT IN (SELECT source FROM @contexts@)""")
def j20(t):
    notes = t.generations.select(F.col("gen_id"), F.col("generation").alias("content"))
    return V.broken_links(notes, t.contexts.select(F.col("source").alias("name")), "gen_id")


@query("J21_rendering_joins", """
    WITH l AS (SELECT repo, name, count(*) AS n_links FROM @links@ WHERE confidence >= 0.5 GROUP BY ALL),
    c AS (SELECT doc, count(*) AS n_clones FROM (SELECT doc_a AS doc, doc_b AS other FROM @clone_pairs@ WHERE similarity >= 0.8 UNION ALL SELECT doc_b, doc_a FROM @clone_pairs@ WHERE similarity >= 0.8) GROUP BY doc)
    SELECT s.doc_id, coalesce(n_links, 0) AS n_links, least(coalesce(n_clones, 0), 5) AS n_clones FROM @symbols@ s LEFT JOIN l ON s.repo = l.repo AND s.name = l.name LEFT JOIN c ON c.doc = s.doc_id""")
def j21(t):
    from corpuskit.operators.similarity import top_partners
    from corpuskit.plans.clones import find_clones

    strong = links(t).where("confidence >= 0.5").groupBy("repo", "name").agg(F.count("*").alias("n_links"))
    partners = top_partners(find_clones(t.symbols), 5).where("similarity >= 0.8").groupBy(F.col("item").alias("doc_id")).agg(F.count("*").alias("n_clones"))
    return t.symbols.join(strong, ["repo", "name"], "left").join(partners, "doc_id", "left").select(
        "doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_clones", F.lit(0)).alias("n_clones"))


@query("J23_chapter_note_join", """
    SELECT c.doc, c.chapter, count(n.note_id) AS notes, min(n.note_id) AS first_note FROM (SELECT DISTINCT doc, coalesce(nullif(chapter, ''), 'Uncategorized') AS chapter FROM @page_ctx@) c
    LEFT JOIN (SELECT n.doc, p.chapter, 'N' || n.page || '.' || n.note_no AS note_id FROM @notes@ n JOIN @page_ctx@ p ON n.doc = p.doc AND n.page = p.page) n ON c.doc = n.doc AND c.chapter = n.chapter GROUP BY ALL""")
def j23(t):
    chapters = M.chapter_rollup(M.page_context(t.block_table)).select("doc", "chapter")
    notes = M.extract_notes(t.block_table).groupBy("doc", "chapter").agg(F.count("*").alias("notes"), F.min("note_id").alias("first_note"))
    return chapters.join(notes, ["doc", "chapter"], "left").withColumn("notes", F.coalesce("notes", F.lit(0)))


oracle_table("ab_runs", "SELECT user_id AS prompt, event_type AS model, max_by(value, event_id) AS ms FROM events GROUP BY ALL")


@query("J24_side_by_side", """
    SELECT a.prompt, a.ms AS ms_a, b.ms AS ms_b, CAST(round(100 * a.ms / greatest(a.ms, b.ms, 1)) AS INTEGER) AS bar_a, CAST(round(100 * b.ms / greatest(a.ms, b.ms, 1)) AS INTEGER) AS bar_b
    FROM @ab_runs@ a JOIN @ab_runs@ b ON a.prompt = b.prompt WHERE a.model = 'click' AND b.model = 'view'""")
def j24(t):
    runs = t.events.groupBy(F.col("user_id").alias("prompt"), F.col("event_type").alias("model")).agg(F.max_by("value", "event_id").alias("ms"))
    return V.side_by_side(runs, "click", "view")


@query("P14_annotation_input", "SELECT doc_id, sha256(substr(source, 1, 1200)) AS input FROM @symbols@")
def p14(t):
    return t.symbols.select("doc_id", F.sha2(clip(F.col("source"), 1200), 256).alias("input"))

"""Data-quality expectations over chunks, symbols, clones and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.catalog.registry import query
from corpuskit.functions.text import token_count
from corpuskit.plans import quality as Q
from corpuskit.session import run_dir
from corpuskit.sources.rejects import read_checked
from corpuskit.sources.tables import EVENT_SCHEMA


@query("Q1_required_fields", """
    SELECT 'required_fields' AS "check", subject, CAST(n AS DOUBLE) AS value, n = 0 AS ok FROM (
      SELECT 'chunk_id' AS subject, count(*) FILTER (chunk_id IS NULL OR chunk_id = '') AS n FROM @chunk_rows@ UNION ALL SELECT 'content', count(*) FILTER (content IS NULL OR content = '') FROM @chunk_rows@
      UNION ALL SELECT 'content_type', count(*) FILTER (content_type IS NULL OR content_type = '') FROM @chunk_rows@)""")
def q1(t):
    return Q.required_fields(t.chunk_rows, ["chunk_id", "content", "content_type"])


@query("Q2_unique_ids", "SELECT content_hash, count(*) AS n FROM (SELECT sha256(text) AS content_hash FROM documents) GROUP BY ALL HAVING count(*) > 1")
def q2(t):
    return Q.duplicate_keys(t.documents.select(F.sha2("text", 256).alias("content_hash")), ["content_hash"])


@query("Q3_token_ranges", r"""
    SELECT content_type, count(*) FILTER (k < 10) AS too_small, count(*) FILTER (k > 600) AS too_large, max(k) AS largest FROM (SELECT content_type, greatest(1, len(regexp_extract_all(content, '\S+'))) AS k FROM @chunk_rows@) GROUP BY ALL""")
def q3(t):
    return Q.token_range(t.chunk_rows, token_count(F.col("content")), 10, 600, "content_type")


@query("Q4_short_texts", """SELECT 'short_texts' AS "check", 'content' AS subject, CAST(count(*) FILTER (length(trim(content)) < 10) AS DOUBLE) AS value, count(*) FILTER (length(trim(content)) < 10) = 0 AS ok FROM @chunk_rows@""")
def q4(t):
    return Q.short_texts(t.chunk_rows, "content")


@query("Q5_content_types_present", """
    SELECT r.name, r.name IN (SELECT content_type FROM @chunk_rows@) AS present FROM (VALUES ('repo_code'), ('trm_code'), ('trm_note'), ('trm_prose'), ('trm_table'), ('trm_figure')) r(name)""")
def q5(t):
    return Q.presence(t.chunk_rows, "content_type", ["repo_code", "trm_code", "trm_note", "trm_prose", "trm_table", "trm_figure"])


@query("Q6_minimum_counts", """
    SELECT 'minimum_counts' AS "check", subject, CAST(n AS DOUBLE) AS value, n >= least AS ok FROM (SELECT 'chunks' AS subject, count(*) AS n, 500 AS least FROM @chunk_rows@ UNION ALL SELECT 'symbols', count(*), 5000 FROM @symbols@
      UNION ALL SELECT 'blocks', count(*), 180 FROM @raw_blocks@)""")
def q6(t):
    return Q.minimum_counts({"chunks": t.chunk_rows, "symbols": t.symbols, "blocks": t.raw_blocks}, {"chunks": 500, "symbols": 5000, "blocks": 180})


@query("Q7_line_numbers", "SELECT doc_id FROM (SELECT doc_id, line_start - 3 AS line_start, line_end FROM @symbols@) WHERE line_start < 1 OR line_end < line_start")
def q7(t):
    return Q.line_numbers(t.symbols.withColumn("line_start", F.col("line_start") - 3)).select("doc_id")


@query("Q8_known_clone_pairs", """
    SELECT 'pair_minimum' AS "check", subject, CAST(n AS DOUBLE) AS value, n >= least AS ok FROM (
      SELECT 'src1|src2' AS subject, count(*) AS n, 1 AS least FROM @clone_pairs@ WHERE least(repo_a, repo_b) = 'src1' AND greatest(repo_a, repo_b) = 'src2'
      UNION ALL SELECT 'src9|src10', count(*), 500 FROM @clone_pairs@ WHERE least(repo_a, repo_b) = 'src10' AND greatest(repo_a, repo_b) = 'src9')""")
def q8(t):
    from corpuskit.plans.clones import find_clones, repo_pair_counts

    return Q.pair_minimum(repo_pair_counts(find_clones(t.symbols)), [("src1", "src2", 1), ("src9", "src10", 500)])


@query("Q9_note_shape", """
    SELECT gen_id, gen_id % 3 = 0 AS has_frontmatter, contains(generation, '[[') AND contains(generation, ']]') AS has_links FROM @generations@""")
def q9(t):
    head = F.when(F.col("gen_id") % 3 == 0, F.lit("---\ntitle: x\n---\n")).otherwise("")
    return Q.note_shape(t.generations.select("gen_id", F.concat(head, "generation").alias("content")), "gen_id")


@query("Q10_broken_link_count", r"""
    SELECT target, count(DISTINCT gen_id) AS notes FROM (SELECT gen_id, unnest(regexp_extract_all(generation, '\[\[([^\]|#]+)', 1)) AS target FROM @generations@) WHERE target NOT IN (SELECT source FROM @contexts@) GROUP BY target""")
def q10(t):
    from corpuskit.plans.vault import broken_links

    notes = t.generations.select("gen_id", F.col("generation").alias("content"))
    return broken_links(notes, t.contexts.select(F.col("source").alias("name")), "gen_id").groupBy("target").agg(F.count("*").alias("notes"))


_BAD_LINE = "event_id % 100 < user_id % 10"


@query("Q11_failure_rate", f"""
    SELECT 'app' || user_id % 20 AS subject, count(*) AS lines, count(*) FILTER ({_BAD_LINE}) AS failed, round(count(*) FILTER ({_BAD_LINE}) / count(*), 6) AS rate,
      CASE WHEN count(*) FILTER ({_BAD_LINE}) / count(*) > 0.05 THEN 'stop' WHEN count(*) FILTER ({_BAD_LINE}) / count(*) >= 0.02 THEN 'warn' ELSE 'ok' END AS verdict FROM events GROUP BY ALL""")
def q11(t):
    path = run_dir(t.spark, "app-logs")
    line = F.to_json(F.struct(F.col("event_id").cast("double").alias("ts"), F.col("event_type").alias("event")))
    rows = t.events.select(F.concat(F.lit("app"), F.col("user_id") % 20).alias("app"), F.when(F.expr(_BAD_LINE), F.substring(line, 1, 9)).otherwise(line).alias("value"))
    rows.repartition("app").write.partitionBy("app").text(path)
    return read_checked(t.spark, path, EVENT_SCHEMA).rates(F.regexp_extract("file", "app=([^/]+)", 1))

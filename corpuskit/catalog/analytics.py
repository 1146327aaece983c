"""Summaries of chunks, vectors, history and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.catalog.inputs import text_template
from corpuskit.catalog.registry import query
from corpuskit.functions import tags as G
from corpuskit.operators.dictionary import dictionary_of, tagged
from corpuskit.operators.embedding import map_points
from corpuskit.plans import analytics as A
from corpuskit.plans import answers
from corpuskit.plans import history as H


@query("E10_chunk_and_file_counts", "SELECT repo, count(*) AS chunks, count(DISTINCT file) AS files FROM @chunk_rows@ GROUP BY ALL")
def e10(t):
    return t.chunk_rows.groupBy("repo").agg(F.count("*").alias("chunks"), F.countDistinct("file").alias("files"))


@query("E11_totals", """
    SELECT count(*) AS chunks, count(DISTINCT repo) AS repos, count(*) FILTER (content_type = 'trm_note') AS notes, (SELECT count(*) FROM @symbols@) AS symbols, (SELECT count(*) FROM @ref_pages@) AS links FROM @chunk_rows@""")
def e11(t):
    from corpuskit.plans.manual import reference_mentions

    symbols = t.symbols.agg(F.count("*")).scalar()
    links = reference_mentions(t.blocks).agg(F.count("*")).scalar()
    return t.chunk_rows.agg(F.count("*").alias("chunks"), F.countDistinct("repo").alias("repos"), F.count_if(F.col("content_type") == "trm_note").alias("notes")).select(
        "chunks", "repos", "notes", symbols.alias("symbols"), links.alias("links"))


@query("E13_size_histogram", "SELECT CAST(floor(length(content) / 200) * 200 AS BIGINT) AS bucket, count(*) AS count FROM @chunk_rows@ GROUP BY ALL")
def e13(t):
    return A.size_histogram(t.chunk_rows)


@query("E13_size_summary", "SELECT count(*) AS total, CAST(round(avg(length(content))) AS BIGINT) AS avg_chars FROM @chunk_rows@")
def e13_summary(t):
    return t.chunk_rows.agg(F.count("*").alias("total"), F.round(F.avg(F.length("content"))).cast("bigint").alias("avg_chars"))


@query("E14_top_files", "SELECT file AS source, count(*) AS chunk_count FROM @chunk_rows@ GROUP BY ALL ORDER BY chunk_count DESC, source LIMIT 20")
def e14(t):
    return A.top_counts(t.chunk_rows, F.col("file"), 20)


@query("E15_retrieval_heatmap", """
    SELECT path, count(*) AS count, max(ts) AS last_accessed FROM (SELECT ts, json_extract_string(unnest(CAST(sources AS JSON[])), '$.filename') AS path FROM @history@ WHERE sources IS NOT NULL) GROUP BY path ORDER BY count DESC, path LIMIT 200""")
def e15(t):
    return H.heatmap(t.history)


@query("E15_order_heatmap", """
    SELECT l_partkey AS path, count(*) AS count, max(o_orderdate) AS last_accessed FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL ORDER BY count DESC, path LIMIT 200""")
def e15_orders(t):
    joined = t.lineitem.select("l_orderkey", "l_partkey").join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("l_partkey").alias("path")).agg(F.count("*").alias("count"), F.max("o_orderdate").alias("last_accessed")).orderBy(F.desc("count"), "path").limit(200)


_HEALTH_SQL = """
    SELECT n_files, documented, round(coverage, 6) AS coverage, 0.5 AS freshness, round(documentation, 6) AS documentation, activity, round(hallucination, 6) AS hallucination,
      round(({0} * coverage + {1} * 0.5 + {2} * documentation + {3} * activity + {4} * hallucination) * 100, 1) AS score
    FROM (SELECT n_files, documented, (SELECT count(DISTINCT source) FROM documents WHERE doc_id % 3 = 0) / n_files AS coverage, documented / n_files AS documentation,
      least(1.0, (SELECT count(*) FROM events WHERE ts > TIMESTAMP '2024-01-23 00:00:00') / 10) AS activity,
      greatest(0, 1 - (SELECT count(*) FROM events WHERE event_type = 'error') / (SELECT count(*) FROM events)) AS hallucination
      FROM (SELECT count(*) AS n_files, count(*) FILTER (strlen(text) > 500) AS documented FROM documents))"""


def _health(t, weights):
    files = t.documents.select(F.col("doc_id").alias("name"), F.octet_length("text").alias("size"))
    indexed = t.documents.where("doc_id % 3 = 0").select(F.col("source").alias("name"))
    rows = A.health(files, indexed, t.events, t.events.where("event_type = 'error'"), F.lit("2024-01-30 00:00:00"), weights=weights)
    for c in ("coverage", "documentation", "hallucination"):
        rows = rows.withColumn(c, F.round(c, 6))
    return rows


@query("E16_health_score", _HEALTH_SQL.format(0.30, 0.25, 0.20, 0.15, 0.10))
def e16(t):
    return _health(t, A.HEALTH_WEIGHTS)


@query("V6_weighted_health", _HEALTH_SQL.format(0.5, 0.1, 0.2, 0.1, 0.1))
def v6(t):
    return _health(t, {"coverage": 0.5, "freshness": 0.1, "documentation": 0.2, "activity": 0.1, "hallucination": 0.1})


@query("E17_collection_sizes", "SELECT coalesce(collection, 'all') AS collection, count(*) AS n, count(DISTINCT file) AS sources FROM @vectors@ GROUP BY GROUPING SETS ((collection), ())")
def e17(t):
    sizes = t.vectors.groupingSets([["collection"], []], "collection").agg(F.count("*").alias("n"), F.countDistinct("file").alias("sources"))
    return sizes.withColumn("collection", F.coalesce("collection", F.lit("all")))


@query("E18_phase_shares", """
    SELECT id, total_ms, phase, ms, CASE WHEN total_ms > 0 THEN round(ms / total_ms, 6) END AS share FROM (
      SELECT id, CAST(r + g + v AS DOUBLE) AS total_ms, unnest(['retrieve', 'generate', 'validate']) AS phase, CAST(unnest([r, g, v]) AS DOUBLE) AS ms
      FROM (SELECT id, CAST(json_extract(phases, '$.retrieve') AS BIGINT) AS r, CAST(json_extract(phases, '$.generate') AS BIGINT) AS g, CAST(json_extract(phases, '$.validate') AS BIGINT) AS v FROM @history@))""")
def e18(t):
    return H.phase_shares(t.history)


@query("E19_token_breakdown", """
    SELECT id, CAST(round(used * 100 / 32768) AS INTEGER) AS used_pct, CASE WHEN used = 0 THEN NULL WHEN round(used * 100 / 32768) > 80 THEN 'reduce' ELSE 'healthy' END AS advice, segment, tokens, CAST(round(tokens * 100 / 32768) AS INTEGER) AS pct
    FROM (SELECT id, used, unnest(['system', 'context', 'chat_history', 'memory', 'available']) AS segment, unnest([s, c, h, m, greatest(0, 32768 - used)]) AS tokens
      FROM (SELECT *, s + c + h + m AS used FROM (SELECT id, CAST(json_extract(token_usage, '$.system') AS BIGINT) AS s, CAST(json_extract(token_usage, '$.context') AS BIGINT) AS c, CAST(json_extract(token_usage, '$.chat_history') AS BIGINT) AS h, id % 9000 AS m FROM @history@)))""")
def e19(t):
    usage = H.parse_history(t.history).select("id", *[F.col("token_usage")[n].cast("bigint").alias(n) for n in ("system", "context", "chat_history")], (F.col("id") % 9000).alias("memory"))
    return answers.token_breakdown(usage, "id")


@query("E20_repo_shares", "SELECT repo, count(*) AS n, round(count(*) / (SELECT count(*) FROM @vectors@), 6) AS share FROM @vectors@ GROUP BY repo")
def e20(t):
    return A.shares(t.vectors, "repo")


@query("E21_bounding_boxes", """
    SELECT repo, round(min(x) - 0.3, 6) AS x_min, round(max(x) + 0.3, 6) AS x_max, round(min(y) - 0.3, 6) AS y_min, round(max(y) + 0.3, 6) AS y_max
    FROM (SELECT repo, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM @vectors@) GROUP BY repo""")
def e21(t):
    points = t.vectors.select("repo", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    boxes = A.bounding_boxes(points)
    return boxes.select("repo", *[F.round(c, 6).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")])


@query("E21_map_boxes")
def e21_map(t):
    boxes = A.bounding_boxes(map_points(t.vectors)[0])
    return boxes.select("repo", *[F.round(c, 3).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")])


_TODO_TEXT = "concat(text, chr(10), CASE doc_id % 5 WHEN 0 THEN " + text_template("// TODO: check <<lang>>\nx = 1 # FIXME later") + " WHEN 1 THEN " + text_template("HACK around <<doc_id>>") + " ELSE 'fine' END)"


@query("E22_open_work_tracker", rf"""
    SELECT doc_id, n AS line, regexp_extract(l, '\b(TODO|FIXME|HACK|DEPRECATED|XXX)\b', 1) AS kind, trim(regexp_extract(l, '\b(TODO|FIXME|HACK|DEPRECATED|XXX)\b[:\s]*(.*)', 2)) AS remark
    FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS n FROM (SELECT doc_id, string_split({_TODO_TEXT}, chr(10)) AS ls FROM documents)) WHERE regexp_matches(l, '\b(TODO|FIXME|HACK|DEPRECATED|XXX)\b')""")
def e22(t):
    files = t.spark.sql(f"SELECT doc_id, {_TODO_TEXT} AS text FROM {{documents}}", documents=t.documents)
    return A.code_todos(files)


@query("E22_open_work_per_file", rf"""
    SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split({_TODO_TEXT}, chr(10))) AS l FROM documents) WHERE regexp_matches(l, '\b(TODO|FIXME|HACK|DEPRECATED|XXX)\b') GROUP BY ALL""")
def e22_counts(t):
    files = t.spark.sql(f"SELECT doc_id, {_TODO_TEXT} AS text FROM {{documents}}", documents=t.documents)
    return A.code_todos(files).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("E23_file_index", r"""
    SELECT f.*, coalesce(s.n, 0) AS symbol_count, coalesce(c.n, 0) AS chunk_count, c.a AS first_chunk, c.b AS last_chunk FROM (
      SELECT source AS repo, 'file_' || doc_id % 211 AS file, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS line_count, CAST(sum(greatest(1, len(regexp_extract_all(text, '\S+')))) AS BIGINT) AS token_count FROM documents GROUP BY 1, 2) f
    LEFT JOIN (SELECT repo, 'file_' || doc_id % 211 AS file, count(*) AS n FROM @symbols@ GROUP BY ALL) s ON f.repo = s.repo AND f.file = s.file
    LEFT JOIN (SELECT repo, file, count(*) AS n, min(chunk_id) AS a, max(chunk_id) AS b FROM @chunk_rows@ GROUP BY ALL) c ON f.repo = c.repo AND f.file = c.file""")
def e23(t):
    file = F.concat(F.lit("file_"), F.col("doc_id") % 211)
    files = t.documents.select(F.col("source").alias("repo"), file.alias("file"), "text")
    return A.file_index(files, t.symbols.withColumn("file", file), t.chunk_rows)


@query("E27_job_progress", """
    SELECT event_type AS collection, count(*) AS done, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS per_second,
      CAST(floor(greatest(0, 5000 - count(*)) / (count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6))) AS BIGINT) AS eta_s FROM events GROUP BY event_type""")
def e27(t):
    return A.progress(t.events.withColumnRenamed("event_type", "collection"), "collection", 5000)


@query("E29_generation_stats", r"""
    SELECT conv_id, turn, ms, greatest(1, len(regexp_extract_all(text, '\S+'))) AS output_tokens, CASE WHEN ms > 0 THEN round(greatest(1, len(regexp_extract_all(text, '\S+'))) / (ms / 1000), 1) ELSE 0.0 END AS tokens_per_s, ms < 500 AS cache_hit
    FROM (SELECT *, CAST((conv_id * 37 + turn * 211) % 1700 AS DOUBLE) AS ms FROM conversations)""")
def e29(t):
    ms = ((F.col("conv_id") * 37 + F.col("turn") * 211) % 1700).cast("double")
    runs = t.conversations.select(F.struct("conv_id", "turn").alias("k"), ms.alias("ms"), F.col("text").alias("output"))
    return A.generation_stats(runs, "k").select("k.*", "ms", "output_tokens", "tokens_per_s", "cache_hit")


@query("E31_tag_index", f"SELECT tag, doc_id FROM (SELECT doc_id, unnest(string_split({G.tags_sql('text')}, '|')) AS tag FROM @src_files@) WHERE tag <> ''")
def e31(t):
    return A.tag_index(t.src_files, "doc_id", G.tags_of(F.col("text")))


@query("E31_tag_counts", f"SELECT tag, count(*) AS n FROM (SELECT doc_id, unnest(string_split({G.tags_sql('text')}, '|')) AS tag FROM @src_files@) WHERE tag <> '' GROUP BY tag")
def e31_counts(t):
    return A.tag_index(t.src_files, "doc_id", G.tags_of(F.col("text"))).groupBy("tag").agg(F.count("*").alias("n"))


_TAGS = {"articles": ("the ", "le ", "der ", "el "), "plural": ("s ",), "question": ("?",), "caps": ("XX",)}


@query("V7_own_dictionary", f"SELECT doc_id, {G.tags_sql('text', _TAGS)} AS tags FROM documents")
def v7(t):
    found = tagged(t.documents.select("doc_id", "text"), dictionary_of(t.spark, _TAGS), "text")
    return found.select("doc_id", F.array_join("tags", "|").alias("tags"))

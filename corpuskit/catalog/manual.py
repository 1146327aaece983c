"""Manual jobs: blocks, headings, notes, snippets, tables, references."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.catalog import scalars as C
from corpuskit.catalog.inputs import oracle_table
from corpuskit.catalog.registry import query
from corpuskit.functions import tags as G
from corpuskit.plans import manual as M

NOTE_START = " OR ".join(f"starts_with(upper(text), '{p}')" for p in M.X.NOTE_PREFIXES)
oracle_table("blocks", f"""
    SELECT * FROM (SELECT doc, page, block_idx, width, height, size, font, text,
      CASE WHEN kind = 1 OR font IS NULL THEN 'figure_region'
        WHEN font LIKE '%Garamond%' AND size >= 14 THEN 'chapter_heading'
        WHEN font LIKE '%Tahoma%' AND font LIKE '%Bold%' AND size >= 12 THEN 'section_heading'
        WHEN font LIKE '%Tahoma%' AND size >= 11 THEN 'subsection_heading'
        WHEN font LIKE '%Trebuchet%' AND size <= 9 THEN 'code'
        WHEN font LIKE '%Verdana%' AND font LIKE '%Bold%' AND size <= 9 THEN 'table_header'
        WHEN font LIKE '%Arial%' AND font LIKE '%BoldItalic%' AND size <= 9 THEN 'caption'
        WHEN font LIKE '%Arial%' AND size <= 9 THEN 'figure_label'
        WHEN {NOTE_START} THEN 'developer_note' ELSE 'prose' END AS type
    FROM @raw_blocks@)""")
oracle_table("heads", """
    SELECT *, max(CASE WHEN type = 'chapter_heading' AND text <> '' THEN page * 1000000 + block_idx END) OVER w AS ch_at,
      max(CASE WHEN type = 'section_heading' AND text <> '' THEN page * 1000000 + block_idx END) OVER w AS se_at,
      max(CASE WHEN type = 'subsection_heading' AND text <> '' THEN page * 1000000 + block_idx END) OVER w AS su_at,
      last_value(CASE WHEN type = 'chapter_heading' AND text <> '' THEN text END IGNORE NULLS) OVER w AS ch,
      last_value(CASE WHEN type = 'section_heading' AND text <> '' THEN text END IGNORE NULLS) OVER w AS se,
      last_value(CASE WHEN type = 'subsection_heading' AND text <> '' THEN text END IGNORE NULLS) OVER w AS su
    FROM @blocks@ WINDOW w AS (PARTITION BY doc ORDER BY page, block_idx ROWS UNBOUNDED PRECEDING)""")
oracle_table("ctx", """
    SELECT doc, page, block_idx, type, text, width, height, ch AS chapter,
      CASE WHEN se_at > coalesce(ch_at, -1) THEN se END AS section,
      CASE WHEN su_at > coalesce(ch_at, -1) AND su_at > coalesce(se_at, -1) THEN su END AS subsection
    FROM @heads@""")
oracle_table("page_ctx", """
    SELECT doc, page, chapter, section, subsection FROM
      (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY block_idx DESC) AS rn FROM @ctx@) WHERE rn = 1""")


@query("S4_layout_blocks", "SELECT doc, page, block_idx, tag, text FROM @tagged@")
def s4(t):
    return t.tagged


@query("W1_heading_carry_forward", "SELECT doc, page, block_idx, chapter, section, subsection FROM @ctx@")
def w1(t):
    return t.context_blocks.select("doc", "page", "block_idx", "chapter", "section", "subsection")


@query("W2_page_context", "SELECT doc, page, chapter, section, subsection FROM @page_ctx@")
def w2(t):
    return M.page_context(t.context_blocks).drop("chapter_num")


@query("W3_pending_table_header", """
    SELECT doc, page, block_idx, CASE WHEN start_type = 'table_header' THEN start_text END AS table_header
    FROM (SELECT b.*, (SELECT max_by(e.type, e.block_idx) FROM @blocks@ e WHERE e.doc = b.doc AND e.page = b.page AND e.block_idx < b.block_idx
                       AND e.type IN ('table_header', 'caption', 'chapter_heading', 'section_heading', 'subsection_heading')) AS start_type,
                 (SELECT max_by(e.text, e.block_idx) FROM @blocks@ e WHERE e.doc = b.doc AND e.page = b.page AND e.block_idx < b.block_idx
                       AND e.type IN ('table_header', 'caption', 'chapter_heading', 'section_heading', 'subsection_heading')) AS start_text
          FROM @blocks@ b WHERE b.type = 'code')""")
def w3(t):
    return M.pending_table_header(t.blocks).where("type = 'code'").select("doc", "page", "block_idx", "table_header")


@query("W4_caption_attach", """
    WITH hosts AS (SELECT * FROM @blocks@ WHERE type IN ('figure_region', 'table_header', 'code')),
    caps AS (SELECT c.doc, c.page, c.block_idx, c.text, max(h.block_idx) AS host FROM @blocks@ c JOIN hosts h
             ON c.doc = h.doc AND c.page = h.page AND h.block_idx < c.block_idx WHERE c.type = 'caption' GROUP BY ALL),
    labs AS (SELECT c.doc, c.page, c.block_idx, c.text, max(h.block_idx) AS host FROM @blocks@ c JOIN hosts h
             ON c.doc = h.doc AND c.page = h.page AND h.block_idx < c.block_idx AND h.type = 'figure_region' WHERE c.type = 'figure_label' GROUP BY ALL),
    cap1 AS (SELECT doc, page, host, max_by(text, block_idx) AS caption FROM caps GROUP BY ALL),
    lab1 AS (SELECT doc, page, host, string_agg(text, '|' ORDER BY block_idx) AS labels FROM labs GROUP BY ALL)
    SELECT h.doc, h.page, h.block_idx, h.type, caption, labels FROM hosts h
      LEFT JOIN cap1 c ON h.doc = c.doc AND h.page = c.page AND h.block_idx = c.host
      LEFT JOIN lab1 l ON h.doc = l.doc AND h.page = l.page AND h.block_idx = l.host""")
def w4(t):
    labels = F.nullif(F.array_join("labels", "|"), F.lit(""))
    return M.attach_captions(t.blocks).withColumn("labels", labels)


@query("W5_page_ordinals", """
    SELECT doc, page, block_idx, type, row_number() OVER (PARTITION BY doc, page, type ORDER BY block_idx) - 1 AS ordinal
    FROM @blocks@ WHERE type IN ('figure_region', 'table_header', 'code')""")
def w5(t):
    return M.page_ordinals(t.blocks).select("doc", "page", "block_idx", "type", "ordinal")


oracle_table("snip_marks", r"""
    SELECT doc, page, block_idx, type, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text,
      sum(CASE WHEN type IN ('table_header', 'caption', 'chapter_heading', 'section_heading', 'subsection_heading') THEN 1 ELSE 0 END) OVER w AS grp
    FROM @blocks@ WINDOW w AS (PARTITION BY doc, page ORDER BY block_idx ROWS UNBOUNDED PRECEDING)""")
oracle_table("snips", """
    SELECT c.doc, c.page, c.grp, c.content, CASE WHEN o.type = 'table_header' THEN o.text END AS table_header,
           CASE WHEN k.type = 'caption' THEN k.text END AS caption
    FROM (SELECT doc, page, grp, string_agg(text, chr(10) ORDER BY block_idx) AS content FROM @snip_marks@ WHERE type = 'code' GROUP BY ALL) c
    LEFT JOIN (SELECT * FROM @snip_marks@ WHERE type IN ('table_header', 'caption', 'chapter_heading', 'section_heading', 'subsection_heading')) o
      ON c.doc = o.doc AND c.page = o.page AND c.grp = o.grp
    LEFT JOIN (SELECT * FROM @snip_marks@ WHERE type IN ('table_header', 'caption', 'chapter_heading', 'section_heading', 'subsection_heading')) k
      ON c.doc = k.doc AND c.page = k.page AND c.grp + 1 = k.grp""")


@query("W6_snippet_groups", "SELECT doc, page, content, table_header, caption FROM @snips@")
def w6(t):
    return M.snippet_groups(t.blocks).drop("grp")


oracle_table("tab_groups", r"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY grp) AS n FROM (
      SELECT doc, page, grp, max(CASE WHEN type = 'table_header' THEN text END) AS header, max(CASE WHEN type = 'caption' THEN text END) AS caption,
             list(text ORDER BY block_idx) FILTER (type = 'code') AS row_texts
      FROM (SELECT *, sum(CASE WHEN type = 'table_header' OR prev = 'caption' THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY block_idx ROWS UNBOUNDED PRECEDING) AS grp
            FROM (SELECT doc, page, block_idx, type, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, lag(type) OVER (PARTITION BY doc, page ORDER BY block_idx) AS prev
                  FROM @blocks@ WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''))
      GROUP BY ALL) WHERE row_texts IS NOT NULL OR caption IS NOT NULL) WHERE row_texts IS NOT NULL""")


@query("W7_table_groups", "SELECT doc, page, n, header, caption, array_to_string(row_texts, '#') AS row_texts FROM @tab_groups@")
def w7(t):
    return M.table_groups(t.blocks).select("doc", "page", "n", "header", "caption", F.array_join("row_texts", "#").alias("row_texts"))


oracle_table("notes", rf"""
    SELECT doc, page, block_idx, text AS full_text, row_number() OVER (PARTITION BY doc ORDER BY page, block_idx) AS note_no,
           {C.note_type_sql('text')} AS note_type, {C.note_body_sql('text')} AS content
    FROM (SELECT doc, page, block_idx, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM @blocks@ WHERE type = 'developer_note')
    WHERE length(text) >= 10""")


@query("W8_sequence_ids", "SELECT doc, page, block_idx, 'N' || page || '.' || note_no AS note_id FROM @notes@")
def w8(t):
    return M.extract_notes(t.block_table).select("doc", "page", "block_idx", "note_id")


SLUG_SQL = (r"substr(array_to_string(list_filter(regexp_split_to_array(regexp_replace({0}, '[^a-zA-Z0-9\s]', '', 'g'), '\s+'), lambda w: w <> '')[1:6], '_'), 1, 50)")


@query("X3_note_extraction", f"""
    SELECT n.doc, n.page, 'N' || n.page || '.' || note_no AS note_id, note_type, content, full_text,
           'TRM_Note__N' || n.page || '.' || note_no || '_' || {SLUG_SQL.format('content')} || '.md' AS vault_note,
           {G.tags_sql('full_text', G.NOTE_TAGS)} AS hardware, array_to_string({C.code_mentions_sql('full_text')}, '|') AS mentions, chapter, section
    FROM @notes@ n LEFT JOIN @page_ctx@ p ON n.doc = p.doc AND n.page = p.page""")
def x3(t):
    return M.extract_notes(t.block_table).select(
        "doc", "page", "note_id", "note_type", "content", "full_text", "vault_note", F.array_join("hardware_mentions", "|").alias("hardware"),
        F.array_join("code_mentions", "|").alias("mentions"), "chapter", "section")


oracle_table("snippets", rf"""
    SELECT s.doc, s.page, 'C' || s.page || '.' || row_number() OVER (PARTITION BY s.doc, s.page ORDER BY grp) AS snippet_id, content, table_header, caption, chapter, section,
      {C.language_sql('content')} AS language, array_to_string({C.STRUCT_NAMES_SQL.format('content')}, '|') AS struct_names,
      {C.WORDS_SQL.format('content')} AS token_count, split_part({C.STRIP_SQL.format('content')}, chr(10), 1) AS line
    FROM @snips@ s LEFT JOIN @page_ctx@ p ON s.doc = p.doc AND s.page = p.page
    WHERE length({C.STRIP_SQL.format('content')}) >= 5 AND {C.WORDS_SQL.format('content')} >= 3""")


@query("X4_snippet_extraction", r"""
    SELECT doc, page, snippet_id, content, table_header, caption, chapter, section, language, struct_names, token_count,
      nullif(CASE language WHEN 'c' THEN regexp_extract(line, '^(?:\w[\w\s*]+\s+)(\w+)\s*\(', 1) WHEN 'go' THEN regexp_extract(line, '^func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\(', 1)
        WHEN 'python' THEN regexp_extract(line, '^def\s+(\w+)\s*\(', 1) END, '') AS function_name
    FROM @snippets@""")
def x4(t):
    return M.extract_snippets(t.block_table).select(
        "doc", "page", "snippet_id", "content", "table_header", "caption", "chapter", "section", "language",
        F.array_join("struct_names", "|").alias("struct_names"), "token_count", "function_name")


oracle_table("manual_tables", f"""
    SELECT doc, page, 'T' || page || '.' || n AS table_id, caption, headers, row_texts, chapter, section,
      list_transform(row_texts, lambda r: {C.row_cells_sql('headers', 'r')}) AS rows,
      coalesce(header, '') || ' ' || array_to_string(row_texts, ' ') || ' ' || coalesce(caption, '') AS everything
    FROM (SELECT g.*, p.chapter, p.section, {C.HEADERS_SQL.format('g.header')} AS headers FROM @tab_groups@ g LEFT JOIN @page_ctx@ p ON g.doc = p.doc AND g.page = p.page)""")


@query("X5_table_extraction", rf"""
    SELECT doc, page, table_id, caption, array_to_string(headers, '#') AS headers, chapter, section,
      array_to_string(list_transform(rows, lambda r: array_to_string(list_transform(list_filter(r, lambda c: regexp_replace(c.value, '^\s+|\s+$', '', 'g') <> ''), lambda c: c.key || ': ' || c.value), '. ')), ' | ') AS structured_text,
      {G.tags_sql('everything', G.TABLE_TAGS)} AS hardware, {C.WORDS_SQL.format('everything')} AS token_count
    FROM @manual_tables@""")
def x5(t):
    return M.extract_tables(t.block_table).select(
        "doc", "page", "table_id", "caption", F.array_join("headers", "#").alias("headers"), "chapter", "section", "structured_text",
        F.array_join("hardware_components", "|").alias("hardware"), "token_count")


oracle_table("ref_pages", f"""
    SELECT doc, r.ref_type AS ref_type, r.identifier AS identifier, page, count(*) AS mentions
    FROM (SELECT doc, page, unnest({C.references_sql('text')}) AS r FROM @blocks@
          WHERE type IN ('prose', 'developer_note', 'subsection_heading', 'section_heading')) GROUP BY ALL""")
oracle_table("ref_targets", r"""
    SELECT doc, ref_type, identifier, max(page) AS target_page FROM (
      SELECT doc, 'section' AS ref_type, regexp_extract(section, '^(\d+\.[\d.]*)', 1) AS identifier, page FROM @page_ctx@
      UNION ALL SELECT doc, 'figure', regexp_extract(text, '^[Ff]igure\s+(\d+)', 1), page FROM @blocks@ WHERE type = 'caption'
      UNION ALL SELECT doc, 'table', regexp_extract(text, '^[Tt]able\s+(\d+)', 1), page FROM @blocks@ WHERE type = 'caption')
    WHERE identifier <> '' GROUP BY ALL""")


@query("E4_reference_rollup", """
    SELECT doc, ref_type, identifier, CAST(sum(mentions) AS BIGINT) AS mention_count, count(*) AS source_pages, min(page) AS first_page FROM @ref_pages@ GROUP BY ALL""")
def e4(t):
    return M.reference_mentions(t.blocks).groupBy("doc", "ref_type", "identifier").agg(
        F.sum("mentions").alias("mention_count"), F.count("*").alias("source_pages"), F.min("page").alias("first_page"))


@query("E4_reference_source_pages", "SELECT doc, ref_type, identifier, page, mentions FROM @ref_pages@")
def e4_pages(t):
    return M.reference_mentions(t.blocks)


@query("J10_reference_targets", """
    SELECT r.doc, r.ref_type, r.identifier, r.page, g.target_page FROM @ref_pages@ r LEFT JOIN @ref_targets@ g
      ON r.doc = g.doc AND r.ref_type = g.ref_type AND r.identifier = g.identifier""")
def j10(t):
    targets = M.reference_targets(t.block_table)
    return M.reference_mentions(t.block_table).join(targets, ["doc", "ref_type", "identifier"], "left").select(
        "doc", "ref_type", "identifier", "page", "target_page")


@query("X6_cross_reference_map", f"""
    SELECT r.doc, r.ref_type, r.identifier, CAST(sum(mentions) AS BIGINT) AS mention_count, count(*) AS source_pages, min(page) AS first_page, any_value(target_page) AS target_page,
      {C.REF_NOTE_SQL.format('r.ref_type', 'r.identifier')} AS vault_note
    FROM @ref_pages@ r LEFT JOIN @ref_targets@ g ON r.doc = g.doc AND r.ref_type = g.ref_type AND r.identifier = g.identifier GROUP BY r.doc, r.ref_type, r.identifier""")
def x6(t):
    return M.cross_references(t.block_table)


IMAGES_SQL = "SELECT doc, page, block_idx, block_idx AS image_idx, width, height FROM @blocks@ WHERE type = 'figure_region'"


def _images(t):
    return t.block_table.where("type = 'figure_region'").select("doc", "page", "block_idx", F.col("block_idx").alias("image_idx"), "width", "height")


oracle_table("figures", f"""
    SELECT i.doc, i.page, image_idx, coalesce(c.text, '') AS caption, p.chapter, p.section FROM
      (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY block_idx) AS n FROM ({IMAGES_SQL}) WHERE width >= 50 AND height >= 50) i
      LEFT JOIN (SELECT doc, page, text, row_number() OVER (PARTITION BY doc, page ORDER BY block_idx) AS n FROM @blocks@
                 WHERE type = 'caption' AND (starts_with(text, 'Figure') OR starts_with(text, 'Fig.'))) c ON i.doc = c.doc AND i.page = c.page AND i.n = c.n
      LEFT JOIN @page_ctx@ p ON i.doc = p.doc AND i.page = p.page""")


@query("X7_figure_captions", "SELECT doc, page, 'Fig_' || page || '_' || image_idx AS figure_id, caption, chapter, section FROM @figures@")
def x7(t):
    return M.figure_captions(_images(t), t.block_table).select("doc", "page", "figure_id", "caption", "chapter", "section")


@query("J11_page_context_join", """
    SELECT g.doc, g.page, g.n, p.chapter, p.section, p.subsection FROM @tab_groups@ g LEFT JOIN @page_ctx@ p ON g.doc = p.doc AND g.page = p.page""")
def j11(t):
    context = M.page_context(t.block_table).drop("chapter_num")
    return M.table_groups(t.block_table).select("doc", "page", "n").join(context, ["doc", "page"], "left")


@query("J12_ordinal_caption_join", "SELECT doc, page, image_idx, caption FROM @figures@")
def j12(t):
    return M.figure_captions(_images(t), t.block_table).select("doc", "page", "image_idx", "caption")


@query("E1_block_type_counts", "SELECT type, count(*) AS n FROM @blocks@ GROUP BY type")
def e1(t):
    return t.blocks.groupBy("type").agg(F.count("*").alias("n"))


@query("E3_note_and_reference_counts", """
    SELECT 'note' AS what, note_type AS kind, count(*) AS n FROM @notes@ GROUP BY ALL
    UNION ALL SELECT 'reference', ref_type, count(*) FROM (SELECT DISTINCT doc, ref_type, identifier FROM @ref_pages@) GROUP BY ALL""")
def e3(t):
    notes = M.extract_notes(t.block_table).groupBy("note_type").count().select(
        F.lit("note").alias("what"), F.col("note_type").alias("kind"), F.col("count").alias("n"))
    refs = M.reference_mentions(t.block_table).select("doc", "ref_type", "identifier").distinct().groupBy("ref_type").count()
    return notes.unionByName(refs.select(F.lit("reference").alias("what"), F.col("ref_type").alias("kind"), F.col("count").alias("n")))


@query("E12_chapter_rollup", """
    SELECT doc, coalesce(nullif(chapter, ''), 'Uncategorized') AS chapter, min(page) AS page_start, max(page) AS page_end, count(*) AS pages,
           count(DISTINCT nullif(section, '')) AS section_count FROM @page_ctx@ GROUP BY ALL""")
def e12(t):
    return M.chapter_rollup(M.page_context(t.context_blocks))


@query("E12_chapter_sections", """
    SELECT doc, coalesce(nullif(chapter, ''), 'Uncategorized') AS chapter, section, min(page) AS first_page FROM @page_ctx@
    WHERE coalesce(section, '') <> '' GROUP BY ALL""")
def e12_sections(t):
    return M.chapter_sections(M.page_context(t.context_blocks))

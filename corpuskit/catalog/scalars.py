"""Scalar functions and predicates (F*, P*) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.catalog.inputs import text_template
from corpuskit.catalog.registry import query
from corpuskit.functions import extract as X
from corpuskit.functions import formats as M
from corpuskit.functions import tags as G
from corpuskit.functions import text as S
from corpuskit.plans import history as H

WORDS_SQL = "len(regexp_extract_all({0}, '\\S+'))"
STRIP_SQL = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query("F1_normalize_identifier", r"""
    SELECT doc_id, regexp_replace(lower(name || '-' || file), '[_\-\s]+', '', 'g') AS norm FROM @symbols@""")
def f1(t):
    return t.symbols.select("doc_id", S.normalize_identifier(F.concat("name", F.lit("-"), "file")).alias("norm"))


@query("F2_slugs", r"""
    SELECT doc_id,
      substr(array_to_string(list_filter(regexp_split_to_array(regexp_replace(text, '[^a-zA-Z0-9\s]', '', 'g'), '\s+'), lambda w: w <> '')[1:6], '_'), 1, 50) AS slug_words,
      substr(regexp_replace(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s\-]', '', 'g'), '^\s+|\s+$', '', 'g'), '\s+', '_', 'g'), 1, 80) AS slug_path,
      replace(replace('a/' || source || '.' || lang, '/', '__'), '.', '_') AS slug_file
    FROM documents""")
def f2(t):
    return t.documents.select(
        "doc_id", S.slug_words(F.col("text")).alias("slug_words"), S.slug_path(F.col("text")).alias("slug_path"),
        S.slug_file(F.concat(F.lit("a/"), "source", F.lit("."), "lang")).alias("slug_file"))


@query("F3_content_hash", """
    SELECT doc_id, substr(sha256(text || source || CAST(doc_id AS VARCHAR)), 1, 16) AS chunk_id,
           'trm_note_' || substr(sha256(text), 1, 16) AS note_id, sha256(text) AS cache_key FROM documents""")
def f3(t):
    c = F.col
    return t.documents.select(
        "doc_id", S.content_hash(c("text"), c("source"), c("doc_id").cast("string")).alias("chunk_id"),
        S.content_hash(c("text"), prefix="trm_note_").alias("note_id"), S.full_hash(c("text")).alias("cache_key"))


@query("F4_token_count", rf"SELECT doc_id, greatest(1, {WORDS_SQL.format('text')}) AS tokens FROM documents")
def f4(t):
    return t.documents.select("doc_id", S.token_count(F.col("text")).alias("tokens"))


@query("F5_estimated_tokens", "SELECT doc_id, CAST(floor(length(text) / 3.5) AS INTEGER) AS tokens FROM documents")
def f5(t):
    return t.documents.select("doc_id", S.estimated_tokens(F.col("text")).alias("tokens"))


STOP_SQL = "(" + ", ".join(f"'{w}'" for w in S.CLONE_STOP_WORDS) + ")"


@query("F6_tokenizers", rf"""
    SELECT doc_id,
      len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}')), lambda w: w NOT IN {STOP_SQL})) AS n_clone,
      array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}')), lambda w: w NOT IN {STOP_SQL}))[1:5], ' ') AS first_clone,
      len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS n_search,
      len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS n_ascii,
      {WORDS_SQL.format('text')} AS n_words
    FROM documents""")
def f6(t):
    c = F.col("text")
    clone = S.clone_tokens(c)
    return t.documents.select(
        "doc_id", F.size(clone).alias("n_clone"), F.array_join(F.slice(F.sort_array(clone), 1, 5), " ").alias("first_clone"),
        F.size(S.search_tokens(c)).alias("n_search"), F.size(S.ascii_tokens(c)).alias("n_ascii"),
        S.word_count(c).alias("n_words"))


@query("F7_dictionary_tags", f"""
    SELECT doc_id, {G.tags_sql("text")} AS code_tags, {G.tags_sql("text", G.TABLE_TAGS)} AS table_tags,
           {G.tags_sql("text", G.NOTE_TAGS)} AS note_tags FROM @src_files@""")
def f7(t):
    c = F.col("text")
    return t.src_files.select(
        "doc_id", F.array_join(G.tags_of(c), "|").alias("code_tags"),
        F.array_join(G.tags_of(c, G.TABLE_TAGS), "|").alias("table_tags"),
        F.array_join(G.tags_of(c, G.NOTE_TAGS), "|").alias("note_tags"))


def _contains_sql(column, needles):
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in needles) + ")"


def language_sql(column, hints=X.LANGUAGE_HINTS):
    whens = []
    for lang, needles in hints:
        extra = f" AND NOT contains({column}, '=>')" if lang == "python" else ""
        whens.append(f"WHEN {_contains_sql(column, needles)}{extra} THEN '{lang}'")
    return (f"CASE {' '.join(whens)} WHEN regexp_matches({STRIP_SQL.format(column)}, '^\\d+\\s+\\d+\\s+\\w+') "
            "THEN 'c_struct' ELSE 'unknown' END")


@query("F8_language_hint", f"""
    SELECT doc_id, {language_sql('text')} AS language, {language_sql('text', X.SCAN_LANGUAGE_HINTS)} AS scan_hint,
           {language_sql("(doc_id || '  ' || doc_id || ' ' || body)")} AS prose_language
    FROM (SELECT s.doc_id, s.text, d.text AS body FROM @src_files@ s JOIN documents d ON s.doc_id = d.doc_id)""")
def f8(t):
    files = t.src_files.select("doc_id", "text").join(t.documents.select("doc_id", F.col("text").alias("body")), "doc_id")
    prose = F.concat("doc_id", F.lit("  "), "doc_id", F.lit(" "), "body")
    return files.select("doc_id", X.language_of(F.col("text")).alias("language"),
                        X.language_of(F.col("text"), X.SCAN_LANGUAGE_HINTS).alias("scan_hint"),
                        X.language_of(prose).alias("prose_language"))


# every document as a snippet that starts with a function of one of three languages
_SNIPPET = ("CASE doc_id % 4 WHEN 0 THEN " + text_template("static int read_<<doc_id % 9>>(void) {\n<<text>>") +
            " WHEN 1 THEN " + text_template("func (s *Store) Load<<doc_id % 7>>(x int) {\n<<text>>") +
            " WHEN 2 THEN " + text_template("def run_<<doc_id>>(a):\n<<text>>") +
            " ELSE " + text_template("typedef struct st_<<doc_id % 5>> { A_REG } struct B_<<doc_id>> { <<text>>") + " END")
_SNIPPETS = (f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'c' WHEN 1 THEN 'go' WHEN 2 THEN 'python' ELSE 'c' END AS language, "
             f"{_SNIPPET} AS text FROM documents")


def _snippets(t):
    return t.spark.sql(_SNIPPETS.replace("FROM documents", "FROM {documents}"), documents=t.documents)


@query("F9_function_name", rf"""
    SELECT doc_id, nullif(CASE language
        WHEN 'c' THEN regexp_extract(line, '^(?:\w[\w\s*]+\s+)(\w+)\s*\(', 1)
        WHEN 'go' THEN regexp_extract(line, '^func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\(', 1)
        ELSE regexp_extract(line, '^def\s+(\w+)\s*\(', 1) END, '') AS function_name
    FROM (SELECT *, split_part({STRIP_SQL.format('text')}, chr(10), 1) AS line FROM ({_SNIPPETS}))""")
def f9(t):
    return _snippets(t).select("doc_id", X.function_name(F.col("text"), F.col("language")).alias("function_name"))


# RE2 word boundaries are ASCII only, so accented letters stand in as ``z``
ASCII_SQL = "regexp_replace({0}, '[À-ÖØ-öø-ÿ]', 'z', 'g')"
STRUCT_NAMES_SQL = (r"list_sort(list_distinct(list_concat(list_concat(regexp_extract_all({0}, 'typedef\s+struct\s+(\w+)', 1), "
                    r"regexp_extract_all({0}, 'struct\s+(\w+)\s*\{{', 1)), regexp_extract_all(" + ASCII_SQL + r", '\b([A-Z][A-Z_]{{2,}})\b', 1))))[1:10]")


@query("F10_struct_names", f"""
    SELECT doc_id, array_to_string({STRUCT_NAMES_SQL.format('text')}, '|') AS names FROM ({_SNIPPETS})""")
def f10(t):
    return _snippets(t).select("doc_id", F.array_join(X.struct_names(F.col("text")), "|").alias("names"))


def code_mentions_sql(column):
    calls = rf"regexp_extract_all({column}, '[\p{{L}}\p{{N}}_]+_[\p{{L}}\p{{N}}_]+\s*\(')"
    lists = ", ".join([calls] + [f"regexp_extract_all({ASCII_SQL.format(column)}, '{p}')" for p in X.CODE_MENTION_PATTERNS[1:]])
    return (f"list_sort(list_distinct(list_transform(flatten([{lists}]), "
            "lambda m: regexp_replace(m, '^\\s+|\\s+$', '', 'g'))))[1:10]")


@query("F11_code_mentions", f"""
    SELECT doc_id, array_to_string({code_mentions_sql('text')}, '|') AS mentions FROM ({_SNIPPETS})
    UNION ALL SELECT page * 1000 + block_idx, array_to_string({code_mentions_sql('text')}, '|') FROM @raw_blocks@""")
def f11(t):
    rows = _snippets(t).select("doc_id", "text").unionByName(
        t.raw_blocks.select((F.col("page") * 1000 + F.col("block_idx")).alias("doc_id"), "text"))
    return rows.select("doc_id", F.array_join(X.code_mentions(F.col("text")), "|").alias("mentions"))


def note_type_sql(column):
    return "CASE " + " ".join(f"WHEN starts_with(upper({column}), '{p}') THEN '{p[:-1].replace(' ', '_')}'"
                              for p in X.NOTE_PREFIXES) + " ELSE 'NOTE' END"


def note_body_sql(column):
    return "CASE " + " ".join(
        f"WHEN starts_with(upper({column}), '{p}') THEN {STRIP_SQL.format(f'substr({column}, {len(p) + 1})')}"
        for p in X.NOTE_PREFIXES) + f" ELSE {column} END"


@query("F12_note_type", f"""
    SELECT doc, page, block_idx, {note_type_sql('text')} AS note_type, {note_body_sql('text')} AS body FROM @raw_blocks@""")
def f12(t):
    c = F.col("text")
    return t.raw_blocks.select("doc", "page", "block_idx", X.note_type(c).alias("note_type"), X.note_body(c).alias("body"))


@query("F13_block_type", "SELECT doc, page, block_idx, type FROM @blocks@")
def f13(t):
    return t.raw_blocks.select("doc", "page", "block_idx", X.block_type(
        F.col("kind"), F.col("font"), F.col("size"), F.col("text")).alias("type"))


@query("F14_chapter_number", r"""
    SELECT page, block_idx, CAST(coalesce(nullif(regexp_extract(lower(h), 'chapter\s+(\d+)', 1), ''),
        nullif(regexp_extract(h, 'C\s*H\s*A\s*P\s*T\s*E\s*R\s+(\d+)', 1), '')) AS INTEGER) AS chapter_num
    FROM (SELECT page, block_idx, CASE WHEN page % 2 = 0 THEN text ELSE replace(text, 'Chapter', 'C H A P T E R') END AS h
          FROM @raw_blocks@)""")
def f14(t):
    spaced = F.replace(F.col("text"), F.lit("Chapter"), F.lit("C H A P T E R"))
    heading = F.when(F.col("page") % 2 == 0, F.col("text")).otherwise(spaced)
    return t.raw_blocks.select("page", "block_idx", X.chapter_number(heading).alias("chapter_num"))


CELLS_SQL = "list_transform(regexp_split_to_array({0}, '\\s{{2,}}'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))"
HEADERS_SQL = "list_filter(" + CELLS_SQL.replace("{0}", "coalesce({0}, '')") + ", lambda h: h <> '')"


def row_cells_sql(headers, row):
    """SQL list of {key, value} for one table row."""
    cells = CELLS_SQL.format(row)
    return (f"CASE WHEN len({headers}) > 1 AND len({cells}) >= len({headers}) - 1 THEN "
            f"list_transform({headers}, lambda h, i: {{'key': h, 'value': coalesce({cells}[i], '')}}) "
            f"ELSE [{{'key': 'data', 'value': {row}}}] END")


@query("F15_row_cells", f"""
    SELECT page, block_idx, array_to_string(list_transform(cells, lambda c: c.key || '=' || c.value), ';') AS cells
    FROM (SELECT page, block_idx, {row_cells_sql('headers', 'text')} AS cells
          FROM (SELECT page, block_idx, text, {HEADERS_SQL.format("'Name  Value  ' || CASE WHEN page % 3 = 0 THEN 'Extra  More  Yet' ELSE 'Note' END")} AS headers
                FROM @raw_blocks@))""")
def f15(t):
    head = F.concat(F.lit("Name  Value  "), F.when(F.col("page") % 3 == 0, "Extra  More  Yet").otherwise("Note"))
    rows = t.raw_blocks.withColumn("headers", X.table_headers(head))
    cells = F.transform(X.row_cells(F.col("headers"), F.col("text")),
                        lambda c: F.concat(c["key"], F.lit("="), c["value"]))
    return rows.select("page", "block_idx", F.array_join(cells, ";").alias("cells"))


@query("F16_table_text", f"""
    SELECT page, block_idx, array_to_string(list_transform(list_filter(cells, lambda c: regexp_replace(c.value, '^\\s+|\\s+$', '', 'g') <> ''), lambda c: c.key || ': ' || c.value), '. ')
        || ' | ' || array_to_string(list_transform(list_filter(cells, lambda c: regexp_replace(c.value, '^\\s+|\\s+$', '', 'g') <> ''), lambda c: c.key || ': ' || c.value), '. ') AS line
    FROM (SELECT page, block_idx, {row_cells_sql('headers', 'text')} AS cells
          FROM (SELECT page, block_idx, text, {HEADERS_SQL.format("'Name  Value'")} AS headers FROM @raw_blocks@))""")
def f16(t):
    rows = t.raw_blocks.withColumn("headers", X.table_headers(F.lit("Name  Value")))
    cells = X.row_cells(F.col("headers"), F.col("text"))
    return rows.select("page", "block_idx", X.table_text(F.array(cells, cells)).alias("line"))


LABEL_SQL = ("CASE WHEN {0} >= 0.95 THEN 'exact_copy' WHEN {0} >= 0.80 THEN 'near_identical_fork' "
             "WHEN {0} >= 0.60 THEN 'fork_with_modifications' ELSE 'different' END")


@query("F17_similarity_label", f"SELECT l_orderkey, l_linenumber, {LABEL_SQL.format('(l_quantity / 50.0)')} AS label FROM lineitem")
def f17(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", S.similarity_label(F.col("l_quantity") / 50.0).alias("label"))


_ANSWER = text_template('Sure: <<substr(text, 1, 5)>> {"summary": "k<<doc_id>>", "complexity": "low"} done {"summary": "x"}')
_ANSWERS = (f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {_ANSWER} WHEN 1 THEN "
            + text_template('{"summary": "whole<<doc_id>>", "complexity": "high"}') +
            " ELSE replace(replace(text, chr(123), ' '), chr(125), ' ') END AS answer FROM documents")


@query("F18_json_from_text", rf"""
    SELECT doc_id, CASE WHEN json_valid(obj) THEN json_extract_string(obj, '$.summary') END AS summary,
           CASE WHEN json_valid(obj) THEN json_extract_string(obj, '$.complexity') END AS complexity
    FROM (SELECT doc_id, CASE WHEN regexp_extract(answer, '\{{[^{{}}]+\}}') <> '' THEN regexp_extract(answer, '\{{[^{{}}]+\}}') ELSE answer END AS obj
          FROM ({_ANSWERS}))""")
def f18(t):
    rows = t.spark.sql(_ANSWERS.replace("FROM documents", "FROM {documents}"), documents=t.documents)
    parsed = F.from_json(M.json_object_in(F.col("answer")), "summary string, complexity string")
    return rows.select("doc_id", parsed.alias("j")).select("doc_id", "j.summary", "j.complexity")


@query("F19_json_columns", """
    SELECT id, CAST(json_extract(phases, '$.retrieve') AS BIGINT) AS retrieve_ms, CAST(json_extract(token_usage, '$.context') AS BIGINT) AS context_tokens,
           coalesce(json_array_length(sources), 0) AS n_sources, json_extract_string(sources, '$[0].filename') AS first_source
    FROM @history@""")
def f19(t):
    parsed = H.parse_history(t.history)
    return parsed.select(
        "id", F.col("phases")["retrieve"].cast("bigint").alias("retrieve_ms"),
        F.col("token_usage")["context"].cast("bigint").alias("context_tokens"),
        F.coalesce(F.nullif(F.size("sources"), F.lit(-1)), F.lit(0)).alias("n_sources"),
        F.get("sources", 0)["filename"].alias("first_source"))


@query("F20_frontmatter", """
    SELECT doc_id, '---' || chr(10) || 'title: "' || replace(title, '"', chr(92) || '"') || '"' || chr(10) || 'n: ' || n_chars || chr(10)
        || CASE WHEN doc_id % 2 = 0 THEN 'tags:' || chr(10) || '  - ' || lang || chr(10) || '  - ' || source ELSE 'tags: []' END
        || chr(10) || '---' || chr(10) AS head
    FROM (SELECT *, 'The "' || substr(text, 1, 40) || '"' AS title FROM documents)""")
def f20(t):
    title = F.concat(F.lit('The "'), F.substring("text", 1, 40), F.lit('"'))
    tags = F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    return t.documents.select("doc_id", M.frontmatter(title=title, n=(F.col("n_chars"),), tags=[tags]).alias("head"))


@query("F21_citations", r"""
    SELECT gen_id, array_to_string(regexp_extract_all(generation, '\[\[([^\]|#]+)', 1), ',') AS cited FROM @generations@""")
def f21(t):
    return t.generations.select("gen_id", F.array_join(X.citations(F.col("generation")), ",").alias("cited"))


def references_sql(column):
    lists = ", ".join(f"list_transform(regexp_extract_all({column}, '{p}', 1), lambda x: {{'ref_type': '{k}', 'identifier': x}})"
                      for p, k in X.REFERENCE_PATTERNS)
    return f"flatten([{lists}])"


@query("F22_references", f"""
    SELECT page, block_idx, r.ref_type AS ref_type, r.identifier AS identifier, count(*) AS n
    FROM (SELECT page, block_idx, unnest({references_sql('text')}) AS r FROM @raw_blocks@) GROUP BY ALL""")
def f22(t):
    refs = t.raw_blocks.select("page", "block_idx", F.explode(X.references(F.col("text"))).alias("r"))
    return refs.groupBy("page", "block_idx", F.col("r.ref_type").alias("ref_type"),
                        F.col("r.identifier").alias("identifier")).agg(F.count("*").alias("n"))


REF_NOTE_SQL = ("CASE {0} WHEN 'section' THEN 'TRM_Ch_Sec' || replace({1}, '.', '_') WHEN 'figure' THEN 'TRM_Figure__Fig_' || {1} "
                "WHEN 'table' THEN 'TRM_Table__T' || {1} WHEN 'chapter' THEN 'TRM_Ch' || CASE WHEN length({1}) < 2 THEN lpad({1}, 2, '0') ELSE {1} END "
                "ELSE 'TRM_' || {0} || '_' || {1} END")


@query("F23_reference_note", f"""
    SELECT DISTINCT r.ref_type AS ref_type, r.identifier AS identifier, {REF_NOTE_SQL.format('r.ref_type', 'r.identifier')} AS note
    FROM (SELECT unnest({references_sql('text')}) AS r FROM @raw_blocks@)""")
def f23(t):
    refs = t.raw_blocks.select(F.explode(X.references(F.col("text"))).alias("r")).select("r.*").distinct()
    return refs.withColumn("note", X.reference_note(F.col("ref_type"), F.col("identifier")))


@query("F24_days_between", """
    SELECT o_orderkey, round((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-06-17 12:00:00')) / 86400e6, 1) AS days FROM orders""")
def f24(t):
    since = F.lit("1995-06-17 12:00:00").cast("timestamp_ntz")
    return t.orders.select("o_orderkey", F.round(M.days_between(F.col("o_orderdate"), since), 1).alias("days"))


@query("F25_recent", "SELECT event_id, ts > TIMESTAMP '2024-01-23 00:00:00' AS recent FROM events")
def f25(t):
    return t.events.select("event_id", H.recent(F.col("ts"), F.lit("2024-01-30 00:00:00"), 7).alias("recent"))


@query("F26_repo_from_name", """
    SELECT vec_id, CASE WHEN contains(n, '__') THEN split_part(n, '__', 1) ELSE 'unknown' END AS repo
    FROM (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN symbol_name WHEN vec_id % 3 = 1 THEN file ELSE file || '__x' END AS n FROM @vectors@)""")
def f26(t):
    k = F.col("vec_id") % 3
    name = F.when(k == 0, F.col("symbol_name")).when(k == 1, F.col("file")).otherwise(F.concat("file", F.lit("__x")))
    return t.vectors.select("vec_id", S.repo_from_name(name).alias("repo"))


@query("F27_signature_text", r"""
    SELECT doc_id, regexp_replace(array_to_string(ls[1:CASE WHEN cut > 0 THEN cut ELSE 5 END], ' '), '^\s+|\s+$', '', 'g') AS signature
    FROM (SELECT doc_id, ls, coalesce(list_position(list_transform(ls, lambda x: contains(x, ':') AND NOT starts_with(trim(x), '#')), true), 0) AS cut
          FROM (SELECT doc_id, string_split(text, chr(10))[1:5] AS ls FROM @src_files@))""")
def f27(t):
    return t.src_files.select("doc_id", S.signature_text(F.col("text")).alias("signature"))


@query("F28_comment_above", r"""
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM @src_files@),
    p AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS n FROM l),
    c AS (SELECT doc_id, n, list_reverse(list_transform(ls[greatest(1, n - 14):n - 1], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))) AS up FROM p),
    s AS (SELECT doc_id, n, up, coalesce(list_position(list_transform(up, lambda x: x <> '' AND NOT starts_with(x, '//')), true), 0) AS stop FROM c)
    SELECT doc_id, n AS line, array_to_string(list_reverse(list_transform(list_filter(up[1:CASE WHEN stop > 0 THEN stop - 1 ELSE len(up) END], lambda x: x <> ''),
           lambda x: regexp_replace(substr(x, 3), '^\s+|\s+$', '', 'g'))), ' ') AS comment
    FROM s""")
def f28(t):
    lines = t.src_files.select("doc_id", F.split("text", "\n").alias("ls"))
    return lines.select("doc_id", F.posexplode(S.comments_above(F.col("ls"))).alias("at", "comment")).select("doc_id", (F.col("at") + 1).alias("line"), "comment")


@query("F29_path_parts", r"""
    SELECT doc_id, lower(regexp_extract(path, '(\.[^./]+)$', 1)) AS ext, list_last(string_split(path, '/')) AS base,
           CASE WHEN starts_with(repo || '/' || path, repo || '/') THEN substr(repo || '/' || path, length(repo) + 2) ELSE repo || '/' || path END AS rel
    FROM @src_files@""")
def f29(t):
    whole = F.concat_ws("/", "repo", "path")
    return t.src_files.select("doc_id", S.file_extension(F.col("path")).alias("ext"), S.base_name(F.col("path")).alias("base"),
                              S.relative_path(whole, F.col("repo")).alias("rel"))


@query("F30_display_formats", """
    SELECT event_id, CASE WHEN value * 60 > 999 THEN printf('%.2fs', round(value * 60 / 1000 + 1e-9, 2)) ELSE CAST(floor(value * 60 + 0.5) AS BIGINT) || 'ms' END AS ms_text,
      CASE WHEN user_id <= 0 THEN '—' WHEN user_id * 3 < 60 THEN user_id * 3 || 's' ELSE (user_id * 3) // 60 || 'm' || CASE WHEN (user_id * 3) % 60 > 0 THEN (user_id * 3) % 60 || 's' ELSE '' END END AS eta,
      CASE WHEN value < 60 THEN 'safe' WHEN value < 85 THEN 'warning' ELSE 'danger' END AS light,
      CASE WHEN value < 33 THEN 'safe' WHEN value < 66 THEN 'warning' ELSE 'danger' END AS light33
    FROM events""")
def f30(t):
    v = F.col("value")
    return t.events.select("event_id", M.duration_text(v * 60).alias("ms_text"), M.eta_text(F.col("user_id") * 3).alias("eta"),
                           M.light(v).alias("light"), M.light(v, 33, 66).alias("light33"))


@query("F31_node_name", """
    SELECT doc_id, replace(repo || '-x', '-', '_') || '__' || replace(replace(file, '/', '__'), '.', '_') || '__' || name || '.md' AS node FROM @symbols@""")
def f31(t):
    return t.symbols.select("doc_id", S.node_name(F.concat("repo", F.lit("-x")), F.col("file"), F.col("name")).alias("node"))


@query("F32_qualified_name", """
    SELECT doc_id, repo || '/' || file || '/' || CASE WHEN doc_id % 2 = 0 THEN name ELSE 'Owner' || doc_id % 9 || '.' || name END AS qualified,
           repo || '/' || file || '/' || CASE WHEN doc_id % 2 = 0 THEN name ELSE 'Owner' || doc_id % 9 || '/' || name END AS receiver_form FROM @symbols@""")
def f32(t):
    owner = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("Owner"), F.col("doc_id") % 9)).otherwise("")
    args = (F.col("repo"), F.col("file"), owner, F.col("name"))
    return t.symbols.select("doc_id", S.qualified_name(*args).alias("qualified"), S.qualified_name(*args, joiner="/").alias("receiver_form"))


# ── predicates and projections ──────────────────────────────────────────────

@query("P1_skipped_names", rf"""
    SELECT doc_id, regexp_matches(list_last(string_split(path, '/')), '{X.SKIPPED_FILE_PATTERN}') AS skipped FROM @src_files@""")
def p1(t):
    return t.src_files.select("doc_id", X.skipped_file(S.base_name(F.col("path"))).alias("skipped"))


# Kinds of symbols that take part in clone search.
CLONE_KINDS = ("function", "method", "struct", "type", "class")


@query("P2_kind_whitelist", "SELECT doc_id, type FROM @symbols@ WHERE type IN ('function', 'method', 'struct', 'type', 'class')")
def p2(t):
    return t.symbols.where(F.col("type").isin(*CLONE_KINDS)).select("doc_id", "type")


@query("P3_minimum_sizes", rf"""
    SELECT doc_id, {WORDS_SQL.format('text')} >= 10 AS chunk_ok, length({STRIP_SQL.format('text')}) >= 5 AND {WORDS_SQL.format('text')} >= 3 AS snippet_ok,
           length(text) >= 20 AS prose_ok, length(text) >= 10 AS note_ok,
           {WORDS_SQL.format('text')} >= 3 AND len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}')), lambda w: w NOT IN {STOP_SQL})) >= 5 AS clone_ok,
           length({STRIP_SQL.format('text')}) >= 30 AS annotate_ok FROM documents""")
def p3(t):
    c = F.col("text")
    words, body = S.word_count(c), F.length(S.strip(c))
    return t.documents.select(
        "doc_id", (words >= 10).alias("chunk_ok"), ((body >= 5) & (words >= 3)).alias("snippet_ok"),
        (F.length(c) >= 20).alias("prose_ok"), (F.length(c) >= 10).alias("note_ok"),
        ((words >= 3) & (F.size(S.clone_tokens(c)) >= 5)).alias("clone_ok"), (body >= 30).alias("annotate_ok"))


@query("P4_valid_embeddings", """
    SELECT d.doc_id, e.vec_id IS NOT NULL AND len(e.embedding) > 0 AS has_vector FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id""")
def p4(t):
    joined = t.documents.select("doc_id").join(t.embeddings, F.col("doc_id") == F.col("vec_id"), "left")
    return joined.select("doc_id", F.coalesce(F.size("embedding") > 0, F.lit(False)).alias("has_vector"))


@query("P5_flat_metadata", """
    SELECT doc_id, substr(repo, 1, 500) AS repo, substr(content, 1, 500) AS llm_summary, substr(content_type, 1, 100) AS content_type,
           array_to_string(list_filter(string_split(content, ' '), lambda w: w <> '')[1:10], '|') AS hardware_binds, coalesce(line_start, 0) AS line_start,
           doc_id % 2 = 0 AS has_trm_link, CASE WHEN doc_id % 2 = 0 THEN 'C' || doc_id ELSE '' END AS trm_snippet_id,
           CASE WHEN doc_id % 2 = 0 THEN line_start ELSE 0 END AS trm_page
    FROM @chunk_rows@""")
def p5(t):
    from corpuskit.plans.chunks import flat_metadata

    chunks = t.chunk_rows.select(
        "doc_id", "repo", F.col("content").alias("llm_summary"), "content_type", F.col("line_start").cast("int").alias("line_start"),
        F.filter(F.split("content", " "), lambda w: w != "").alias("hardware_binds"), (F.col("doc_id") % 2 == 0).alias("has_trm_link"),
        F.when(F.col("doc_id") % 2 == 0, F.struct(F.concat(F.lit("C"), "doc_id").alias("trm_snippet_id"),
                                                 F.col("line_start").cast("int").alias("trm_page"))).alias("trm_reference"))
    return flat_metadata(chunks).select("doc_id", "repo", "llm_summary", "content_type", "hardware_binds", "line_start",
                                        "has_trm_link", "trm_snippet_id", "trm_page")


@query("P6_nested_to_json", """
    SELECT doc_id, '{"trm_page":' || line_start || ',"repo":"' || repo || '"}' AS trm_reference, '["' || language || '","' || content_type || '"]' AS hardware_binds
    FROM @chunk_rows@""")
def p6(t):
    return t.chunk_rows.select("doc_id", F.to_json(F.struct(F.col("line_start").alias("trm_page"), "repo")).alias("trm_reference"),
                               F.to_json(F.array("language", "content_type")).alias("hardware_binds"))


@query("P7_metadata_predicates", """
    SELECT chunk_id, repo, content_type FROM @chunk_rows@ WHERE (repo = 'src1' AND language = 'en') OR content_type = 'trm_note'""")
def p7(t):
    from corpuskit.functions.predicates import matches

    where = {"$or": [{"$and": [{"repo": {"$eq": "src1"}}, {"language": {"$eq": "en"}}]}, {"content_type": "trm_note"}]}
    return t.chunk_rows.where(matches(where)).select("chunk_id", "repo", "content_type")


@query("P8_relevance_threshold", """
    SELECT vec_id, collection, round(score, 6) AS score FROM (
      SELECT vec_id, collection, abs(CAST(embedding[1] AS DOUBLE)) * 2 AS score,
        CASE collection WHEN 'repo_code' THEN 0.40 WHEN 'trm_notes' THEN 0.35 WHEN 'trm_code' THEN 0.35 WHEN 'trm_tables' THEN 0.30 END AS t
      FROM @vectors@) WHERE score > t""")
def p8(t):
    from corpuskit.functions.predicates import relevant
    from corpuskit.plans.retrieval import COMPONENT_CONTEXT

    rows = t.vectors.withColumn("score", F.abs(F.col("embedding")[0]).cast("double") * 2)
    kept = rows.where(relevant(F.col("collection"), F.col("score"), COMPONENT_CONTEXT))
    return kept.select("vec_id", "collection", F.round("score", 6).alias("score"))


@query("P9_cross_repo", """
    SELECT doc_id, target IS NOT NULL AND target <> repo AS is_cross_repo
    FROM (SELECT doc_id, repo, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'src' || doc_id % 20 END AS target FROM @symbols@)""")
def p9(t):
    from corpuskit.functions.predicates import cross_repo

    target = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("src"), F.col("doc_id") % 20))
    return t.symbols.select("doc_id", cross_repo(F.col("repo"), target).alias("is_cross_repo"))


@query("P10_block_type_sets", """
    SELECT page, block_idx, type IN ('prose', 'subsection_heading', 'section_heading') AS prose_like,
           type IN ('prose', 'developer_note', 'subsection_heading', 'section_heading') AS may_refer, type = 'developer_note' AS is_note FROM @blocks@""")
def p10(t):
    from corpuskit.plans.manual import PROSE_TYPES, REFERRING_TYPES

    k = F.col("type")
    return t.blocks.select("page", "block_idx", k.isin(*PROSE_TYPES).alias("prose_like"), k.isin(*REFERRING_TYPES).alias("may_refer"),
                           (k == "developer_note").alias("is_note"))


@query("P11_distance_scores", """
    SELECT l_orderkey, l_linenumber, round(greatest(0, 1 - l_quantity / 25), 3) AS cosine_score, round(greatest(0, 1 - l_quantity / 25 / 2), 3) AS l2_score FROM lineitem""")
def p11(t):
    d = F.col("l_quantity") / 25
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(M.score_of(d), 3).alias("cosine_score"),
                             F.round(M.score_of(d, "l2"), 3).alias("l2_score"))


@query("P12_snippets", """
    SELECT doc_id, replace(substr(text, 1, 120), chr(10), ' ') AS s120, replace(substr(text, 1, 200), chr(10), ' ') AS s200,
           replace(substr(text, 1, 300), chr(10), ' ') AS s300, trim(replace(substr(text, 1, 250), chr(10), ' ')) || '...' AS s250 FROM documents""")
def p12(t):
    c = F.col("text")
    return t.documents.select("doc_id", S.one_line(c, 120).alias("s120"), S.one_line(c, 200).alias("s200"),
                              S.one_line(c, 300).alias("s300"), S.one_line(c, 250, "...").alias("s250"))


@query("P13_source_fallback", """
    SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE file END, ''), nullif(CASE WHEN doc_id % 6 = 0 THEN '' ELSE repo END, ''), 'Unknown') AS source
    FROM @chunk_rows@""")
def p13(t):
    k = F.col("doc_id")
    file = F.when(k % 3 == 0, "").otherwise(F.col("file"))
    repo = F.when(k % 6 == 0, "").otherwise(F.col("repo"))
    return t.chunk_rows.select("doc_id", S.first_present(file, repo, default="Unknown").alias("source"))


@query("P14_clipped_inputs", """
    SELECT doc_id, sha256(substr(text, 1, 4096)) AS embed_input, sha256(substr(text, 1, 1200)) AS annotate_input, sha256(substr(text, 1, 3000)) AS summary_input FROM documents""")
def p14(t):
    c = F.col("text")
    return t.documents.select("doc_id", F.sha2(S.clip(c, 4096), 256).alias("embed_input"),
                              F.sha2(S.clip(c, 1200), 256).alias("annotate_input"), F.sha2(S.clip(c, 3000), 256).alias("summary_input"))


@query("P15_visible_points", "SELECT vec_id, repo FROM @vectors@ WHERE repo IN ('repo1', 'repo4')")
def p15(t):
    return t.vectors.where(F.col("repo").isin("repo1", "repo4")).select("vec_id", "repo")


@query("P16_log_class", """
    SELECT event_id, CASE WHEN e LIKE '%node%' OR e LIKE '%retrieve%' OR e LIKE '%generate%' OR e LIKE '%validate%' THEN 'node' WHEN e LIKE '%start%' THEN 'startup'
        WHEN e LIKE '%pca%' THEN 'pca' WHEN e LIKE '%query%' THEN 'query' WHEN e LIKE '%error%' THEN 'error' ELSE 'other' END AS cls
    FROM (SELECT event_id, lower(CASE event_id % 6 WHEN 0 THEN 'Node_' WHEN 1 THEN 'pca_' WHEN 2 THEN 'restart_' WHEN 3 THEN 'query_' ELSE '' END || event_type) AS e FROM events)""")
def p16(t):
    k = F.col("event_id") % 6
    head = F.when(k == 0, "Node_").when(k == 1, "pca_").when(k == 2, "restart_").when(k == 3, "query_").otherwise("")
    return t.events.select("event_id", M.log_class(F.concat(head, "event_type")).alias("cls"))


@query("P17_error_flag", """
    SELECT event_id, contains(l, 'ERROR') OR contains(l, 'error') AS is_error FROM
      (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE 'Error: ' || event_type END AS l FROM events)""")
def p17(t):
    line = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat(F.lit("Error: "), "event_type"))
    return t.events.select("event_id", M.error_line(line).alias("is_error"))

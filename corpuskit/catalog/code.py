"""Source-code jobs: files, definitions, imports, commits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.catalog import scalars as C
from corpuskit.catalog.inputs import oracle_table
from corpuskit.catalog.registry import query
from corpuskit.functions import extract as X
from corpuskit.functions import tags as G
from corpuskit.plans import code as P
from corpuskit.sources import files as S

_FOLDERS = ", ".join(f"'{f}'" for f in S.SKIPPED_FOLDERS)
_LANGUAGES = " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in S.LANGUAGE_OF_EXTENSION.items())
oracle_table("kept_files", rf"""
    SELECT * FROM (SELECT doc_id, repo, path, text, ext, CASE ext {_LANGUAGES} END AS language, strlen(text) AS length,
        string_split(path, '/') AS parts FROM (SELECT *, lower(regexp_extract(path, '(\.[^./]+)$', 1)) AS ext FROM @src_files@))
    WHERE language IS NOT NULL AND NOT list_has_any(parts[1:-2], [{_FOLDERS}])
      AND NOT regexp_matches(parts[-1], '{X.SKIPPED_FILE_PATTERN}') AND length BETWEEN 1 AND 5242880""")


def kept(t):
    return S.keep_source_files(t.src_files.withColumn("length", F.octet_length("text")))


@query("S1_source_file_scan", "SELECT doc_id, repo, path, ext, language, length FROM @kept_files@")
def s1(t):
    return kept(t).select("doc_id", "repo", "path", "ext", "language", "length")


@query("S2_package_manifests", r"""
    SELECT package AS name, 'package' AS kind, max(repo) AS repo FROM (
      SELECT repo, CASE WHEN path IN ('setup.py', 'setup.cfg', 'pyproject.toml') THEN replace(lower(regexp_extract(text, 'name\s*=\s*[''"]([^''"]+)[''"]', 1)), '-', '_')
                        WHEN path LIKE '%__init__.py' THEN lower(regexp_extract(path, '^([^/]+)/__init__\.py$', 1)) END AS package FROM @manifests@)
    WHERE package <> '' GROUP BY ALL
    UNION ALL SELECT module, 'module', max(repo) FROM (SELECT repo, regexp_extract(text, '(?m)^module\s+(\S+)', 1) AS module FROM @manifests@ WHERE path = 'go.mod')
    WHERE module <> '' GROUP BY ALL""")
def s2(t):
    packages = S.manifest_packages(t.manifests).select(F.col("package").alias("name"), F.lit("package").alias("kind"), "repo")
    modules = S.manifest_modules(t.manifests).select(F.col("module").alias("name"), F.lit("module").alias("kind"), "repo")
    return packages.unionByName(modules)


@query("S3_commit_log", """
    SELECT repo, max_by(sha, (ts, sha)) AS sha, max_by(author, (ts, sha)) AS author, max(ts) AS ts FROM @commits@ GROUP BY repo""")
def s3(t):
    return P.head_commits(t.commits)


oracle_table("file_lines", """
    SELECT doc_id, repo, path, language, unnest(ls) AS line, generate_subscripts(ls, 1) AS n
    FROM (SELECT *, string_split(text, chr(10)) AS ls FROM @kept_files@)""")
# Literals and comments by one pattern a language; what they leave has the same lines.
_WORDS = r"""//[^\n]*|/\*[\s\S]*?\*/|"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''|`[^`]*`|[^"''`/]+|[\s\S]"""
_PYTHON_WORDS = r"""#[^\n]*|"{3}[\s\S]*?"{3}|''{3}[\s\S]*?''{3}|"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''|[^"''#]+|[\s\S]"""
oracle_table("code_lines", rf"""
    SELECT doc_id, repo, path, language, unnest(ls) AS line, generate_subscripts(ls, 1) AS n
    FROM (SELECT *, string_split(array_to_string(list_transform(
            CASE language WHEN 'python' THEN regexp_extract_all(text, '{_PYTHON_WORDS}') ELSE regexp_extract_all(text, '{_WORDS}') END,
            lambda t: CASE WHEN strlen(t) < 2 OR NOT (t[1] IN ('"', chr(39), '`') OR t[1] = '#' AND language = 'python' OR t[1:2] IN ('//', '/*') AND language <> 'python') THEN t
              ELSE replace(regexp_replace(t, '[^
]', if(t[1] = '/', ' ', chr(1)), 'g'), chr(10) || if(t[1] = '/', ' ', chr(1)), chr(10) || chr(2)) END), ''), chr(10)) AS ls
          FROM @kept_files@)""")
oracle_table("line_depth", r"""
    SELECT *, sum(length(line) - length(replace(line, chr(123), '')) - length(line) + length(replace(line, chr(125), '')))
                OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS depth,
           sum(length(line) - length(replace(line, chr(123), ''))) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS opens,
           coalesce(sum(length(regexp_replace(line, '[^(\[{]', '', 'g')) - length(regexp_replace(line, '[^)\]}]', '', 'g')))
                OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_before,
           length(line) - length(ltrim(line)) AS indent, regexp_replace(line, '^\s+|\s+$', '', 'g') <> '' AS solid
    FROM @code_lines@""")
_DEFS = " UNION ALL ".join(
    f"SELECT doc_id, n, indent, depth, line, '{kind}' AS type, regexp_extract(line, '{pat}', {g}) AS name, "
    + (f"regexp_extract(line, '{pat}', {og})" if og else "''") + f" AS owner FROM @line_depth@ WHERE language = '{lang}' AND regexp_matches(line, '{pat}')"
    for lang, rules in P.DEFINITIONS.items() for kind, pat, g, og in rules if "(?!" not in pat)
_DEFS += r""" UNION ALL SELECT doc_id, n, indent, depth, line, 'type', regexp_extract(line, '^type\s+(\w+)', 1), '' FROM @line_depth@
    WHERE language = 'go' AND regexp_matches(line, '^type\s+(\w+)\s+\S') AND NOT regexp_matches(line, '^type\s+(\w+)\s+struct\b')"""
oracle_table("defs", _DEFS)
oracle_table("def_ends", r"""
    SELECT d.doc_id, d.n, d.type, d.name, d.owner, k.language,
      CASE WHEN k.language = 'python' THEN
          coalesce((SELECT max(a.n) FROM @line_depth@ a WHERE a.doc_id = d.doc_id AND a.solid AND a.n >= d.n AND a.n <
            coalesce((SELECT min(z.n) FROM @line_depth@ z WHERE z.doc_id = d.doc_id AND z.n > d.n AND z.solid AND z.indent <= d.indent AND z.open_before = 0 AND NOT starts_with(z.line, chr(2))), 1000000000)), d.n)
        WHEN k.language = 'proto' AND d.type = 'function' THEN d.n
        ELSE coalesce((SELECT min(z.n) FROM @line_depth@ z WHERE z.doc_id = d.doc_id AND CASE WHEN k.language = 'proto' THEN z.n > d.n
              ELSE z.n >= d.n AND z.opens > coalesce((SELECT b.opens FROM @line_depth@ b WHERE b.doc_id = d.doc_id AND b.n = d.n - 1), 0) END
            AND z.depth <= coalesce((SELECT b.depth FROM @line_depth@ b WHERE b.doc_id = d.doc_id AND b.n = d.n - 1), 0)), d.n) END AS line_end
    FROM @defs@ d JOIN @kept_files@ k ON d.doc_id = k.doc_id""")
oracle_table("owned_defs", r"""
    SELECT d.*, c.name AS class_name,
      EXISTS (SELECT 1 FROM @def_ends@ f WHERE f.doc_id = d.doc_id AND f.type = 'function' AND f.language = 'python' AND f.n < d.n AND f.line_end >= d.line_end) AS in_function
    FROM @def_ends@ d LEFT JOIN (SELECT d.doc_id, d.n, d.type, max_by(c.name, c.n) AS name FROM @def_ends@ d JOIN @def_ends@ c ON d.doc_id = c.doc_id AND c.type = 'class'
        AND c.n < d.n AND c.line_end >= d.line_end GROUP BY ALL) c ON c.doc_id = d.doc_id AND c.n = d.n AND c.type = d.type""")


@query("X1_definition_extraction", r"""
    SELECT repo, path, CASE WHEN language = 'proto' THEN 'protobuf' ELSE language END AS language, name, line_start, line_end, class_context,
      CASE WHEN type = 'function' AND language IN ('python', 'javascript') AND class_context <> '' THEN 'method' ELSE type END AS type,
      sha256(array_to_string(string_split(text, chr(10))[line_start:line_end], chr(10))) AS source_hash,
      repo || '/' || path || '/' || CASE WHEN class_context = '' THEN '' ELSE class_context || CASE WHEN language = 'go' THEN '/' ELSE '.' END END || name AS qualified_name
    FROM (SELECT k.repo, k.path, k.text, d.language, d.name, d.n AS line_start, d.line_end, d.type,
            CASE WHEN d.type = 'function' AND d.language IN ('python', 'javascript') THEN coalesce(class_name, '') ELSE owner END AS class_context
          FROM @owned_defs@ d JOIN @kept_files@ k ON d.doc_id = k.doc_id WHERE NOT (d.language = 'python' AND in_function))""")
def x1(t):
    return P.extract_symbols(kept(t)).select(
        "repo", "path", "language", "name", "line_start", "line_end", "class_context", "type", F.sha2("source", 256).alias("source_hash"), "qualified_name")


@query("W11_brace_matched_end", "SELECT doc_id, n AS line_start, name, line_end FROM @def_ends@ WHERE language = 'proto'")
def w11(t):
    return P.definitions(kept(t)).where("language = 'proto'").select("doc_id", "line_start", "name", "line_end")


@query("V5_pattern_dispatch", """
    SELECT language, type, count(*) AS n FROM (SELECT language, type FROM @def_ends@
      UNION ALL SELECT language, 'package' FROM @file_lines@ WHERE language = 'go' AND regexp_matches(line, '^package [a-z]+')) GROUP BY ALL""")
def v5(t):
    more = {**P.DEFINITIONS, "go": P.DEFINITIONS["go"] + (("package", r"^package (\w+)", 1, 0),)}
    return P.definitions(kept(t), more).groupBy("language", "type").agg(F.count("*").alias("n"))


oracle_table("py_imports", r"""
    SELECT repo, path, n AS line, s AS statement, CASE WHEN regexp_matches(s, '^import\s+([\w.]+)') THEN regexp_extract(s, '^import\s+([\w.]+)', 1) ELSE regexp_extract(s, '^from\s+([\w.]+)\s+import', 1) END AS module,
      CASE WHEN regexp_matches(s, '^import\s+([\w.]+)') THEN 'import' ELSE 'from' END AS form
    FROM (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM @file_lines@ WHERE language = 'python')
    WHERE regexp_matches(s, '^import\s+([\w.]+)') OR regexp_matches(s, '^from\s+([\w.]+)\s+import')""")
oracle_table("packages", r"""
    SELECT package, max(repo) AS repo FROM (
      SELECT repo, CASE WHEN path IN ('setup.py', 'setup.cfg', 'pyproject.toml') THEN replace(lower(regexp_extract(text, 'name\s*=\s*[''"]([^''"]+)[''"]', 1)), '-', '_')
                        WHEN path LIKE '%__init__.py' THEN lower(regexp_extract(path, '^([^/]+)/__init__\.py$', 1)) END AS package FROM @manifests@)
    WHERE package <> '' GROUP BY ALL""")
oracle_table("modules", r"""
    SELECT module, max(repo) AS repo FROM (SELECT repo, regexp_extract(text, '(?m)^module\s+(\S+)', 1) AS module FROM @manifests@ WHERE path = 'go.mod')
    WHERE module <> '' GROUP BY ALL""")
oracle_table("py_resolved", """
    SELECT i.repo, i.path, i.line, i.statement, i.module, coalesce(p.repo, CASE WHEN form = 'from' AND starts_with(module, '.') THEN i.repo END) AS target,
      CASE WHEN form = 'import' THEN 0.8 ELSE 0.9 END AS c
    FROM @py_imports@ i LEFT JOIN @packages@ p ON p.package = lower(split_part(i.module, '.', 1))""")
oracle_table("go_imports", r"""
    SELECT repo, path, n AS line, module FROM (
      SELECT *, CASE WHEN mark = 1 AND s <> ')' AND s <> 'import (' THEN regexp_extract(line, '^\s*(?:\w+\s+)?"([^"]+)"', 1)
                     WHEN mark = 0 THEN regexp_extract(s, '^import\s+"([^"]+)"', 1) ELSE '' END AS module
      FROM (SELECT *, coalesce(last_value(CASE s WHEN 'import (' THEN 1 WHEN ')' THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mark
            FROM (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM @file_lines@ WHERE language = 'go'))) WHERE module <> ''""")
oracle_table("go_resolved", """
    SELECT i.repo, i.path, i.line, 'import "' || i.module || '"' AS statement, i.module,
      coalesce(m.repo, CASE WHEN contains(i.module, 'util') THEN 'src9' WHEN contains(i.module, 'fmt') THEN 'std' END) AS target, CASE WHEN m.repo IS NOT NULL THEN 0.95 ELSE 0.7 END AS c
    FROM @go_imports@ i LEFT JOIN (SELECT i.module, min_by(m.repo, (m.repo, m.module)) AS repo FROM (SELECT DISTINCT module FROM @go_imports@) i
        JOIN @modules@ m ON starts_with(i.module, m.module) GROUP BY ALL) m ON i.module = m.module""")
_KEYWORDS = (("util", "src9"), ("fmt", "std"))
_IMPORT_COLUMNS = ("repo", "path", "line", "statement", "module", "resolves_to_repo", "is_cross_repo", "confidence")
_IMPORT_SQL = """SELECT repo, path, line, statement, module, target AS resolves_to_repo, target IS NOT NULL AND target <> repo AS is_cross_repo,
    CASE WHEN target IS NULL THEN 0.0 ELSE c END AS confidence FROM {0}"""


def _python(t):
    files = kept(t).where("language = 'python'")
    return P.resolve_python(P.python_imports(files), S.manifest_packages(t.manifests))


def _go(t):
    files = kept(t).where("language = 'go'")
    modules = S.manifest_modules(t.manifests).withColumn("ord", F.struct("repo", "module"))
    return P.resolve_go(P.go_imports(files), modules, _KEYWORDS)


def all_imports(t):
    return _python(t).select(*_IMPORT_COLUMNS).unionByName(_go(t).select(*_IMPORT_COLUMNS))


@query("X2_import_extraction", _IMPORT_SQL.format("@py_resolved@") + " UNION ALL " + _IMPORT_SQL.format("@go_resolved@"))
def x2(t):
    return all_imports(t)


@query("J7_import_package_join", _IMPORT_SQL.format("@py_resolved@"))
def j7(t):
    return _python(t).select(*_IMPORT_COLUMNS)


@query("J8_module_prefix_join", """
    SELECT i.module, min_by(m.repo, (m.repo, m.module)) AS target FROM (SELECT DISTINCT p_type || '/' || p_name AS module FROM part) i
      JOIN (SELECT DISTINCT substr(p_type, 1, 1 + p_partkey % 4) AS module, 'r' || p_partkey % 4 AS repo FROM part) m ON starts_with(i.module, m.module) GROUP BY ALL""")
def j8(t):
    paths = t.part.select(F.concat_ws("/", "p_type", "p_name").alias("module"))
    k = F.col("p_partkey") % 4
    modules = t.part.select(F.substr("p_type", F.lit(1), (k + 1).cast("int")).alias("module"), F.concat(F.lit("r"), k).alias("repo")).distinct()
    return P.prefix_matches(paths, modules.withColumn("ord", F.struct("repo", "module")))


@query("J9_keyword_fallback", _IMPORT_SQL.format("@go_resolved@"))
def j9(t):
    return _go(t).select(*_IMPORT_COLUMNS)


oracle_table("last_commits", """
    SELECT repo, path, substr(max_by(sha, (ts, sha)), 1, 10) AS commit_sha, max_by(author, (ts, sha)) AS last_author, max(ts) AS commit_date FROM @commits@ GROUP BY ALL""")


@query("J1_file_commit_join", """
    SELECT f.repo, f.path, f.title, coalesce(commit_sha, 'unknown') AS commit_sha, coalesce(last_author, '') AS last_author,
      coalesce(strftime(commit_date, '%Y-%m-%d %H:%M:%S'), '') AS commit_date
    FROM @files_of_commits@ f LEFT JOIN @last_commits@ c ON f.repo = c.repo AND f.path = c.path""")
def j1(t):
    return P.with_file_facts(t.files_of_commits, P.file_facts(t.commits))


@query("E25_last_commit_per_file", "SELECT * FROM @last_commits@")
def e25(t):
    return P.file_facts(t.commits)


@query("E26_contributors", """
    SELECT DISTINCT repo, author FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, sha DESC) AS rn FROM @commits@) WHERE rn <= 200""")
def e26(t):
    return P.contributors(t.commits)


@query("E24_repo_rollup", """
    SELECT r.*, h.path AS hottest_file, h.n AS hottest_commits FROM (
      SELECT repo, count(*) AS commits, count(DISTINCT path) AS files, count(DISTINCT author) AS contributors, max(ts) AS last_commit FROM @commits@ GROUP BY repo) r
    JOIN (SELECT repo, min_by(path, (-n, path)) AS path, max(n) AS n FROM (SELECT repo, path, count(*) AS n FROM @commits@ GROUP BY ALL) GROUP BY repo) h ON r.repo = h.repo""")
def e24(t):
    return P.repo_rollup(t.commits)


oracle_table("cross_imports", "SELECT * FROM (" + _IMPORT_SQL.format("@py_resolved@") + " UNION ALL " + _IMPORT_SQL.format("@go_resolved@") + ") WHERE is_cross_repo")


@query("E5_import_counts", """
    SELECT repo AS source, resolves_to_repo AS target, count(*) AS n FROM @cross_imports@ GROUP BY ALL ORDER BY n DESC, source, target LIMIT 20""")
def e5(t):
    return P.import_pairs(all_imports(t)).orderBy(F.desc("n"), "source", "target").limit(20)


@query("E6_imported_by", """
    SELECT resolves_to_repo AS repo, repo AS importer, count(*) AS n, min_by(module, (path, line)) AS first_module, count(*) - 1 AS more FROM @cross_imports@ GROUP BY ALL""")
def e6(t):
    return P.imported_by(all_imports(t))

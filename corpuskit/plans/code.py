"""Source-code jobs: definitions, imports, commit facts.

Files are bounded records (5 MB at most), so everything within one file is an
expression over its array of lines and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import tags as G
from corpuskit.functions.text import signature_text, strip, token_count
from corpuskit.operators.blocks import blocks
from corpuskit.operators.lexer import code_only
from corpuskit.operators.scan import top_rows

# Definition patterns by language: (kind, pattern, group of the name, group of the owner).
DEFINITIONS = {
    "python": (
        ("class", r"^\s*class\s+(\w+)", 1, 0),
        ("function", r"^\s*(?:async\s+)?def\s+(\w+)", 1, 0),
    ),
    "go": (
        ("function", r"^func\s+(\w+)\s*[(\[]", 1, 0),
        ("method", r"^func\s+(\([^)]*\))\s*(\w+)\s*\(", 2, 1),
        ("struct", r"^type\s+(\w+)\s+struct\b", 1, 0),
        ("type", r"^type\s+(\w+)\s+(?!struct\b)\S", 1, 0),
    ),
    "c": (
        ("struct", r"^\s*(?:typedef\s+)?struct\s+(\w+)\s*\{", 1, 0),
        ("function", r"^[A-Za-z_][\w\s*]*?[\s*](\w+)\s*\([^;]*$", 1, 0),
    ),
    "javascript": (
        ("class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)", 1, 0),
        ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)\s*\(", 1, 0),
    ),
    "proto": (
        ("struct", r"^message\s+(\w+)\s*\{", 1, 0),
        ("interface", r"^service\s+(\w+)\s*\{", 1, 0),
        ("function", r"^\s+rpc\s+(\w+)\s*\(", 1, 0),
        ("enum", r"^enum\s+(\w+)\s*\{", 1, 0),
    ),
}
DEFINITIONS["cpp"] = DEFINITIONS["c"]
DEFINITIONS["typescript"] = DEFINITIONS["javascript"]


def definitions(files: DataFrame, patterns: dict = DEFINITIONS) -> DataFrame:
    """Definitions of source files: kind, name, owner, lines and source text.

    ``files`` has ``repo``, ``path``, ``language``, ``text``; other columns are
    kept.  ``patterns`` may be extended with more languages.  They are held
    against the lines without strings and comments, so a definition that is
    quoted or commented out is none.
    """
    lines = F.split("__code", "\n")

    def hits_of(kind, pattern, name_group, owner_group):
        def hit(line, i):
            return F.struct(
                (i + 1).alias("line_start"), F.lit(kind).alias("type"), F.regexp_extract(line, pattern, name_group).alias("name"),
                (F.regexp_extract(line, pattern, owner_group) if owner_group else F.lit("")).alias("owner"))

        return F.filter(F.transform(lines, hit), lambda h: h["name"] != "")

    found = None
    for language, rules in patterns.items():
        for kind, pattern, name_group, owner_group in rules:
            part = F.when(F.col("language") == language, hits_of(kind, pattern, name_group, owner_group)).otherwise(F.array().cast("array<struct<line_start:int,type:string,name:string,owner:string>>"))
            found = part if found is None else F.concat(found, part)
    keep = [c for c in files.columns if c != "text"]
    field = lambda name: F.transform("found_defs", lambda d: d[name])
    coded = files.select(*keep, "text", code_only("text", "language").alias("__code"))
    rows = coded.select(*keep, "text", "__code", found.alias("found_defs"))
    ended = rows.withColumn("b", blocks("text", "__code", "language", field("line_start"), field("type"), field("name")))
    zipped = F.arrays_zip("found_defs", "b.end", "b.source", "b.above", "b.class_name", "b.in_function")
    # Outer: no filter that repeats the patterns.
    each = ended.select(*keep, F.explode_outer(zipped).alias("d")).where("d is not null")
    return each.select(*keep, "d.found_defs.*", F.col("d.end").alias("line_end"), "d.source", "d.above", "d.class_name", "d.in_function")


def with_owners(defs: DataFrame) -> DataFrame:
    """Innermost class around each function, which makes it a method.

    Python functions inside functions are not symbols and are left out.
    """
    ownable = (F.col("type") == "function") & F.col("language").isin("python", "javascript", "typescript")
    return (
        defs.where("not in_function")
        .withColumn("class_context", F.when(ownable, F.coalesce("class_name", F.lit(""))).otherwise(F.col("owner")))
        .withColumn("type", F.when(ownable & (F.col("class_context") != ""), "method").otherwise(F.col("type")))
        .drop("class_name", "in_function", "owner")
    )


def extract_symbols(files: DataFrame, patterns: dict = DEFINITIONS) -> DataFrame:
    """Symbol table of source files."""
    defs = definitions(files, patterns)
    language = F.col("language")
    is_go = language == "go"
    below = F.when(F.col("line_end") > F.col("line_start"), F.regexp_replace("source", r"^[^\n]*\n", "")).otherwise("")
    body_doc = F.regexp_extract(below, r'^(?:[^\n]*:\n)?\s*(?:[rRbBuU]*)("""|\'\'\'|"|\')([\s\S]*?)\1', 2)
    doc = F.when(is_go, F.col("above")).when(
        language == "python", strip(body_doc)).otherwise("")
    signature = F.when((language == "python") & (F.col("type") == "class"), F.concat(F.lit("class "), "name")).when(
        language == "python", signature_text(F.col("source"))).otherwise("")
    joiner = F.when(is_go, "/").otherwise(".")
    owner = F.when(F.col("class_context") == "", "").otherwise(F.concat("class_context", joiner))
    # How much of a source is looked at for component tags.
    reach = F.when((language == "python") & (F.col("type") != "class"), 500).when(
        language.isin("c", "cpp") & (F.col("type") == "struct"), 200).when(is_go & (F.col("type") != "function"), 0).otherwise(300)
    probe = F.concat_ws(" ", "name", F.when(F.col("class_context").startswith("("), F.col("class_context")), "docstring",
                        F.substr("source", F.lit(1), reach))
    tagged = language.isin("python", "go", "c", "cpp")
    defs = with_owners(defs.withColumn("docstring", doc).drop("above"))
    return (
        defs.withColumn("signature", signature)
        .withColumn("qualified_name", F.concat(F.concat_ws("/", "repo", "path", F.concat(owner, "name"))))
        .withColumn("token_count", token_count(F.col("source")))
        .withColumn("hardware_binds", F.when(tagged, G.tags_of(probe)).otherwise(F.array().cast("array<string>")))
        .withColumn("language", F.when(language == "proto", "protobuf").otherwise(language))
    )


def symbol_rows(symbols: DataFrame) -> DataFrame:
    """Extracted symbols as the later jobs take them: ``file`` for the path and an id per symbol in ``doc_id``.

    The id is a hash of place and name, so it is the same in every run.
    """
    key = F.xxhash64("repo", "path", "line_start", "type", "name")
    return symbols.drop("doc_id", "file").withColumn("doc_id", key).withColumn("file", F.col("path"))


def python_imports(files: DataFrame) -> DataFrame:
    """``import x`` and ``from x import`` lines with their module."""
    rows = files.select("repo", "path", F.posexplode_outer(F.split("text", "\n")).alias("i", "raw")).withColumn("line_text", strip(F.col("raw")))
    plain = F.regexp_extract("line_text", r"^import\s+([\w.]+)", 1)
    from_ = F.regexp_extract("line_text", r"^from\s+([\w.]+)\s+import", 1)
    return (
        rows.withColumn("module", F.when(plain != "", plain).otherwise(from_)).where("module <> ''")
        .select("repo", "path", (F.col("i") + 1).alias("line"), F.col("line_text").alias("statement"), "module",
                F.when(plain != "", "import").otherwise("from").alias("form"))
    )


def go_imports(files: DataFrame) -> DataFrame:
    """Single and block imports of Go files, one row per path; a file is read in place, line after line."""
    def step(acc: Column, raw: Column) -> Column:
        t = strip(raw)
        quoted = F.regexp_extract(raw, r'^\s*(?:\w+\s+)?"([^"]+)"', 1)
        single = F.regexp_extract(t, r'^import\s+"([^"]+)"', 1)
        module = F.when(acc["inside"], F.when((t != ")") & (t != "import ("), quoted).otherwise("")).otherwise(single)
        taken = F.when(module != "", F.concat(acc["found"], F.array(F.struct(acc["n"].alias("line"), module.alias("module"))))).otherwise(acc["found"])
        inside = F.when(t == "import (", True).when(t == ")", False).otherwise(acc["inside"])
        return F.struct(inside.alias("inside"), (acc["n"] + 1).alias("n"), taken.alias("found"))

    start = F.struct(F.lit(False).alias("inside"), F.lit(1).alias("n"), F.array().cast("array<struct<line:int,module:string>>").alias("found"))
    found = F.aggregate(F.split("text", "\n"), start, step, lambda acc: acc["found"])
    rows = files.select("repo", "path", F.explode_outer(found).alias("i")).where("i is not null")
    return rows.select(
        "repo", "path", "i.line", F.concat(F.lit('import "'), "i.module", F.lit('"')).alias("statement"), "i.module", F.lit("go").alias("form"))


def resolve_python(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """Repository a Python import leads to, by its top-level package.

    A relative ``from`` import leads to the importing repository.
    """
    top = F.lower(F.split("module", r"\.")[0])
    joined = imports.withColumn("package", top).join(
        packages.select("package", F.col("repo").alias("target")), "package", "left")
    relative = (F.col("form") == "from") & F.col("module").startswith(".")
    target = F.coalesce(F.col("target"), F.when(relative, F.col("repo")))
    return _resolved(joined.drop("package"), target, F.when(F.col("form") == "import", 0.8).otherwise(0.9))


def prefix_matches(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """First module, in ``ord``, that each distinct path starts with.

    Instead of testing every path against every module, each distinct path is
    spread into its leading parts and joined by equality.
    """
    distinct = paths.select("module").distinct()
    parts = distinct.select("module", F.explode(F.sequence(F.lit(1), F.length("module"))).alias("n")).select(
        "module", F.substr("module", F.lit(1), F.col("n")).alias("prefix"))
    hits = parts.join(modules.select(F.col("module").alias("prefix"), "repo", "ord"), "prefix")
    return hits.groupBy("module").agg(F.min_by("repo", F.struct("ord", "prefix")).alias("target"))


def resolve_go(imports: DataFrame, modules: DataFrame, keywords=()) -> DataFrame:
    """Repository a Go import leads to: by module prefix, else by keyword.

    ``keywords`` lists ``(substring, repository)``; the first that occurs wins.
    """
    joined = imports.join(prefix_matches(imports, modules), "module", "left")
    chain = F.when(F.lit(False), "")
    for keyword, repo in keywords:
        chain = chain.when(F.col("module").contains(keyword), repo)
    target = F.coalesce(F.col("target"), chain)
    return _resolved(joined, target, F.when(F.col("target").isNotNull(), 0.95).otherwise(0.7))


def _resolved(rows: DataFrame, target: Column, confidence: Column) -> DataFrame:
    return rows.withColumn("confidence", F.when(target.isNotNull(), confidence).otherwise(0.0)).withColumn(
        "resolves_to_repo", target).withColumn(
        "is_cross_repo", F.col("resolves_to_repo").isNotNull() & (F.col("resolves_to_repo") != F.col("repo"))).drop("target")


def file_facts(commits: DataFrame) -> DataFrame:
    """Last commit of each file."""
    last = F.max_by(F.struct("sha", "author", "ts"), F.struct("ts", "sha"))
    return commits.groupBy("repo", "path").agg(last.alias("c")).select(
        "repo", "path", F.substring("c.sha", 1, 10).alias("commit_sha"), F.col("c.author").alias("last_author"), F.col("c.ts").alias("commit_date"))


def head_commits(commits: DataFrame) -> DataFrame:
    """Newest commit of each repository."""
    return commits.groupBy("repo").agg(F.max_by(F.struct("sha", "author", "ts"), F.struct("ts", "sha")).alias("c")).select("repo", "c.*")


def contributors(commits: DataFrame, window: int = 200) -> DataFrame:
    """Distinct authors of the newest ``window`` commits of each repository."""
    newest = top_rows(commits, ["repo"], [F.desc("ts"), F.desc("sha")], window)
    return newest.select("repo", "author").distinct()


def with_file_facts(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Files with their last commit; files without one are ``unknown``."""
    return (
        files.join(facts, ["repo", "path"], "left")
        .withColumn("commit_sha", F.coalesce("commit_sha", F.lit("unknown")))
        .withColumn("last_author", F.coalesce("last_author", F.lit("")))
        .withColumn("commit_date", F.coalesce(F.col("commit_date").cast("string"), F.lit("")))
    )


def repo_rollup(commits: DataFrame) -> DataFrame:
    """Files, contributors, newest commit and most changed file of each repository."""
    per_file = commits.groupBy("repo", "path").agg(F.count("*").alias("n"))
    hottest = per_file.groupBy("repo").agg(
        F.min_by("path", F.struct(-F.col("n"), "path")).alias("hottest_file"), F.max("n").alias("hottest_commits"))
    totals = commits.groupBy("repo").agg(
        F.count("*").alias("commits"), F.countDistinct("path").alias("files"),
        F.countDistinct("author").alias("contributors"), F.max("ts").alias("last_commit"))
    return totals.join(hottest, "repo")


def import_pairs(imports: DataFrame) -> DataFrame:
    """Cross-repository imports per source and target."""
    return imports.where("is_cross_repo").groupBy(F.col("repo").alias("source"), F.col("resolves_to_repo").alias("target")).agg(
        F.count("*").alias("n"))


def imported_by(imports: DataFrame) -> DataFrame:
    """Importers of each repository with the first imported module and how many more."""
    return imports.where("is_cross_repo").groupBy(F.col("resolves_to_repo").alias("repo"), F.col("repo").alias("importer")).agg(
        F.count("*").alias("n"), F.min_by("module", F.struct("path", "line")).alias("first_module"), (F.count("*") - 1).alias("more"))

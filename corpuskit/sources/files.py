"""Sources that read files: source trees, notes, page markup, logs."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions.extract import skipped_file
from corpuskit.functions.text import base_name, file_extension, relative_path
from corpuskit.session import bounded_batches, materialize
from corpuskit.sources.note_writer import file_system

# Language of each file extension.
LANGUAGE_OF_EXTENSION = {
    ".py": "python", ".go": "go", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp",
    ".js": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".proto": "proto",
}
# Folders that hold no code of the repository itself.
SKIPPED_FOLDERS = (
    ".git", "vendor", "node_modules", "build", "dist", "__pycache__", ".cache", ".idea", ".vscode",
    "testdata", "generated", "gen",
)
MAX_FILE_BYTES = 5 * 1024 * 1024


def language_of_extension(extension: Column) -> Column:
    chain = F.when(F.lit(False), "")
    for ext, language in LANGUAGE_OF_EXTENSION.items():
        chain = chain.when(extension == ext, language)
    return chain


def keep_source_files(files: DataFrame, path: str = "path", length: str = "length") -> DataFrame:
    """Rows whose path and size make them source files; adds ``ext`` and ``language``."""
    folders = F.slice(F.split(F.col(path), "/"), 1, F.size(F.split(F.col(path), "/")) - 1)
    pruned = F.arrays_overlap(folders, F.array(*[F.lit(f) for f in SKIPPED_FOLDERS]))
    return (
        files.withColumn("ext", file_extension(F.col(path)))
        .withColumn("language", language_of_extension(F.col("ext")))
        .where(F.col("language").isNotNull() & ~pruned & ~skipped_file(base_name(F.col(path)))
               & F.col(length).between(1, MAX_FILE_BYTES))
    )


def read_source_tree(spark: SparkSession, root: str) -> DataFrame:
    """Source files below ``root/<repo>/...`` with their decoded text."""
    globs = "*{" + ",".join(LANGUAGE_OF_EXTENSION) + "}"
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", globs).load(root)
    )
    plain = F.regexp_replace("path", "^file:/+", "/")
    below = relative_path(plain, F.lit(root))
    return (
        files.withColumn("below", below)
        .withColumn("repo", F.split("below", "/", 2)[0])
        .withColumn("path", F.split("below", "/", 2)[1])
        .transform(keep_source_files)
        .select("repo", "path", "ext", "language", "length", "modificationTime",
                F.expr("try_validate_utf8(cast(content as string))").isNull().alias("bad_bytes"),
                F.expr("make_valid_utf8(cast(content as string))").alias("text"))
    )


#: Notes that a task reads at a time.
NOTES_A_TASK = 4096


def _list_folders(root: str):
    """A function of folders that gives what they hold: ``folder``, ``path``, ``size``, ``mtime`` in microseconds."""
    def entries(files: fs.FileSystem, folder: str) -> Iterator[tuple]:
        if isinstance(files, fs.LocalFileSystem):
            with os.scandir(folder) as found:  # one at a time, however many there are
                for e in found:
                    yield e.is_dir(), e.path, e.name, e.stat().st_size, e.stat().st_mtime_ns // 1000
        else:
            for i in files.get_file_info(fs.FileSelector(folder)):
                yield i.type == fs.FileType.Directory, i.path, i.base_name, i.size or 0, (i.mtime_ns or 0) // 1000

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, _ = file_system(root)
        for batch in batches:
            for folder in batch["path"]:
                rows = (
                    (is_dir, path, size, mtime) for is_dir, path, name, size, mtime in entries(files, folder)
                    if not name.startswith(".") and (is_dir or (name.endswith(".md") and not name.startswith("_")))
                )
                while part := list(islice(rows, NOTES_A_TASK)):
                    yield pd.DataFrame(part, columns=["folder", "path", "size", "mtime"])

    return of


def _text_of(root: str):
    """Contents of the notes at some paths."""
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        files, _ = file_system(root)

        def read(path: str) -> bytes:
            with files.open_input_stream(path, compression=None) as f:
                return f.read()

        for paths in batches:
            yield pd.Series([read(p) for p in paths], dtype=object)

    return F.pandas_udf(of, "binary")


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """Markdown notes below ``root`` whose name does not start with ``_``; hidden folders are left out.

    Tasks list the folders, one level after the other, and read the notes, so the
    driver holds none of them; a text is read only if it is asked for.  Empty
    notes are notes, too; one that was written without content has no size and
    no text.  A store that Arrow does not know is listed by Spark, on the driver
    and without its empty files.
    """
    bounded_batches(spark)
    try:
        _, top = file_system(root)
    except ValueError:
        return _notes_listed_by_spark(spark, root)
    level, found = spark.createDataFrame([(top.rstrip("/"),)], "path string"), []
    while True:
        rows = level.mapInPandas(_list_folders(root), "folder boolean, path string, size long, mtime long")
        found.append(materialize(rows, "listed"))
        folders = found[-1].where("folder").select("path")
        n = folders.count()
        if not n:
            break
        level = folders.repartition(min(n, 4 * spark.sparkContext.defaultParallelism))
    notes = reduce(DataFrame.unionAll, found).where("not folder")
    # Listings are small files of many notes; their texts are not.
    notes = notes.repartition(max(spark.sparkContext.defaultParallelism, -(-notes.count() // NOTES_A_TASK)))
    text = _text_of(root)("path").cast("string")
    return notes.select("path", F.regexp_replace(base_name(F.col("path")), r"\.md$", "").alias("name"), "size",
                        F.timestamp_micros("mtime").alias("mtime"), text.alias("text"))


def _notes_listed_by_spark(spark: SparkSession, root: str) -> DataFrame:
    notes = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.md").load(root)
    )
    name = F.regexp_replace(base_name(F.col("path")), r"\.md$", "")
    return (
        notes.select("path", name.alias("name"), F.col("length").alias("size"),
                     F.col("modificationTime").alias("mtime"), F.col("content").cast("string").alias("text"))
        .where(~F.col("name").startswith("_"))
    )


def html_blocks(pages: DataFrame, tag_pattern: str) -> DataFrame:
    """Layout blocks of page markup: one row per wanted tag, in page order."""
    tags = F.regexp_extract_all("html", F.lit(tag_pattern), F.lit(1))
    texts = F.regexp_extract_all("html", F.lit(tag_pattern), F.lit(2))
    return (
        pages.select(F.regexp_extract("url", "://([^/]+)", 1).alias("doc"), F.col("page_id").alias("page"),
                     F.posexplode_outer(F.arrays_zip(tags.alias("tag"), texts.alias("text"))))
        # an outer explode does not repeat the patterns in a filter below it
        .where("pos is not null")
        .select("doc", "page", F.col("pos").alias("block_idx"), F.col("col.tag").alias("tag"),
                F.trim("col.text").alias("text"))
    )


def manifest_packages(files: DataFrame, repo_order: Column | None = None) -> DataFrame:
    """Package names that manifests and package folders declare, with their repository.

    ``files`` has ``repo``, ``path``, ``text``.  Of several repositories that
    declare one name the last in ``repo_order`` keeps it.
    """
    order = repo_order if repo_order is not None else F.col("repo")
    name = base_name(F.col("path"))
    declared = F.regexp_extract("text", r"name\s*=\s*['\"]([^'\"]+)['\"]", 1)
    folder = F.regexp_extract("path", r"^([^/]+)/__init__\.py$", 1)
    package = (
        F.when(F.col("path").isin("setup.py", "setup.cfg", "pyproject.toml"),
               F.replace(F.lower(declared), F.lit("-"), F.lit("_")))
        .when(name == "__init__.py", F.lower(folder))
    )
    rows = files.select("repo", order.alias("o"), package.alias("package")).where("package <> ''")
    return rows.groupBy("package").agg(F.max_by("repo", F.struct("o", "repo")).alias("repo"))


def manifest_modules(files: DataFrame) -> DataFrame:
    """Module paths that ``go.mod`` files declare."""
    module = F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1)
    rows = files.where(F.col("path") == "go.mod").select("repo", module.alias("module")).where("module <> ''")
    return rows.groupBy("module").agg(F.max("repo").alias("repo"))

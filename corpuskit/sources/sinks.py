"""Sinks: JSON and collection tables, resumable append, notes.  Changes of tables are in ``versions``."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.plans.chunks import collection_of
from corpuskit.sources.note_writer import file_system


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_collections(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One partition per collection, rows of one collection near each other."""
    routed = chunks.withColumn("collection", collection_of(F.col("content_type")))
    routed.write.mode(mode).partitionBy("collection").parquet(path)


def append_unseen(new: DataFrame, path: str, key: str) -> None:
    """Append rows whose key the table lacks; running it again adds nothing."""
    known = new.sparkSession.read.parquet(path).select(key)
    new.dropDuplicates([key]).join(known, key, "left_anti").write.mode("append").parquet(path)


def _write_files(root: str):
    """A function of a partition's ``(path, content)`` rows that writes each as a file, at once."""
    def write(rows: Iterator) -> None:
        files, top = file_system(root)
        made: set[str] = set()
        for row in rows:
            target = f"{top}/{row['path']}"
            folder = os.path.dirname(target)
            if folder not in made:
                files.create_dir(folder, recursive=True)
                made.add(folder)
            # a retried task replaces the same file, so a lost executor leaves no torn note
            part = f"{target}.{uuid.uuid4().hex}.tmp"
            with files.open_output_stream(part, compression=None) as out:
                out.write((row["content"] or "").encode())
            files.move(part, target)

    return write

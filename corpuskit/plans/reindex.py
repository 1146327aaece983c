"""Index of note files: build it, and re-index single files in one step."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpuskit.operators.packing import split_notes
from corpuskit.sources.versions import create_table, rewrite_parts


def write_file_chunks(notes: DataFrame, path: str) -> None:
    """Chunks of notes ``(shard, source, text)`` as a table of versions, a folder per shard."""
    create_table(split_notes(notes, "source", "text"), path, "shard")


def reindex_file(changed: DataFrame, path: str) -> None:
    """Replace the chunks of the changed notes; other shards stay untouched.

    Old chunks go and new ones come in the same version, so no reader and no
    failure ever meets a note without its chunks.
    """
    fresh = split_notes(changed, "source", "text")
    names = changed.select("shard", "source").distinct()
    rewrite_parts(path, changed, lambda old: old.join(names, ["shard", "source"], "left_anti").unionByName(fresh))

"""Note files as a Spark data source: all notes of a write appear, or none.

Tasks write below a folder of their own that no reader looks at.  Only when all
tasks are done the driver moves the files to their places; if one fails, what
the others wrote is deleted.  A task that ran twice leaves one folder that is
committed and one that is not.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Names of file systems that Spark and Arrow spell differently.
_SPELT = {"s3a": "s3", "s3n": "s3"}
#: Threads of the driver that move files, and files that each takes at a time.
MOVERS, MOVED_AT_ONCE = 16, 256


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it; a clear error where Arrow has none."""
    if ":/" not in root:
        return fs.LocalFileSystem(), root
    scheme, rest = root.split(":", 1)
    try:
        return fs.FileSystem.from_uri(f"{_SPELT.get(scheme, scheme)}:{rest}")
    except Exception as e:
        raise ValueError(f"files cannot be written to {root}: {e}") from e


def _folders(files: fs.FileSystem, top: str) -> Iterator[list[fs.FileInfo]]:
    """The files of each folder from ``top`` down, folder by folder."""
    waiting = [top]
    while waiting:
        found = files.get_file_info(fs.FileSelector(waiting.pop()))
        waiting += [i.path for i in found if i.type == fs.FileType.Directory]
        if own := [i for i in found if i.type == fs.FileType.File]:
            yield own


@dataclass
class _Staged(WriterCommitMessage):
    folder: str
    files: int


class NoteWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.staging = f"{self.root}/.staging-{uuid.uuid4().hex}"
        file_system(root)  # an unknown place is refused before any task starts

    def write(self, rows: Iterator[Row]) -> _Staged:
        files, top = file_system(self.staging)
        folder, made, n = f"{top}/{uuid.uuid4().hex}", set(), 0
        for row in rows:
            target = f"{folder}/{row['path']}"
            parent = os.path.dirname(target)
            if parent not in made:
                files.create_dir(parent, recursive=True)
                made.add(parent)
            with files.open_output_stream(target, compression=None) as out:
                out.write((row["content"] or "").encode())
            n += 1
        return _Staged(folder, n)

    def commit(self, messages: list[_Staged | None]) -> None:
        files, top = file_system(self.root)

        made: set[str] = set()

        def move(moves: list[tuple[str, str]]) -> None:
            for source, target in moves:
                files.move(source, target)

        with ThreadPoolExecutor(MOVERS) as pool:
            for message in messages:
                if message and message.files:
                    # One folder of one task at a time is held.
                    for found in _folders(files, message.folder):
                        moves = [(i.path, top + i.path[len(message.folder) :]) for i in found]
                        # A folder is made once, not for each of its files.
                        fresh = {os.path.dirname(target) for _, target in moves} - made
                        list(pool.map(lambda d: files.create_dir(d, recursive=True), fresh))
                        made |= fresh
                        list(pool.map(move, (moves[at : at + MOVED_AT_ONCE] for at in range(0, len(moves), MOVED_AT_ONCE))))
        self._clear()

    def abort(self, messages: list[_Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, top = file_system(self.staging)
        if files.get_file_info(top).type != fs.FileType.NotFound:
            files.delete_dir(top)


class NoteSource(DataSource):
    """``df.write.format("notes").mode("append").save(folder)`` for rows ``(path, content)``."""

    @classmethod
    def name(cls) -> str:
        return "notes"

    def writer(self, schema: StructType, overwrite: bool) -> NoteWriter:
        if overwrite or not {"path", "content"} <= set(schema.names):
            raise ValueError("notes are appended, as rows of path and content")
        return NoteWriter(self.options["path"])


def write_notes(notes: DataFrame, root: str) -> None:
    """One markdown file per row of ``(path, content)`` below a folder all executors share.

    ``root`` is a path or a URI of any file system that the executors reach.
    Two notes of one path would overwrite each other, so they raise, as does a
    note without a path.  A NULL content makes an empty note.
    """
    twice = notes.groupBy("path").count().where("count > 1 or path is null").select("path").head(3)
    if any(r.path is None for r in twice):
        raise ValueError("a note has no path")
    if twice:
        raise ValueError(f"several notes have the path {', '.join(r.path for r in twice)}")
    notes.sparkSession.dataSource.register(NoteSource)
    notes.select("path", "content").write.format("notes").mode("append").save(root)

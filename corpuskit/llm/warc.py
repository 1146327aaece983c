"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with some whole WARC
records, and behind them a seek table in a skippable frame.  An index maps a
record's id to its bundle, frame and place in the frame, so one record costs
one frame to read.  Equal payloads are stored once: later ones are revisits.

Tasks write bundles through the file system that the folder's URI names, so the
folder must be one that all executors reach.  A bundle's name holds the task
attempt; the index names only the bundles of attempts that Spark kept.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.session import materialize, run_dir

#: Bytes of records in a frame and of frames in a bundle, reached by the last one in it.
FRAME = 1 << 18
BUNDLE = 1 << 26
#: Payloads below this size are always stored.
LEAST = 100
DATE = "1970-01-01T00:00:00Z"
LEVEL = 3
#: Bytes of records that a task reads back, about.
SHARE = 1 << 24

# Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

_INDEX = "record_id string, id long, bundle string, frame long, frame_offset long, frame_length long, offset long, length long"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI, or of a plain path."""
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def _clean(value: str | None) -> str:
    """A header's value on one line; what would break the line is percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "%" or c == "\x7f" else c for c in value or "")


def _plain(value: str) -> str:
    out, parts = [], value.split("%")
    for i, part in enumerate(parts):
        out.append(part if i == 0 else chr(int(part[:2], 16)) + part[2:])
    return "".join(out)


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> tuple[str, bytes]:
    """A response with its payload, or a revisit that refers to another page's response."""
    named = lambda i: f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{named(page_id)}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
        f"X-Page-Id: {page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{named(refers_to)}>", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return named(page_id), "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in ``data``."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        at = start + int(head["Content-Length"])
        yield head, data[start:at]
        at += 4


class Bundles:
    """Writes records of one task into bundles; ``add`` and ``close`` give index rows."""

    def __init__(self, folder: str, name: str):
        self.files, self.path = _place(folder)
        self.folder, self.name, self.number = folder, name, 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.out, self.frames = None, []
        self.waiting: list[tuple[str, int, bytes]] = []
        self.size = 0

    def _frame(self) -> list[tuple]:
        if not self.waiting:
            return []
        if self.out is None:
            self.at, self.frames = f"{self.name}-{self.number:05d}.warc.zst", []
            self.out = self.files.open_output_stream(f"{self.path}/{self.at}", compression=None)
            self.number += 1
        body = b"".join(x[2] for x in self.waiting)
        packed = self.packer.compress(body)
        start, rows, offset = sum(f[0] for f in self.frames), [], 0
        for rid, page, data in self.waiting:
            rows.append((rid, page, f"{self.folder}/{self.at}", len(self.frames), start, len(packed), offset, len(data)))
            offset += len(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(body)))
        self.waiting, self.size = [], 0
        if start + len(packed) >= BUNDLE:
            self._end()
        return rows

    def _end(self) -> None:
        entries = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries)) + entries)
        self.out.close()
        self.out = None

    def add(self, rid: str, page: int, data: bytes) -> list[tuple]:
        self.waiting.append((rid, page, data))
        self.size += len(data)
        return self._frame() if self.size >= FRAME else []

    def close(self) -> list[tuple]:
        rows = self._frame()
        if self.out is not None:
            self._end()
        return rows


def seek_table(source, size: int) -> list[tuple[int, int, int]]:
    """``(offset, length, unpacked length)`` of each frame, from the end of a bundle."""
    source.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    source.seek(size - 9 - width * count)
    entries = source.read(width * count)
    out, at = [], 0
    for i in range(count):
        packed, whole = struct.unpack_from("<II", entries, i * width)
        out.append((at, packed, whole))
        at += packed
    return out


def _unpacked(frame: bytes) -> bytes:
    """A whole frame, whether or not its head tells its size."""
    return zstandard.ZstdDecompressor().decompressobj().decompress(frame)


def first_of_equal(pages: DataFrame) -> DataFrame:
    """``id`` and ``refers_to`` of the pages whose payload an earlier page has.

    Works on ids and digests alone; a digest of any number of pages is summed
    up before the shuffle and joined by a join that Spark can split.
    """
    slim = pages.where(F.octet_length("payload") >= LEAST).select("id", "digest")
    first = slim.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return slim.join(first, "digest").where("id <> refers_to").select("id", "refers_to")


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """Writes a record per row of ``pages`` and returns the index of the records.

    A NULL payload is empty, a NULL URL an empty header; line breaks in a URL
    are percent-encoded.  Of equal payloads of 100 bytes or more the smallest
    id is the response.  Rows that repeat an id are written each; their payload
    is stored with the smallest id only, so an id should name one page.  A row
    without an id can be neither named nor found and raises.  Other columns are
    ignored; an empty table writes no bundle and gives an empty index.
    """
    payload = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    rows = rows.withColumn("id", F.coalesce("id", F.raise_error(F.lit("a page without an id"))))
    marked = rows.join(first_of_equal(rows).distinct(), "id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        bundles = Bundles(folder, f"bundle-{task.partitionId():06d}-{task.taskAttemptId()}")
        files, path = _place(folder)
        files.create_dir(path, recursive=True)
        fields = [f.split(" ")[0] for f in _INDEX.split(", ")]
        for batch in batches:
            found = []
            for page, url, data, digest, refers in zip(batch["id"].tolist(), batch["url"], batch["payload"], batch["digest"], batch["refers_to"].tolist(), strict=True):
                rid, body = record(page, url, bytes(data), digest, None if refers is None or refers != refers else int(refers))
                found += bundles.add(rid, page, body)
            yield pd.DataFrame(found, columns=fields)
        yield pd.DataFrame(bundles.close(), columns=fields)

    return materialize(marked.select("id", "url", "payload", "digest", "refers_to").mapInPandas(run, _INDEX), "warc-index")


def read_archive(index: DataFrame) -> DataFrame:
    """What the bundles of ``index`` hold: a row per record, with its payload.

    Tasks get frames, not bundles; each frame is found through the seek table
    of its bundle and unpacked by itself.
    """
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    fields = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bundle, group in batch.groupby("bundle"):
                files, path = _place(bundle)
                with files.open_input_file(path) as source:
                    table = seek_table(source, source.size())
                    for frame in sorted(group["frame"]):
                        at, packed, whole = table[frame]
                        source.seek(at)
                        data = _unpacked(source.read(packed))
                        if len(data) != whole:
                            raise ValueError(f"damaged frame {frame} of {bundle}")
                        out = []
                        for head, block in parse(data):
                            body = block.split(b"\r\n\r\n", 1)[1]
                            digest, refers = head["WARC-Payload-Digest"].split(":")[1], head.get("X-Refers-To-Page")
                            if refers is None and hashlib.sha256(body).hexdigest() != digest:
                                raise ValueError(f"damaged record {head['WARC-Record-ID']}")
                            out.append((int(head["X-Page-Id"]), _plain(head["WARC-Target-URI"]), head["WARC-Type"], int(head["X-Payload-Length"]), digest, None if refers is None else int(refers), body))
                        frame_rows = pd.DataFrame(out, columns=fields)
                        frame_rows["refers_to"] = frame_rows["refers_to"].astype("Int64")
                        yield frame_rows

    # An index row is small and its frame is not, so tasks are cut by what the frames hold.
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // SHARE))
    return index.select("bundle", "frame").distinct().repartition(tasks, "bundle", "frame").mapInPandas(run, schema)


def fetch(index: DataFrame, ids: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The records of the ids in ``ids``, each cut out of its own frame."""
    wanted = index.join(ids.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for (bundle, at, packed), group in batch.groupby(["bundle", "frame_offset", "frame_length"]):
                files, path = _place(bundle)
                with files.open_input_file(path) as source:
                    source.seek(int(at))
                    data = _unpacked(source.read(int(packed)))
                out += [(page, data[offset : offset + length]) for page, offset, length in zip(group["id"], group["offset"], group["length"], strict=True)]
            yield pd.DataFrame(out, columns=["id", "record"])

    return wanted.mapInPandas(run, "id long, record binary").withColumnRenamed("id", id_col)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` into a new folder of the shared one and reads them back."""
    return read_archive(write_archive(pages, run_dir(pages.sparkSession, "warc")))


#: Twin of the query over ``pages``.
SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM d
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

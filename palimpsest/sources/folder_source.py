"""A Spark data source of Markdown files in a mounted folder, as a table or as a stream of what changes.

The folder is listed once, while a scan is planned: ignored folders and links aren't
entered, and only names, sizes and times are held. A partition is a file, or small
files up to PARTITION_BYTES together; its task alone opens them, so a lost one is read again.

Defined results: a missing folder raises, as do files over max_bytes and files that
aren't UTF-8, each with its path; empty files are rows with empty text; a folder
without Markdown gives no rows. A file that goes between listing and reading raises.

The stream gives a file whenever its time of change is new. A file is taken once it is
SETTLE_SECONDS old, so that none of the same tick is missed; what is moved in with an
older time, and what is deleted, isn't seen until something else changes.
"""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "relative_path string, content string, content_hash string, byte_size long"
#: Folders that are passed over, and endings of Markdown files.
IGNORED = [".git", ".hg", ".svn", ".venv", "venv", "env", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "build", "dist", "target"]
ENDINGS = (".md", ".markdown")
MAX_BYTES = 1_000_000
PARTITION_BYTES = 4 << 20
SETTLE_SECONDS = 2.0


@dataclass(frozen=True)
class Found:
    path: str
    size: int
    changed: int


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


def listed(root: str) -> Iterator[Found]:
    """Markdown files below root, by relative path; nothing is read, and no link is followed."""
    waiting = [""]
    while waiting:
        below = waiting.pop()
        with os.scandir(os.path.join(root, below)) as entries:
            for entry in entries:
                path = f"{below}/{entry.name}" if below else entry.name
                if entry.is_dir(follow_symlinks=False):
                    if entry.name not in IGNORED:
                        waiting.append(path)
                elif entry.is_file(follow_symlinks=False) and entry.name.lower().endswith(ENDINGS):
                    stat = entry.stat(follow_symlinks=False)
                    yield Found(path, stat.st_size, stat.st_mtime_ns)


def packed(files: list[Found], most: int) -> list[Files]:
    """Partitions of neighbouring files, of `most` bytes each at the most, or of one file."""
    out: list[list[str]] = []
    room = -1
    for f in sorted(files, key=lambda f: f.path):
        if not out or f.size > room:
            out.append([])
            room = most
        out[-1].append(f.path)
        room -= max(f.size, 1)
    return [Files(tuple(paths)) for paths in out]


class _Folder:
    """What the batch reader and the stream reader share."""

    def __init__(self, options):
        self.root = options.get("path", "")
        self.max_bytes = int(options.get("maxBytes", MAX_BYTES))
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.settle = int(float(options.get("settleSeconds", SETTLE_SECONDS)) * 1e9)

    def files(self) -> list[Found]:
        if not os.path.isdir(self.root):
            raise ValueError(f"there is no folder {self.root}")
        return list(listed(self.root))

    def dealt(self, files: list[Found]) -> list[Files]:
        large = min((f.path for f in files if f.size > self.max_bytes), default=None)
        if large is not None:
            raise ValueError(f"a document is too large: {large} has over {self.max_bytes} bytes")
        return packed(files, self.partition_bytes)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows = []
        for path in partition.paths:
            with open(os.path.join(self.root, path), "rb") as f:
                raw = f.read(self.max_bytes + 1)
            if len(raw) > self.max_bytes:
                raise ValueError(f"a document is too large: {path} has over {self.max_bytes} bytes")
            try:
                text = raw.decode()
            except UnicodeDecodeError as e:
                raise ValueError(f"a document isn't UTF-8: {path}") from e
            rows.append((path, text, hashlib.sha256(raw).hexdigest(), len(raw)))
        columns = list(zip(*rows)) or [()] * 4
        types = [pa.string(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in SCHEMA.split(", ")])


class FolderReader(_Folder, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.dealt(self.files()) or [Files(())]


class FolderStreamReader(_Folder, DataSourceStreamReader):
    """Offsets are times of change in nanoseconds: a batch has the files after one and up to another."""

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        settled = time.time_ns() - self.settle
        return {"changed": max((f.changed for f in self.files() if f.changed <= settled), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.dealt([f for f in self.files() if start["changed"] < f.changed <= end["changed"]])


class MarkdownFolder(DataSource):
    """spark.read (or readStream) .format("markdown_folder").load(path); options maxBytes, partitionBytes, settleSeconds."""

    @classmethod
    def name(cls) -> str:
        return "markdown_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderStreamReader(self.options)

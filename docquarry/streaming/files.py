"""A streaming source of Markdown files that hands over a file again whenever it has been written anew."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Seconds that a file must have been left alone before it is handed over.
SETTLE = 0.1
#: Bytes and files of one task, at most (a larger file stands by itself).
_TASK_BYTES, _TASK_FILES = 32 << 20, 256
_SCHEMA = "source_path string, content binary, length long, modificationTime timestamp"
#: Before all files.
_NOTHING = {"mtime": -1, "path": ""}


@dataclass
class Listed:
    path: str
    mtime: int
    size: int


@dataclass
class FilesPartition(InputPartition):
    files: list[Listed]


def _opened(root: str) -> tuple[pafs.FileSystem, str, str]:
    """File system and path of ``root`` (a path or a URI), and what its paths are called with in front."""
    fs, path = pafs.FileSystem.from_uri(root)
    parts = urlsplit(root)
    prefix = f"{parts.scheme}://{parts.netloc}" if parts.scheme not in ("", "file") else ""
    return fs, path.rstrip("/"), prefix


def _listed(fs: pafs.FileSystem, root: str) -> list[Listed]:
    """All ``.md`` files below ``root`` by (time, path); like Spark's file sources it passes over names that start with _ or a dot."""
    found = []
    for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True)):
        names = info.path[len(root) :].strip("/").split("/")
        if info.type == pafs.FileType.File and names[-1].endswith(".md") and not any(n[0] in "_." for n in names):
            found.append(Listed(info.path, info.mtime_ns, info.size))
    return sorted(found, key=lambda f: (f.mtime, f.path))


class MarkdownReader(DataSourceStreamReader):
    """Offsets are (time, path) of the last file handed over, in the order of times of last change, then paths."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.settle = float(options.get("settle", SETTLE))
        self.most_files = int(options.get("maxFilesPerTrigger", 0))
        self.most_bytes = int(options.get("maxBytesPerTrigger", 0))
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        self.at = dict(_NOTHING)
        return dict(_NOTHING)

    def latestOffset(self) -> dict:
        fs, root, _ = _opened(self.root)
        before = time.time_ns() - int(self.settle * 1e9)
        left = [f for f in _listed(fs, root) if f.mtime <= before]
        if self.at is not None:
            left = self._after(left, self.at)
            size = 0
            for n, f in enumerate(left):
                size += f.size
                if n and (self.most_files and n >= self.most_files or self.most_bytes and size > self.most_bytes):
                    left = left[:n]
                    break
        if left:
            self.at = {"mtime": left[-1].mtime, "path": left[-1].path}
        return dict(self.at or _NOTHING)

    @staticmethod
    def _after(files: list[Listed], start: dict) -> list[Listed]:
        return [f for f in files if (f.mtime, f.path) > (start["mtime"], start["path"])]

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        fs, root, _ = _opened(self.root)
        self.at = dict(end)
        found = [f for f in self._after(_listed(fs, root), start) if (f.mtime, f.path) <= (end["mtime"], end["path"])]
        parts: list[FilesPartition] = []
        size = 0
        for f in found:
            if not parts or len(parts[-1].files) >= _TASK_FILES or size + f.size > _TASK_BYTES:
                parts.append(FilesPartition([]))
                size = 0
            parts[-1].files.append(f)
            size += f.size
        return parts

    def read(self, partition: FilesPartition) -> Iterator[tuple]:
        fs, _, prefix = _opened(self.root)
        for f in partition.files:
            try:
                with fs.open_input_file(f.path) as stream:
                    content = stream.read()
                info = fs.get_file_info(f.path)
            except OSError:
                continue  # it is gone
            if info.type != pafs.FileType.File or info.mtime_ns != f.mtime or len(content) != f.size:
                continue  # written anew since it was listed: it stands behind this offset now and comes again
            yield prefix + f.path, content, f.size, datetime.fromtimestamp(f.mtime / 1e9, timezone.utc)

    def commit(self, end: dict) -> None:
        self.at = self.at or dict(end)


class MarkdownFiles(DataSource):
    """``spark.readStream.format("markdown_files").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "markdown_files"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema: StructType) -> MarkdownReader:
        return MarkdownReader(self.options)


def watch_markdown(spark: SparkSession, root: str, *, settle: float = SETTLE, max_files: int = 0, max_bytes: int = 0) -> DataFrame:
    """The ``.md`` files below ``root`` as a stream, first all that are there, then each that is new or written anew.

    A file is handed over once it has been left alone for ``settle`` seconds, so one that is still growing
    comes out once, whole. One that is deleted, or written anew, between listing and reading is passed over
    (the latter comes at a later trigger). ``max_files`` and ``max_bytes`` hold back the rest of a trigger (0: no
    limit; at least one file comes); leave them at 0 with availableNow, which asks for one trigger only, and note
    that the first trigger after a restart has no limit, as Spark does not say then where the stream stands.

    Files come in the order of their times of last change. A file that is put in place with an older time
    than one already handed over is not seen; a listing met with the ledger (``ingest`` of
    ``read_markdown``) finds it. ``root`` is a path or URI that pyarrow opens; every trigger lists it.
    """
    spark.dataSource.register(MarkdownFiles)
    options = {"settle": str(settle), "maxFilesPerTrigger": str(max_files), "maxBytesPerTrigger": str(max_bytes)}
    return spark.readStream.format("markdown_files").options(**options).load(root)

"""The format `flat`: text files of any length as pieces of byte ranges, for batch and stream reads.

    register(spark)
    spark.read.format("flat").option("glob", "*.txt").load(folder)
    spark.readStream.format("flat").load(folder)     # files that come, and what is appended to them

Rows are (file, at, value): a file's place in the folder, and its piece that
begins at a byte. Files need
no lines: ranges are cut by bytes and moved to the next character, so a file of
one line is read by as many tasks as it has ranges. The glob chooses the files
that are opened; conditions on `file` don't, as Spark plans one reader for all
scans of a source, and a union of two would read the files of one. Files are
reached by Arrow's file systems (local paths, file:, hdfs:, s3:, gs:).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at long, value string"
_ARROW = pa.schema([("file", pa.string()), ("at", pa.int64()), ("value", pa.string())])
#: Bytes of a task's range and of a row's piece, unless options say otherwise.
RANGE, PIECE = 32 << 20, 64 << 10


@dataclass
class Range(InputPartition):
    path: str
    file: str
    lo: int
    hi: int


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class _Files:
    """What batch and stream readers share: the folder, its files, and how a range becomes pieces."""

    def __init__(self, options: dict) -> None:
        if "path" not in options:
            raise ValueError("the format flat needs a path")
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.range, self.piece = int(options.get("rangeBytes", RANGE)), int(options.get("pieceBytes", PIECE))
        if min(self.range, self.piece) < 4:
            raise ValueError("rangeBytes and pieceBytes must be 4 at least")

    def found(self) -> dict[str, tuple[str, int]]:
        """Each file's place in the folder with its path and its size; hidden files and folders and names that don't match are left out."""
        system, path = _system(self.path)
        whole = system.get_file_info(path)
        alone = whole.type == fs.FileType.File
        out = {}
        for i in [whole] if alone else system.get_file_info(fs.FileSelector(path, recursive=True)):
            file = i.base_name if alone else i.path[len(path.rstrip("/")) + 1 :]
            if i.type == fs.FileType.File and i.size and fnmatch(i.base_name, self.glob) and not any(part[:1] in "._" for part in file.split("/")):
                out[file] = (i.path, i.size)
        return out

    def ranges(self, path: str, file: str, lo: int, hi: int) -> list[Range]:
        return [Range(path, file, at, min(at + self.range, hi)) for at in range(lo, hi, self.range)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path)
        with system.open_input_file(partition.path) as f:
            at, size = partition.lo, f.size()
            while at < partition.hi:
                raw = f.read_at(min(self.piece, partition.hi - at), at)
                if not raw:
                    break
                end = at + len(raw)
                if end < size:
                    raw += _rest(f.read_at(3, end))
                skipped = len(raw) - len(raw.lstrip(_INNER)) if at else 0
                yield pa.RecordBatch.from_arrays([pa.array([partition.file]), pa.array([at + skipped]), pa.array([raw[skipped:].decode()])], schema=_ARROW)
                at = end


#: Bytes that begin no character of UTF-8.
_INNER = bytes(range(0x80, 0xC0))


def _rest(after: bytes) -> bytes:
    """What the next bytes hold of a character that has begun before them."""
    return after[: len(after) - len(after.lstrip(_INNER))]


class FlatReader(_Files, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [r for file, (path, size) in sorted(self.found().items()) for r in self.ranges(path, file, 0, size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _Files.read(self, partition)


class FlatStreamReader(_Files, DataSourceStreamReader):
    """An offset holds how many bytes of each file have been read; files only grow."""

    def initialOffset(self) -> dict:
        return {"read": "{}"}

    def latestOffset(self) -> dict:
        return {"read": json.dumps({file: size for file, (_, size) in sorted(self.found().items())})}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, paths = json.loads(start["read"]), self.found()
        return [r for file, size in json.loads(end["read"]).items() if file in paths for r in self.ranges(paths[file][0], file, before.get(file, 0), size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _Files.read(self, partition)


class Flat(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flat"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FlatReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FlatStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(Flat)

"""Members of zip archives as a data source of Spark's: large members are read by several tasks, only in the asked columns."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructType

PART_BYTES = 64 << 20  # of a member's text that a task reads
READ_BYTES = 1 << 20
BATCH_LINES = 20_000
QUARTER = "quarter"  # a column that holds the archive's name


@dataclass
class Part(InputPartition):
    archive: str
    first: int  # byte of the member's text, unpacked
    end: int


def archives(path: str) -> tuple[fs.FileSystem, list[str]]:
    """The file system of a path, and the archive there or those in the folder, by name."""
    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return store, [at]
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return store, sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".zip"))


def quarter_of(archive: str) -> str:
    return archive.rsplit("/", 1)[-1].removesuffix(".zip")


class ZipMember(DataSource):
    """Unquoted tab-separated text with a header, one member of each archive under a path.

    Options: path, member, part_bytes, and quarters: the archives that are read, by name, with commas (all, if it is empty).
    The schema, of strings, names the columns; cells of others aren't kept, a column that a member lacks is null, and
    `quarter` is the archive's name. Paths are those of pyarrow.fs: local ones, and URIs that it knows.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_member"

    def schema(self) -> str:
        raise ValueError("zip_member needs a schema: the columns that are wanted")

    def reader(self, schema: StructType) -> DataSourceReader:
        if any(not isinstance(f.dataType, StringType) for f in schema):
            raise ValueError("columns of zip_member are strings")
        return ZipReader(self.options["path"], self.options["member"], schema.names, int(self.options.get("part_bytes", PART_BYTES)), self.options.get("quarters", ""))


class ZipReader(DataSourceReader):
    def __init__(self, path: str, member: str, columns: list[str], part_bytes: int, quarters: str = "") -> None:
        self.path, self.member, self.columns, self.part_bytes = path, member, columns, part_bytes
        self.only = {q.strip() for q in quarters.split(",") if q.strip()}

    def partitions(self) -> list[InputPartition]:
        """Sizes come from the archives' own lists; nothing is unpacked for them."""
        store, found = archives(self.path)
        parts: list[InputPartition] = []
        for archive in found:
            if not self.only or quarter_of(archive) in self.only:
                with store.open_input_file(archive) as raw, zipfile.ZipFile(raw) as z:
                    size = z.getinfo(self.member).file_size
                parts += [Part(archive, k, min(size, k + self.part_bytes)) for k in range(0, max(size, 1), self.part_bytes)]
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the part. A packed member is unpacked up to there, a chunk at a time, but not split into lines."""
        store, _ = archives(self.path)
        with store.open_input_file(partition.archive) as raw, zipfile.ZipFile(raw) as z, z.open(self.member) as f:
            head = f.readline()
            at = {c: k for k, c in enumerate(head.decode().rstrip("\r\n").split("\t"))}
            place = [at.get(c, -1) for c in self.columns]
            position = len(head)
            if partition.first > position:
                position = skip(f, position, partition.first - 1)
                position += len(f.readline())  # the line before the part, or its last byte
            held: list[list[str]] = []
            while position < partition.end and (line := f.readline()):
                position += len(line)
                held.append(line.decode().rstrip("\r\n").split("\t"))
                if len(held) == BATCH_LINES:
                    yield self.batch(held, place, partition.archive)
                    held = []
            if held:
                yield self.batch(held, place, partition.archive)

    def batch(self, lines: list[list[str]], place: list[int], archive: str) -> pa.RecordBatch:
        whole = quarter_of(archive)
        columns = [[whole] * len(lines) if c == QUARTER and i < 0 else [x[i] if 0 <= i < len(x) else None for x in lines] for c, i in zip(self.columns, place, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], self.columns)


def skip(f, position: int, target: int) -> int:
    """Reads on to a byte; seeking in a packed member would begin again."""
    while position < target:
        got = len(f.read(min(READ_BYTES, target - position)))
        if not got:
            break
        position += got
    return position


def register(spark: SparkSession) -> None:
    """Makes spark.read.format("zip_member") known."""
    spark.dataSource.register(ZipMember)

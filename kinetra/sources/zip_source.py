"""Spark data sources over ZIP archives of CSV members, a partition for each member.

Planning reads the central directory at the end of each archive, many at once; no archive is held whole, on the driver or in a row,
so archives and members may be larger than 2 GB. A task decompresses its member as a stream and decodes it block by
block with the types of the wanted schema, so that a column whose values look different later on is read like any other. Only the columns of the schema
that the reader is given are decoded, and conditions on city, recording or archive choose the archives that are opened
(`spark.sql.python.filterPushdown.enabled`).

Stores are those that `pyarrow.fs` reaches by the URI (local, S3, GCS, HDFS with its native library); for others see
`archives.discover_archives`, which lets Spark read.
"""

from __future__ import annotations

import csv as text_csv
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv, fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructType

#: Patterns of archive names without extension and "(1)", in the order in which they are tried, and their cities.
NAME_RULES = ((r"(?i)^changchun_", "Changchun"), (r"(?i)_nr_", "Chongqing"), (r"(?i)^xian_", "Xi'an"), (r"^[0-9]+_[0-9]+_[0-9]+(?![\s\S])", "Tianjin"))
HEAD = ("city", "recording_id", "source_archive", "status", "error")
MEMBERS_SCHEMA = "city string, recording_id string, source_archive string, member string, size long, packed_size long, ok boolean, error string"
BLOCK_BYTES = 1 << 20


def place_of(archive: str) -> tuple[str | None, str]:
    """(city, recording) of an archive's file name."""
    stem = re.sub(r"\.[^.]*$", "", archive).replace("(1)", "")
    return next((city for pattern, city in NAME_RULES if re.search(pattern, stem)), None), stem


def check_columns(found: Sequence[str], required: Sequence[str]) -> list[str]:
    """Stripped names; raises with the list of what is missing. Unnamed export-index columns are ignored."""
    names = [n.strip() for n in found]
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return names


def member_of(z: zipfile.ZipFile, name: str) -> str | None:
    """The first member, in any folder, whose base name is `name`."""
    return next((m for m in z.namelist() if posixpath.basename(m) == name), None)


def _typed(column: pa.Array, kind: pa.DataType) -> pa.Array:
    """Integers may be written as 7 or 7.0; they pass through text, so that large ones stay exact."""
    if not pa.types.is_integer(kind):
        return column.cast(kind)
    trimmed = pc.utf8_trim_whitespace(column)
    try:
        return trimmed.cast(kind)
    except pa.ArrowInvalid:
        return trimmed.cast(pa.float64()).cast(kind)


def decode_csv(stream: io.BufferedIOBase, wanted: pa.Schema, required: Sequence[str] = ()) -> Iterator[pa.RecordBatch]:
    """The wanted columns of a CSV stream with a header, block by block; a column that it lacks is null unless it is required."""
    head = stream.readline().decode("utf-8-sig")
    names = check_columns(next(text_csv.reader([head]), []), required)
    if not names:
        return
    unique = [n if n and n not in names[:k] else f"_{k}" for k, n in enumerate(names)]
    read = {f.name: pa.string() if pa.types.is_integer(f.type) else f.type for f in wanted if f.name in unique}
    options = csv.ConvertOptions(column_types=read, include_columns=list(read) or unique[:1], strings_can_be_null=True)
    try:
        blocks = csv.open_csv(stream, read_options=csv.ReadOptions(column_names=unique, block_size=BLOCK_BYTES), convert_options=options)
    except pa.ArrowInvalid as e:
        if "Empty CSV" in str(e):  # a header without rows
            return
        raise
    for block in blocks:
        yield pa.RecordBatch.from_arrays([_typed(block.column(f.name), f.type) if f.name in read else pa.nulls(block.num_rows, f.type) for f in wanted], schema=wanted)


class _Raw(io.RawIOBase):
    """A random-access file of pyarrow as a Python file."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            return self.file.seek(offset, whence)
        except pa.ArrowInvalid as e:  # before the start: what zipfile expects of small files
            raise OSError(str(e)) from e

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def is_reachable(path: str) -> bool:
    """Whether pyarrow has a file system for the path's scheme and finds the path there."""
    try:
        store, inner = _store(path)
        return store.get_file_info(inner).type != fs.FileType.NotFound
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def open_archive(root: str, path: str) -> zipfile.ZipFile:
    store, _ = _store(root)
    return zipfile.ZipFile(io.BufferedReader(_Raw(store.open_input_file(path)), BLOCK_BYTES))


@dataclass
class Member(InputPartition):
    """A member to read; without a member's name, an archive that gives none or an error."""

    path: str
    city: str
    recording_id: str
    source_archive: str
    member: str | None = None
    size: int | None = None
    packed_size: int | None = None
    error: str | None = None


class _Reader(DataSourceReader):
    """Finds archives below the root, in the order of their paths, and leaves out those that pushed conditions exclude."""

    def __init__(self, schema: StructType, options: dict):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.arrow = to_arrow_schema(schema)
        self.root = options["path"]
        self.member = options.get("member")
        self.required = [c for c in options.get("required", "").split(",") if c]
        self.optional = options.get("optional", "false").lower() == "true"
        self.allowed: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            values = (f.value,) if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            if values is not None and f.attribute[0] in HEAD[:3]:
                name = f.attribute[0]
                self.allowed[name] = self.allowed.get(name, set(values)) & set(values)
            else:
                yield f

    def archives(self) -> list[Member]:
        store, inner = _store(self.root)
        info = store.get_file_info(inner)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner, recursive=True))
        found = []
        for f in sorted(files, key=lambda f: f.path):
            name = posixpath.basename(f.path)
            city, recording = place_of(name)
            if f.type == fs.FileType.File and name.endswith(".zip") and city:
                one = Member(f.path, city, recording, name)
                if all(getattr(one, k) in v for k, v in self.allowed.items()):
                    found.append(one)
        return found

    def members(self, archive: Member) -> list[Member]:
        raise NotImplementedError

    def _planned(self, archive: Member) -> list[Member]:
        try:
            return self.members(archive)
        except Exception as e:  # a failure is a row, so that all of them are reported together
            return [replace(archive, error=f"{type(e).__name__}: {e}")]

    def partitions(self) -> list[Member]:
        with ThreadPoolExecutor(16) as pool:
            return [m for members in pool.map(self._planned, self.archives()) for m in members]


class _RowsReader(_Reader):
    def members(self, archive: Member) -> list[Member]:
        with open_archive(self.root, archive.path) as z:
            name = member_of(z, self.member)
        if name is None and not self.optional:
            raise FileNotFoundError(f"{self.member} is not in the archive")
        return [] if name is None else [replace(archive, member=name)]

    def _batch(self, p: Member, error: str | None, rows: pa.RecordBatch | None) -> pa.RecordBatch:
        n = 1 if rows is None else rows.num_rows
        first = {"city": p.city, "recording_id": p.recording_id, "source_archive": p.source_archive, "status": "ok" if error is None else "failed", "error": error}
        columns = [pa.array([first[f.name]] * n, pa.string()) if f.name in first else pa.nulls(n, f.type) if rows is None else rows.column(f.name) for f in self.arrow]
        return pa.RecordBatch.from_arrays(columns, schema=self.arrow)

    def read(self, p: Member) -> Iterator[pa.RecordBatch]:
        if p.error:
            yield self._batch(p, p.error, None)
            return
        wanted = pa.schema([f for f in self.arrow if f.name not in HEAD])
        try:
            with open_archive(self.root, p.path) as z, z.open(p.member) as stream:
                for block in decode_csv(stream, wanted, self.required):
                    yield self._batch(p, None, block)
        except Exception as e:  # the rows before it are void: see archives.split_failures
            yield self._batch(p, f"{type(e).__name__}: {e}", None)


class _MembersReader(_Reader):
    """All members, each read to its end against its checksum."""

    def members(self, archive: Member) -> list[Member]:
        with open_archive(self.root, archive.path) as z:
            found = [replace(archive, member=m.filename, size=m.file_size, packed_size=m.compress_size) for m in z.infolist()]
        return found or [archive]

    def read(self, p: Member) -> Iterator[pa.RecordBatch]:
        error = p.error
        if p.member is not None:
            try:
                with open_archive(self.root, p.path) as z, z.open(p.member) as stream:
                    while stream.read(BLOCK_BYTES):
                        pass
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
        values = {"city": p.city, "recording_id": p.recording_id, "source_archive": p.source_archive, "member": p.member, "size": p.size, "packed_size": p.packed_size, "ok": error is None, "error": error}
        yield pa.RecordBatch.from_arrays([pa.array([values[f.name]], f.type) for f in self.arrow], schema=self.arrow)


class ArchiveRows(DataSource):
    """The rows of the member `member` of each archive below `path`. Options: `required`, comma-separated columns that it must have; `optional`, true where an archive may lack the member."""

    @classmethod
    def name(cls) -> str:
        return "archive_rows"

    def schema(self) -> str:
        return ", ".join(f"{h} string" for h in HEAD)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _RowsReader(schema, self.options)


class ArchiveMembers(DataSource):
    """A row for each member of each archive below `path`, with the result of its checksum; an archive that cannot be opened has one row without a member."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return MEMBERS_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _MembersReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveRows)
    spark.dataSource.register(ArchiveMembers)

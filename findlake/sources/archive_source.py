"""A data source for the members of archives: `spark.read.format("archive_members")`, planned from the directories of zip files."""

from __future__ import annotations

import fnmatch
import io
import tarfile
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from findlake.sources.archives import BATCH, BROKEN, Limits, _tar, _zip, planned, walk, zip_entries

SCHEMA = "archive string, seq int, name string, size long, reason string, content binary"
_ARROW = pa.schema([("archive", pa.string()), ("seq", pa.int32()), ("name", pa.string()), ("size", pa.int64()), ("reason", pa.string()), ("content", pa.binary())])
#: Bytes of an archive that a task unpacks.
PER_TASK = 32 << 20


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of an address; a path without a scheme is a local one."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Seekable(io.RawIOBase):
    """A file of pyarrow's as Python's readers expect it: a place before its start is an OSError."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = 0) -> int:
        try:
            return self.file.seek(at, whence)
        except pa.ArrowInvalid as refused:
            raise OSError(str(refused)) from refused

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, into) -> int:
        data = self.file.read(len(into))
        into[: len(data)] = data
        return len(data)


def _opened(store: fs.FileSystem, path: str) -> io.BufferedReader:
    return io.BufferedReader(_Seekable(store.open_input_file(path)), 1 << 16)


@dataclass
class Run(InputPartition):
    """Entries `first` to before `end` of an archive; None for all of an archive that can only be read from its start."""

    archive: str
    size: int
    first: int = 0
    end: int | None = None
    used: int = 0
    count: int = 0


class Members(DataSourceReader):
    def __init__(self, path: str, pattern: str, limits: Limits, per_task: int) -> None:
        self.path, self.pattern, self.limits, self.per_task = path, pattern, limits, per_task

    def _plan(self, store: fs.FileSystem, found: fs.FileInfo) -> list[Run]:
        if not found.path.endswith(".zip"):
            return [Run(found.path, found.size)]
        try:
            # only the directory at the end of the file is read
            with _opened(store, found.path) as file, zipfile.ZipFile(file) as z:
                return [Run(found.path, found.size, *run) for run in planned(zip_entries(z), found.size, self.limits, self.per_task)]
        except BROKEN:
            return [Run(found.path, found.size)]

    def partitions(self) -> list[InputPartition]:
        store, path = file_system(self.path)
        found = sorted((f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and fnmatch.fnmatch(f.base_name, self.pattern)), key=lambda f: f.path)
        with ThreadPoolExecutor(16) as pool:
            return [run for runs in pool.map(lambda f: self._plan(store, f), found) for run in runs]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.path)
        rows: list[tuple] = []
        held = 0
        with _opened(store, run.archive) as file:
            if run.end is None:
                members = walk((_zip if run.archive.endswith(".zip") else _tar)(file), run.size, self.limits)
            else:
                members = walk(iter(zip_entries(zipfile.ZipFile(file))[run.first : run.end]), run.size, self.limits, run.first, run.used, run.count)
            for member in members:
                rows.append((run.archive, *member))
                held += len(member[-1] or b"")
                if held > BATCH or len(rows) >= 10_000:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class ArchiveMembers(DataSource):
    """Files of all archives under a folder. Options: path; pattern (`*.zip`); perTask, bytes of an archive that a task
    unpacks; and the fields of `Limits`. A large zip file is many tasks, as its directory says where each member is and
    what those before it give; a compressed tar file is read from its start by one."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Members:
        given = {k.lower(): v for k, v in self.options.items()}
        limits = Limits(**{f.name: type(f.default)(float(given[f.name])) for f in fields(Limits) if f.name in given})
        return Members(given["path"], given.get("pattern", "*.zip"), limits, int(given.get("pertask", PER_TASK)))


def archive_members(spark: SparkSession, path: str, pattern: str = "*.zip", limits: Limits = Limits(), per_task: int = PER_TASK) -> DataFrame:
    """(archive, seq, name, size, reason, content), as of `read_archives`, of archives in any folder that pyarrow's file systems reach."""
    spark.dataSource.register(ArchiveMembers)
    options = {f.name: str(getattr(limits, f.name)) for f in fields(Limits)}
    return spark.read.format("archive_members").options(path=path, pattern=pattern, perTask=str(per_task), **options).load()


def write_archives(members: DataFrame, folder: str, kind: str = "zip") -> DataFrame:
    """(archive, file, members): an archive written to the folder for each value of archive in members (archive, seq, name,
    content). An archive is written under a name of its own and then moved to its place, so that a task that is lost or
    repeated leaves no half archive there."""

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        rows = pdf.sort_values(["seq", "name"])
        if kind == "zip":
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                for name, content in zip(rows["name"], rows["content"], strict=True):
                    z.writestr(zipfile.ZipInfo(name), bytes(content), zipfile.ZIP_DEFLATED)
        else:
            with tarfile.open(fileobj=held, mode="w:gz") as t:
                for name, content in zip(rows["name"], rows["content"], strict=True):
                    info = tarfile.TarInfo(f"root/{name}")
                    info.size = len(content)
                    t.addfile(info, io.BytesIO(bytes(content)))
        store, path = file_system(folder)
        store.create_dir(path)
        name = f"{key[0]}.{'zip' if kind == 'zip' else 'tar.gz'}"
        part = f"{path}/{uuid.uuid4().hex}.part"
        with store.open_output_stream(part, compression=None) as out:
            out.write(held.getvalue())
        store.move(part, f"{path}/{name}")
        return pd.DataFrame({"archive": [key[0]], "file": [name], "members": [len(rows)]})

    kind_of = members.schema["archive"].dataType.simpleString()
    return members.select("archive", "seq", "name", "content").groupBy("archive").applyInPandas(write, f"archive {kind_of}, file string, members int")

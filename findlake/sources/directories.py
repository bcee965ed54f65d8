"""A folder of source files in two phases: names are listed, judged and ordered before any content is read."""

from __future__ import annotations

import functools
import os
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.functions import paths
from findlake.operators.order import placed
from findlake.sources.archive_source import file_system
from findlake.sources.archives import MOST_BYTES, decoded
from findlake.sources.folders import written


#: Entries after which a task that walks a folder leaves the folders that it has still to enter to other tasks.
ENTRIES = 10_000
#: Names under which `write_files` writes: they are no files of the folder.
_PART = re.compile(r"\.[0-9a-f]{32}\.part")


def _entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int]]:
    """(name, is a folder, size) of the folders and regular files in a folder; links and special files are passed over."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for x in found:
                if x.is_dir(follow_symlinks=False):
                    yield x.name, True, 0
                elif x.is_file(follow_symlinks=False):
                    yield x.name, False, x.stat(follow_symlinks=False).st_size
    else:
        for x in store.get_file_info(fs.FileSelector(folder)):
            if x.type in (fs.FileType.Directory, fs.FileType.File):
                yield x.base_name, x.type == fs.FileType.Directory, x.size or 0


def list_directory(spark: SparkSession, root: str, entries: int = ENTRIES) -> DataFrame:
    """(path, address, size) of the regular files under a folder: path is relative to it, address is that under `root`.
    Contents are not read; what is a link, or lies behind one, is passed over.

    Tasks walk the folders and write what they find, so that the driver holds no names: it begins with the folder itself, and each
    task leaves the folders that it has not entered after so many entries to the tasks of the next round."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = file_system(root)
        base = base.rstrip("/")
        rows: list[tuple] = []
        for batch in batches:
            for begin in batch["path"]:
                waiting, met = [begin], 0
                while waiting and met <= entries:
                    folder = waiting.pop()
                    for name, is_folder, size in _entries(store, f"{base}/{folder}"):
                        met += 1
                        path = f"{folder}/{name}" if folder else name
                        if is_folder:
                            waiting.append(path)
                        elif folder or not _PART.fullmatch(name):
                            rows.append((path, size, False))
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=["path", "size", "open"])
                            rows = []
                rows += [(folder, 0, True) for folder in waiting]
        if rows:
            yield pd.DataFrame(rows, columns=["path", "size", "open"])

    tasks = 4 * spark.sparkContext.defaultParallelism
    folders = spark.createDataFrame([("",)], "path string")
    rounds = []
    while not rounds or not folders.isEmpty():
        rounds.append(written(folders.repartition(tasks).mapInPandas(walk, "path string, size long, open boolean"), "listed"))
        folders = rounds[-1].where("open").select("path")
    found = functools.reduce(DataFrame.union, rounds).where("not open")
    return found.select("path", F.concat(F.lit(f"{root.rstrip('/')}/"), "path").alias("address"), "size")


def scan_directory(spark: SparkSession, root: str) -> DataFrame:
    """(place, path, size, language, analysable, text) of the files under a folder that are to be read, in one order by the
    parts of their paths. Only the contents of these are read, and of none beyond MOST_BYTES; a binary or larger one has no text."""
    files = list_directory(spark, root).where(paths.should_read(F.col("path")))
    ordered = placed(files, [F.split("path", "/")])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = file_system(root)
        for batch in batches:
            held, n = [], 0
            for row in batch.itertuples(index=False):
                content = None
                if row.size <= MOST_BYTES:
                    with store.open_input_stream(f"{base.rstrip('/')}/{row.path}", compression=None) as f:
                        content = f.read()
                held.append((*row, content))
                n += len(content or b"")
                if n > 8 << 20:
                    yield pd.DataFrame(held, columns=[*batch.columns, "content"])
                    held, n = [], 0
            yield pd.DataFrame(held, columns=[*batch.columns, "content"])

    contents = ordered.select("place", "path", "size").mapInPandas(read, "place long, path string, size long, content binary")
    language = paths.language(F.col("path"))
    return contents.select("place", "path", "size", language.alias("language"), paths.should_analyse(F.col("path")).alias("analysable"), decoded(F.col("content")).alias("text"))


def write_files(files: DataFrame, root: str) -> DataFrame:
    """(path): each of files (path, content) written under a folder. A file is written under a name of its own and then
    moved to its place, so a task that is repeated leaves the same files."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = file_system(root)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                target = f"{base}/{path}"
                folder = target.rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder)
                    made.add(folder)
                part = f"{base}/.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(bytes(content))
                store.move(part, target)
            yield batch[["path"]]

    return files.select("path", "content").mapInPandas(write, "path string")

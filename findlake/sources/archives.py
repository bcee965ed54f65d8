"""Archive members and file contents as rows: what is kept, what is rejected and why."""

from __future__ import annotations

import functools
import io
import re
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findlake.functions.paths import rejection

#: Bytes beyond which a file is not read, and bytes in which a zero means that it is binary.
MOST_BYTES, PROBED = 1_000_000, 8000


def decoded(content: Column) -> Column:
    """Text of a file's bytes; null if it is too large or binary, replacement characters for malformed bytes."""
    binary = F.position(F.lit(b"\0"), F.substring(content, 1, PROBED)) > 0
    return F.when((F.octet_length(content) > MOST_BYTES) | binary, None).otherwise(F.make_valid_utf8(content.cast("string")))


def budgeted(members: DataFrame, per_file: int, total: int) -> DataFrame:
    """members (archive, seq, name, size) with reason, the running total of kept bytes and whether it went over.

    A rejected member takes no part of the budget."""
    reason = F.coalesce(rejection(F.col("name")), F.when(F.col("size") > per_file, "too_large"))
    kept = F.sum(F.when(F.col("reason").isNull(), F.col("size"))).over(Window.partitionBy("archive").orderBy("seq"))
    return members.withColumn("reason", reason).withColumn("total", F.coalesce(kept, F.lit(0))).withColumn("aborted", F.col("total") > total)


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, text) of all files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), decoded(F.col("content")).alias("text"))


@dataclass(frozen=True)
class Limits:
    """What an archive may hold: bytes of a member (a larger one is rejected and reading goes on), members and bytes in
    all, and bytes in all for each byte of the archive, to two digits (reading stops beyond them)."""

    member: int = 8 << 20
    members: int = 30_000
    total: int = 500 << 20
    ratio: float = 20.0


#: Bytes that are unpacked at a time, and bytes of contents that a task holds before it passes them on.
PIECE, BATCH = 1 << 16, 8 << 20


def _refused(name: str, depth: int = 24) -> str | None:
    """`rejection` of a single name, for the budget that is kept while an archive is read."""
    plain = name.replace("\\", "/")
    parts = [p for p in plain.split("/") if p not in ("", ".")]
    if not name or "\0" in name:
        return "traversal"
    if plain.startswith("/"):
        return "absolute_path"
    if re.match("[A-Za-z]:", plain):
        return "drive_letter"
    return "traversal" if ".." in parts else "too_deep" if len(parts) > depth else None


def zip_entries(z: zipfile.ZipFile) -> list[tuple]:
    """(name, is a folder, is a link, how to open it, bytes as stated, bytes in the archive)."""
    return [(m.filename, m.is_dir(), (m.external_attr >> 16) & 0o170000 == 0o120000, functools.partial(z.open, m), m.file_size, m.compress_size) for m in z.infolist()]


def _zip(file) -> Iterator[tuple]:
    with zipfile.ZipFile(file) as z:
        yield from (entry[:4] for entry in zip_entries(z))


def _tar(file) -> Iterator[tuple]:
    with tarfile.open(fileobj=file, mode="r|*") as t:
        for m in t:
            name = m.name.split("/", 1)[1] if "/" in m.name else ""
            yield name, m.isdir(), not (m.isdir() or m.isreg()), functools.partial(t.extractfile, m)


BROKEN = (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, zlib.error, RuntimeError, NotImplementedError)


def budget_of(size: int, limits: Limits) -> tuple[int, str]:
    """The bytes that an archive of `size` bytes may give, and the reason beyond them."""
    return min((limits.total, "total_bytes"), (int((limits.ratio + 0.005) * size), "compression_ratio"))


def walk(entries: Iterator[tuple], size: int, limits: Limits, first: int = 0, used: int = 0, count: int = 0) -> Iterator[tuple]:
    """(seq, name, size, reason, content) of the files among an archive's entries from number `first` on, when the ones
    before were `count` members and gave `used` bytes. Sizes are those that come out, whatever the archive says; what is
    rejected takes no part of the limits of bytes, but counts as a member.

    Ends with a row without a name whose reason is the limit that was passed, or 'unreadable' for a broken archive."""
    most, over = budget_of(size, limits)
    seq = first - 1
    try:
        for seq, (name, folder, special, opened, *_) in enumerate(entries, first):
            if folder:
                continue
            count += 1
            if count > limits.members:
                yield seq, None, None, "file_count", None
                return
            if special:
                yield seq, name, None, "symlink", None
                continue
            reason = _refused(name)
            held = bytearray()
            with opened() as source:
                while len(held) <= limits.member and (piece := source.read(PIECE)):
                    held += piece
                    if not reason and used + len(held) > most:
                        yield seq, None, None, over, None
                        return
            if len(held) > limits.member:
                yield seq, name, None, reason or "too_large", None
                continue
            used += 0 if reason else len(held)
            yield seq, name, len(held), reason, bytes(held)
    except BROKEN:
        yield seq + 1, None, None, "unreadable", None


def planned(entries: list[tuple], size: int, limits: Limits, per_task: int) -> list[tuple[int, int, int, int]]:
    """(first, end, used, count) of runs of a zip's entries with about `per_task` bytes in the archive, by what its
    directory states. No entry gives more than it states, so the directory tells the budget that a run begins with, and
    the run in which a limit is passed is the last."""
    most, _ = budget_of(size, limits)
    runs, first, used, count, weight, begun = [], 0, 0, 0, 0, (0, 0)
    for k, (name, folder, special, _, stated, held) in enumerate(entries):
        if weight and weight + held > per_task:
            runs.append((first, k, *begun))
            first, weight, begun = k, 0, (used, count)
        weight += held
        if folder:
            continue
        count += 1
        reach = stated if stated <= limits.member else min(stated, (limits.member // PIECE + 1) * PIECE)
        if count > limits.members or (not special and not _refused(name) and used + reach > most):
            return [*runs, (first, k + 1, *begun)]
        if not special and not _refused(name) and stated <= limits.member:
            used += stated
    return [*runs, (first, len(entries), *begun)]


def _opened(unpack: Callable, content: bytes) -> Iterator[tuple]:
    yield from unpack(io.BytesIO(content))


def read_archives(spark: SparkSession, path: str, pattern: str, limits: Limits = Limits()) -> DataFrame:
    """(archive, seq, name, size, reason, content) of the files in all zip or tar.gz archives of a folder.

    A rejected file has a reason; a link or a file that is too large has neither size nor content. Where a limit of the whole archive is passed, reading of
    it stops and its last row has that reason and no name: the archive as a whole is then to be refused. A task unpacks
    whole archives by pieces and passes contents on in batches. The first folder of a tar member's name is dropped."""
    unpack = _zip if pattern.endswith(".zip") else _tar
    columns = ["archive", "seq", "name", "size", "reason", "content"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                for member in walk(_opened(unpack, bytes(content)), len(content), limits):
                    rows.append((archive, *member))
                    held += len(member[-1] or b"")
                    if held > BATCH or len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=columns, dtype=object)
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, seq int, name string, size long, reason string, content binary")

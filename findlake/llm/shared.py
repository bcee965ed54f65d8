"""Helpers shared by the training-data operators: materialised tables, content keys and array sums."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which all executors see. Where it is unset and all executors are threads of
    this process (tests), a new local one is set; on a cluster that is an error, for no folder of one machine would do."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: it has to name a folder that driver and executors share")
        held = tempfile.mkdtemp(prefix="findlake-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(held)
    return held


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: its lineage ends in files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what `materialise` wrote for df, once no later step reads it, neither at first nor again."""
    files = df.inputFiles()
    if files:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def give_back(spark: SparkSession | None = None) -> None:
    """Hand memory that arrays have left to the system: a Python worker lives on, and the next stage's would lie beside it.
    On the driver, with spark, the JVM collects too, gives its free heap back and lets go of finished queries' shuffles, and
    so do those of the executors: they keep what the largest shuffle took, and Python workers of later steps lie beside it.
    Tasks are as many as cores, so that each executor gets one, which Spark does not promise; nothing depends on it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps what it likes
    if spark is not None:
        cores = spark.sparkContext.defaultParallelism
        collected = spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("collected"))
        collected.write.format("noop").mode("overwrite").save()
        spark._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """`name`, or one made from it that no column of df has, in any case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"own {name}"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def content_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """16 bytes from the id and the whole text. It is the same however often the row is read, unlike a running number;
    rows equal in both columns share it and share every result that depends on them alone."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit("|"), F.coalesce(F.col(text), F.lit("")))))


#: Cells of an array that is summed over tasks travel in slices of this many.
SLICE = 1 << 14
#: Arrays that are added up in one place in each round of a sum, and the rounds before the last.
FAN, ROUNDS = 64, 2


def emit_slices(counts: np.ndarray) -> pd.DataFrame:
    """One row per slice of a task's array that has anything in it, with the number of the task's group."""
    task = TaskContext.get()
    group = task.partitionId() // FAN if task else 0
    flat = np.ascontiguousarray(counts).reshape(-1)
    parts = [(i // SLICE, group, flat[i : i + SLICE].tobytes()) for i in range(0, len(flat), SLICE) if flat[i : i + SLICE].any()]
    return pd.DataFrame(parts, columns=["slice", "group", "part"])


#: Rows of `emit_slices`.
PARTS = "slice int, group long, part binary"


def sum_slices(parts: DataFrame, dtype: str, size: int) -> np.ndarray:
    """Sum the arrays of all tasks, slice by slice, and bring the `size` cells to the driver.

    The input is one row per task and slice. Slices of FAN tasks are added up in one place, then those of FAN such
    groups, so the number of places follows the number of tasks; the last round adds (tasks / 4096) rows a slice.
    What reaches the driver has a fixed size, whatever the corpus is.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, group, part in zip(batch["slice"], batch["group"], batch["part"], strict=True):
                values = np.frombuffer(part, dtype)
                if (k, group) in held:
                    held[k, group] += values
                else:
                    held[k, group] = values.copy()
            if len(held) > 1024:
                yield rows(held)
                held = {}
        yield rows(held)

    def rows(held: dict[tuple[int, int], np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame([(k, group // FAN, v.tobytes()) for (k, group), v in held.items()], columns=["slice", "group", "part"])

    summed = parts
    for _ in range(ROUNDS):
        summed = summed.repartition("slice", "group").mapInPandas(add, PARTS)
    total = np.zeros(-(-size // SLICE) * SLICE, dtype)
    for row in summed.repartition("slice").mapInPandas(add, PARTS).toLocalIterator():
        at = row["slice"] * SLICE
        values = np.frombuffer(bytes(row["part"]), dtype)
        total[at : at + len(values)] += values
    return total[:size]

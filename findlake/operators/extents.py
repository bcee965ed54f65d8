"""Where things in a file's code end: functions, signatures, list callbacks and nested blocks, a row for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from findlake.functions import kernels


def _each(files: DataFrame, found: Callable[[list[str], str], list[tuple]], columns: str) -> DataFrame:
    """Rows (repo, path, *columns) that a kernel finds in the code of each of files (repo, path, language, code)."""
    names = ["repo", "path", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(repo, path, *x) for repo, path, language, code in batch.itertuples(index=False) for x in found(list(code), language)]
            yield pd.DataFrame(rows, columns=names)

    repo = files.schema["repo"].dataType.simpleString()
    return files.select("repo", "path", "language", "code").mapInPandas(run, f"repo {repo}, path string, {columns}")


def function_extents(files: DataFrame) -> DataFrame:
    return _each(files, kernels.functions, "line int, name string, last int, logic int")


def signature_extents(files: DataFrame) -> DataFrame:
    """Signatures that begin with def, and whether a default in them is shared by calls."""
    return _each(files, lambda code, _: kernels.signatures(code), "line int, name string, last int, shared boolean")


def callback_extents(files: DataFrame) -> DataFrame:
    """List callbacks, and whether they make an element without a key."""
    return _each(files, lambda code, _: kernels.callbacks(code), "line int, last int, unkeyed boolean")


def nesting(files: DataFrame) -> DataFrame:
    """The deepest nesting of control flow of each file and the first line that has it; 0 and 0 without any."""
    return _each(files, lambda code, _: [kernels.deepest(code)], "depth int, line int")


def logic_counts(files: DataFrame) -> DataFrame:
    return _each(files, lambda code, _: [(kernels.logic_lines(code),)], "n int")

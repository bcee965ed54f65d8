"""Lines and text kernels. A file's lines stay in arrays, so context needs no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.functions.blanking import with_code

#: A line ends at any of these; the pair counts once.
_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def split_lines(text: Column) -> Column:
    """Lines of a text, without an empty one after the last line end; an empty text has none."""
    parts = F.split(text, _LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def viewer_line_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.regexp_count(text, F.lit("\n")) + 1)


def context(lines: Column, line: Column, before: int, after: int) -> Column:
    """The lines from `before` above to `after` below a line (from 1), clamped to the file."""
    first = F.greatest(line - before, F.lit(1))
    return F.array_join(F.slice(lines, first, line + after - first + 1), "\n")


def with_raw(files: DataFrame) -> DataFrame:
    """files with raw, their lines, in place of their text. A null text has no lines."""
    return files.withColumn("raw", F.coalesce(split_lines(F.col("text")), F.array().cast("array<string>"))).drop("text")


def with_lines(files: DataFrame) -> DataFrame:
    """files with raw and code: their lines, and the same with comments and strings blanked.

    Whether a character is code depends on all before it, so this is a batch function over whole files; everything
    after it is built-in functions on the two arrays."""
    return with_code(with_raw(files))


def clamp(text: Column, lines: int, characters: int, marker: str = "\n… (truncated)") -> Column:
    """At most so many lines and then characters, with a marker where something went."""
    rows = F.split(text, "\n", -1)
    short = F.array_join(F.slice(rows, 1, lines), "\n")
    cut = F.substring(short, 1, characters)
    return F.when((F.size(rows) > lines) | (F.length(short) > characters), F.concat(cut, F.lit(marker))).otherwise(text)


def entropy(value: Column) -> Column:
    """Shannon entropy in bits of a string's characters."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    parts = F.transform(F.array_sort(F.array_distinct(chars)), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n > 0, -F.aggregate(parts, F.lit(0.0), lambda a, p: a + p * F.log2(p))).otherwise(0.0)


def redacted(value: Column) -> Column:
    """Three leading and two trailing characters with the length."""
    return F.concat(F.substring(value, 1, 3), F.lit("…"), F.substring(value, -2, 2), F.lit(" ("), F.length(value), F.lit(" characters)"))

"""Package names, version specifications and requirement lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def exact_version(spec: Column) -> Column:
    """The version of an == pin, or null."""
    return F.nullif(F.regexp_extract(F.trim(spec), r"^==\s*(\d+(?:\.\d+)*(?:\.[A-Za-z0-9]+)?)$", 1), F.lit(""))


def coerced(spec: Column) -> Column:
    """x.y.z out of a range, or null for what names no release (links, workspaces, any)."""
    refused = spec.rlike(r"^(?:workspace|git|file|link|https?|npm):|^\*$|/")
    return F.when(refused, None).otherwise(F.nullif(F.regexp_extract(spec, r"(\d+\.\d+\.\d+)", 1), F.lit("")))


def major(version: Column) -> Column:
    return F.split_part(version, F.lit("."), F.lit(1))


def version_key(version: Column) -> Column:
    """A value that orders versions: by their numbers, where missing ones are 0; before a release its pre-releases, after
    it its post-releases; of two of these by their parts, numbers as numbers and before words. Null for what begins with no number.

    A leading v and build metadata after a plus sign do not count, nor does case."""
    plain = F.lower(F.regexp_replace(F.trim(version), r"^[vV]|\+.*$", ""))
    numbers = F.split(F.regexp_extract(plain, r"^(\d+(?:\.\d+)*)", 1), r"\.")
    release = F.transform(numbers, lambda x: x.try_cast("decimal(38,0)"))
    rest = F.regexp_replace(plain, r"^\d+(?:\.\d+)*", "")
    # arrays compare part by part, so zeros at the end must not make one longer
    significant = F.greatest(F.lit(0), F.array_max(F.transform(release, lambda x, k: F.when(x > 0, k + 1).otherwise(0))))
    part = lambda p: F.struct((~p.rlike(r"^\d+$")).alias("word"), F.when(p.rlike(r"^\d+$"), p.try_cast("decimal(38,0)")).otherwise(0).alias("number"), F.when(p == "dev", "").otherwise(p).alias("text"))
    parts = F.transform(F.regexp_extract_all(rest, F.lit("[0-9]+|[a-z]+"), F.lit(0)), part)
    stage = F.when(F.size(parts) == 0, 1).when(rest.rlike(r"^[-._]?(post|rev|r)\d*$"), 2).otherwise(0)
    return F.when(plain.rlike(r"^\d"), F.struct(F.slice(release, 1, significant).alias("release"), stage.alias("stage"), parts.alias("parts")))


def requirement(line: Column) -> Column:
    """struct(name, spec) of a requirements line without extras, marker and comment; null for options and blanks."""
    pattern = r"^\s*([A-Za-z0-9._-]+)\s*(?:\[[^\]]*\])?\s*([^;#]*)"
    name = F.regexp_extract(line, pattern, 1)
    return F.when((name != "") & ~line.rlike(r"^\s*[-#]"), F.struct(normal_name(name).alias("name"), F.trim(F.regexp_extract(line, pattern, 2)).alias("spec")))

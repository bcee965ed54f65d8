"""Identities of findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(*parts: Column) -> Column:
    text = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha1(F.concat_ws("|", *text).cast("binary")), 1, 12)


def fingerprint(rule_id: Column, file: Column, line: Column, key: Column | None = None) -> Column:
    """Identity across runs: of the rule and its key, where the rule has one ('' included), else of the rule and its place."""
    place = _digest(rule_id, file, F.coalesce(line, F.lit(0)))
    return place if key is None else F.when(key.isNull(), place).otherwise(_digest(rule_id, key))


def finding_id(rule_id: Column, file: Column, line: Column, title: Column) -> Column:
    """Identity within a report."""
    return _digest(rule_id, file, F.coalesce(line, F.lit(0)), title)

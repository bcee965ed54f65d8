"""Places of regular-expression matches in a text, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A span of a text: code points, end exclusive; order: place of its kind in the list of kinds.
SPAN = "array<struct<start:int,order:int,end:int,kind:string>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def find_spans(text: Column, pattern: str, kind: str, order: int, fits: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """All leftmost non-overlapping matches of a Java pattern whose `group` passes `fits`, in order.

    A place is what the gaps and matches before it measure: gaps come from splitting at the pattern, matches from
    extracting it. A null text has no match."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(match.alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"), F.slice(F.split(text, pattern, -1), 1, F.size(match)).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["m"])
        one = F.array(F.struct(begin.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(kind).alias("kind")))
        return F.struct(end.alias("at"), (F.concat(acc["out"], one) if fits is None else F.when(fits(x["g"]), F.concat(acc["out"], one)).otherwise(acc["out"])).alias("out"))

    return F.coalesce(F.aggregate(parts, start, step, lambda acc: acc["out"]), no_spans())


def joined(spans: Column) -> Column:
    """kind:start:end of each span, with commas between."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def merged(spans: Column) -> Column:
    """Spans by start, those that touch or overlap as one (of the first one's kind)."""
    ordered = F.array_sort(spans)

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["start"].alias("start"), last["order"].alias("order"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(s)))

    step_safe = lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).otherwise(step(acc, s))
    return F.aggregate(ordered, no_spans(), step_safe)


def redact(text: Column, spans: Column) -> Column:
    """The text with each span as [KIND]; spans must be ordered and apart."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))

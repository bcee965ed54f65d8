"""Sources mixed to target weights by weighted fair queueing, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.llm.shared import content_key, materialise
from findlake.llm.totals import running_totals

#: A word: anything between blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a source are dealt to this many joins with its target, so that a source of a third of all rows is no hot key.
SALTS = 16


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> tuple[DataFrame, float]:
    """(source_key, source_size, rank, source_start, target) for each row (source_key, source_size), and the total budget.

    The budget is `share` of all sizes. Sources by key take the weights in turn. A target is weight * level, but at
    most `most` times the source's size; the level at which targets sum to the budget is found by reading what the
    capped sources leave to the others, as often as the capped set grows. That is Newton's method on a concave,
    piecewise linear function, from below: few rounds at any number of sources, each one aggregate of three exact sums.
    """
    ordered = materialise(running_totals(sizes.withColumn("one", F.lit(1)), ["source_key"], {"rank": "one", "source_start": "source_size"}).drop("one"), "sources")
    ordered = ordered.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    total, weight = ordered.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    budget = total * share
    level = budget / weight if weight else 0.0
    while True:
        capped = F.col("cap") <= F.col("weight") * F.lit(level)
        held, left = ordered.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        risen = (budget - held) / left if left else level
        if risen <= level:
            break
        level = risen
    target = F.when(F.col("cap") <= F.col("weight") * F.lit(level), F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level))
    return ordered.select("source_key", "source_size", "rank", "source_start", target.alias("target")), budget


def _with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    salted = targets.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    return rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["source_key", "salt"]).drop("salt")


def mix_parts(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, key: Column | None = None) -> DataFrame:
    """One row per document and pass over its source, with its place in the mix: key, doc_id, source_rank, before, pass,
    size, source_size, target, finish, at, words. Rows that the mix has no room for keep a first pass of 0 words.

    Each source is a queue: its documents by a hash of id and text, then the same ones again, up to `most` passes. The
    virtual finish time of a document is the words of its source up to its end, divided by the source's target, so all
    queues advance at their targets' rates and reach them at time 1. The document that a source is at by then is cut
    there. Documents are range-sorted by finish time over the whole table, and the mix ends with the budget.
    `at` counts the words of the mix before a part.

    Every order is total up to rows equal in all that is returned, and every sum is one of integers: the same rows give
    the same mix, however they are dealt. A null text has no words, and takes no part; a null source is one source of
    its own, the last; rows without an id and repeated rows are documents like others, and rows that are equal in id,
    text and source stand side by side. Other columns are not read. An empty table gives no rows.
    """
    words = F.regexp_count(F.col("text").cast("string"), F.lit(WORD))
    source = F.col("source").cast("string")
    rows = docs.select(
        (content_key() if key is None else key).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("source_key"),
        F.coalesce(words, F.lit(0)).cast("long").alias("size"),
    )
    rows = materialise(rows, "mix-sizes")
    targets, budget = source_targets(rows.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, share, most)
    queued = running_totals(rows.where("size > 0"), ["source_key", "key", "doc_id"], {"before": "size"})
    queued = _with_targets(queued, targets).withColumn("before", F.col("before") - F.col("source_start"))
    passes = queued.withColumn("pass", F.explode(F.array(*[F.lit(p) for p in range(most)]))).withColumn("start", F.col("before") + F.col("pass") * F.col("source_size"))
    passes = passes.withColumn("words", F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - F.col("start")))).where("words > 0 or pass = 0")
    passes = passes.withColumn("finish", F.least(F.lit(1.0), (F.col("start") + F.col("size")) / F.col("target")))
    mixed = running_totals(passes.where("words > 0"), ["finish", "rank", "start"], {"at": "words"})
    mixed = mixed.withColumn("words", F.greatest(F.lit(0), F.least(F.col("words"), F.lit(int(budget)) - F.col("at"))))
    names = ["key", "doc_id", F.col("rank").alias("source_rank"), "before", "pass", "size", "source_size", "target", "finish", "at", "words"]
    none = [F.lit(None).cast("double").alias("finish"), F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("words")]
    unused = passes.where("words <= 0").select(*names[:8], *none)
    empty = _with_targets(rows.where("size = 0"), targets).select("key", "doc_id", F.col("rank").alias("source_rank"), F.lit(None).cast("long").alias("before"), F.lit(0).alias("pass"), "size", "source_size", "target", *none)
    return mixed.select(*names).unionByName(unused).unionByName(empty)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words over all passes), first_at (words of the mix
    before the document's first part, null if it has none). Hard rows are those of `mix_parts`."""
    parts = mix_parts(docs, weights, share, most)
    out = ["doc_id", "size", "source_size", "target", "taken", "first_at"]
    # a document with words is told by its source and the words before it; one without is a single row already
    whole = parts.where("size > 0").groupBy("source_rank", "before", "doc_id", "size", "source_size", "target").agg(F.sum("words").alias("taken"), F.min("at").alias("first_at"))
    return whole.select(*out).unionByName(parts.where("size = 0").select("doc_id", "size", "source_size", "target", F.col("words").alias("taken"), F.col("at").alias("first_at")))


def mixed_texts(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(at, doc_id, pass, words, text): the mix itself in its order, each text once per pass; the text that a source's
    target cuts is its first words with one blank between them. Hard rows are those of `mix_parts`."""
    # the source is part of the key here, so that a key has one text and its parts join it once
    keyed = F.unhex(F.md5(F.concat(F.hex(content_key()), F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1")))))
    parts = mix_parts(docs, weights, share, most, keyed).where("words > 0")
    texts = docs.select(keyed.alias("key"), F.col("text").cast("string").alias("text")).dropDuplicates(["key"])
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("words").cast("int")), " ")
    return parts.join(texts, "key").select("at", "doc_id", "pass", "words", F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("text")).alias("text")).orderBy("at")

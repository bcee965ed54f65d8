"""A bounded sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(folds: int) -> Column:
    """crc32 of the decimal doc_id, modulo the number of folds; null without a doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, most_bytes: int = 1 << 25) -> DataFrame:
    """(doc_id, text, label, weight) of at most per_class documents of each label and most_bytes of their texts, those least by
    a hash of their id; a text that does not fit any more is passed over.

    `learn` is a condition on doc_id. Ids are chosen before any text is read, and lengths before any text is collected, so
    the rows hold 2 * most_bytes at most, however long texts are. A weight is how many labelled documents of its class each sampled one stands for. Labels other than 0
    and 1, and nulls, are left out; of an id with several labels the largest counts; of several texts the least.
    """
    held = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(learn)
    held = held.groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in held.groupBy("label").count().collect()}
    chosen = None
    for value in (0, 1):
        part = held.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).withColumn("place", F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")))
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # 2 * per_class rows at most
    sizes_of = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "place").agg(F.max(F.octet_length("text")).alias("bytes")).orderBy("label", "place").collect()
    left, fitting = {0: most_bytes, 1: most_bytes}, []
    for r in sizes_of:
        if r["bytes"] <= left[r["label"]]:
            left[r["label"]] -= r["bytes"]
            fitting.append((r["doc_id"], r["label"]))
    wanted = docs.sparkSession.createDataFrame(fitting, "doc_id long, label int")
    found = {v: sum(x == v for _, x in fitting) for v in (0, 1)}
    weight = F.when(F.col("label") == 1, sizes.get(1, 0) / max(found[1], 1)).otherwise(sizes.get(0, 0) / max(found[0], 1))
    return texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label", weight.alias("weight"))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, most_bytes: int = 1 << 25) -> tuple[list[str], list[int], list[float]]:
    """`training_rows` as lists (texts, labels, weights) in order of doc_id."""
    rows = training_rows(docs, labels, label, learn, per_class, most_bytes).orderBy("doc_id").collect()
    return [r["text"] for r in rows], [r["label"] for r in rows], [r["weight"] for r in rows]

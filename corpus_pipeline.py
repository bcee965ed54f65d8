"""A training corpus from raw documents: STAGES are applied in order, each to the Parquet that the one before left."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.llm.decontaminate import contaminated
from findlake.llm.labelled import fold
from findlake.llm.minhash import near_duplicates
from findlake.llm.packing import pack_documents
from findlake.llm.pii import redact_documents
from findlake.llm.shared import content_key, give_back, materialise, unused
from findlake.llm.toxicity import score_toxicity

#: Documents of a higher probability of toxicity go.
TOXIC = 0.5


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC, with all their columns; trained on the labels outside the held-out fold."""
    give_back(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = unused(docs, "own score")
    scored = score_toxicity(docs, labels, learn=fold(5) != 0, columns=tuple(docs.columns), score=name)
    return scored.where(F.col(name) < TOXIC).select(*_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; of equal rows one. Documents without a word all stay."""
    give_back(spark)
    own, kept = unused(docs, "own rid"), unused(docs, "kept rid")
    marked = near_duplicates(docs).where("kept").select(F.col("rid").alias(kept)).distinct()
    return docs.withColumn(own, content_key()).join(marked, F.col(own) == F.col(kept), "left_semi").dropDuplicates([own]).select(*_columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    give_back(spark)
    own, hit = unused(docs, "own rid"), unused(docs, "found rid")
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("rid").alias(hit)).distinct()
    return docs.withColumn(own, content_key()).join(found, F.col(own) == F.col(hit), "left_anti").select(*_columns(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind."""
    give_back(spark)
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, each with its place in a sequence of at most 1024 tokens."""
    give_back(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), end_id=2, capacity=1024)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("personal_data", personal_data), ("packing", packing)]

#: Stages that train a model or compare similarities cannot be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over `documents`, with every earlier stage written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

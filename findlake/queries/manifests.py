"""TOML manifests and compressed contents derived from parts and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.functions import manifests
from findlake.plans import bindings as b
from findlake.registry import query


@query("f097_pyproject", "SELECT p_brand AS repo, concat('pkg', p_partkey) AS name, CASE p_partkey % 3 WHEN 0 THEN concat('>=', p_size) WHEN 1 THEN concat('==', p_size, '.0') ELSE concat('^', p_size) END AS spec FROM part")
def pyproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements out of a project file for each part: of the project, an optional group or the other tool's table."""
    k, n, s = F.col("p_partkey") % 3, F.col("p_partkey"), F.col("p_size")
    text = (
        F.when(k == 0, F.concat(F.lit('[project]\nname = "x"\ndependencies = ["Pkg'), n, F.lit("[a] >="), s, F.lit("; python_version > '3'\"]\n")))
        .when(k == 1, F.concat(F.lit('[project.optional-dependencies]\ndev = ["pkg'), n, F.lit("=="), s, F.lit('.0"]\n')))
        .otherwise(F.concat(F.lit('[tool.poetry.dependencies]\npython = "^3"\npkg'), n, F.lit(' = "^'), s, F.lit('"\n')))
    )
    rows = b.table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo"), manifests.project_requirements(text).alias("m"))
    return rows.select("repo", F.explode("m").alias("name", "spec"))


@query("f098_poetry_lock", "SELECT p_brand AS repo, concat('pkg', p_partkey) AS name, concat(p_size, '.1') AS version FROM part WHERE p_partkey % 5 <> 0")
def poetry_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of a lock file for each part; every fifth is malformed and has none."""
    good = F.concat(F.lit('[[package]]\nname = "Pkg'), "p_partkey", F.lit('"\nversion = "'), "p_size", F.lit('.1"\n'))
    text = F.when(F.col("p_partkey") % 5 == 0, "[[package").otherwise(good)
    rows = b.table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo"), manifests.poetry_lock(text).alias("m"))
    return rows.select("repo", F.explode("m").alias("name", "version"))


@query("f111_compressed_round_trip", "SELECT doc_id, length(text) AS characters, true AS same FROM documents")
def compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts compressed as a store keeps them, and unpacked again."""
    d = b.table(spark, sf_dir, "documents").select("doc_id", "text", manifests.packed(F.col("text")).alias("content"))
    return d.select("doc_id", F.length("text").cast("long").alias("characters"), (manifests.unpacked(F.col("content")) == F.col("text")).alias("same"))

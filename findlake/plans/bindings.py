"""The given tables in the roles of the model: findings, reports, runs, files and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.functions.ids import fingerprint
from findlake.schemas import CATEGORIES, CONFIDENCES, SEVERITIES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nth(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


#: l_returnflag in the order of the confidences.
FLAGS = ("R", "A", "N")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding for each line item: its order is the repository, the order's priority the severity."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rule = F.concat(F.lit("rule/"), F.col("l_linenumber"))
    file = F.concat(F.lit("src/part"), F.col("l_partkey"), F.lit(".py"))
    return joined.select(
        F.col("o_orderkey").alias("repo"),
        F.col("o_custkey").alias("owner"),
        rule.alias("rule_id"),
        F.concat(F.lit("Finding of kind "), F.col("l_linenumber")).alias("title"),
        _nth(CATEGORIES, F.col("l_partkey") % 9).alias("category"),
        _nth(SEVERITIES, F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("severity"),
        F.when(F.col("l_returnflag") == "R", CONFIDENCES[0]).when(F.col("l_returnflag") == "A", CONFIDENCES[1]).otherwise(CONFIDENCES[2]).alias("confidence"),
        file.alias("file"),
        F.col("l_suppkey").cast("int").alias("line"),
        fingerprint(rule, file, F.col("l_suppkey")).alias("fingerprint"),
    )


FINDINGS = """findings AS (
  SELECT o_orderkey AS repo, o_custkey AS owner, concat('rule/', l_linenumber) AS rule_id,
    concat('Finding of kind ', l_linenumber) AS title,
    (['security','secret','dependencies','correctness','performance','quality','testing','configuration','metric'])[1 + l_partkey % 9] AS category,
    (['critical','high','medium','low','info'])[CAST(substr(o_orderpriority, 1, 1) AS INT)] AS severity,
    CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END AS confidence,
    concat('src/part', l_partkey, '.py') AS file, CAST(l_suppkey AS INT) AS line,
    substr(sha1(concat('rule/', l_linenumber, '|src/part', l_partkey, '.py|', l_suppkey)), 1, 12) AS fingerprint
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository for each order, with a number of analysed files."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("repo"), (F.col("o_custkey") % 400 + 1).alias("files"))


REPOSITORIES = "repositories AS (SELECT o_orderkey AS repo, o_custkey % 400 + 1 AS files FROM orders)"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each order; customers are repositories, and every tenth has no owner."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_custkey") % 10 != 0, F.concat(F.lit("u"), F.col("o_custkey") % 50)).alias("owner_id"),
        F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("org/repo"), F.col("o_custkey"))).alias("repository"),
        (F.col("o_orderstatus") == "P").alias("truncated"),
        F.col("o_custkey").alias("custkey"),
        F.round(F.col("o_totalprice")).cast("long").alias("size"),
    )


REPORTS = """reports AS (
  SELECT o_orderkey AS id, o_orderdate AS created_at, CASE WHEN o_custkey % 10 <> 0 THEN concat('u', o_custkey % 50) END AS owner_id,
    CASE WHEN o_orderstatus <> 'F' THEN concat('org/repo', o_custkey) END AS repository, o_orderstatus = 'P' AS truncated,
    o_custkey AS custkey, CAST(round(o_totalprice) AS BIGINT) AS size
  FROM orders)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints per weekly run of the event log: run 0 is the week from 2024-01-01."""
    e = table(spark, sf_dir, "events")
    week = F.floor(F.datediff("ts", F.lit("2024-01-01")) / 7).cast("long")
    return e.select(week.alias("run"), "event_id", "event_type", "user_id", F.substring(F.sha1(F.concat_ws("|", "event_type", F.col("user_id").cast("string")).cast("binary")), 1, 12).alias("fingerprint"))


RUNS = """runs AS (
  SELECT CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7.0) AS BIGINT) AS run, event_id, event_type, user_id,
    substr(sha1(concat(event_type, '|', user_id)), 1, 12) AS fingerprint
  FROM events)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("repo"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.col("lang").alias("language"), "text")


FILES = "files AS (SELECT source AS repo, concat(source, '/', doc_id) AS path, n_chars AS size, lang AS language, text FROM documents)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a job log: users are jobs, and event ids order a job's events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"), "value", "props")

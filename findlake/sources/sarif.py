"""Export of reports: SARIF documents, one per repository, and a Markdown comment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findlake.operators.scoring import lookup, truncated

# Fixed values of the format: levels and security scores by severity, precision by confidence.
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
SECURITY_SEVERITY = {"critical": "9.5", "high": "8.0", "medium": "5.5", "low": "3.0", "info": "1.0"}
PRECISION = {"high": "very-high", "medium": "high", "low": "medium"}
SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def results(findings: DataFrame) -> DataFrame:
    """One row per finding: its place, its rule's number by first appearance, level and location."""
    placed = truncated(findings)
    first = placed.groupBy("repo", "rule_id").agg(F.min("place").alias("first"))
    index = first.select("repo", "rule_id", (F.row_number().over(Window.partitionBy("repo").orderBy("first")) - 1).alias("rule_index"))
    return placed.join(index, ["repo", "rule_id"]).withColumns({"level": lookup("severity", LEVELS), "uri": F.col("file"), "start_line": F.greatest("line", F.lit(1))})


def exported(findings: DataFrame) -> DataFrame:
    """`results` with result and rule, what a document says of them."""
    rows = results(findings if "suppressed" in findings.columns else findings.withColumn("suppressed", F.lit(False)))
    place = F.when(F.col("file").isNotNull(), F.array(F.struct(F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation"), F.when(F.col("line").isNotNull(), F.struct(F.col("start_line").alias("startLine"))).alias("region")).alias("physicalLocation"))))
    accepted = F.when(F.col("suppressed"), F.array(F.struct(F.lit("external").alias("kind"), F.lit("accepted").alias("status"))))
    result = F.struct(F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), "level", F.struct(F.col("title").alias("text")).alias("message"), place.alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"), accepted.alias("suppressions"))
    rule = F.struct(F.col("rule_id").alias("id"), F.struct(F.col("title").alias("text")).alias("shortDescription"), F.struct(lookup("severity", SECURITY_SEVERITY).alias("security-severity"), lookup("confidence", PRECISION).alias("precision")).alias("properties"))
    return rows.withColumns({"result": result, "rule": rule})


def documents(findings: DataFrame, tool: str = "findlake") -> DataFrame:
    """(repo, document): the JSON of each repository's report; a report keeps a bounded number of findings, so it is one row."""
    rows = exported(findings)
    rules = rows.groupBy("repo", "rule_index").agg(F.min_by(F.struct("rule_index", F.col("rule").alias("d")), "place").alias("rule")).groupBy("repo").agg(F.transform(F.array_sort(F.collect_list("rule")), lambda x: x["d"]).alias("rules"))
    found = rows.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("result").alias("r")))), lambda x: x["r"]).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), "rules").alias("driver")).alias("tool"), "results")
    return found.join(rules, "repo").select("repo", F.to_json(F.struct(F.lit(SCHEMA).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))

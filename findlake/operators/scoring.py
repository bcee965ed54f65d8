"""Priorities, order, truncation, scores and summaries of findings, for many repositories in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findlake.schemas import ACTIONABLE, CAPPING, CATEGORIES, CEILINGS, CONFIDENCE_10, CONFIDENCE_20, GRADES, LEVERAGE_20, POLICIES, REPORT_LIMIT, SEVERITIES, SEVERITY_4


def lookup(column: str | Column, values: dict, default=None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    out = None
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


def severity_rank(column: str | Column = "severity") -> Column:
    return lookup(column, {s: i for i, s in enumerate(SEVERITIES)})


def priority() -> Column:
    """0 to 100, halves to even; worked out in whole numbers of sixteen hundredths."""
    raw = lookup("severity", SEVERITY_4) * lookup("confidence", CONFIDENCE_20) * lookup("category", LEVERAGE_20, 10)
    return F.least(F.lit(100), F.bround(raw / 160.0, 0)).cast("int")


def penalty40() -> Column:
    return (lookup("severity", SEVERITY_4) * lookup("confidence", CONFIDENCE_10)).cast("long")


def report_order() -> list[Column]:
    """Worst first; ends in the fingerprint, so the order is total for equal places."""
    return [F.desc("priority"), F.asc("rank"), F.asc(F.coalesce("file", F.lit(""))), F.asc(F.coalesce("line", F.lit(0))), F.asc("rule_id"), F.desc("penalty"), F.asc("fingerprint")]


def prioritised(findings: DataFrame) -> DataFrame:
    return findings.withColumns({"priority": priority(), "rank": severity_rank(), "penalty": penalty40()})


def truncated(findings: DataFrame, limit: int = REPORT_LIMIT) -> DataFrame:
    """The first `limit` findings of each report in its order, with their place."""
    place = F.row_number().over(Window.partitionBy("repo").orderBy(*report_order()))
    return prioritised(findings).withColumn("place", place).where(F.col("place") <= limit)


def category_score(penalty: Column, category: str, files: Column) -> Column:
    _, sensitivity, normalised = POLICIES[category]
    p = penalty / 40.0
    if normalised:
        p = p / F.greatest(F.lit(1.0), F.sqrt(F.greatest(files, F.lit(1)).cast("double")))
    return F.bround(100.0 / (1.0 + sensitivity * p), 0).cast("int")


def grade(value: Column) -> Column:
    out = None
    for low, name in GRADES:
        out = F.when(value >= low, name) if out is None else out.when(value >= low, name)
    return out.otherwise("F")


def ceiling() -> Column:
    """The lowest ceiling that a sure security finding of a group imposes; 100 without one."""
    hit = F.col("category").isin(*CAPPING) & (F.col("confidence") == "high")
    return F.coalesce(F.min(F.when(hit, lookup("severity", CEILINGS, 100))), F.lit(100))


def report_scores(findings: DataFrame, repositories: DataFrame) -> DataFrame:
    """(repo, total, score, grade, cap, <category>_score): one aggregation of findings, then a join to all repositories.

    Categories without findings count as 100, so a repository without findings scores 100."""
    sums = [F.sum(F.when(F.col("category") == c, penalty40()).otherwise(0)).alias(f"p_{c}") for c in CATEGORIES]
    per_repo = findings.groupBy("repo").agg(F.count("*").alias("total"), ceiling().alias("cap"), *sums)
    joined = repositories.join(per_repo, "repo", "left")
    weighed = [c for c in CATEGORIES if POLICIES[c][0]]
    scores = {f"{c}_score": category_score(F.coalesce(F.col(f"p_{c}"), F.lit(0)), c, F.col("files")) for c in weighed}
    scored = joined.withColumns(scores)
    mean = F.bround(sum(F.col(f"{c}_score") * POLICIES[c][0] for c in weighed) / float(sum(POLICIES[c][0] for c in weighed)), 0).cast("int")
    value = F.greatest(F.lit(0), F.least(mean, F.coalesce("cap", F.lit(100))))
    return scored.select("repo", F.coalesce("total", F.lit(0)).alias("total"), value.alias("score"), grade(value).alias("grade"), F.coalesce("cap", F.lit(100)).alias("cap"), *scores)


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count("*").alias("total"))


def serious() -> Column:
    """Findings that a summary may name."""
    return F.col("category").isin(*ACTIONABLE) & (F.col("confidence") == "high") & F.col("severity").isin("critical", "high") & ~F.coalesce(F.col("suppressed"), F.lit(False))


def decapitalised(title: Column) -> Column:
    """The first letter lowered, unless the second is a capital too."""
    second = F.substring(title, 2, 1)
    acronym = (F.length(title) < 2) | ((F.upper(second) == second) & (F.lower(second) != second))
    return F.when(acronym, title).otherwise(F.concat(F.lower(F.substring(title, 1, 1)), F.substring(title, 2, F.length(title))))


def summaries(findings: DataFrame, repositories: DataFrame) -> DataFrame:
    """(repo, lead_title, lead_file, others, summary): one sentence that names the first serious finding, if there is one."""
    marked = findings if "suppressed" in findings.columns else findings.withColumn("suppressed", F.lit(False))
    marked = prioritised(marked).withColumn("serious", serious())
    first = F.min(F.when(F.col("serious"), F.struct((-F.col("priority")).alias("p"), F.col("rank").alias("r"), F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"), F.col("rule_id").alias("rule"), F.col("title").alias("title"))))
    agg = marked.groupBy("repo").agg(first.alias("lead"), F.count_if("serious").alias("n"), F.count("*").alias("total"), F.count_if(F.col("severity").isin("critical", "high")).alias("blocking"))
    both = repositories.select("repo").join(agg, "repo", "left")
    others = F.greatest(F.coalesce("n", F.lit(0)) - 1, F.lit(0))
    plural = lambda n: F.when(n == 1, "").otherwise("s")
    where = F.when(F.col("lead.file") != "", F.concat(F.lit(" in "), F.col("lead.file"))).otherwise("")
    tail = F.when(others > 0, F.concat(F.lit(", then "), others, F.lit(" other issue"), plural(others), F.lit(" of the same kind"))).otherwise("")
    b, t = F.col("blocking"), F.col("total")
    text = (
        F.when(F.coalesce(t, F.lit(0)) == 0, "No issues detected across the rules that applied to this project.")
        .when(F.col("lead").isNotNull(), F.concat(F.lit("Start with "), decapitalised(F.col("lead.title")), where, tail, F.lit(".")))
        .when(b > 0, F.concat(b, F.lit(" finding"), plural(b), F.lit(" of high severity, "), F.when(b == 1, "not confirmed").otherwise("none of them confirmed"), F.lit(" — worth reviewing before acting.")))
        .otherwise(F.concat(F.lit("Nothing blocking found. "), t, F.lit(" lower-severity finding"), plural(t), F.lit(" to look at when convenient.")))
    )
    return both.select("repo", F.col("lead.title").alias("lead_title"), F.col("lead.file").alias("lead_file"), others.alias("others"), text.alias("summary"))

"""Comments on branches: every order against the order that its customer placed before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findlake.operators import scoring
from findlake.operators.comments import branch_comments
from findlake.plans import bindings as b
from findlake.queries import reports
from findlake.registry import query

_PLACE = "concat('`', file, CASE WHEN line > 0 THEN concat(':', line) ELSE '' END, '`')"


def _listed(source: str, text: str, name: str) -> str:
    return f"{name}l AS (SELECT report, count(*) AS n_{name}, string_agg({text}, chr(10) ORDER BY k) FILTER (k <= 2) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY report ORDER BY place, title) AS k FROM {source}) GROUP BY report)"


_SQL = f"""WITH {b.FINDINGS}, {b.REPORTS}, chain AS (SELECT id, custkey, truncated, lag(id) OVER (PARTITION BY custkey ORDER BY created_at, id) AS before FROM reports),
{b.REPOSITORIES}, {reports._score_sql('findings')},
f AS (SELECT repo, rule_id, file, line, severity, title, row_number() OVER (PARTITION BY repo ORDER BY {reports._PRIORITY} DESC, {reports._RANK}, coalesce(file, ''), coalesce(line, 0), rule_id, {reports._PENALTY} DESC, fingerprint) AS place FROM findings),
rules AS (SELECT id AS report, count(DISTINCT rule_id) AS new_rules FROM chain JOIN f ON f.repo = id WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM findings g WHERE g.repo = before AND g.rule_id = f.rule_id) GROUP BY id),
added AS (SELECT id AS report, f.* FROM chain JOIN f ON f.repo = id WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM findings g WHERE g.repo = before AND g.rule_id = f.rule_id)),
gone AS (SELECT id AS report, f.* FROM chain JOIN f ON f.repo = before WHERE NOT EXISTS (SELECT 1 FROM findings g WHERE g.repo = id AND g.rule_id = f.rule_id)),
{_listed("added", "concat('| ', severity, ' | ', title, ' | ', " + _PLACE + ", ' |')", "new")},
{_listed("gone", "concat('- ', severity, ': ', title, ' (`', file, '`)')", "resolved")},
total AS (SELECT repo, count(*) AS n FROM findings GROUP BY repo)
SELECT id AS report, concat('### org/repo', custkey, chr(10), chr(10), CASE WHEN before IS NULL THEN concat(coalesce(n, 0), ' findings; first report, nothing to compare with') ELSE concat(coalesce(n_new, 0), ' new, ', coalesce(n_resolved, 0), ' resolved, ', coalesce(n, 0) - coalesce(n_new, 0), ' unchanged') END, ' · score ', score, ' (', {reports._grade('score')}, ')',
 CASE WHEN n_new > 0 THEN concat(chr(10), chr(10), '#### New (', n_new, ')', chr(10), '| severity | finding | place |', chr(10), '|---|---|---|', chr(10), new, CASE WHEN n_new > 2 THEN concat(chr(10), 'and ', n_new - 2, ' more: see [all of them](https://reports.example/', id, '?tab=findings&new=1)') ELSE '' END) ELSE '' END,
 CASE WHEN n_resolved > 0 THEN concat(chr(10), chr(10), '#### Resolved (', n_resolved, ')', chr(10), resolved, CASE WHEN n_resolved > 2 THEN concat(chr(10), 'and ', n_resolved - 2, ' more') ELSE '' END) ELSE '' END,
 CASE WHEN new_rules > 0 THEN concat(chr(10), chr(10), '> Some of these come from ', new_rules, ' rule', CASE WHEN new_rules = 1 THEN '' ELSE 's' END, ' that the earlier report did not have, not from this branch.') ELSE '' END,
 CASE WHEN truncated THEN concat(chr(10), chr(10), '> The list of findings was cut off; this comparison is not complete.') ELSE '' END, chr(10), chr(10), '[Report](https://reports.example/', id, ')') AS comment
FROM chain LEFT JOIN newl ON newl.report = id LEFT JOIN resolvedl ON resolvedl.report = id LEFT JOIN total ON total.repo = id LEFT JOIN rules ON rules.report = id LEFT JOIN valued ON valued.repo = id"""


@query("f016_branch_comments", _SQL)
def comments_on_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings are matched by rule, and two of each list are shown, for an order has seven lines at most."""
    all_ = b.findings(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("repo").orderBy(*scoring.report_order()))
    f = scoring.prioritised(all_).withColumn("place", place).select("repo", "place", "severity", "title", "file", "line", "rule_id")
    before = F.lag("id").over(Window.partitionBy("custkey").orderBy("created_at", "id"))
    chain = b.reports(spark, sf_dir).select(F.col("id").alias("report"), "custkey", "truncated", before.alias("before"))
    rules = f.select("repo", "rule_id").distinct()
    pairs = chain.where("before is not null").select("report", "before")
    new = f.withColumnRenamed("repo", "report").join(pairs, "report").join(rules.withColumnRenamed("repo", "before"), ["before", "rule_id"], "left_anti").drop("before")
    gone = f.withColumnRenamed("repo", "before").join(pairs, "before").join(rules.withColumnRenamed("repo", "report"), ["report", "rule_id"], "left_anti").drop("before")
    totals = f.groupBy(F.col("repo").alias("report")).agg(F.count("*").alias("findings"))
    added = new.groupBy("report").agg(F.count("*").alias("added"), F.count_distinct("rule_id").alias("new_rules"))
    scores = scoring.report_scores(all_, b.repositories(spark, sf_dir)).select(F.col("repo").alias("report"), "score", "grade")
    told = chain.join(totals, "report", "left").join(added, "report", "left").join(scores, "report").fillna(0, ["findings", "added", "new_rules"])
    told = told.select("report", F.concat(F.lit("org/repo"), "custkey").alias("name"), F.col("before").isNotNull().alias("compared"), "truncated", "findings", (F.col("findings") - F.col("added")).alias("unchanged"), "score", "grade", "new_rules", F.concat(F.lit("https://reports.example/"), "report").alias("address"))
    return branch_comments(told, new, gone, listed=2)

"""Scores, order, comparison and listing of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findlake.operators import diff, scoring
from findlake.plans import bindings as b
from findlake.registry import query

_SEV4 = "CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 24 WHEN 'medium' THEN 12 WHEN 'low' THEN 4 ELSE 1 END"
_CONF10 = "CASE confidence WHEN 'high' THEN 10 WHEN 'medium' THEN 7 ELSE 4 END"
_CONF20 = "CASE confidence WHEN 'high' THEN 20 WHEN 'medium' THEN 11 ELSE 5 END"
_LEV20 = "CASE category WHEN 'secret' THEN 20 WHEN 'security' THEN 20 WHEN 'dependencies' THEN 17 WHEN 'correctness' THEN 15 WHEN 'performance' THEN 9 WHEN 'configuration' THEN 8 WHEN 'testing' THEN 7 WHEN 'quality' THEN 6 ELSE 2 END"
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
_PRIORITY = f"CAST(least(100, round_even(({_SEV4}) * ({_CONF20}) * ({_LEV20}) / 160.0, 0)) AS INT)"
_PENALTY = f"({_SEV4}) * ({_CONF10})"
_POLICY = [("secret", 6, 0.60, 0), ("security", 6, 0.30, 0), ("dependencies", 4, 0.18, 0), ("correctness", 4, 0.12, 1), ("testing", 3, 0.35, 0), ("configuration", 2, 0.30, 0), ("performance", 2, 0.15, 1), ("quality", 2, 0.10, 1)]
_CAP = "coalesce(min(CASE WHEN category IN ('security','secret') AND confidence = 'high' THEN CASE severity WHEN 'critical' THEN 39 WHEN 'high' THEN 69 ELSE 100 END END), 100)"


def _grade(x: str) -> str:
    return f"CASE WHEN {x} >= 90 THEN 'A' WHEN {x} >= 80 THEN 'B' WHEN {x} >= 70 THEN 'C' WHEN {x} >= 60 THEN 'D' ELSE 'F' END"


def _score_sql(findings: str, extra: str = "") -> str:
    cats = ", ".join(f"sum(CASE WHEN category = '{c}' THEN {_PENALTY} ELSE 0 END) AS p_{c}" for c, *_ in _POLICY)
    each = ", ".join(f"CAST(round_even(100.0::DOUBLE / (1.0 + {k}::DOUBLE * (coalesce(p_{c}, 0) / 40.0::DOUBLE{' / greatest(1.0, sqrt(greatest(files, 1)::DOUBLE))' if n else ''})), 0) AS INT) AS {c}_score" for c, _, k, n in _POLICY)
    mean = " + ".join(f"{c}_score * {w}" for c, w, _, _ in _POLICY)
    return f"""per_repo AS (SELECT repo, count(*) AS total, {_CAP} AS cap, {cats} FROM {findings} GROUP BY repo),
scored AS (SELECT repo, coalesce(total, 0) AS total, coalesce(cap, 100) AS cap, {each} FROM repositories LEFT JOIN per_repo USING (repo)),
valued AS (SELECT *, greatest(0, least(CAST(round_even(({mean}) / 29.0::DOUBLE, 0) AS INT), cap)) AS score FROM scored)"""


_FINDINGS_REPOS = f"WITH {b.FINDINGS}, {b.REPOSITORIES}"


@query("f061_report_score", f"{_FINDINGS_REPOS}, {_score_sql('findings')} SELECT repo, total, score, {_grade('score')} AS grade, cap, " + ", ".join(f"{c}_score" for c, *_ in _POLICY) + " FROM valued")
def report_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.report_scores(b.findings(spark, sf_dir), b.repositories(spark, sf_dir))


@query("f059_severity_counts", f"WITH {b.FINDINGS} SELECT repo, count_if(severity='critical') AS critical, count_if(severity='high') AS high, count_if(severity='medium') AS medium, count_if(severity='low') AS low, count_if(severity='info') AS info, count(*) AS total FROM findings GROUP BY repo")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.severity_counts(b.findings(spark, sf_dir))


@query("f060_category_score", f"WITH {b.FINDINGS}, {b.REPOSITORIES}, s AS (SELECT repo, category, count(*) AS findings, sum({_PENALTY}) AS p FROM findings GROUP BY ALL) SELECT repo, category, findings, CASE category " + " ".join(f"WHEN '{c}' THEN CAST(round_even(100.0::DOUBLE / (1.0 + {k}::DOUBLE * (p / 40.0::DOUBLE{' / greatest(1.0, sqrt(greatest(files, 1)::DOUBLE))' if n else ''})), 0) AS INT)" for c, _, k, n in [*_POLICY, ("metric", 0, 0.10, 1)]) + " END AS score FROM s JOIN repositories USING (repo)")
def category_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = b.findings(spark, sf_dir).groupBy("repo", "category").agg(F.count("*").alias("findings"), F.sum(scoring.penalty40()).alias("p"))
    joined = sums.join(b.repositories(spark, sf_dir), "repo")
    score = None
    for c in scoring.CATEGORIES:
        value = scoring.category_score(F.col("p"), c, F.col("files"))
        score = F.when(F.col("category") == c, value) if score is None else score.when(F.col("category") == c, value)
    return joined.select("repo", "category", "findings", score.alias("score"))


@query("f062_cap", f"WITH {b.FINDINGS} SELECT repo, {_CAP} AS cap FROM findings GROUP BY repo")
def cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.findings(spark, sf_dir).groupBy("repo").agg(scoring.ceiling().alias("cap"))


@query("f072_priority", f"WITH {b.FINDINGS} SELECT severity, confidence, category, {_PRIORITY} AS priority, count(*) AS n FROM findings GROUP BY ALL")
def priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.findings(spark, sf_dir).withColumn("priority", scoring.priority()).groupBy("severity", "confidence", "category", "priority").agg(F.count("*").alias("n"))


_ORDERED = f"ordered AS (SELECT *, {_PRIORITY} AS priority, {_RANK} AS rank, {_PENALTY} AS penalty FROM findings)"


@query("f073_prioritised_order", f"WITH {b.FINDINGS}, {_ORDERED} SELECT repo, rule_id, file, line, priority, row_number() OVER (PARTITION BY repo ORDER BY priority DESC, rank, file, line, rule_id, penalty DESC, fingerprint) AS place FROM ordered")
def prioritised_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.truncated(b.findings(spark, sf_dir), limit=1 << 30).select("repo", "rule_id", "file", "line", "priority", "place")


@query("f074_truncation", f"WITH {b.FINDINGS}, wide AS (SELECT * REPLACE (owner AS repo) FROM findings), ordered AS (SELECT *, {_PRIORITY} AS priority, {_RANK} AS rank, {_PENALTY} AS penalty FROM wide), placed AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY priority DESC, rank, file, line, rule_id, penalty DESC, fingerprint) AS place FROM ordered) SELECT repo, rule_id, file, line, severity, category, place, priority FROM placed WHERE place <= 20")
def truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst 20 of each customer's findings (reports keep 500; no customer has as many here)."""
    wide = b.findings(spark, sf_dir).withColumn("repo", F.col("owner"))
    return scoring.truncated(wide, limit=20).select("repo", "rule_id", "file", "line", "severity", "category", "place", "priority")


_SERIOUS = "category IN ('secret','security','dependencies','correctness') AND confidence = 'high' AND severity IN ('critical','high')"
_LEAD = f"""{b.FINDINGS}, {b.REPOSITORIES}, {_ORDERED}, placed AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY priority DESC, rank, file, line, rule_id, title) AS k FROM ordered WHERE {_SERIOUS}),
n AS (SELECT repo, count(*) AS total, count_if({_SERIOUS}) AS n, count_if(severity IN ('critical','high')) AS blocking FROM findings GROUP BY repo),
j AS (SELECT r.repo, coalesce(total, 0) AS total, coalesce(n, 0) AS n, coalesce(blocking, 0) AS blocking, title, file FROM repositories r LEFT JOIN n USING (repo) LEFT JOIN (SELECT * FROM placed WHERE k = 1) p USING (repo))"""


@query("f079_lead_finding", f"WITH {_LEAD} SELECT repo, title AS lead_title, file AS lead_file, greatest(n - 1, 0) AS others FROM j")
def lead_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.summaries(b.findings(spark, sf_dir), b.repositories(spark, sf_dir)).drop("summary")


@query("f080_summary", f"""WITH {_LEAD} SELECT repo, CASE WHEN total = 0 THEN 'No issues detected across the rules that applied to this project.'
WHEN title IS NOT NULL THEN concat('Start with ', lower(title[1]), title[2:], ' in ', file, CASE WHEN n > 1 THEN concat(', then ', n - 1, ' other issue', CASE WHEN n = 2 THEN '' ELSE 's' END, ' of the same kind') ELSE '' END, '.')
WHEN blocking > 0 THEN concat(blocking, ' finding', CASE WHEN blocking = 1 THEN '' ELSE 's' END, ' of high severity, ', CASE WHEN blocking = 1 THEN 'not confirmed' ELSE 'none of them confirmed' END, ' — worth reviewing before acting.')
ELSE concat('Nothing blocking found. ', total, ' lower-severity finding', CASE WHEN total = 1 THEN '' ELSE 's' END, ' to look at when convenient.') END AS summary FROM j""")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.summaries(b.findings(spark, sf_dir), b.repositories(spark, sf_dir)).select("repo", "summary")


_SUPPRESSED = "marks AS (SELECT DISTINCT fingerprint FROM findings WHERE line % 7 = 0)"


@query("f053_suppression_marks", f"WITH {b.FINDINGS}, {_SUPPRESSED} SELECT repo, fingerprint, line, marks.fingerprint IS NOT NULL AS suppressed FROM findings LEFT JOIN marks USING (fingerprint)")
def suppression_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("repo", "fingerprint", "line", "suppressed")


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with a flag for those whose fingerprint is accepted; an empty fingerprint never is, and nothing is dropped."""
    f = b.findings(spark, sf_dir)
    marks = f.where("line % 7 = 0 and fingerprint <> ''").select("fingerprint").distinct().withColumn("suppressed", F.lit(True))
    return f.join(marks, "fingerprint", "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))


@query("f135_effective_score", f"WITH {b.FINDINGS}, {b.REPOSITORIES}, open AS (SELECT * FROM findings WHERE line % 7 <> 0 AND fingerprint NOT IN (SELECT fingerprint FROM findings WHERE line % 7 = 0)), hidden AS (SELECT repo, count(*) AS suppressed_count FROM findings WHERE fingerprint IN (SELECT fingerprint FROM findings WHERE line % 7 = 0) GROUP BY repo), {_score_sql('open')} SELECT repo, coalesce(suppressed_count, 0) AS suppressed_count, CASE WHEN suppressed_count > 0 THEN score END AS effective_score FROM valued LEFT JOIN hidden USING (repo)")
def effective_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score without accepted findings, where there are any."""
    marked = _marked(spark, sf_dir)
    scores = scoring.report_scores(marked.where("not suppressed"), b.repositories(spark, sf_dir)).select("repo", "score")
    hidden = marked.where("suppressed").groupBy("repo").agg(F.count("*").alias("suppressed_count"))
    return scores.join(hidden, "repo", "left").select("repo", F.coalesce("suppressed_count", F.lit(0)).alias("suppressed_count"), F.when(F.col("suppressed_count") > 0, F.col("score")).alias("effective_score"))


_STATUS = f"""{b.RUNS}, seen AS (SELECT DISTINCT run, fingerprint FROM runs), last AS (SELECT max(run) AS last_run FROM runs),
present AS (SELECT c.run, c.fingerprint, CASE WHEN EXISTS (SELECT 1 FROM seen p WHERE p.fingerprint = c.fingerprint AND p.run = c.run - 1) THEN 'unchanged'
  WHEN EXISTS (SELECT 1 FROM seen p WHERE p.fingerprint = c.fingerprint AND p.run < c.run - 1 AND p.run >= c.run - 10) THEN 'reopened' ELSE 'new' END AS status FROM seen c WHERE c.run > 0),
status AS (SELECT * FROM present UNION ALL SELECT p.run + 1, p.fingerprint, 'resolved' FROM seen p, last WHERE p.run < last_run AND NOT EXISTS (SELECT 1 FROM seen c WHERE c.fingerprint = p.fingerprint AND c.run = p.run + 1))"""


def _status_query(name: str, status: str, doc: str) -> None:
    @query(name, f"WITH {_STATUS} SELECT run, fingerprint FROM status WHERE status = '{status}'")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return diff.status_per_run(b.runs(spark, sf_dir)).where(F.col("status") == status).select("run", "fingerprint")

    run.__doc__ = doc


_status_query("f084_new", "new", "Fingerprints of a week that neither the week before nor the nine before that had.")
_status_query("f085_reopened", "reopened", "Fingerprints that are back after they were away.")
_status_query("f086_resolved", "resolved", "Fingerprints that the week before had and this one has not.")


@query("f087_delta_counts", f"WITH {_STATUS} SELECT run, status, count(*) AS n FROM status GROUP BY ALL")
def delta_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.status_per_run(b.runs(spark, sf_dir)).groupBy("run", "status").agg(F.count("*").alias("n"))


@query("f088_new_rules", f"WITH {b.FINDINGS}, rules AS (SELECT owner, repo, list_sort(list(DISTINCT rule_id)) AS rules FROM findings GROUP BY ALL), p AS (SELECT *, lag(rules) OVER (PARTITION BY owner ORDER BY repo) AS before FROM rules) SELECT repo, array_to_string(list_sort(list_filter(rules, lambda x: NOT list_contains(before, x))), ',') AS new_rules FROM p WHERE before IS NOT NULL")
def new_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = b.findings(spark, sf_dir).groupBy("owner", "repo").agg(F.collect_set("rule_id").alias("rules"))
    before = F.lag("rules").over(Window.partitionBy("owner").orderBy("repo"))
    return rules.withColumn("before", before).where("before is not null").select("repo", F.array_join(F.array_sort(F.array_except("rules", "before")), ",").alias("new_rules"))


_PREV = f"{b.REPORTS}, p AS (SELECT *, lag(id) OVER w AS previous_id, lag(truncated) OVER w AS previous_truncated, row_number() OVER (PARTITION BY repository, owner_id ORDER BY created_at DESC, id DESC) AS age FROM reports WHERE repository IS NOT NULL WINDOW w AS (PARTITION BY repository, owner_id ORDER BY created_at, id))"


@query("f089_comparable", f"WITH {_PREV} SELECT id, previous_id, coalesce(NOT truncated AND NOT previous_truncated AND id <> previous_id, false) AS comparable FROM p")
def comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = diff.with_previous(b.reports(spark, sf_dir))
    ok = diff.comparable(F.col("repository"), F.col("repository"), F.col("id"), F.col("previous_id"), F.col("truncated"), F.col("previous_truncated"))
    return p.select("id", "previous_id", ok.alias("comparable"))


@query("f090_history_window", f"WITH {_PREV} SELECT repository, owner_id, id, age FROM p WHERE age <= 10")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.with_previous(b.reports(spark, sf_dir)).where("age <= 10").select("repository", "owner_id", "id", "age")


@query("f077_listing", f"WITH {b.REPORTS} SELECT id, created_at, repository FROM reports ORDER BY created_at DESC, id LIMIT 100")
def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.reports(spark, sf_dir).select("id", "created_at", "repository").orderBy(F.desc("created_at"), "id").limit(100)


@query("f078_latest", f"WITH {b.REPORTS} SELECT repository, owner_id, max(struct_pack(a := created_at, b := id)).b AS id FROM reports WHERE repository IS NOT NULL GROUP BY repository, owner_id")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.reports(spark, sf_dir).where("repository is not null").groupBy("repository", "owner_id").agg(F.max(F.struct("created_at", "id")).alias("m")).select("repository", "owner_id", F.col("m.id").alias("id"))


@query("f047_owner_scope", f"WITH {b.REPORTS}, n AS (SELECT n_nationkey, CASE WHEN n_nationkey > 0 THEN concat('u', n_nationkey) END AS owner FROM nation) SELECT n_nationkey, id FROM reports JOIN n ON owner_id IS NOT DISTINCT FROM owner WHERE repository IS NOT NULL")
def owner_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of each owner; without an owner only those that have none."""
    owners = b.table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") > 0, F.concat(F.lit("u"), "n_nationkey")).alias("owner"))
    return b.reports(spark, sf_dir).where("repository is not null").join(owners, F.col("owner_id").eqNullSafe(F.col("owner"))).select("n_nationkey", "id")


@query("f012_bounded_lru", f"WITH {b.REPORTS} SELECT custkey, id, row_number() OVER (PARTITION BY custkey ORDER BY created_at DESC, id DESC) AS place FROM reports QUALIFY place <= 3")
def bounded_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three reports of each customer: what a store of that capacity keeps."""
    place = F.row_number().over(Window.partitionBy("custkey").orderBy(F.desc("created_at"), F.desc("id")))
    return b.reports(spark, sf_dir).select("custkey", "id", place.alias("place")).where("place <= 3")


@query("f137_report_summary", f"WITH {b.REPORTS} SELECT id, created_at, repository, owner_id, truncated, coalesce(repository, concat('upload-', id)) AS name FROM reports")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.reports(spark, sf_dir).select("id", "created_at", "repository", "owner_id", "truncated", F.coalesce("repository", F.concat(F.lit("upload-"), "id")).alias("name"))


@query("f082_fingerprint", f"WITH {b.FINDINGS} SELECT repo, line, rule_id, file, fingerprint, substr(sha1(concat(rule_id, '|', file)), 1, 12) AS keyed, substr(sha1(concat(rule_id, '|')), 1, 12) AS global FROM findings")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from findlake.functions.ids import fingerprint

    f = b.findings(spark, sf_dir)
    made = lambda key: fingerprint(F.col("rule_id"), F.col("file"), F.col("line"), key)
    return f.select("repo", "line", "rule_id", "file", "fingerprint", made(F.col("file")).alias("keyed"), made(F.lit("")).alias("global"))


@query("f083_finding_id", f"WITH {b.FINDINGS} SELECT repo, rule_id, file, line, substr(sha1(concat(rule_id, '|', file, '|', line, '|', title)), 1, 12) AS id FROM findings")
def finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from findlake.functions.ids import finding_id

    return b.findings(spark, sf_dir).select("repo", "rule_id", "file", "line", finding_id(F.col("rule_id"), F.col("file"), F.col("line"), F.col("title")).alias("id"))


@query("f069_histograms", f"WITH {b.FINDINGS} SELECT 'file' AS kind, file AS key, count(*) AS n FROM findings GROUP BY ALL UNION ALL SELECT 'category', category, count(*) FROM findings GROUP BY ALL UNION ALL SELECT 'rule', rule_id, count(*) FROM findings GROUP BY ALL")
def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by file, category and rule from one pass over the findings."""
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in (("file", "file"), ("category", "category"), ("rule", "rule_id"))])
    return b.findings(spark, sf_dir).select(F.inline(keys)).groupBy("kind", "key").agg(F.count("*").alias("n"))


@query("f066_churn_candidates", f"WITH {b.FINDINGS}, c AS (SELECT owner, file, count(*) AS findings, min({_RANK}) AS worst FROM findings GROUP BY ALL) SELECT owner, file, findings, worst, row_number() OVER (PARTITION BY owner ORDER BY worst, findings DESC, file) AS place FROM c QUALIFY place <= 25")
def churn_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = b.findings(spark, sf_dir).groupBy("owner", "file").agg(F.count("*").alias("findings"), F.min(scoring.severity_rank()).alias("worst"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy("worst", F.desc("findings"), "file"))).where("place <= 25")


@query("f067_churn_ranking", f"WITH {b.FINDINGS}, c AS (SELECT owner, file, count(*) AS findings, min({_RANK}) AS worst FROM findings GROUP BY ALL), k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY owner ORDER BY worst, findings DESC, file) <= 25), ch AS (SELECT o_custkey AS owner, concat('src/part', l_partkey, '.py') AS file, CAST(sum(l_quantity) AS BIGINT) AS changes FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= TIMESTAMP '1999-01-01' GROUP BY ALL) SELECT owner, file, findings, changes, changes * findings AS churn FROM k JOIN ch USING (owner, file)")
def churn_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their changes in the window; files without a change drop out."""
    lines = b.table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz'1999-01-01 00:00:00'")
    orders = b.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("owner"))
    changes = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("owner", F.concat(F.lit("src/part"), "l_partkey", F.lit(".py")).alias("file")).agg(F.sum("l_quantity").cast("long").alias("changes"))
    return _candidates(spark, sf_dir).join(changes, ["owner", "file"]).select("owner", "file", "findings", "changes", (F.col("changes") * F.col("findings")).alias("churn"))


@query("f017_corpus_batch", f"{_FINDINGS_REPOS}, {_score_sql('findings')}, cn AS (SELECT repo, category, count(*) AS n FROM findings GROUP BY ALL), top AS (SELECT * FROM cn QUALIFY row_number() OVER (PARTITION BY repo ORDER BY n DESC, category) = 1) SELECT repo, total, score, {_grade('score')} AS grade, category AS top_category, n AS top_n FROM valued LEFT JOIN top USING (repo)")
def corpus_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All repositories at once: score, grade and the category with most findings."""
    f = b.findings(spark, sf_dir)
    top = f.groupBy("repo", "category").agg(F.count("*").alias("n")).groupBy("repo").agg(F.min(F.struct((-F.col("n")).alias("n"), "category")).alias("t"))
    return scoring.report_scores(f, b.repositories(spark, sf_dir)).join(top, "repo", "left").select("repo", "total", "score", "grade", F.col("t.category").alias("top_category"), (-F.col("t.n")).alias("top_n"))


@query("f015_sarif", f"WITH {b.FINDINGS}, {_ORDERED}, placed AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY priority DESC, rank, file, line, rule_id, penalty DESC, fingerprint) AS place FROM ordered), first AS (SELECT repo, rule_id, min(place) AS f FROM placed GROUP BY ALL), idx AS (SELECT repo, rule_id, row_number() OVER (PARTITION BY repo ORDER BY f) - 1 AS rule_index FROM first) SELECT repo, place, rule_id, rule_index, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, file AS uri, greatest(line, 1) AS start_line, fingerprint FROM placed JOIN idx USING (repo, rule_id)")
def sarif_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the exchange format in report order, each with the number of its rule by first appearance."""
    from findlake.sources.sarif import results

    return results(b.findings(spark, sf_dir)).select("repo", "place", "rule_id", "rule_index", "level", "uri", "start_line", "fingerprint")


@query(
    "f015_sarif_files",
    f"WITH {b.FINDINGS}, wide AS (SELECT * REPLACE (owner % 40 AS repo) FROM findings), ordered AS (SELECT *, {_PRIORITY} AS priority, {_RANK} AS rank, {_PENALTY} AS penalty FROM wide), placed AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY priority DESC, rank, file, line, rule_id, penalty DESC, fingerprint) AS place FROM ordered QUALIFY place <= 500) SELECT repo, count(*) AS results, count(DISTINCT rule_id) AS rules, min_by(rule_id, place) AS first_rule, max_by(fingerprint, place) AS last_result FROM placed GROUP BY repo",
)
def sarif_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of forty repositories written as files by the sink, and what is read back from them."""
    from uuid import uuid4

    from findlake.sources.folders import shared_folder
    from findlake.sources.sarif_sink import write_documents

    folder = f"{shared_folder(spark)}/sarif-{uuid4().hex}"
    write_documents(b.findings(spark, sf_dir).withColumn("repo", F.col("owner") % 40), folder)
    shape = "struct<runs:array<struct<results:array<struct<ruleId:string,ruleIndex:int,partialFingerprints:struct<primary:string>>>,tool:struct<driver:struct<rules:array<struct<id:string>>>>>>>"
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.sarif").text(folder).select(F.regexp_extract("_metadata.file_name", r"^(\d+)\.sarif$", 1).cast("long").alias("repo"), F.from_json("value", shape)["runs"][0].alias("run"))
    results, rules = F.col("run.results"), F.col("run.tool.driver.rules")
    first = F.element_at(rules, results[0]["ruleIndex"] + 1)["id"]
    return files.select("repo", F.size(results).cast("long").alias("results"), F.size(rules).cast("long").alias("rules"), first.alias("first_rule"), F.element_at(results, -1)["partialFingerprints"]["primary"].alias("last_result"))

"""References, refusals, context, answers and manifest lines: the operators of `operators/guards.py` over the given tables.

The texts that are parsed are composed from rows of the tables; the SQL gives what the parts were, not the patterns again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.operators import guards
from findlake.plans import bindings as b
from findlake.registry import query


def _pick(n: Column, *values: object) -> Column:
    """The value at place n modulo their number; values are columns or constants."""
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (n % len(values)).cast("int") + 1)


_PARTS = "SELECT c_custkey, c_custkey % 7 AS k, concat('org-', c_nationkey) AS owner, concat('repo.', c_custkey) AS repo, concat('v', c_nationkey) AS ref FROM customer"


@query("f010_repository_refs", f"SELECT c_custkey, CASE WHEN k < 5 THEN owner END AS owner, CASE WHEN k < 5 THEN repo END AS repo, CASE WHEN k = 1 THEN ref END AS ref FROM ({_PARTS})")
def repository_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of all accepted shapes, and two that are none."""
    c = b.table(spark, sf_dir, "customer")
    owner, repo, ref = F.concat(F.lit("org-"), "c_nationkey"), F.concat(F.lit("repo."), "c_custkey"), F.concat(F.lit("v"), "c_nationkey")
    both = F.concat(owner, F.lit("/"), repo)
    web = F.concat(F.lit("https://github.com/"), both)
    shapes = web, F.concat(web, F.lit("/tree/"), ref, F.lit("?tab=files")), F.concat(F.lit(" git@github.com:"), both, F.lit(".git")), both, F.concat(F.lit("www.github.com/"), both, F.lit(".git/#top")), F.concat(F.lit("https://example.org/"), both), F.concat(owner, F.lit("//"), repo)
    return c.select("c_custkey", guards.repository_ref(_pick(F.col("c_custkey"), *shapes)).alias("r")).select("c_custkey", "r.owner", "r.repo", "r.ref")


@query("f010_pull_request_refs", f"SELECT c_custkey, CASE WHEN k < 4 THEN owner END AS owner, CASE WHEN k < 4 THEN repo END AS repo, CASE WHEN k < 4 THEN c_custkey END AS number FROM (SELECT * REPLACE (c_custkey % 5 AS k) FROM ({_PARTS}))")
def pull_request_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = b.table(spark, sf_dir, "customer")
    start = F.concat(F.lit("github.com/org-"), "c_nationkey", F.lit("/repo."), "c_custkey")
    ends = [F.concat(start, F.lit("/pull/"), "c_custkey", F.lit(e)) for e in ("", "/files", "#top", "/commits?x=1")]
    return c.select("c_custkey", guards.pull_request_ref(_pick(F.col("c_custkey"), *ends, F.concat(start, F.lit("/pull/new")))).alias("r")).select("c_custkey", "r.owner", "r.repo", "r.number")


@query("f046_source_access", f"WITH {b.REPORTS} SELECT id, CASE WHEN truncated AND owner_id IS NULL THEN 'refused' ELSE 'open' END AS verdict FROM reports")
def source_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether files may be read; truncated reports stand for private ones."""
    return b.reports(spark, sf_dir).select("id", guards.source_access(F.col("truncated"), F.col("owner_id")).alias("verdict"))


@query(
    "f128_acceptance_refusals",
    f"WITH {b.REPORTS}, {b.FINDINGS}, w AS (SELECT l_orderkey, l_linenumber, concat('rule/', l_linenumber + l_suppkey % 2) AS rule_id FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, CASE WHEN owner_id IS NULL OR (l_linenumber = 1 AND owner_id <> 'u7') THEN 'not_owner' WHEN repository IS NULL THEN 'upload' WHEN f.rule_id IS NULL THEN 'unknown_finding' WHEN f.severity = 'info' THEN 'no_fingerprint' END AS reason "
    "FROM w JOIN reports ON l_orderkey = id LEFT JOIN findings f ON f.repo = l_orderkey AND f.rule_id = w.rule_id",
)
def acceptance_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to accept a finding of a report, some by another user and some for a finding that the report lacks; those
    of the lowest severity stand for findings without a fingerprint."""
    wanted = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("rule/"), F.col("l_linenumber") + F.col("l_suppkey") % 2).alias("rule_id"))
    held = b.findings(spark, sf_dir).select(F.col("repo").alias("l_orderkey"), "rule_id", F.col("rule_id").alias("found"), F.when(F.col("severity") != "info", F.col("fingerprint")).alias("fingerprint"))
    r = b.reports(spark, sf_dir).select(F.col("id").alias("l_orderkey"), "owner_id", "repository")
    user = F.when(F.col("l_linenumber") == 1, "u7").otherwise(F.col("owner_id"))
    rows = wanted.join(r, "l_orderkey").join(held, ["l_orderkey", "rule_id"], "left")
    return rows.select("l_orderkey", "l_linenumber", guards.acceptance_refusal(F.col("owner_id"), user, F.col("repository"), F.col("found"), F.col("fingerprint")).alias("reason"))


@query("f129_source_providers", f"WITH {b.REPORTS} SELECT id, CASE WHEN repository IS NULL AND custkey % 3 = 0 THEN 'stored' WHEN repository IS NULL THEN 'no_repository' WHEN id % 4 = 0 THEN 'no_commit' ELSE 'remote' END AS provider FROM reports")
def source_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("repository").isNull() & (F.col("custkey") % 3 == 0), "upload").otherwise("repository")
    commit = F.when(F.col("id") % 4 != 0, F.sha1(F.col("id").cast("string").cast("binary")))
    return b.reports(spark, sf_dir).select("id", guards.source_provider(kind, F.col("repository"), commit).alias("provider"))


@query("f141_fetch_failures", "SELECT event_id, CASE event_id % 7 WHEN 1 THEN 'not_found' WHEN 4 THEN 'empty' WHEN 5 THEN 'unavailable' WHEN 6 THEN 'unavailable' WHEN 0 THEN NULL ELSE CASE WHEN user_id % 3 <> 0 THEN 'refused' WHEN event_type = 'view' THEN 'rate_limited' ELSE 'rate_limited_anonymous' END END AS failure FROM events")
def fetch_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as responses: their number gives the status, the user the requests that are left."""
    status = _pick(F.col("event_id"), 200, 404, 403, 429, 409, 500, 400)
    return b.table(spark, sf_dir, "events").select("event_id", guards.fetch_failure(status, F.col("user_id") % 3, F.col("event_type") == "view").alias("failure"))


@query("f106_context_labels", f"WITH {b.FINDINGS} SELECT repo, rule_id, CASE WHEN severity = 'info' OR (line = 0 AND severity <> 'critical') THEN concat('report ', repo, ' · project-wide finding') WHEN severity = 'critical' THEN concat('report ', repo, ' · ', file, ' · lines ', line, '–', line + 40) ELSE concat('report ', repo, ' · ', file, ' · lines ', line, '–', line + 2, ' (snippet only)') END AS label FROM findings")
def context_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critical findings have a wide window, those of the lowest severity no file; line 0 is no line."""
    f = b.findings(spark, sf_dir)
    line, placed, wide = F.col("line"), F.col("severity") != "info", F.when(F.col("severity") == "critical", F.col("line"))
    label = guards.context_label(F.concat(F.lit("report "), "repo"), F.when(placed, F.col("file")), F.when(placed, line), F.lit(None).cast("int"), F.when(placed, line + 2), wide, wide + 40)
    return f.select("repo", "rule_id", label.alias("label"))


@query("f130_chosen_contexts", "SELECT doc_id, md5(CASE WHEN text IS NOT NULL AND n_chars > 3000 THEN text WHEN n_chars > 300 AND text[1:40] <> '' THEN text[1:40] WHEN doc_id % 3 = 0 THEN 'no source' END) AS context FROM documents")
def chosen_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long documents have their whole text, others their start as snippet, short ones nothing; a third only asks for an explanation."""
    wide, snippet = F.when(F.col("n_chars") > 3000, F.col("text")), F.when(F.col("n_chars") > 300, F.substring("text", 1, 40))
    chosen = guards.chosen_context(_pick(F.col("doc_id"), "explain", "fix", "test"), wide, snippet)
    return b.table(spark, sf_dir, "documents").select("doc_id", F.md5(chosen.cast("binary")).alias("context"))


@query("f108_answer_problems", "SELECT conv_id, turn, CASE (conv_id + turn) % 9 WHEN 0 THEN 'no_diff' WHEN 1 THEN 'no_hunk' WHEN 4 THEN 'missing_sections' WHEN 6 THEN 'echo' WHEN 8 THEN 'empty' END AS problem FROM conversations WHERE role = 'assistant'")
def answer_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of nine shapes around the assistants' turns: four to fix something, two to explain, and three others."""
    said = F.regexp_replace(F.coalesce("text", F.lit("")), "@@|[-+]{3} |#{3} |`{3}", " ")
    k, sentinel = F.col("conv_id") + F.col("turn"), F.lit("7f3a91c2d5e84b06a1")
    parts = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    diff, fence = "--- a/x\n+++ b/x\n", "`" * 3
    sections = "\n".join(guards.EXPLANATION)
    shapes = (
        parts("x", said), parts(diff, said), parts(diff, "@@ -1 +1 @@\n", said), parts(fence, "diff\n", diff, "@@ -1 +1 @@\n", said, "\n", fence, "\nthat is all"),
        parts(guards.EXPLANATION[0], "\n", said), parts(sections, "\n", said), parts(said, sentinel), parts("  ", guards.INSUFFICIENT, said), parts(" \n\t "),
    )
    action = _pick(k, "fix", "fix", "fix", "fix", "explain", "explain", "explain", "fix", "fix")
    rows = b.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", guards.answer_problem(action, _pick(k, *shapes), sentinel).alias("problem"))


@query(
    "f119_routes",
    "WITH a AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k, l_partkey % 7 AS c FROM lineitem), e AS (SELECT l_orderkey, count(*) AS n, min(k) FILTER (c IN (0, 3, 4, 6)) AS first_end, count(*) FILTER (c = 2) AS gone FROM a GROUP BY l_orderkey) "
    "SELECT e.l_orderkey, CASE WHEN c = 0 THEN 'served' WHEN first_end IS NOT NULL THEN 'fatal' WHEN gone = n THEN 'unreachable' ELSE 'exhausted' END AS result, CAST(coalesce(first_end, n) AS INT) AS tried FROM e LEFT JOIN a ON a.l_orderkey = e.l_orderkey AND a.k = e.first_end",
)
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as attempts in turn, of one number by part; the part gives the status code of each."""
    code = _pick(F.col("l_partkey"), 200, 503, 404, 429, 401, 500, 403)
    codes = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", code.alias("code")))), lambda x: x["code"])
    chains = b.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(codes.alias("codes"))
    return chains.select("l_orderkey", guards.routed(F.col("codes")).alias("r")).select("l_orderkey", "r.result", "r.tried")


@query("f103_manifest_lines", "SELECT p_partkey AS manifest, concat('pkg-', p_partkey % 4) AS package, CASE WHEN p_partkey % 3 = 2 THEN 3 WHEN p_partkey % 4 IN (1, 3) THEN 7 ELSE 3 END AS line FROM part WHERE CASE WHEN p_partkey % 3 = 2 THEN p_partkey % 4 = 1 ELSE p_partkey % 4 <> 2 END")
def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each part. The wanted package is among the scripts (0), the dependencies (1), both (3) or nowhere (2);
    every third manifest is a list of requirements, in which package 1 stands third."""
    p = b.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    package = F.concat(F.lit("pkg-"), k % 4)
    script, needed = F.when((k % 4).isin(0, 3), package).otherwise("build"), F.when((k % 4).isin(1, 3), package).otherwise("left")
    as_json = F.concat(F.lit('{\n  "scripts": {\n    "'), script, F.lit('": "run",\n    "dev": "pkg-1"\n  },\n  "devDependencies": {\n    "'), needed, F.lit('": "1.0.0"\n  }\n}'))
    listed = F.lit("# pkg-1\n\nPkg__1>=2\npkg.1==3")
    manifests = p.select(k.alias("manifest"), F.when(k % 3 == 2, "requirements.txt").otherwise("package.json").alias("path"), F.when(k % 3 == 2, listed).otherwise(as_json).alias("text"))
    return guards.manifest_lines(manifests, p.select(k.alias("manifest"), package.alias("package")))


@query(
    "f104_part_summaries",
    "SELECT l_orderkey, CASE WHEN length(j) > 120 THEN concat(rtrim(regexp_replace(j[1:120], ' [^ ]*$', ''), ',;:'), '…') ELSE j END AS summary FROM (SELECT l_orderkey, string_agg(concat('Line ', l_linenumber, ' holds part ', l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN '!' ELSE '.' END), ' ' ORDER BY l_linenumber, l_partkey) AS j FROM lineitem GROUP BY l_orderkey)",
)
def part_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of an order's lines, every second of which has its end already, within 120 characters."""
    said = F.concat(F.lit("Line "), "l_linenumber", F.lit(" holds part "), "l_partkey", F.when(F.col("l_linenumber") % 2 == 0, "!").otherwise(""))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", said.alias("said")))), lambda x: x["said"])
    grouped = b.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(parts.alias("parts"))
    return grouped.select("l_orderkey", guards.joined_summaries(F.col("parts"), 120, most=7).alias("summary"))

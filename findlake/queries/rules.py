"""A query for each rule over the source files derived from `part` and `supplier`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.operators import engine, rules
from findlake.operators import facts as facts_of
from findlake.plans import corpus
from findlake.queries import reports
from findlake.registry import ORACLE_SQL, query

_N = len(corpus.TEMPLATES)
_NUMBER = "CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT)"
_EXPECTED = "expected(t, rule_id, line, severity, confidence) AS (VALUES " + ", ".join(f"({t}, '{r}', {n}, '{s}', '{c}')" for t, r, n, s, c in corpus.EXPECTED) + ")"
_PATHS = "templates(t, path) AS (VALUES " + ", ".join(f"({i}, '{t[0]}')" for i, t in enumerate(corpus.TEMPLATES)) + ")"
_FILES = f"{_EXPECTED}, {_PATHS}, files AS (SELECT p_brand AS repo, {_NUMBER} AS n, t, replace(path, '@K', CAST(p_partkey AS VARCHAR)) AS path FROM part JOIN templates ON p_partkey % {_N} = t)"
_NODE = "n % 5 <> 0"
_GATES = {"is_node": _NODE, "is_react": _NODE, "is_python": "true", rules._EITHER: "true", "has_typescript": "true", "true": "true"}


def _sql(rule: rules.Rule) -> str:
    found = f"WITH {_FILES}, hits AS (SELECT repo, path, line, severity, confidence FROM files JOIN expected USING (t) WHERE rule_id = '{rule.id}' AND {_GATES[rule.gate]})"
    cap = ""
    if rule.cap:
        found += ", per AS (SELECT repo, path, count(*) AS c FROM hits GROUP BY ALL), before AS (SELECT repo, path, coalesce(sum(c) OVER (PARTITION BY repo ORDER BY string_split(path, '/') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM per)"
        cap = f" JOIN before USING (repo, path) WHERE b < {rule.cap}"
    if rule.id == "quality/long-file":
        cap = " QUALIFY row_number() OVER (PARTITION BY repo ORDER BY CASE severity WHEN 'medium' THEN 0 ELSE 1 END, string_split(path, '/')) <= 40"
    return f"{found} SELECT repo, path AS file, CAST(line AS INT) AS line, severity, confidence FROM hits{cap}"


def _rule_query(name: str, rule: rules.Rule) -> None:
    sql = _sql(rule)
    if rule.id == "quality/todo-markers":
        per = "SELECT repo, path, string_split(path, '/') AS parts, t FROM files WHERE t = 31"
        sql = f"WITH {_FILES}, todo AS ({per}) SELECT repo, min_by(path, parts) AS file, CAST(1 AS INT) AS line, 'info' AS severity, 'high' AS confidence FROM todo GROUP BY repo HAVING 2 * count(*) >= 10"

    if rule.id == "dep/react-dom-mismatch":
        sql = f"SELECT DISTINCT p_brand AS repo, 'package.json' AS file, CAST(1 AS INT) AS line, 'high' AS severity, 'high' AS confidence FROM part WHERE {_NUMBER} % 5 <> 0"

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files, facts = corpus.lines_and_facts(spark, sf_dir)
        return rules.run_rules(files, facts, (rule,)).select("repo", "file", "line", "severity", "confidence")

    run.__doc__ = f"Findings of {rule.id}."


_NUMBERS = {
    "config/ts-not-strict": 4, "dep/react-dom-mismatch": 8, "python/mutable-default-argument": 9, "python/bare-except": 10, "python/subprocess-shell": 11, "python/unsafe-deserialisation": 12, "quality/long-file": 13,
    "quality/long-function": 14, "quality/deep-nesting": 15, "quality/todo-markers": 16, "react/missing-list-key": 17, "react/array-index-key": 18, "react/dangerously-set-inner-html": 19,
    "security/sql-injection": 20, "security/command-injection": 21, "security/code-injection": 22, "security/path-traversal": 23, "security/ssrf": 24, "security/weak-hash": 25,
    "security/insecure-random": 26, "security/permissive-cors": 27, "security/jwt-unverified": 28, "security/hardcoded-secret": 29,
}
_NAMED = {f"r{_NUMBERS[rule.id]:02d}_{rule.id.split('/')[1].replace('-', '_')}": rule for rule in rules.RULES}
for _name, _rule in _NAMED.items():
    _rule_query(_name, _rule)

_REPOS = f"repos AS (SELECT DISTINCT p_brand AS repo, {_NUMBER} AS n FROM part UNION ALL SELECT concat('supplier', s_suppkey), NULL FROM supplier)"
_TESTED = f"tested AS (SELECT DISTINCT p_brand AS repo FROM part WHERE p_partkey % {_N} IN (25))"
_MISSING = (
    ("r01_no_linter", "config/no-linter", "low", "high", "n IS NULL OR n % 5 = 0 OR n % 4 <> 0"),
    ("r02_no_tests", "config/no-tests", "medium", "medium", "repo NOT IN (SELECT repo FROM tested)"),
    ("r03_no_ci", "config/no-ci", "low", "medium", "n IS NULL OR n % 3 <> 0"),
    ("r05_no_readme", "config/no-readme", "low", "high", "n IS NULL OR n % 2 <> 0"),
    ("r07_no_lockfile", "dep/no-lockfile", "medium", "high", "n % 5 <> 0 AND n % 6 <> 0"),
    ("r30_env_not_ignored", "security/env-not-ignored", "high", "high", "n % 7 = 0 AND n % 14 <> 0"),
)


def _missing_query(name: str, rule_id: str, severity: str, confidence: str, where: str) -> None:
    @query(name, f"WITH {_REPOS}, {_TESTED} SELECT repo, '{severity}' AS severity, '{confidence}' AS confidence FROM repos WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = corpus.source_files(spark, sf_dir)
        return rules.repository_rules(files, facts_of.project_facts(files)).where(F.col("rule_id") == rule_id).select("repo", "severity", "confidence")

    run.__doc__ = f"Repositories with {rule_id}."


for _m in _MISSING:
    _missing_query(*_m)


# Paths made from parts: fifty repositories with Python and other files, tests and manifests among them.
_PLACES, _SOURCES, _MANIFESTS_OF = ("src", "tests", "app/testing", "lib"), ("a.py", "test_b.py", "c_test.py", "d.js", "latest.py"), ("pyproject.toml", "setup.py", "Requirements.txt", "requirements-dev.txt", "requirements.txt")
_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_PYTHON_PATHS = f"p AS (SELECT p_partkey % 50 AS repo, concat({_list(_PLACES)}[1 + p_partkey % 4], p_partkey % 13, '/', CASE WHEN p_partkey % 3 = 0 THEN {_list(_MANIFESTS_OF)}[1 + p_size % 5] ELSE {_list(_SOURCES)}[1 + p_size % 5] END) AS path FROM part)"


def _python_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), k.cast("int"))
    k, n = F.col("p_partkey"), F.col("p_size")
    file = F.when(k % 3 == 0, pick(_MANIFESTS_OF, n % 5)).otherwise(pick(_SOURCES, n % 5))
    path = F.concat(pick(_PLACES, k % 4), k % 13, F.lit("/"), file)
    return corpus.table(spark, sf_dir, "part").select((k % 50).alias("repo"), path.alias("path"), F.when(F.endswith(file, F.lit(".py")), "python").otherwise("other").alias("language"))


@query(
    "f139_python_scope",
    f"WITH {_PYTHON_PATHS}, m AS (SELECT repo, path, list_position(['requirements.txt', 'pyproject.toml'], lower(string_split(path, '/')[-1])) AS k FROM p), first AS (SELECT repo, arg_min(path, (k, string_split(path, '/'))) AS manifest FROM m WHERE k > 0 GROUP BY repo) "
    f"SELECT repo, count_if(path LIKE '%.py') AS python, count_if(path LIKE '%.py' AND NOT regexp_matches(path, '{rules.PYTHON_TEST_PATH}')) AS untested, any_value(manifest) AS manifest FROM p LEFT JOIN first USING (repo) GROUP BY repo",
)
def python_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python files of a repository with and without tests, and the manifest that its requirements are read from."""
    files = _python_paths(spark, sf_dir)
    counts = files.groupBy("repo").agg(F.count_if(rules._python(True)).alias("python"), F.count_if(rules._python(False)).alias("untested"))
    return counts.join(rules.python_manifest(files).withColumnRenamed("path", "manifest"), "repo", "left")


_ADVISED = """adv AS (SELECT CASE s_suppkey % 2 WHEN 0 THEN 'react' ELSE 'react-dom' END AS name, concat('ADV-', lpad(CAST(s_suppkey AS VARCHAR), 8, '0')) AS id, s_nationkey % 5 AS rank, s_suppkey % 19 AS since, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 19 + 4 END AS until FROM supplier),
held AS (SELECT name, id, rank, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM adv JOIN (VALUES ('react', 19), ('react-dom', 18)) v(name, major) USING (name) WHERE since <= major AND (until IS NULL OR major < until)),
worst AS (SELECT name, (['critical', 'high', 'medium', 'low', 'info'])[1 + min(rank)] AS severity FROM held WHERE k <= 8 GROUP BY name)"""


@query("r06_known_vulnerability", f"WITH {_ADVISED} SELECT DISTINCT p_brand AS repo, name AS package, 'package.json' AS file, CAST(NULL AS INT) AS line, severity, 'medium' AS confidence FROM part, worst WHERE {_NUMBER} % 5 <> 0")
def known_vulnerability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages that the manifests of the derived repositories declare at a version that an advisory holds."""
    found = engine.advisory_findings(corpus.source_files(spark, sf_dir), corpus.advisories(spark, sf_dir))
    return found.select("repo", "package", "file", "line", "severity", "confidence")


@query("f065_project_facts", f"WITH {_REPOS}, {_TESTED} SELECT repo, coalesce(n % 5 <> 0, false) AS is_node, coalesce(n % 5 <> 0, false) AS is_react, repo IN (SELECT repo FROM tested) AS has_tests, coalesce(n % 3 = 0, false) AS has_ci, coalesce(n % 6 = 0, false) AS has_lockfile, coalesce(n % 2 = 0, false) AS has_readme FROM repos")
def project_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_of.project_facts(corpus.source_files(spark, sf_dir)).select("repo", "is_node", "is_react", "has_tests", "has_ci", "has_lockfile", "has_readme")


@query("f045_react_rules", f"WITH {_FILES} SELECT repo, rule_id, count(*) AS n FROM files JOIN expected USING (t) WHERE rule_id LIKE 'react/%' AND n % 5 <> 0 GROUP BY ALL")
def react_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by repository of all rules that the react gate opens. `f045_all_rules` runs all rules."""
    return _counts(spark, sf_dir, [rule for rule in rules.RULES if rule.gate == "is_react"])


def _counts(spark: SparkSession, sf_dir: str, some: Sequence[rules.Rule]) -> DataFrame:
    files, facts = corpus.lines_and_facts(spark, sf_dir)
    return rules.run_rules(files, facts, some).groupBy("repo", "rule_id").agg(F.count("*").alias("n"))


_EVERY = " UNION ALL ".join(f"SELECT repo, '{rule.id}' AS rule_id, count(*) AS n FROM ({ORACLE_SQL[name]}) GROUP BY repo" for name, rule in _NAMED.items())


@query("f045_rules_of_every_gate", _EVERY)
def every_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by repository of all rules, whichever gate opens them."""
    return _counts(spark, sf_dir, rules.RULES)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TITLES = "titles(rule_id, title) AS (VALUES " + ", ".join(f"('{rule}', {_quoted(title)})" for rule, (title, _) in engine.TEXTS.items()) + ")"
_PLACED = " UNION ALL ".join(
    [f"SELECT repo, '{rule.id}' AS rule_id, '{rule.category}' AS category, severity, confidence, file, line FROM ({ORACLE_SQL[name]})" for name, rule in _NAMED.items()]
    + [f"SELECT repo, 'dep/known-vulnerability' AS rule_id, 'dependencies' AS category, severity, confidence, file, line FROM ({ORACLE_SQL['r06_known_vulnerability']})"]
    + [f"SELECT repo, '{rule}' AS rule_id, '{engine.LACKS[rule]}' AS category, severity, confidence, NULL AS file, NULL AS line FROM ({ORACLE_SQL[name]})" for name, rule, *_ in _MISSING]
)
_SOURCE = f"""{_TITLES}, found AS (SELECT * FROM ({_PLACED}) JOIN titles USING (rule_id)),
findings AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {reports._PRIORITY} DESC, {reports._RANK}, coalesce(file, ''), coalesce(line, 0), rule_id) AS place, {reports._PRIORITY} AS priority FROM found QUALIFY place <= 500)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.findings(corpus.source_files(spark, sf_dir), ranges=corpus.advisories(spark, sf_dir))


@query("f045_all_rules", f"SELECT repo, rule_id, count(*) AS n FROM ({_PLACED}) GROUP BY ALL")
def all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by repository of the whole registry, with the rules about what a repository lacks."""
    return _found(spark, sf_dir).groupBy("repo", "rule_id").agg(F.count("*").alias("n"))


@query("f017_source_findings", f"WITH {_SOURCE} SELECT repo, place, priority, rule_id, category, severity, confidence, file, line, title FROM findings")
def source_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every rule finds in all source files, in the order of the reports."""
    return engine.scoring.truncated(_found(spark, sf_dir)).select("repo", "place", "priority", "rule_id", "category", "severity", "confidence", "file", "line", "title")


_FILE_COUNTS = "all_files AS (SELECT repo, count(*) AS files FROM (SELECT p_brand AS repo FROM part UNION ALL " + " UNION ALL ".join(f"SELECT DISTINCT p_brand FROM part WHERE {_NUMBER} % {abs(by)} {'<>' if by < 0 else '='} 0" for *_, by in corpus.MANIFESTS) + " UNION ALL SELECT concat('supplier', s_suppkey) FROM supplier) GROUP BY repo)"
_ACRONYM = "(length(title) < 2 OR (upper(title[2]) = title[2] AND lower(title[2]) <> title[2]))"


@query(
    "f017_source_reports",
    f"""WITH {_SOURCE}, {_FILE_COUNTS}, repositories AS (SELECT * FROM all_files), {reports._score_sql("findings")},
lead AS (SELECT repo, title, file FROM findings WHERE {reports._SERIOUS} QUALIFY row_number() OVER (PARTITION BY repo ORDER BY place) = 1),
sums AS (SELECT repo, count_if({reports._SERIOUS}) AS n, count_if(severity IN ('critical', 'high')) AS blocking, {", ".join(f"count_if(severity = '{s}') AS {s}" for s in engine.scoring.SEVERITIES)} FROM findings GROUP BY repo)
SELECT v.repo, files, total, score, {reports._grade("score")} AS grade, cap, {", ".join(f"coalesce({s}, 0) AS {s}" for s in engine.scoring.SEVERITIES)}, title AS lead_title, coalesce(file, CASE WHEN title IS NOT NULL THEN '' END) AS lead_file,
  CASE WHEN total = 0 THEN 'No issues detected across the rules that applied to this project.'
  WHEN title IS NOT NULL THEN concat('Start with ', CASE WHEN {_ACRONYM} THEN title ELSE concat(lower(title[1]), title[2:]) END, CASE WHEN file IS NOT NULL THEN concat(' in ', file) ELSE '' END, CASE WHEN n > 1 THEN concat(', then ', n - 1, ' other issue', CASE WHEN n = 2 THEN '' ELSE 's' END, ' of the same kind') ELSE '' END, '.')
  WHEN blocking > 0 THEN concat(blocking, ' finding', CASE WHEN blocking = 1 THEN '' ELSE 's' END, ' of high severity, ', CASE WHEN blocking = 1 THEN 'not confirmed' ELSE 'none of them confirmed' END, ' — worth reviewing before acting.')
  ELSE concat('Nothing blocking found. ', total, ' lower-severity finding', CASE WHEN total = 1 THEN '' ELSE 's' END, ' to look at when convenient.') END AS summary
FROM valued v JOIN all_files USING (repo) LEFT JOIN lead USING (repo) LEFT JOIN sums USING (repo)""",
)
def source_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run: source files to findings, scores, grades and summaries of every repository."""
    files = corpus.source_files(spark, sf_dir)
    made = engine.reports(files, _found(spark, sf_dir))
    return made.select("repo", "files", "total", "score", "grade", "cap", *engine.scoring.SEVERITIES, "lead_title", "lead_file", "summary")

"""From source files to reports: one scan by all rules, then gates, caps, order, truncation, scores, summary and export.
Every step covers all repositories of a table in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.functions.ids import finding_id, fingerprint
from findlake.functions.text import with_raw
from findlake.operators import dependencies, rules, scoring
from findlake.operators.facts import project_facts
from findlake.operators.guards import manifest_lines
from findlake.sources import sarif
from findlake.sources.folders import written

#: rule: (title, remediation)
TEXTS = {
    "config/no-linter": ("No linter is configured", "Add a linter's configuration and run it on every change."),
    "config/no-tests": ("No tests found", "Begin with tests of the code that changes most."),
    "config/no-ci": ("No continuous integration", "Run build and tests on every change."),
    "config/ts-not-strict": ("Strict type checking is off", 'Set "strict": true in the compiler options.'),
    "config/no-readme": ("No read-me file", "Say what the project does and how to run it."),
    "dep/known-vulnerability": ("Dependency with known vulnerabilities", "Upgrade to a version in which the advisories are fixed."),
    "dep/no-lockfile": ("No lock file", "Commit the lock file of the package manager."),
    "dep/react-dom-mismatch": ("Major versions of react and react-dom differ", "Install both packages at the same major version."),
    "python/mutable-default-argument": ("Mutable default argument", "Use None as the default and make the value inside."),
    "python/bare-except": ("Bare except clause", "Name the exceptions that are meant."),
    "python/subprocess-shell": ("Command run through a shell", "Pass a list of arguments without a shell."),
    "python/unsafe-deserialisation": ("Unsafe deserialisation", "Use a safe loader or a format of plain data."),
    "quality/long-file": ("Long file", "Split the file by topic."),
    "quality/long-function": ("Long function", "Take parts with a name of their own out of it."),
    "quality/deep-nesting": ("Deeply nested code", "Return early or take inner blocks out."),
    "quality/todo-markers": ("Many open markers", "Move them to the issue tracker or settle them."),
    "react/missing-list-key": ("List items without a key", "Give each element a stable key."),
    "react/array-index-key": ("Array index as key", "Use an identifier of the item."),
    "react/dangerously-set-inner-html": ("Markup set without escaping", "Sanitise the markup or render text."),
    "security/sql-injection": ("SQL statement built from input", "Use parameters in place of built strings."),
    "security/command-injection": ("Command built from input", "Pass arguments as a list and check them."),
    "security/code-injection": ("Code evaluated from input", "Do not evaluate text; parse the data."),
    "security/path-traversal": ("File path taken from input", "Resolve the path and check that it stays in its folder."),
    "security/ssrf": ("Request to an address from input", "Allow only known hosts."),
    "security/weak-hash": ("Weak hash for a security purpose", "Use a password hash, or SHA-256 for integrity."),
    "security/insecure-random": ("Predictable random value as a secret", "Use a cryptographic source of randomness."),
    "security/permissive-cors": ("Any origin allowed with credentials", "List the origins that may send credentials."),
    "security/jwt-unverified": ("Token accepted without verification", "Verify signature and algorithm."),
    "security/hardcoded-secret": ("Secret in the source", "Revoke it and read it from the environment."),
    "security/env-not-ignored": ("Environment file is not ignored", "Add it to the ignore file and revoke what it held."),
}
#: Categories of what a repository lacks.
LACKS = {
    "config/no-linter": "configuration",
    "config/no-tests": "testing",
    "config/no-ci": "configuration",
    "config/no-readme": "configuration",
    "dep/no-lockfile": "dependencies",
    "security/env-not-ignored": "secret",
}
COLUMNS = ("repo", "rule_id", "category", "severity", "confidence", "file", "line", "fingerprint")


def _lacking(files: DataFrame, facts: DataFrame) -> DataFrame:
    nowhere, category = F.lit(None).cast("string"), scoring.lookup("rule_id", LACKS)
    lacks = rules.repository_rules(files, facts).withColumns({"category": category, "file": nowhere, "line": F.lit(None).cast("int")})
    return lacks.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("file"), F.col("line"))).select(*COLUMNS)


def known_vulnerabilities(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """A finding for each package with advisories, surer if a lock file names its version.

    packages: (repo, ecosystem, name, direct, from_lockfile, file, line), one row a package; advisories as of `dependencies.vulnerable`."""
    keys = ["repo", "ecosystem", "name"]
    hits = dependencies.vulnerable(packages.select(*keys, "direct"), advisories).join(packages.drop("direct"), keys)
    rule, confidence = F.lit("dep/known-vulnerability"), F.when(F.col("from_lockfile"), "high").otherwise("medium")
    return hits.select("repo", rule.alias("rule_id"), F.lit("dependencies").alias("category"), "severity", confidence.alias("confidence"), "file", F.col("line").cast("int").alias("line"), fingerprint(rule, F.col("file"), F.col("line"), F.col("name")).alias("fingerprint"))


def advisory_findings(files: DataFrame, advisories: DataFrame) -> DataFrame:
    """Findings about the packages that files declare or lock, by the ranges of advisories that hold their versions; with
    package, version, description, fixed and references. A declared package is placed at its line of the manifest."""
    packages = written(dependencies.packages_in(files), "packages")
    hits = dependencies.advised(packages, advisories)
    name = F.element_at(F.split("path", "/"), -1)
    preferred = F.when(name == "package.json", "npm").when(name.isin(*rules.PYTHON_MANIFESTS), "PyPI")
    rank = F.struct(F.array_position(F.array(*map(F.lit, rules.PYTHON_MANIFESTS)), name), F.split("path", "/"))
    manifests = files.withColumn("ecosystem", preferred).where("ecosystem is not null").groupBy("repo", "ecosystem").agg(F.min_by(F.struct("path", "text"), rank).alias("m")).select("repo", "ecosystem", "m.*")
    at = hits.where("direct").join(manifests, ["repo", "ecosystem"]).select(F.struct("repo", "path").alias("manifest"), "repo", "ecosystem", "path", "text", F.col("name").alias("package"))
    lines = manifest_lines(at.select("manifest", "path", "text").dropDuplicates(["manifest"]), at).select(F.col("manifest.repo").alias("repo"), F.col("manifest.path").alias("file"), F.col("package").alias("name"), "line")
    placed = hits.join(manifests.select("repo", "ecosystem", F.col("path").alias("file")), ["repo", "ecosystem"], "left").withColumn("file", F.when(F.col("direct"), F.col("file"))).join(lines, ["repo", "file", "name"], "left")
    rule, confidence = F.lit("dep/known-vulnerability"), F.when(F.col("from_lockfile"), "high").otherwise("medium")
    return placed.select(
        "repo", rule.alias("rule_id"), F.lit("dependencies").alias("category"), "severity", confidence.alias("confidence"), "file", F.col("line").cast("int").alias("line"), fingerprint(rule, F.col("file"), F.col("line"), F.col("name")).alias("fingerprint"),
        F.col("name").alias("package"), "version", "n", "fixed", "references", "description",
    )


def _text(part: int) -> Column:
    return scoring.lookup("rule_id", {rule: texts[part] for rule, texts in TEXTS.items()})


def findings(files: DataFrame, packages: DataFrame | None = None, advisories: DataFrame | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """All findings in files (repo, path, language, text), with id, title and remediation.

    Texts are read twice: for facts, and by the one scan of all rules. With `ranges`, advisories by version as of
    `dependencies.affected`, what the files declare and lock is looked up; with packages and advisories, these by name. Files without text have no lines; an empty table gives no findings."""
    facts = written(project_facts(files), "facts")
    found = [rules.run_rules(with_raw(files), facts).select(*COLUMNS), _lacking(files, facts)]
    if packages is not None and advisories is not None:
        found.append(known_vulnerabilities(packages, advisories).select(*COLUMNS))
    if ranges is not None:
        found.append(advisory_findings(files, ranges).select(*COLUMNS))
    titled = reduce(DataFrame.unionByName, found).withColumns({"title": _text(0), "remediation": _text(1)})
    return titled.withColumn("id", finding_id(F.col("rule_id"), F.col("file"), F.col("line"), F.col("title")))


def reports(files: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each repository: what `report_scores` and `summaries` give for the findings that its report keeps,
    severity counts, whether findings were cut off, and the exported document (null without findings)."""
    all_ = scoring.truncated(found, limit=scoring.REPORT_LIMIT + 1)
    kept = written(all_.where(F.col("place") <= scoring.REPORT_LIMIT), "kept")
    repositories = files.groupBy("repo").agg(F.count("*").alias("files"))
    cut = all_.where(F.col("place") > scoring.REPORT_LIMIT).select("repo", F.lit(True).alias("cut"))
    plain = kept.drop("place", "priority", "rank", "penalty")
    scored = scoring.report_scores(plain, repositories).join(repositories, "repo")
    counts = scoring.severity_counts(plain).drop("total")
    out = scored.join(counts, "repo", "left").na.fill(0, list(scoring.SEVERITIES)).join(scoring.summaries(plain, repositories), "repo").join(cut, "repo", "left")
    return out.withColumn("truncated", F.coalesce("cut", F.lit(False))).drop("cut").join(sarif.documents(plain), "repo", "left")

"""Facts of repositories: one row each, from all their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers of tests, continuous integration and lockfiles, and packages that name a framework.
TEST_MARKERS = (".test.", ".spec.", "_test.", "test_", "__tests__")
CI_MARKERS = (".github/workflows", ".gitlab-ci.yml", ".circleci", "azure-pipelines.yml", "jenkinsfile", ".travis.yml", "bitbucket-pipelines.yml")
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "pipfile.lock", "cargo.lock", "go.sum", "composer.lock")
FRAMEWORKS = {"next": "next", "react": "react", "vue": "vue", "nuxt": "nuxt", "svelte": "svelte", "@sveltejs/kit": "sveltekit", "@angular/core": "angular", "express": "express", "fastify": "fastify", "@nestjs/core": "nestjs", "remix": "remix", "gatsby": "gatsby", "astro": "astro", "vite": "vite", "webpack": "webpack", "electron": "electron", "react-native": "react-native"}
MANAGERS = {"yarn.lock": "yarn", "pnpm-lock.yaml": "pnpm", "requirements.txt": "pip", "pyproject.toml": "pip", "pipfile": "pip", "go.mod": "go", "cargo.toml": "cargo"}
TEST_SCRIPTS = ("test", "test:unit", "vitest", "jest")
REACT = ("react", "next", "remix", "gatsby")


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def project_facts(files: DataFrame) -> DataFrame:
    """(repo, languages, managers, frameworks, has_*, is_node, is_python, is_react): one aggregation over files.

    The root manifest is the shallowest package.json (of equals the first by path); one that is no JSON object makes
    no Node project. Lockfile names are compared in lower case."""
    low, name = F.lower("path"), F.lower(name_of(F.col("path")))
    parts = F.split("path", "/")
    manifest = F.when(name == "package.json", F.struct(F.size(parts), parts, F.col("text").alias("text")))
    manager = None
    for file, label in MANAGERS.items():
        manager = F.when(name == file, label) if manager is None else manager.when(name == file, label)
    agg = files.groupBy("repo").agg(
        F.array_sort(F.collect_set("language")).alias("languages"),
        F.collect_set(manager).alias("managers"),
        F.bool_or(_contains_any(low, TEST_MARKERS)).alias("has_tests"),
        F.bool_or(_contains_any(low, CI_MARKERS)).alias("has_ci"),
        F.bool_or(name.isin(*LOCKFILES)).alias("has_lockfile"),
        F.bool_or((name == "tsconfig.json") | (F.coalesce("language", F.lit("")) == "typescript")).alias("has_typescript"),
        F.bool_or(F.startswith(name, F.lit("readme"))).alias("has_readme"),
        F.min(manifest).alias("root"),
    )
    shape = "struct<dependencies:map<string,string>,devDependencies:map<string,string>,scripts:map<string,string>>"
    text = F.col("root.text")
    agg = agg.withColumn("manifest", F.when(F.startswith(F.ltrim(text), F.lit("{")), F.from_json(text, shape)))
    empty = F.create_map().cast("map<string,string>")
    keys = lambda c: F.map_keys(F.coalesce(c, empty))
    packages = F.array_union(keys(F.col("manifest.dependencies")), keys(F.col("manifest.devDependencies")))
    frameworks = F.array_compact(F.array(*[F.when(F.array_contains(packages, p), F.lit(label)) for p, label in FRAMEWORKS.items()]))
    node = F.col("manifest").isNotNull()
    tested = F.col("has_tests") | F.arrays_overlap(keys(F.col("manifest.scripts")), F.array(*map(F.lit, TEST_SCRIPTS)))
    agg = agg.withColumns({"is_node": node, "frameworks": frameworks, "has_tests": tested, "managers": F.array_sort(F.when(node, F.array_union("managers", F.array(F.lit("npm")))).otherwise(F.col("managers")))})
    return agg.withColumns({"is_python": F.array_contains("languages", "python"), "is_react": F.arrays_overlap("frameworks", F.array(*map(F.lit, REACT)))}).drop("root", "manifest")

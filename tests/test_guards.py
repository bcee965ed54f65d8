"""Decisions over a row at their edges: nulls, blanks, and the order of reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from findlake.operators import guards
from findlake.operators.comments import branch_comments


def _one(spark, schema, rows, column):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(column).collect()]


def test_references_take_the_first_shape_that_fits(spark):
    rows = [("https://github.com/a/b/commit/0f1e",), ("a/b.git",), ("git@github.com:a-/b/",), ("-a/b",), ("",), (None,)]
    got = _one(spark, "u string", rows, guards.repository_ref(F.col("u")))
    assert [r and tuple(r) for r in got] == [("a", "b", "0f1e"), ("a", "b", None), ("a-", "b", None), None, None, None]
    pulls = _one(spark, "u string", [("github.com/a/b/pull/12/files",), ("github.com/a/b/pull/x",), (None,)], guards.pull_request_ref(F.col("u")))
    assert [r and tuple(r) for r in pulls] == [("a", "b", 12), None, None]


def test_the_first_refusal_counts(spark):
    rows = [("u", None, "a/b", "f", "p"), (None, None, "a/b", "f", "p"), ("u", "u", None, None, None), ("u", "u", "a/b", None, None), ("u", "u", "a/b", "f", ""), ("u", "u", "a/b", "f", "p")]
    got = _one(spark, "o string, u string, r string, f string, p string", rows, guards.acceptance_refusal(*[F.col(c) for c in "ourfp"]))
    assert got == ["not_owner", "not_owner", "upload", "unknown_finding", "no_fingerprint", None]


def test_sources_without_a_repository_or_commit(spark):
    rows = [("upload", None, None), ("repository", None, "c"), ("repository", "b", "c"), ("repository", "a/b", None), ("repository", "a/b", ""), ("repository", "a/b", "c"), (None, "a/b", "c")]
    got = _one(spark, "k string, r string, c string", rows, guards.source_provider(F.col("k"), F.col("r"), F.col("c")))
    assert got == ["stored", "no_repository", "no_repository", "no_commit", "no_commit", "remote", "remote"]


def test_chains_of_attempts(spark):
    rows = [([503, 200, 401],), ([404, 429, 200],), ([404, 404],), ([404, 500],)]
    got = _one(spark, "c array<int>", rows, guards.routed(F.col("c")))
    assert [tuple(r) for r in got] == [("served", 2), ("fatal", 2), ("unreachable", 2), ("exhausted", 2)]


def test_answers(spark):
    diff = "--- a\n+++ b\n@@ -1 +1 @@\n-x\n+y"
    rows = [("fix", diff), ("fix", f"```diff\n{diff}\n```"), ("fix", "prose"), ("fix", "INSUFFICIENT_CONTEXT: more"), ("explain", "### What this is"), ("other", "s" * 20), ("fix", None), ("fix", " \n")]
    got = _one(spark, "a string, t string", rows, guards.answer_problem(F.col("a"), F.col("t"), F.lit("s" * 20)))
    assert got == [None, None, "no_diff", None, "missing_sections", "echo", "empty", "empty"]


def test_manifest_lines_prefer_dependencies(spark):
    text = '{\n"scripts": {\n"vite": "x",\n"dev": "left"\n},\n"dependencies": {\n"vite": "1",\n"left": "2"\n}\n}'
    manifests = spark.createDataFrame([(1, "package.json", text), (2, "requirements.txt", "# left\nLeft==1"), (3, "package.json", None)], "manifest int, path string, text string")
    wanted = spark.createDataFrame([(m, p) for m in (1, 2, 3) for p in ("vite", "left", "dev", "none")], "manifest int, package string")
    got = {(r.manifest, r.package): r.line for r in guards.manifest_lines(manifests, wanted).collect()}
    assert got == {(1, "vite"): 7, (1, "left"): 8, (1, "dev"): 4, (2, "left"): 2}


def test_a_comment_of_a_report_without_any_finding(spark):
    reports = spark.createDataFrame([(1, "a/b", True, True, 0, 0, 100, "A", 0, "u"), (2, "a/b", False, False, 3, 0, 60, "D", 0, "u"), (3, "a/b", True, False, 9, 0, 39, "F", 1, "u")], "report int, name string, compared boolean, truncated boolean, findings long, unchanged long, score int, grade string, new_rules long, address string")
    none = spark.createDataFrame([], "report int, place int, severity string, title string, file string, line int")
    got = {r.report: r.comment for r in branch_comments(reports, none, none).collect()}
    assert got[1].startswith("### a/b\n\n0 new, 0 resolved, 0 unchanged · score 100 (A)\n\n> ") and got[2] == "### a/b\n\n3 findings; first report, nothing to compare with · score 60 (D)\n\n[Report](u)"
    # the order is that of the report: a low finding that stands first is told first
    new = spark.createDataFrame([(3, 2, "critical", "b", "x.py", 3), (3, 1, "low", "a", None, None), (3, 5, "info", "c", "y", 1)], none.schema)
    told = {r.report: r.comment for r in branch_comments(reports, new, none, listed=2).collect()}[3]
    assert told == (
        "### a/b\n\n3 new, 0 resolved, 0 unchanged · score 39 (F)\n\n#### New (3)\n| severity | finding | place |\n|---|---|---|\n| low | a | — |\n| critical | b | `x.py:3` |\nand 1 more: see [all of them](u?tab=findings&new=1)"
        "\n\n> Some of these come from 1 rule that the earlier report did not have, not from this branch.\n\n[Report](u)"
    )

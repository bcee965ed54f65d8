"""Order of versions, advisories by range, lock files and summaries on small fixtures."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from findlake.functions.manifests import ROWS, lock_packages, lock_rows
from findlake.functions.versions import version_key
from findlake.operators import dependencies as deps
from findlake.operators import engine
from findlake.operators.guards import joined_summaries
from findlake.registry import QUERIES

ORDER = "0 0.0.1 1.0.dev1 1.0-alpha 1.0-alpha.1 1.0-alpha.beta 1.0-beta.2 1.0-beta.11 1.0rc1 1.0 1.0.post1 1.0.1 1.2 1.10 2.0.0-rc.1 2 10.0.0 99999999999999999999.1".split()


def test_versions_in_order(spark):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(ORDER)], "k int, v string").select("k", version_key(F.col("v")).alias("key"))
    assert [r.k for r in rows.repartition(3).orderBy("key").collect()] == list(range(len(ORDER)))
    same = spark.createDataFrame([("1.0", "v1.0.0+build.5"), ("2", "2.0.0.0"), ("1.0RC1", "1.0rc1")], "a string, b string").where(version_key(F.col("a")) == version_key(F.col("b")))
    assert same.count() == 3
    assert spark.createDataFrame([("latest",), ("",), (None,)], "v string").where(version_key(F.col("v")).isNotNull()).count() == 0


ADVISORY = "ecosystem string, name string, id string, severity string, introduced string, fixed string, summary string, aliases array<string>"


def test_a_fixed_version_is_not_affected(spark):
    ranges = [
        ("npm", "left", "A-1", "high", "1.0.0", "1.2.0", "One, two", ["CVE-1"]),
        ("npm", "left", "A-1", "high", "2.0.0", "2.1.0", "One, two", ["CVE-1"]),
        ("npm", "left", "A-2", "low", None, "1.1.0", " ", None),
        ("npm", "left", "A-3", "critical", "2.0.0", None, "One, two", []),
        ("PyPI", "left", "A-4", "critical", "0", None, "x", None),
    ]
    versions = ["0.9", "1.0.0", "1.1.0", "1.2.0-rc1", "1.2.0", "1.9", "2.0.5", "2.1.0", "?"]
    got = deps.affected(spark.createDataFrame([("npm", "left", v) for v in versions], "ecosystem string, name string, version string"), spark.createDataFrame(ranges, ADVISORY)).collect()
    assert {r.version: (r.n, r.worst, r.ids, r.shown, r.fixed) for r in got} == {
        "0.9": (1, 3, ["A-2"], ["A-2"], "1.1.0"),
        "1.0.0": (2, 1, ["A-1", "A-2"], ["CVE-1", "A-2"], "1.2.0"),
        "1.1.0": (1, 1, ["A-1"], ["CVE-1"], "1.2.0"),
        "1.2.0-rc1": (1, 1, ["A-1"], ["CVE-1"], "1.2.0"),
        "2.0.5": (2, 0, ["A-1", "A-3"], ["CVE-1", "A-3"], "2.1.0"),
        "2.1.0": (1, 0, ["A-3"], ["A-3"], None),
    }
    assert all(r.summaries in ([], ["One, two"]) for r in got)


def test_lock_files_nested_and_flat():
    nested = {"dependencies": {"a": {"version": "1", "dependencies": {"b": {"version": "2"}, "a": {"version": "9"}}}, "b": {"version": "3"}, "c": {"resolved": 1}, "d": 5}}
    assert lock_packages(json.dumps(nested)) == [("a", "1"), ("b", "2")]
    flat = {"packages": {"": {"version": "0"}, "node_modules/x/node_modules/@s/y": {"version": "1"}, "node_modules/a": {"version": "7"}, "other": {"version": "8"}, "node_modules/z": None}} | nested
    assert lock_packages(json.dumps(flat)) == [("@s/y", "1"), ("a", "7"), ("b", "2")]
    deep: dict = {}
    for k in range(300):
        deep = {"dependencies": {f"p{k}": {"version": "1", **deep}}}
    assert len(lock_packages(json.dumps(deep))) == 300
    assert lock_packages("{") == lock_packages("[1]") == lock_packages('{"packages": []}') == []


def test_rows_of_many_lock_files_are_passed_on_together():
    two = json.dumps({"dependencies": {"a": {"version": "1"}, "b": {"version": "2"}}})
    files = pd.DataFrame([(k, "package-lock.json", two if k % 3 else None) for k in range(3000)], columns=["repo", "path", "text"])
    frames = list(lock_rows(iter([files, files[:0], files])))
    assert len(frames) == 1 and frames[0].groupby("repo").size().to_dict() == {k: 4 for k in range(3000) if k % 3}
    assert [len(f) for f in lock_rows(iter([files] * 6))] == [ROWS, 4000]  # and no more than that are held
    assert list(lock_rows(iter([files[:1]]))) == []


def test_lock_files_of_one_split_are_many_tasks(spark):
    rows = QUERIES["f101_lockfile_packages"](spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("task"))
    assert rows.distinct().count() > 4


def test_findings_from_files_and_ranges(spark):
    lock = {"packages": {"node_modules/left": {"version": "1.5.0"}, "node_modules/deep": {"version": "2.0.0"}, "node_modules/mild": {"version": "2.0.0"}}}
    files = [
        ("a", "web/package.json", "json", json.dumps({"dependencies": {"left": "^1.0.0", "open": "*"}}, indent=1)),
        ("a", "web/package-lock.json", "json", json.dumps(lock)),
        ("a", "requirements.txt", "text", "# tools\nFlask_Login==0.4\nother>=1\n"),
    ]
    ranges = [("npm", n, f"A-{n}", s, "1.0.0", None, "Bad", None) for n, s in (("left", "medium"), ("deep", "critical"), ("mild", "medium"), ("open", "high"))] + [("PyPI", "flask-login", "A-f", "high", None, "0.5", None, None)]
    rows = engine.advisory_findings(spark.createDataFrame(files, "repo string, path string, language string, text string"), spark.createDataFrame(ranges, ADVISORY)).collect()
    assert {(r.package, r.version, r.severity, r.confidence, r.file, r.line) for r in rows} == {
        ("left", "1.5.0", "medium", "high", "web/package.json", 3),
        ("deep", "2.0.0", "high", "high", None, None),
        ("flask-login", "0.4", "high", "medium", "requirements.txt", 2),
    }
    said = {r.package: r.description for r in rows}
    assert said["deep"] == "A-deep (pulled in transitively). Bad." and said["flask-login"] == "A-f. See the advisories for detail."


def test_the_fill_is_bounded_and_in_order(spark):
    direct = spark.createDataFrame([("r", "npm", f"d{k}", "1.0.0", False) for k in range(4)] + [("r", "npm", "none", None, False)], "repo string, ecosystem string, name string, version string, from_lockfile boolean")
    locked = spark.createDataFrame([("r", k, f"t{k:02d}", "1.0.0") for k in range(20)] + [("r", 50, "d1", "2.0.0"), ("s", 0, "x", "1.0.0")], "repo string, place int, name string, version string")
    got = deps.looked_up(direct, locked, most=10).collect()
    assert {r.name for r in got if r.repo == "r"} == {"d0", "d1", "d2", "d3"} | {f"t{k:02d}" for k in range(6)} and [r.name for r in got if r.repo == "s"] == ["x"]


def test_summaries_are_cut_at_a_word(spark):
    cases = [(["a", " ", "b!", None, "c", "d"], "a. b! c."), ([], ""), (["word " * 3 + "x, " + "y" * 20], "word word word x…"), (["abcdefghij klmnopqr"], "abcdefghij…"), (["abcdefghij klmnopq"], "abcdefghij klmnopq.")]
    rows = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(cases)], "k int, p array<string>").select("k", joined_summaries(F.filter("p", lambda x: x.isNotNull()), 19).alias("s")).orderBy("k").collect()
    assert [r.s for r in rows] == [w for _, w in cases]

"""The run from files to reports, and archives that pass a limit."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile

import pytest

from findlake.functions.paths import rejection
from findlake.functions.text import with_raw
from findlake.operators import engine, rules
from findlake.sources.archives import Limits, _refused, read_archives
from pyspark.sql import functions as F

SHAPE = "repo string, path string, language string, text string"


def manifest(react, dom, key="dependencies"):
    return json.dumps({key: {"react": react, "react-dom": dom}}, indent=1)


def test_every_rule_has_texts():
    assert {r.id for r in rules.RULES} | set(engine.LACKS) | {"dep/known-vulnerability"} == set(engine.TEXTS)


def test_react_versions(spark):
    rows = {
        "far": manifest("^19.1.0", "^18.2.0"),
        "near": manifest("^19.1.1", "19.2.0"),
        "dev": manifest("17.0.0", "16.9.1", "devDependencies"),
        "open": manifest("*", "18.0.0"),
        "one": '{"dependencies": {"react": "19.0.0"}}',
        "broken": "{",
        "none": None,
    }
    lines = with_raw(spark.createDataFrame([(k, "web/package.json", "json", v) for k, v in rows.items()], SHAPE))
    got = {(r.repo, r.line) for r in rules.scan(lines, rules.RULES[:1]).collect()}
    assert got == {("far", 4), ("dev", 4)}
    locked = spark.createDataFrame([("far", "react", "18.3.0"), ("near", "react-dom", "18.0.0")], "repo string, name string, version string")
    assert {r.repo for r in rules.locked_react_mismatch(lines, locked).collect()} == {"near", "dev"}


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        ("a", "package.json", "json", manifest("^19.1.0", "^18.2.0")),
        ("a", "src/db.js", "javascript", "await db.query(`SELECT ${req.query.id}`);\n"),
        ("a", "src/none.js", "javascript", None),
        ("b", "README.md", "markdown", "# b\n"),
    ]
    return spark.createDataFrame(rows, SHAPE)


def test_reports(spark, files):
    packages = spark.createDataFrame([("a", "npm", "left", True, True, "package.json", 2), ("b", "pip", "right", True, False, "requirements.txt", 1)], "repo string, ecosystem string, name string, direct boolean, from_lockfile boolean, file string, line int")
    advisories = spark.createDataFrame([("npm", "left", "A-1", "critical", "2.0.0", "x"), ("pip", "right", "A-2", "medium", None, "y")], "ecosystem string, name string, id string, severity string, fixed string, summary string")
    found = engine.findings(files, packages, advisories)
    rows = {(r.repo, r.rule_id): r for r in found.collect()}
    assert rows["a", "dep/known-vulnerability"].confidence == "high" and rows["b", "dep/known-vulnerability"].confidence == "medium"
    assert rows["a", "security/sql-injection"].severity == "critical" and ("a", "dep/react-dom-mismatch") in rows
    assert all(r.title and r.remediation and len(r.id) == 12 and len(r.fingerprint) == 12 for r in rows.values())
    made = {r.repo: r for r in engine.reports(files, found).collect()}
    assert made["a"].cap == 39 and made["a"].grade == "F" and not made["a"].truncated and made["a"].files == 3
    assert made["a"].summary.startswith("Start with SQL statement built from input in src/db.js, then ")
    run = json.loads(made["a"].document)["runs"][0]
    assert len(run["results"]) == made["a"].total == sum(repo == "a" for repo, _ in rows)
    assert run["results"][0]["ruleId"] == "security/sql-injection"
    assert made["b"].summary.startswith("Nothing blocking found.")


def test_no_files(spark, files):
    nothing = files.where("false")
    assert engine.reports(nothing, engine.findings(nothing)).count() == 0


def test_refused_names_agree(spark):
    names = ["/etc/x", "a/../b", "C:\\x", "", "a\0b", "d/" * 30 + "x", "src/a.py", "..\\x", "./a//b", "d/" * 23 + "x"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", rejection(F.col("n")).alias("r")).collect()
    assert {r.n: r.r for r in got} == {n: _refused(n) for n in names}


def packed(tmp_path, kind, members):
    if kind == "zip":
        with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in members:
                z.writestr(name, data)
    else:
        with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
            for name, data in members:
                info = tarfile.TarInfo(f"root/{name}")
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    return str(tmp_path), "*." + ("zip" if kind == "zip" else "tar.gz")


@pytest.mark.parametrize("kind", ["zip", "tar"])
def test_limits_of_archives(spark, tmp_path, kind):
    path, pattern = packed(tmp_path, kind, [("a", b"x" * 50), ("../b", b"y" * 60), ("c", b"z" * 300), ("d", b"w" * 40)])

    def read(**limits):
        return [(r.name, r.size, r.reason) for r in read_archives(spark, path, pattern, Limits(**limits)).orderBy("seq").collect()]

    a, b, d = ("a", 50, None), ("../b", 60, "traversal"), ("d", 40, None)
    assert read() == [a, b, ("c", 300, None), d]
    assert read(member=100) == [a, b, ("c", None, "too_large"), d]
    assert read(total=350) == [a, b, ("c", 300, None), (None, None, "total_bytes")]
    assert read(members=3) == [a, b, ("c", 300, None), (None, None, "file_count")]
    assert read(ratio=0.1)[-1] == (None, None, "compression_ratio")


def test_the_source_reads_what_a_whole_read_gives(spark, tmp_path):
    from findlake.sources.archive_source import archive_members

    import random

    rng = random.Random(6)
    for k in range(6):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for n in range(rng.randint(0, 30)):
                name = rng.choice(["a/{}.py", "../{}", "/abs{}", "dir{}/", "src/{}.txt"]).format(n)
                z.writestr(name, b"" if name.endswith("/") else rng.randbytes(rng.choice([0, 10, 300, 2000])))
    (tmp_path / "broken.zip").write_bytes(b"PK no archive")
    plain = lambda df: sorted((r.archive.rsplit("/", 1)[1], r.seq, r.name, r.size, r.reason, r.content and bytes(r.content)) for r in df.collect())
    for limits in (Limits(), Limits(member=1000), Limits(total=5000), Limits(members=7), Limits(member=500, total=2500)):
        want = plain(read_archives(spark, str(tmp_path), "*.zip", limits))
        for per_task in (1, 3000, 1 << 30):
            assert plain(archive_members(spark, str(tmp_path), "*.zip", limits, per_task)) == want, (limits, per_task)


def test_a_folder_is_listed_before_it_is_read(spark, tmp_path):
    from findlake.sources.directories import list_directory, scan_directory

    made = {"src/b.py": b"x = 1", "src-1/a.py": b"y", "src/a b+c%.py": b"\xff", "node_modules/m/i.js": b"no", "img/x.png": b"no", "big.py": b"z" * 1_000_001, "bin.py": b"a\0b"}
    for name, content in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    (tmp_path / "link.py").symlink_to(tmp_path / "src/b.py")
    (tmp_path / "linked").symlink_to(tmp_path / "src")
    (tmp_path / "node_modules/m/i.js").chmod(0)  # a read of it would be seen
    assert {r.path for r in list_directory(spark, str(tmp_path)).collect()} == set(made)
    got = [(r.place, r.path, r.text, r.analysable) for r in scan_directory(spark, str(tmp_path)).orderBy("place").collect()]
    assert got == [(1, "big.py", None, True), (2, "bin.py", None, True), (3, "src/a b+c%.py", "\ufffd", True), (4, "src/b.py", "x = 1", True), (5, "src-1/a.py", "y", True)]


def test_a_folder_is_listed_by_tasks(spark, tmp_path):
    from findlake.sources.directories import list_directory, scan_directory

    made = {f"{'/'.join(f'd{k % m}' for m in range(1, 2 + k % 5))}/p{k}.py": f"x = {k}" for k in range(300)} | {".gitignore": ".env", "a/.npmrc": "b", "a/_c.py": "c"}
    for name, content in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    (tmp_path / "empty/er").mkdir(parents=True)
    (tmp_path / f".{'0' * 32}.part").write_text("left by a task that was lost")
    (tmp_path / "a/loop").symlink_to(tmp_path)
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        for entries in (0, 20, 10_000):
            listed = list_directory(spark, root, entries)
            assert sorted((r.path, r.size) for r in listed.collect()) == sorted((name, len(content)) for name, content in made.items())
            assert len(listed.inputFiles()) < 100  # the driver's list of what is read: not a file of the folder each
    assert {r.path: r.text for r in scan_directory(spark, str(tmp_path)).collect()} == made
    (tmp_path / "none").mkdir()
    assert list_directory(spark, str(tmp_path / "none")).count() == 0


def test_broken_archives(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(b"no archive")
    (tmp_path / "b.tar.gz").write_bytes(b"\x1f\x8b broken")
    assert [r.reason for r in read_archives(spark, str(tmp_path), "*.zip").collect()] == ["unreadable"]
    assert [r.reason for r in read_archives(spark, str(tmp_path), "*.tar.gz").collect()] == ["unreadable"]

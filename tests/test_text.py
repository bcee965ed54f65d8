"""Kernels and text functions."""

from __future__ import annotations

from findlake.functions import blanking, kernels, text, versions
from findlake.functions.paths import language, rejection, safe_path, should_read
from findlake.sources.archives import decoded, read_archives, read_directory
from pyspark.sql import functions as F


def test_blanked_keeps_lines_and_delimiters():
    lines = ["a = 'x // y' // note", "/* one", "two */ b", "c = `t", "u` + 1"]
    code = blanking.blanked(lines, "javascript")
    assert len(code) == len(lines)
    assert code[0].startswith("a = '") and "note" not in code[0] and "//" not in code[0]
    assert code[1].strip() == "" and code[2].strip() == "b"
    assert code[3].strip() == "c = `" and code[4].strip() == "` + 1"
    assert blanking.blanked(["x = 1  # y", "s = '#'"], "python") == ["x = 1     ", "s = ' '"]
    assert blanking.blanked([r"a = 'it\'s' + b"], "javascript") == ["a = '     ' + b"]


def test_split_lines_is_splitlines(spark):
    texts = ["", "a", "a\n", "a\n\nb", "a\r\nb\rc", "x\x0by\x0cz\x1c\x1d\x1ew\x85v\u2028u\u2029t", "\n", "a\n\n"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.split_lines(F.col("t")).alias("l"), text.viewer_line_count(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.l for r in rows] == [t.splitlines() for t in texts]
    assert [r.n for r in rows] == [t.count("\n") + 1 if t else 0 for t in texts]


def test_entropy_and_redaction(spark):
    r = spark.createDataFrame([("aaaaaaaaaa",), ("q8Zr4Tw1Yx9Kp3Lm7Nv2",), ("",)], "v string").select(text.entropy(F.col("v")).alias("e"), text.redacted(F.col("v")).alias("r")).collect()
    assert r[0].e == 0 and r[1].e > 3.6 and r[2].e == 0
    assert r[1].r == "q8Z…v2 (20 characters)"


def test_kernels_follow_brackets_and_indentation():
    assert kernels.mutable_defaults(["def f(", "    a,", "    b=[],", "):", "    x = {}", "def g(a=None):", "    b = []"]) == [(1, "f")]
    assert kernels.unkeyed_lists(["x.map((a) => <li>{a}</li>)", "x.map((a) => [a, b])", "return (<p/>)"]) == [1]
    assert kernels.unkeyed_lists(["x.map((a) => (", "  <li", "    key={a.id}", "  >", "  </li>", "))"]) == []
    assert kernels.deepest(["if (a) {", "  const o = { b: { c: 1 } };", "  for (;;) {", "  }", "}"]) == (2, 3)
    body = ["def f():", *["    x = 1"] * 90, "y = 2"]
    assert kernels.long_functions(body, "python", 80) == [(1, "f", 91)]
    markup = ["function F() {", "  return (", *["    <div>"] * 200, "  );", "}"]
    assert kernels.long_functions(markup, "javascript", 80) == []


def test_versions_and_requirements(spark):
    specs = ["==1.2.3", "== 2.0", ">=1.0", "^19.1.0", "~1.4.2", "workspace:*", "git+https://x/y", "*"]
    r = spark.createDataFrame([(s,) for s in specs], "s string").select(versions.exact_version(F.col("s")).alias("e"), versions.coerced(F.col("s")).alias("c")).collect()
    assert [x.e for x in r] == ["1.2.3", "2.0", None, None, None, None, None, None]
    assert [x.c for x in r] == ["1.2.3", None, None, "19.1.0", "1.4.2", None, None, None]
    lines = ["# c", "-r other.txt", "", "Flask_Login[a]>=1.0 ; python_version > '3'", "django"]
    got = spark.createDataFrame([(x,) for x in lines], "l string").select(versions.requirement(F.col("l")).alias("r")).collect()
    assert [x.r and tuple(x.r) for x in got] == [None, None, None, ("flask-login", ">=1.0"), ("django", "")]
    names = spark.createDataFrame([("Flask_Login",), ("flask.login",), ("flask--LOGIN",)], "n string").select(versions.normal_name(F.col("n")).alias("n")).distinct().collect()
    assert [x.n for x in names] == ["flask-login"]


def test_paths(spark):
    cases = {"a/b.min.js": None, "x.d.ts": None, "Dockerfile": "dockerfile", "s/a.PY": "python", "a.tsx": "typescript", ".py": None, "noext": None}
    df = spark.createDataFrame([(p,) for p in cases], "p string").select("p", language(F.col("p")).alias("l")).collect()
    assert {r.p: r.l for r in df} == cases
    read = {"node_modules/x/package.json": False, "Cargo.lock": True, "a.lock": False, "src/a.py": True, "img/a.PNG": False, "x.map": False}
    assert {r.p: r.v for r in spark.createDataFrame([(p,) for p in read], "p string").select("p", should_read(F.col("p")).alias("v")).collect()} == read
    bad = {"/etc/x": "absolute_path", "a/../b": "traversal", "C:\\x": "drive_letter", "": "traversal", "a\0b": "traversal", "d/" * 30 + "x": "too_deep", "src/a.py": None, "..\\x": "traversal"}
    assert {r.p: r.v for r in spark.createDataFrame([(p,) for p in bad], "p string").select("p", rejection(F.col("p")).alias("v")).collect()} == bad
    safe = {" a/./b ": "a/b", "../a": None, "/a": None, "a\\b": None, "": None}
    assert {r.p: r.v for r in spark.createDataFrame([(p,) for p in safe], "p string").select("p", safe_path(F.col("p")).alias("v")).collect()} == safe


def test_contents_and_archives(spark, tmp_path):
    import io
    import tarfile
    import zipfile

    raw = [b"plain", b"a\0b", b"A\xffB", b"x" * 1_000_001]
    got = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raw)], "i int, c binary").select("i", decoded(F.col("c")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == ["plain", None, "A\ufffdB", None]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("src/a.py", "x = 1\n")
        z.writestr("../evil", "x")
        link = zipfile.ZipInfo("link")
        link.external_attr = 0o120777 << 16
        z.writestr(link, "target")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("root/src/b.py")
        info.size = 3
        t.addfile(info, io.BytesIO(b"y=1"))
        soft = tarfile.TarInfo("root/soft")
        soft.type, soft.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(soft)
    rows = {r.name: (r.reason, r.content and bytes(r.content)) for r in read_archives(spark, str(tmp_path), "*.zip").collect()}
    assert rows == {"src/a.py": (None, b"x = 1\n"), "../evil": ("traversal", b"x"), "link": ("symlink", None)}
    rows = {r.name: (r.reason, r.content and bytes(r.content)) for r in read_archives(spark, str(tmp_path), "*.tar.gz").collect()}
    assert rows == {"src/b.py": (None, b"y=1"), "soft": ("symlink", None)}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.txt").write_text("hello")
    assert [r.text for r in read_directory(spark, str(tmp_path / "d")).collect()] == ["hello"]

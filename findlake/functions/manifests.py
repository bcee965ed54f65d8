"""Manifests in TOML and compressed contents, for which there is no built-in function."""

from __future__ import annotations

import gzip
import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _project(text: str) -> dict[str, str]:
    """Requirements of a project file: those of the project, its optional groups, and the other tool's tables."""
    data = tomllib.loads(text)
    found: dict[str, str] = {}
    project = data.get("project", {})
    lines = [*project.get("dependencies", []), *(x for group in project.get("optional-dependencies", {}).values() for x in group)]
    for line in lines:
        name = line.strip()
        end = next((i for i, c in enumerate(name) if not (c.isalnum() or c in "._-")), len(name))
        spec = name[end:].split(";")[0].strip()
        found[name[:end].lower()] = spec.split("]", 1)[-1].strip() if spec.startswith("[") else spec
    tool = data.get("tool", {}).get("poetry", {})
    for table in (tool.get("dependencies", {}), tool.get("dev-dependencies", {}), *(g.get("dependencies", {}) for g in tool.get("group", {}).values())):
        for name, spec in table.items():
            if name.lower() != "python":
                found.setdefault(name.lower(), spec if isinstance(spec, str) else str(spec.get("version", "")) if isinstance(spec, dict) else "")
    return found


def _locked(text: str) -> dict[str, str]:
    return {p["name"].lower(): p["version"] for p in tomllib.loads(text).get("package", []) if "name" in p and "version" in p}


def _each(parse):
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            try:
                out.append(parse(text or ""))
            except (tomllib.TOMLDecodeError, AttributeError, TypeError):
                out.append({})  # a malformed file declares nothing
        return pd.Series(out, dtype=object)

    return run


def lock_packages(text: str) -> list[tuple[str, str]]:
    """(name, version) of a package-lock file, each name once, as it is first met: in its flat list, where a name is what
    follows the last folder of packages, and then in its nested one, a package before those inside it."""
    try:
        data = json.loads(text)
    except (json.JSONDecodeError, RecursionError):
        return []
    entries = lambda node, key: list(node[key].items()) if isinstance(node, dict) and isinstance(node.get(key), dict) else []
    found: dict[str, str] = {}
    flat = [(path.rpartition("node_modules/")[2], meta) for path, meta in entries(data, "packages") if "node_modules/" in path]
    for name, meta in flat:
        if name and isinstance(meta, dict) and isinstance(meta.get("version"), str):
            found.setdefault(name, meta["version"])
    waiting = entries(data, "dependencies")[::-1]
    while waiting:
        name, meta = waiting.pop()
        if isinstance(meta, dict) and isinstance(meta.get("version"), str):
            found.setdefault(name, meta["version"])
        waiting += entries(meta, "dependencies")[::-1]
    return list(found.items())


#: Rows that a task gathers from lock files before it passes them on.
ROWS = 20_000
_LOCKED_COLUMNS = ["repo", "path", "place", "name", "version"]


def lock_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of `locked_packages` out of batches of files (repo, path, text), gathered over many files: a frame for each
    file would take longer than the file."""
    rows: list[tuple] = []
    for batch in batches:
        for repo, path, text in batch.itertuples(index=False):
            rows += [(repo, path, k, *p) for k, p in enumerate(lock_packages(text or ""))]
            if len(rows) >= ROWS:
                yield pd.DataFrame(rows, columns=_LOCKED_COLUMNS)
                rows = []
    if rows:
        yield pd.DataFrame(rows, columns=_LOCKED_COLUMNS)


def locked_packages(files: DataFrame) -> DataFrame:
    """(repo, path, place, name, version) of the package-lock files among files (repo, path, text): a row for each package of a file."""
    locks = files.where(F.element_at(F.split("path", "/"), -1) == "package-lock.json").select("repo", "path", "text")
    repo = files.schema["repo"].dataType.simpleString()
    return locks.mapInPandas(lock_rows, f"repo {repo}, path string, place int, name string, version string")


_MAP = T.MapType(T.StringType(), T.StringType())


def project_requirements(text):
    """map of name to specification of a pyproject file; empty for a malformed one."""
    return F.pandas_udf(_each(_project), _MAP)(text)


def poetry_lock(text):
    """map of name to version of a poetry lock file; empty for a malformed one."""
    return F.pandas_udf(_each(_locked), _MAP)(text)


def packed(text):
    """The text's bytes, compressed; the same bytes for the same text."""
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else gzip.compress(t.encode(), mtime=0)), T.BinaryType())(text)


def unpacked(content):
    return F.pandas_udf(lambda s: s.map(lambda b: None if b is None else gzip.decompress(b).decode()), T.StringType())(content)

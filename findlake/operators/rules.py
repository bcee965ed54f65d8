"""The rule set, and one scan that runs all of it.

A rule is a gate over facts, a scope over files and a detection: a judgement of single lines, a kernel over a file's code,
or a condition on whole files. The scan reads each file once: a batch function blanks its code, follows its brackets for
the kernels, and looks for all rules' literals at once, so that each line is known by the rules that may hold on it. Only
such lines go on, with the few lines around them, to be judged by column expressions; what they find is small, and all
caps are taken over it together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findlake.functions import kernels
from findlake.functions.blanking import blank_rows
from findlake.functions.ids import fingerprint
from findlake.functions.text import entropy
from findlake.functions.versions import coerced, major
from findlake.operators.facts import name_of
from findlake.sources.folders import written

# The patterns by which the rules are defined.
TEST_PATH = r"(?i)(^|/)(tests?|testing|__tests__|spec|e2e|fixtures?)/|(^|/)(test_[^/]+|[^/]+_test)\.py$|\.(test|spec)\.[jt]sx?$"
PYTHON_TEST_PATH = r"(^|/)(tests?|testing)/|(^|/)(test_[^/]+|[^/]+_test)\.py$"
VENDOR_PATH = r"(?i)(^|/)(vendor|vendors|third[-_]?party|node_modules|bower_components|dist|build|out|static|public|assets|site-packages)/|\.(?:min|pack|bundle|chunk)\.[jt]sx?$"
REQUEST = (
    r"(?i)\b(?:req(?:uest)?\s*\.\s*(?:query|body|params|headers|cookies|url|path)\b"
    r"|ctx\s*\.\s*(?:query|request|params)\b"
    r"|request\s*\.\s*(?:args|form|json|values|data|files|GET|POST|headers|COOKIES)\b"
    r"|event\s*\.\s*(?:queryStringParameters|pathParameters|body)\b"
    r"|searchParams\s*\.\s*get\b|process\s*\.\s*argv\b|(?:sys\s*\.\s*)?argv\b|input\s*\()"
)
BUILT = (r"\$\{", r"""["'`]\s*\+|\+\s*["'`]""", r"""\bf["']""", r"""["']\s*%\s*[\w(]|%s""", r"""["'][^"']*["']\s*\.\s*format\s*\(""")
INTERPOLATED = r"\$\{\s*([A-Za-z_]\w*)|\{\s*([A-Za-z_]\w*)\s*\}|%\s*\(?\s*([A-Za-z_]\w*)|\+\s*([A-Za-z_]\w*)|format\s*\(\s*([A-Za-z_]\w*)"
SQL_SINK = r"(?i)\.\s*(?:query|execute|executemany|raw|exec)\s*\(|\bsequelize\s*\.\s*query\s*\("
SQL_KEYWORD = r"(?i)\b(?:SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM|DROP\s+TABLE|UNION\s+SELECT)\b"
PARAMETERISED = r"""\?|\$\d|%s\s*["']?\s*,|:\w+\s*["']?\s*,"""
COMMAND_SINK = r"\b(?:child_process\s*\.\s*)?(?:exec|execSync|spawn|spawnSync|execFile)\s*\("
SHELL_OPTION = r"shell\s*:\s*true"
EVAL_JS, EVAL_PY = r"\beval\s*\(|\bnew\s+Function\s*\(", r"\b(?:eval|exec)\s*\("
FILE_SINK = r"\bfs(?:\.promises)?\s*\.\s*(?:readFile|readFileSync|writeFile|writeFileSync|createReadStream|createWriteStream|unlink|unlinkSync)\s*\(|\bsendFile\s*\("
PY_FILE_SINK = r"\bopen\s*\(|\bPath\s*\([^)]*\)\s*\.\s*(?:read_text|read_bytes|open)\s*\("
PATH_GUARD = r"\bbasename\s*\(|\bpath\.resolve\s*\([^)]*\)\s*\.\s*startsWith|\.startsWith\s*\(|\bis_relative_to\s*\(|\bcommonpath\s*\(|\bsafe_join\s*\("
HTTP_SINK = r"\b(?:fetch|axios(?:\s*\.\s*(?:get|post|put|delete|request))?|got|superagent|requests\s*\.\s*(?:get|post|put|delete|head|request)|urlopen|httpx\s*\.\s*(?:get|post|AsyncClient))\s*\("
URL_ALLOWED = r"(?i)\bALLOW|allowlist|whitelist|\bnew URL\s*\([^)]*,\s*\w"
WEAK_HASH = r"""(?i)createHash\s*\(\s*["'](md5|sha1)["']|\bhashlib\s*\.\s*(md5|sha1)\s*\("""
SECURITY_PURPOSE = r"(?i)password|passwd|secret|token|signature|signing|hmac|auth|credential|salt"
WEAK_RANDOM = r"\bMath\s*\.\s*random\s*\(\)|\brandom\s*\.\s*(?:random|randint|choice)\s*\("
SECRET_TARGET = r"(?i)token|secret|password|passwd|key|nonce|salt|otp|session|csrf|reset|verify"
CORS_ANY = r"""(?i)Access-Control-Allow-Origin["']?\s*[,:]\s*["']\*["']|origin\s*:\s*["']\*["']"""
CORS_CREDENTIALS = r"""(?i)Access-Control-Allow-Credentials["']?\s*[,:]\s*["']?true|credentials\s*:\s*true"""
JWT_UNVERIFIED = r"""(?i)jwt\s*\.\s*decode\s*\(|jsonwebtoken\s*\.\s*decode\s*\(|verify_signature["']?\s*:\s*False|algorithms?\s*:\s*\[?\s*["']none["']"""
VERIFY_OFF, JWT_CONTEXT, JWT_VERIFIED = r"(?i)verify\s*=\s*False", r"(?i)\bjwt\b|json\s*web\s*token|jsonwebtoken", r"algorithms\s*=\s*\[|\bjwt\s*\.\s*verify\s*\("
TODO = r"(?i)\b(TODO|FIXME|HACK|XXX)\b[:\s]"
LINTER_FILES = (".eslintrc", ".eslintrc.js", ".eslintrc.cjs", ".eslintrc.json", ".eslintrc.yml", ".eslintrc.yaml", "eslint.config.js", "eslint.config.mjs", "eslint.config.ts", "biome.json", "biome.jsonc")
PYTHON_LINTER_FILES = (".ruff.toml", "ruff.toml", ".flake8", ".pylintrc")
LINTER_SECTIONS = r"\[tool\.ruff|\[flake8\]|\[tool\.pylint|\[pylint"
SECRET_KINDS = {
    "aws access key": r"\b((?:AKIA|ASIA)[A-Z0-9]{16})\b",
    "private key": r"(-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----)",
    "forge token": r"\b(gh[pousr]_[A-Za-z0-9]{36,})\b",
    "chat token": r"\b(xox[abprs]-[A-Za-z0-9-]{10,})\b",
    "web token": r"\b(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,})",
}
ASSIGNED = r"""(?i)\b([\w.-]*(?:password|passwd|secret|token|api_?key)[\w-]*)["']?\s*[:=]\s*["']([^"'\s]{12,})["']"""
ENV_ASSIGNED = r"""(?i)^\s*(?:export\s+)?([\w.-]*(?:password|passwd|secret|token|api_?key)[\w-]*)\s*=\s*([^"'\s#]{12,})\s*(?:#.*)?$"""
DOCUMENTATION_KEY = r"(?i)(^|[._-])(example|docs?)([._-]|$)"
PLACEHOLDER = r"(?i)example|placeholder|changeme|change_me|your[_-]|xxxx|dummy|<.*>|\$\{|\{\{"
LINE_CAP, QUALITY_CAP = 25, 40
JS = ("javascript", "typescript")


def _word(pattern: str) -> str:
    """A pattern whose \\w and \\b know letters beyond ASCII, as the rules' patterns do."""
    return "(?U)" + pattern


def _rlike(c: Column, pattern: str) -> Column:
    return c.rlike(_word(pattern))


# A hit has the columns repo, path, language, line, text and code (its raw and its blanked line), before (up to four raw
# lines above it) and ahead (up to six raw lines from it on).

def _ahead(span: int) -> Column:
    return F.array_join(F.slice("ahead", 1, span), "\n")


def _around() -> Column:
    """Three lines above to three below."""
    n = F.size("before")
    return F.array_join(F.concat(F.slice("before", F.greatest(n - 2, F.lit(1)), F.lit(3)), F.slice("ahead", 1, 4)), "\n")


def built(expression: Column) -> Column:
    return reduce(lambda a, b: a | b, [_rlike(expression, pattern) for pattern in BUILT])


def tainted(expression: Column) -> Column:
    return _rlike(expression, REQUEST)


def tainted_local(expression: Column) -> Column:
    """Whether a name that the expression interpolates is assigned from a request in the four raw lines before."""
    groups = [F.regexp_extract_all(expression, F.lit(_word(INTERPOLATED)), F.lit(g)) for g in range(1, 6)]
    names = F.array_distinct(F.filter(F.flatten(F.array(*groups)), lambda n: n != ""))
    statement = lambda n, row: F.regexp_substr(row, F.concat(F.lit(r"(?U)\b"), n, F.lit(r"\s*=(?!=).*$")))
    assigned = lambda n, row: F.coalesce(tainted(F.regexp_replace(statement(n, row), r"^\w+\s*=", "")), F.lit(False))
    return F.exists(names, lambda n: F.exists("before", lambda row: assigned(n, row)))


def _found(severity: str | Column, confidence: str | Column, key: Column | None = None) -> Column:
    plain = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(plain(severity).alias("severity"), plain(confidence).alias("confidence"), (F.lit(None).cast("string") if key is None else key).alias("key"))


def _graded(expression: Column, proven: Column, otherwise: str = "medium") -> Column:
    """Severity and confidence by whether a request reaches the expression."""
    return _found(F.when(proven, "critical").otherwise(otherwise), F.when(proven, "high").otherwise("medium"))


def _literal() -> Column:
    """Lines that hold more than a comment."""
    return F.trim(F.col("code")) != ""


def _by_language(python: str, other: str) -> Column:
    return F.when(F.col("language") == "python", _rlike(F.col("code"), python)).otherwise(_rlike(F.col("code"), other))


def sql_injection() -> Column:
    window, expression = _around(), _ahead(3)
    holds = _literal() & _rlike(F.col("text"), SQL_KEYWORD) & _rlike(window, SQL_SINK) & ~(_rlike(window, PARAMETERISED) & ~tainted(window)) & built(expression)
    return F.when(holds, _graded(expression, tainted(expression) | tainted_local(expression)))


def command_injection() -> Column:
    expression = _ahead(2)
    call = F.regexp_extract(F.col("code"), _word(COMMAND_SINK), 0)
    argv = F.startswith(call, F.lit("spawn")) | F.startswith(call, F.lit("execFile"))
    holds = _rlike(F.col("code"), COMMAND_SINK) & (~argv | _rlike(expression, SHELL_OPTION)) & built(expression)
    return F.when(holds, _graded(expression, tainted(expression) | tainted_local(expression)))


def code_injection() -> Column:
    window = _ahead(2)
    return F.when(_by_language(EVAL_PY, EVAL_JS) & (tainted(window) | built(window)), _graded(window, tainted(window), "high"))


def path_traversal() -> Column:
    window = _ahead(2)
    return F.when(_by_language(PY_FILE_SINK, FILE_SINK) & tainted(window) & ~_rlike(window, PATH_GUARD), _found("high", "high"))


def request_forgery() -> Column:
    window = _ahead(2)
    return F.when(_rlike(F.col("code"), HTTP_SINK) & tainted(window) & ~_rlike(window, URL_ALLOWED), _found("high", "high"))


def weak_hash() -> Column:
    return F.when(_literal() & _rlike(F.col("text"), WEAK_HASH) & _rlike(_ahead(3), SECURITY_PURPOSE), _found("high", "medium"))


def weak_random() -> Column:
    return F.when(_rlike(F.col("code"), WEAK_RANDOM) & _rlike(F.col("code"), SECRET_TARGET), _found("high", "high"))


def permissive_cors() -> Column:
    return F.when(_literal() & _rlike(F.col("text"), CORS_ANY) & _rlike(_ahead(6), CORS_CREDENTIALS), _found("high", "high"))


def unverified_token() -> Column:
    window, marked = _ahead(2), _rlike(F.col("text"), JWT_UNVERIFIED)
    named = _rlike(F.col("text"), VERIFY_OFF) & _rlike(window, JWT_CONTEXT)
    return F.when(_literal() & (marked | named) & ~(_rlike(window, JWT_VERIFIED) & ~F.contains(window, F.lit("False"))), _found("critical", "high"))


def bare_except() -> Column:
    return F.when(_rlike(F.col("code"), r"^\s*except\s*:"), _found("low", "high"))


def shell_call() -> Column:
    direct, option = r"\bos\.(?:system|popen)\s*\(", _rlike(F.col("code"), r"\bshell\s*=\s*True\b")
    called = _rlike(F.col("code"), r"\b(?:subprocess\.\w+|os\.(?:system|popen))\s*\(")
    return F.when((option & called) | (~option & _rlike(F.col("code"), direct)), _found("medium", "medium"))


def unsafe_load() -> Column:
    label = F.when(_rlike(F.col("code"), r"\byaml\.load\s*\(") & ~F.contains(F.col("code"), F.lit("Loader=")), "yaml.load").when(_rlike(F.col("code"), r"\bpickle\.loads?\s*\("), "pickle.load").when(_rlike(F.col("code"), r"\bmarshal\.loads?\s*\("), "marshal.load")
    return F.when(label.isNotNull(), _found("high", "medium", F.concat_ws("|", F.col("path"), label, F.col("line").cast("string"))))


def todo_marker() -> Column:
    return F.when(_rlike(F.col("text"), TODO), _found("info", "high", F.lit("")))


def index_key() -> Column:
    return F.when(_rlike(F.col("code"), r"\bkey\s*=\s*\{\s*(?:index|idx|i)\s*\}"), _found("low", "medium"))


def inner_html() -> Column:
    return F.when(F.contains(F.col("code"), F.lit("dangerouslySetInnerHTML")), _found("medium", "low"))


def hardcoded_secret() -> Column:
    """Provider tokens anywhere, and assignments of high entropy outside tests, quoted or in environment files; placeholders and keys of documentation are left alone."""
    env = F.lower(name_of(F.col("path"))).rlike(r"^\.env|\.env$")
    test = F.col("path").rlike(TEST_PATH) | F.lower("path").rlike("(^|/)(certs?|test[^/]*)/")
    quoted, plain = _rlike(F.col("text"), ASSIGNED), env & _rlike(F.col("text"), ENV_ASSIGNED)
    kind, token = None, []
    for k, pattern in SECRET_KINDS.items():
        holds = F.col("text").rlike(pattern)
        kind = F.when(holds, k) if kind is None else kind.when(holds, k)
        token.append(F.nullif(F.regexp_extract(F.col("text"), pattern, 1), F.lit("")))
    part = lambda group: F.when(quoted, F.regexp_extract(F.col("text"), _word(ASSIGNED), group)).otherwise(F.regexp_extract(F.col("text"), _word(ENV_ASSIGNED), group))
    value = F.coalesce(*token, part(2))
    # what is said about a value counts, not what else stands on its line
    told = ~F.lower(value).contains("example") & ~part(1).rlike(DOCUMENTATION_KEY)
    random = ~value.rlike(PLACEHOLDER) & ~value.rlike(r"[(\[].*[)\]]|^process\.|^os\.") & (entropy(value) >= 3.0)
    known = kind.isNotNull()
    softened = test & kind.isin("private key", "web token")
    severity, confidence = F.when(known, "critical").otherwise("high"), F.when(softened | ~known, "medium").otherwise("high")
    return F.when((known | quoted | plain) & told & (known | (~test & random)), _found(severity, confidence))


def _own(*languages: str) -> Column:
    """Files in these languages that are neither tests nor vendored."""
    return F.col("language").isin(*languages) & ~F.col("path").rlike(TEST_PATH) & ~F.col("path").rlike(VENDOR_PATH)


def _python(tests: bool) -> Column:
    """Python files, with or without tests."""
    return (F.col("language") == "python") if tests else (F.col("language") == "python") & ~F.col("path").rlike(PYTHON_TEST_PATH)


def _jsx() -> Column:
    """Files in these languages with markup, by suffix or by what they import."""
    return F.col("language").isin(*JS) & (F.col("path").rlike(r"\.[jt]sx$") | F.exists("raw", lambda r: F.contains(r, F.lit("React")) | F.contains(r, F.lit("from 'react'")) | F.contains(r, F.lit('from "react"'))))


# Fixed value: the order in which a Python project's manifest is looked for.
PYTHON_MANIFESTS = ("requirements.txt", "pyproject.toml")


def python_manifest(files: DataFrame) -> DataFrame:
    """(repo, path): of each repository the manifest that comes first in the order of preference, and of two alike the first by path."""
    order = F.array_position(F.array(*map(F.lit, PYTHON_MANIFESTS)), F.lower(name_of(F.col("path"))))
    ranked = files.select("repo", "path", order.alias("order")).where("order > 0")
    return ranked.groupBy("repo").agg(F.min_by("path", F.struct("order", F.split("path", "/"))).alias("path"))


def _secrets_scope() -> Column:
    return ~F.lower(name_of(F.col("path"))).rlike(r"\.(example|sample|template)$") & ~F.col("path").rlike(VENDOR_PATH)


# What a rule finds in a whole file: (line, severity, confidence, key, measure), or null.
def _in_file(line: Column, severity: str | Column, confidence: str, key: Column | None = None, measure: Column | None = None) -> Column:
    none = lambda t: F.lit(None).cast(t)
    return F.struct(line.cast("int").alias("line"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.lit(confidence).alias("confidence"), (none("string") if key is None else key).alias("key"), (none("int") if measure is None else measure.cast("int")).alias("measure"))


def long_file(least: int = 600, very: int = 1000) -> Column:
    n = F.size("raw")
    return F.when(n > least, _in_file(F.lit(1), F.when(n > very, "medium").otherwise("low"), "high", F.col("path"), n))


def loose_types() -> Column:
    text = F.array_join("raw", "\n")
    has = F.contains(text, F.lit('"strict"'))
    off = has & ~F.contains(F.translate(text, "'", '"'), F.lit('"strict": true'))
    line = F.when(has, F.array_position(F.transform("raw", lambda r: F.contains(r, F.lit('"strict"'))), True)).otherwise(1)
    return F.when((F.lower(name_of(F.col("path"))) == "tsconfig.json") & (F.size("raw") > 0) & (off | ~has), _in_file(line, "medium", "high"))


def _react_versions() -> tuple[Column, Column, Column]:
    """What a manifest declares of react and react-dom, and the first line that names the latter."""
    shape = "struct<dependencies:map<string,string>,devDependencies:map<string,string>>"
    declared = F.from_json(F.array_join("raw", "\n"), shape)
    spec = lambda name: F.coalesce(declared["devDependencies"][name], declared["dependencies"][name])
    line = F.greatest(F.array_position(F.transform("raw", lambda r: F.contains(r, F.lit('"react-dom"'))), True), F.lit(1))
    return spec("react"), spec("react-dom"), line


def react_mismatch() -> Column:
    """Manifests that declare react and react-dom at different major versions; those that name no release are left alone."""
    react, dom, line = _react_versions()
    return F.when((name_of(F.col("path")) == "package.json") & (major(coerced(react)) != major(coerced(dom))), _in_file(line, "high", "high"))


def locked_react_mismatch(files: DataFrame, locked: DataFrame) -> DataFrame:
    """(repo, path, line) of the same over files (repo, path, raw), where a version that a lock file gives, locked (repo, name, version), goes before the declared range."""
    react, dom, line = _react_versions()
    both = files.where(name_of(F.col("path")) == "package.json").select("repo", "path", react.alias("react"), dom.alias("dom"), line.cast("int").alias("line")).dropna(subset=["react", "dom"])
    held = locked.groupBy("repo").agg(*[F.max(F.when(F.col("name") == name, F.col("version"))).alias(f"locked_{c}") for name, c in (("react", "react"), ("react-dom", "dom"))])
    both = both.join(held, "repo", "left")
    return both.where(major(F.coalesce("locked_react", coerced(F.col("react")))) != major(F.coalesce("locked_dom", coerced(F.col("dom"))))).select("repo", "path", "line")


Kernel = Callable[[list[str], str, int], list[tuple[int, str | None, int | None]]]


def _defaults(code: list[str], language: str, least: int) -> list[tuple]:
    return [(n, name, None) for n, name in kernels.mutable_defaults(code)]


def _unkeyed(code: list[str], language: str, least: int) -> list[tuple]:
    return [(n, None, None) for n in kernels.unkeyed_lists(code)]


def _long_functions(code: list[str], language: str, least: int) -> list[tuple]:
    return kernels.long_functions(code, language, least) if len(code) >= least else []


def _nesting(code: list[str], language: str, least: int) -> list[tuple]:
    depth, line = kernels.deepest(code) if sum(c.count("{") for c in code) >= least else (0, 0)
    return [(line, None, depth)] if depth >= least else []


@dataclass(frozen=True)
class Rule:
    """scope: files that the rule reads. One of: judge, what it finds in a hit, with literals of which each such line has
    one, in lower case; kernel, (line, name, measure) of what it finds in a file's code, whose level is severity and
    confidence; whole, what it finds in a file. first: only the first line of a file; cap: see `capped`."""

    id: str
    category: str
    gate: str
    scope: Callable[[], Column]
    judge: Callable[[], Column] | None = None
    literals: tuple[str, ...] = ()
    kernel: Kernel | None = None
    least: int = 0
    level: tuple[str, str] = ("medium", "medium")
    whole: Callable[[], Column] | None = None
    first: bool = False
    cap: int | None = None

    @property
    def reads_code(self) -> bool:
        return self.whole is None and self.id not in ("quality/todo-markers", "security/hardcoded-secret")


_EITHER = "is_node or is_python"
_ANY, _WEB = (lambda: F.lit(True)), (lambda: _own(*JS, "python"))
_PY, _PY_OWN = (lambda: _python(True)), (lambda: _python(False))
RULES = (
    Rule("dep/react-dom-mismatch", "dependencies", "is_node", _ANY, whole=react_mismatch),
    Rule("config/ts-not-strict", "configuration", "has_typescript", _ANY, whole=loose_types),
    Rule("python/mutable-default-argument", "correctness", "is_python", _PY, kernel=_defaults, level=("medium", "high"), cap=LINE_CAP),
    Rule("python/bare-except", "correctness", "is_python", _PY, bare_except, ("except",), cap=LINE_CAP),
    Rule("python/subprocess-shell", "security", "is_python", _PY_OWN, shell_call, ("shell", "os.system", "os.popen"), cap=LINE_CAP),
    Rule("python/unsafe-deserialisation", "security", "is_python", _PY_OWN, unsafe_load, ("yaml.load", "pickle.load", "marshal.load"), cap=LINE_CAP),
    Rule("quality/long-file", "metric", "true", _ANY, whole=long_file),
    Rule("quality/long-function", "quality", "true", lambda: F.col("language").isin(*JS, "python", "go", "java", "ruby"), kernel=_long_functions, least=80, level=("low", "medium"), cap=QUALITY_CAP),
    Rule("quality/deep-nesting", "metric", "true", lambda: F.col("language").isin(*JS, "go", "java"), kernel=_nesting, least=5, level=("low", "medium"), cap=QUALITY_CAP),
    Rule("quality/todo-markers", "metric", "true", _ANY, todo_marker, ("todo", "fixme", "hack", "xxx")),
    Rule("react/missing-list-key", "correctness", "is_react", _jsx, kernel=_unkeyed, level=("medium", "medium")),
    Rule("react/array-index-key", "correctness", "is_react", _jsx, index_key, ("key",)),
    Rule("react/dangerously-set-inner-html", "security", "is_react", _jsx, inner_html, ("dangerouslysetinnerhtml",)),
    Rule("security/sql-injection", "security", _EITHER, _WEB, sql_injection, ("select", "insert", "update", "delete", "drop", "union"), first=True, cap=LINE_CAP),
    Rule("security/command-injection", "security", "is_node", lambda: _own(*JS), command_injection, ("exec", "spawn"), first=True, cap=LINE_CAP),
    Rule("security/code-injection", "security", _EITHER, _WEB, code_injection, ("eval", "exec", "function"), first=True, cap=LINE_CAP),
    Rule("security/path-traversal", "security", _EITHER, _WEB, path_traversal, ("readfile", "writefile", "createreadstream", "createwritestream", "unlink", "sendfile", "open", "path"), first=True, cap=LINE_CAP),
    Rule("security/ssrf", "security", _EITHER, _WEB, request_forgery, ("fetch", "axios", "got", "superagent", "requests", "urlopen", "httpx"), first=True, cap=LINE_CAP),
    Rule("security/weak-hash", "security", _EITHER, _WEB, weak_hash, ("createhash", "hashlib"), cap=LINE_CAP),
    Rule("security/insecure-random", "security", _EITHER, _WEB, weak_random, ("random",), cap=LINE_CAP),
    Rule("security/permissive-cors", "security", _EITHER, _WEB, permissive_cors, ("origin",), cap=LINE_CAP),
    Rule("security/jwt-unverified", "security", _EITHER, _WEB, unverified_token, ("jwt", "jsonwebtoken", "verify", "algorithm"), cap=LINE_CAP),
    Rule("security/hardcoded-secret", "secret", "true", _secrets_scope, hardcoded_secret, ("akia", "asia", "private key", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "eyj", "password", "passwd", "secret", "token", "api_key", "apikey")),
)
#: Rules that a repository has one finding of, with so many hits at least.
TODO_LEAST = 10

_HIT = "struct<line:int,marks:bigint,rule:int,name:string,measure:int>"
# Letters beyond ASCII that are another case of one in ASCII.
_FOLDED = str.maketrans({"\u212a": "k", "\u017f": "s"})


def _marked(lines: pa.ListArray, scope: np.ndarray, literals: ahocorasick.Automaton) -> tuple[np.ndarray, np.ndarray]:
    """(lines of the batch, their rules as bits): all literals in all lines are found in one pass over the text."""
    values = lines.flatten().cast(pa.large_string())
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bounds = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(values.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    text = raw.tobytes().lower().decode("utf-8", "replace")
    if len(text) < len(raw):  # places are counted in characters
        text = text.translate(_FOLDED)
        bounds = np.concatenate([[0], np.cumsum(raw & 0xC0 != 0x80)])[bounds]
    found = list(literals.iter(text))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends, marks = (np.array(c, np.int64) for c in zip(*found, strict=True))
    line = np.searchsorted(bounds, ends, "right") - 1
    starts = np.flatnonzero(np.diff(line, prepend=-1))
    line, marks = line[starts], np.bitwise_or.reduceat(marks, starts)
    row = np.repeat(np.arange(len(lines)), lines.value_lengths().to_numpy(zero_copy_only=False))
    marks &= scope[row[line]]
    return line[marks != 0], marks[marks != 0]


def _scanner(rules: Sequence[Rule]):
    """The batch function of `scan`. scope: the rules that read a file, as bits."""
    kernels_of = [(k, r) for k, r in enumerate(rules) if r.kernel]
    reads_code = sum(1 << k for k, r in enumerate(rules) if r.reads_code)
    of_literal: dict[str, int] = {}
    for k, r in enumerate(rules):
        for literal in r.literals:
            of_literal[literal] = of_literal.get(literal, 0) | 1 << k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        literals = ahocorasick.Automaton()
        for literal, bits in of_literal.items():
            literals.add_word(literal, bits)
        literals.make_automaton()
        for batch in batches:
            raw, languages, scope = batch.column("raw"), batch.column("language").to_pylist(), batch.column("scope").to_numpy()
            code, needed = raw, np.flatnonzero(scope & reads_code)
            if len(needed):
                blank = blank_rows(raw.take(pa.array(needed)), [languages[k] for k in needed])
                at = np.arange(len(scope))
                at[needed] = len(scope) + np.arange(len(needed))
                code = pa.concat_arrays([raw, blank]).take(pa.array(at))
            firsts = np.concatenate([[0], np.cumsum(raw.value_lengths().to_numpy(zero_copy_only=False))])
            hits: list[list[tuple]] = [[] for _ in languages]
            if of_literal:
                line, marks = _marked(raw, scope, literals)
                rows = np.searchsorted(firsts, line, "right") - 1
                for row, number, bits in zip(rows.tolist(), (line - firsts[rows] + 1).tolist(), marks.tolist(), strict=True):
                    hits[row].append((number, bits, -1, None, None))
            for row in np.flatnonzero(scope & sum(1 << k for k, _ in kernels_of)).tolist() if kernels_of else ():
                lines = code[row].as_py()
                for k, r in kernels_of:
                    if scope[row] >> k & 1:
                        hits[row] += [(n, 0, k, name, measure) for n, name, measure in r.kernel(lines, languages[row], r.least)]
            shape = pa.list_(pa.struct([("line", pa.int32()), ("marks", pa.int64()), ("rule", pa.int32()), ("name", pa.string()), ("measure", pa.int32())]))
            found = pa.array([[dict(zip(("line", "marks", "rule", "name", "measure"), h, strict=True)) for h in x] for x in hits], shape)
            yield pa.RecordBatch.from_arrays([*batch.columns, code, found], names=[*batch.schema.names, "code", "hits"])

    return run


def scan(files: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """All that the rules find in files (repo, path, language, raw), before gates and caps: repo, path, rule (its place in
    `rules`), line, severity, confidence, key, measure. Files are read once; no text is shuffled."""
    files = files.select("repo", "path", "language", "raw")
    bits = [F.when(F.coalesce(r.scope(), F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(rules) if not r.whole]
    scoped = files.withColumn("scope", reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0)).cast("long"))
    extra = [T.StructField("code", T.ArrayType(T.StringType())), T.StructField("hits", T.ArrayType(T._parse_datatype_string(_HIT)))]
    scanned = scoped.mapInArrow(_scanner(rules), T.StructType([*scoped.schema.fields, *extra]))
    nothing = {"text": "string", "code": "string", "before": "array<string>", "ahead": "array<string>", "severity": "string", "confidence": "string", "key": "string"}
    none = lambda *names: [F.lit(None).cast(nothing[n]).alias(n) for n in names]
    of_line = lambda c, h: F.element_at(F.col(c), h["line"]).alias("text" if c == "raw" else c)
    around = lambda h: [F.slice("raw", F.greatest(h["line"] - 4, F.lit(1)), F.least(h["line"] - 1, F.lit(4))).alias("before"), F.slice("raw", h["line"], F.lit(6)).alias("ahead")]
    names = [h.split(":")[0] for h in _HIT[7:-1].split(",")]
    hits = F.transform("hits", lambda h: F.struct(*[h[n].alias(n) for n in names], of_line("raw", h), of_line("code", h), *around(h), *none("severity", "confidence", "key")))
    whole = []
    for k, r in enumerate(rules):
        if r.whole:
            f = F.coalesce(r.whole())
            whole.append(F.when(f.isNotNull(), F.struct(f["line"].alias("line"), F.lit(0).cast("long").alias("marks"), F.lit(k).alias("rule"), F.lit(None).cast("string").alias("name"), f["measure"].alias("measure"), *none("text", "code", "before", "ahead"), f["severity"].alias("severity"), f["confidence"].alias("confidence"), f["key"].alias("key"))))
    every = F.concat(hits, F.array_compact(F.array(*whole))) if whole else hits
    hit = scanned.select("repo", "path", "language", F.explode(every).alias("h")).select("repo", "path", "language", "h.*")
    judged = [F.when((F.col("marks").bitwiseAND(F.lit(1 << k)) != 0), F.struct(F.lit(k).alias("rule"), r.judge().alias("f"))) for k, r in enumerate(rules) if r.judge]
    # a line is judged by the rules that it is marked with; what kernels and whole files give is found already
    ready = F.array(F.struct(F.col("rule"), F.struct("severity", "confidence", "key").alias("f")))
    levels = [F.when(F.col("rule") == k, _found(*r.level, _kernel_key(r))) for k, r in enumerate(rules) if r.kernel]
    if levels:
        ready = F.array(F.struct(F.col("rule"), F.coalesce(*levels, F.struct("severity", "confidence", "key")).alias("f")))
    results = F.when(F.col("rule") >= 0, ready)
    if judged:
        results = results.otherwise(F.filter(F.array_compact(F.array(*judged)), lambda x: x["f"].isNotNull()))
    return hit.select("repo", "path", "line", "measure", F.explode(results).alias("r")).select("repo", "path", "line", "measure", "r.rule", "r.f.severity", "r.f.confidence", "r.f.key")


def _kernel_key(rule: Rule) -> Column | None:
    if rule.id == "react/missing-list-key":
        return None
    return F.col("path") if rule.id == "quality/deep-nesting" else F.concat_ws("|", "path", "name")


def capped(hits: DataFrame, caps: Column, most: int = QUALITY_CAP) -> DataFrame:
    """Of each repository and rule files in order of their path's parts, until those before hold `caps` findings; the
    last may go over; all where the cap is null. A file holds one finding at least, so only the first `most` of them can
    be among those, and no task sees more."""
    parts = F.split("path", "/")
    per_file = hits.groupBy("repo", "rule", "path").agg(F.count("*").alias("n")).withColumn("parts", parts)
    order = Window.partitionBy("repo", "rule").orderBy("parts")
    near = per_file.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    keep = near.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < caps).select("repo", "rule", "path")
    return hits.where(caps.isNull()).unionByName(hits.where(caps.isNotNull()).join(keep, ["repo", "rule", "path"], "left_semi"))


def run_rules(files: DataFrame, facts: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Findings of the rules in files (repo, path, language, raw) of repositories where their gates hold.

    What the scan finds is written: gates, first lines, counts and caps work on that alone."""
    gates = F.filter(F.array(*[F.when(F.expr(r.gate), F.lit(k)) for k, r in enumerate(rules)]), lambda k: k.isNotNull())
    gated = scan(files, rules).join(facts.select("repo", gates.alias("open")), "repo").where(F.array_contains("open", F.col("rule"))).drop("open")
    found = written(gated, "found")
    of = lambda *ids: F.col("rule").isin([k for k, r in enumerate(rules) if r.id in ids] or [-1])
    one, rest = F.col("rule").isin([k for k, r in enumerate(rules) if r.first] or [-1]), F.split("path", "/")
    columns = ["repo", "rule", "path", "line", "severity", "confidence", "key", "measure"]
    first = found.where(one).groupBy("repo", "rule", "path").agg(F.min_by(F.struct("line", "severity", "confidence", "key", "measure"), "line").alias("h")).select("repo", "rule", "path", "h.*")
    todo = found.where(of("quality/todo-markers")).groupBy("repo", "rule").agg(F.count("*").cast("int").alias("measure"), F.min_by(F.struct("path", "line"), F.struct(rest, F.col("line"))).alias("f"), F.first("severity").alias("severity"), F.first("confidence").alias("confidence")).where(F.col("measure") >= TODO_LEAST)
    todo = todo.select("repo", "rule", "f.path", "f.line", "severity", "confidence", F.lit("").alias("key"), "measure")
    longest = found.where(of("quality/long-file")).withColumn("k", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("measure"), rest))).where(F.col("k") <= QUALITY_CAP)
    others = found.where(~one & ~of("quality/todo-markers", "quality/long-file")).select(*columns).unionByName(first.select(*columns))
    caps = F.get(F.array(*[F.lit(r.cap).cast("int") for r in rules]), F.col("rule"))
    kept = capped(others, caps).unionByName(todo.select(*columns)).unionByName(longest.select(*columns))
    rule_id, category = (F.get(F.array(*[F.lit(v) for v in values]), F.col("rule")) for values in ([r.id for r in rules], [r.category for r in rules]))
    return kept.select("repo", rule_id.alias("rule_id"), category.alias("category"), "severity", "confidence", F.col("path").alias("file"), F.col("line").cast("int").alias("line"), fingerprint(rule_id, F.col("path"), F.col("line"), F.col("key")).alias("fingerprint"))


def repository_rules(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Findings about what a repository lacks: (repo, rule_id, severity, confidence)."""
    name = F.lower(name_of(F.col("path")))
    section = name.isin("pyproject.toml", "setup.cfg", "tox.ini") & F.coalesce(F.lower("text").rlike(LINTER_SECTIONS), F.lit(False))
    found = files.groupBy("repo").agg(F.bool_or(name.isin(*LINTER_FILES)).alias("node_linter"), F.bool_or(name.isin(*PYTHON_LINTER_FILES) | section).alias("python_linter"), F.bool_or(name == ".env").alias("env"), F.max(F.when(name == ".gitignore", F.coalesce("text", F.lit("")))).alias("ignore"))
    all_ = facts.join(found, "repo")
    ignored = F.coalesce(F.col("ignore").rlike(r"(?m)^\s*/?(\.env\*?|\*\.env|\.env\.\*)\s*$"), F.lit(False))
    missing = {
        "config/no-linter": ((F.col("is_node") & ~F.col("node_linter")) | (~F.col("is_node") & F.col("is_python") & ~F.col("python_linter")), "low", "high"),
        "config/no-tests": (~F.col("has_tests"), "medium", "medium"),
        "config/no-ci": (~F.col("has_ci"), "low", "medium"),
        "config/no-readme": (~F.col("has_readme"), "low", "high"),
        "dep/no-lockfile": (F.col("is_node") & ~F.col("has_lockfile"), "medium", "high"),
        "security/env-not-ignored": (F.col("env") & ~ignored, "high", "high"),
    }
    rows = F.array(*[F.when(c, F.struct(F.lit(k).alias("rule_id"), F.lit(s).alias("severity"), F.lit(conf).alias("confidence"))) for k, (c, s, conf) in missing.items()])
    return all_.select("repo", F.inline(F.array_compact(rows)))

"""Code: comments and strings blanked in documents and pages, and the extents of what stands in files made from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.functions import text
from findlake.functions.blanking import with_code, with_code_by_pieces
from findlake.operators import extents
from findlake.plans import bindings as b
from findlake.plans import corpus
from findlake.registry import query

#: Lines of a piece of a page.
PIECE = 2

# A text as tokens of one regular expression, where the library composes an automaton: strings and comments run to their
# end or that of the text, and an escape takes one character, but for a line's end.
_STRINGS = {q: rf"{q}(?:\\[^\n]|\\\n|[^{q}\\])*" for q in "\"'`"}
_OPEN = "|".join(rf"{s}(?:{q}|\\?\z)" for q, s in _STRINGS.items())
_CLOSED = "|".join(s + q for q, s in _STRINGS.items())
_SLASHED = r"/\*(?s:.*?)(?:\*/|\z)|//[^\n]*|" + _OPEN + r"""|[^"'`/]+|/"""
_HASHED = r"#[^\n]*|" + _OPEN + r"""|[^"'`#]+"""


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_INSIDE = r"regexp_replace(regexp_replace(regexp_replace({0}, '\\[^\n]', '  ', 'g'), '\\', '  ', 'g'), '[^\n]', ' ', 'g')"
_BLANKED = (
    r"CASE WHEN (hashed AND k[1] = '#') OR (NOT hashed AND (k[1:2] = '//' OR k[1:2] = '/*')) THEN regexp_replace(k, '[^\n]', ' ', 'g') "
    rf"""WHEN k[1] NOT IN ('"', '''', '`') THEN k WHEN regexp_full_match(k, {_sql(_CLOSED)}) THEN concat(k[1], {_INSIDE.format("k[2:length(k) - 1]")}, k[1]) ELSE concat(k[1], {_INSIDE.format("k[2:]")}) END"""
)
_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _code(table: str, key: str, column: str) -> str:
    return f"""cut AS (SELECT {key} AS k0, regexp_split_to_array({column}, '{_END}') AS p, {key} % 2 = 0 AS hashed FROM {table}), raws AS (SELECT k0, hashed, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS raw FROM cut),
joined AS (SELECT k0, hashed, len(raw) AS lines, array_to_string(raw, chr(10)) AS t FROM raws),
tokens AS (SELECT k0, hashed, lines, CASE WHEN hashed THEN regexp_extract_all(t, {_sql(_HASHED)}) ELSE regexp_extract_all(t, {_sql(_SLASHED)}) END AS ks FROM joined),
code AS (SELECT k0, lines, array_to_string(list_transform(ks, lambda k: {_BLANKED}), '') AS code FROM tokens)"""


def _lines_of(spark: SparkSession, sf_dir: str, table: str, key: str, column: str) -> DataFrame:
    """Texts of a table by their key, those of even keys as Python and the others as JavaScript."""
    t = b.table(spark, sf_dir, table)
    return text.with_raw(t.select(F.col(key), F.when(F.col(key) % 2 == 0, "python").otherwise("javascript").alias("language"), F.col(column).alias("text")))


@query("f020_blanked_documents", f"WITH {_code('documents', 'doc_id', 'text')} SELECT k0 AS doc_id, lines, md5(code) AS code FROM code")
def blanked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document with comments and strings as spaces."""
    code = with_code(_lines_of(spark, sf_dir, "documents", "doc_id", "text"))
    return code.select("doc_id", F.size("raw").cast("long").alias("lines"), F.md5(F.array_join("code", "\n")).alias("code"))


@query(
    "f020_blanked_pages",
    f"WITH {_code('pages', 'page_id', 'html')}, split AS (SELECT k0, string_split(code, chr(10)) AS c FROM code WHERE lines > 0) SELECT k0 AS page_id, CAST(i AS INT) AS piece, CAST(i * {PIECE} + 1 AS INT) AS first_line, md5(array_to_string(c[i * {PIECE} + 1:(i + 1) * {PIECE}], chr(10))) AS code FROM (SELECT k0, c, unnest(range(0, (len(c) + {PIECE - 1}) // {PIECE})) AS i FROM split) x",
)
def blanked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages blanked in pieces of a few lines, each from the state that the pieces before it leave."""
    pieces = with_code_by_pieces(_lines_of(spark, sf_dir, "pages", "page_id", "html").where(F.size("raw") > 0), ["page_id"], PIECE)
    return pieces.select("page_id", "piece", "first_line", F.md5(F.array_join("code", "\n")).alias("code"))


# What each line does by its place in corpus.WEB_LINES and corpus.PYTHON_LINES.
_FILES = """raw AS (SELECT l_orderkey AS repo, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CAST(trunc(l_quantity) AS INT)) AS n, l_partkey AS k, CAST(l_partkey % 8 AS INT) AS p, l_orderkey % 2 = 0 AS py FROM lineitem),
said AS (SELECT *, CASE WHEN py THEN 0 ELSE [1, 1, 1, -1, -1, 0, 0, 0][p + 1] END AS brace, CASE WHEN py THEN 0 ELSE [1, 1, 1, -1, -1, 2, 0, -2][p + 1] END AS bracket, CASE WHEN py THEN [1, 0, -1, 0, 0, 0, 0, 0][p + 1] ELSE 0 END AS round,
  CASE WHEN py THEN [1, 0, 1, 1, 1, 0, 1, 1][p + 1] ELSE [1, 1, 1, 0, 0, 1, 0, 0][p + 1] END AS logic, count(*) OVER (PARTITION BY repo) AS n_lines FROM raw),
l AS (SELECT *, sum(brace) OVER o AS braces, sum(bracket) OVER o AS brackets, sum(round) OVER o AS rounds, sum(logic) OVER o AS logics FROM said WINDOW o AS (PARTITION BY repo ORDER BY n))"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.with_lines(corpus.order_files(spark, sf_dir))


def _ends(balance: str, which: str, most: str) -> str:
    """The first line from a start on at which a balance is back, of `most` lines, else the last of them."""
    return f"SELECT a.repo, a.n, a.k, a.p, coalesce(min(b.n), least(a.n + {most} - 1, a.n_lines)) AS last FROM l a LEFT JOIN l b ON a.repo = b.repo AND b.n BETWEEN a.n AND a.n + {most} - 1 AND b.{balance}s <= a.{balance}s - a.{balance} WHERE {which} GROUP BY a.repo, a.n, a.k, a.p, a.n_lines"


@query("f029_callback_extents", f"WITH {_FILES}, e AS ({_ends('bracket', 'NOT a.py AND a.p = 5', '40')}) SELECT repo, CAST(n AS INT) AS line, CAST(last AS INT) AS last, EXISTS (SELECT 1 FROM l WHERE l.repo = e.repo AND l.n BETWEEN e.n AND e.last AND l.p = 6) AS unkeyed FROM e")
def callback_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the callbacks of lists end, and whether they make an element without a key."""
    return extents.callback_extents(_files(spark, sf_dir).where("language = 'javascript'")).select("repo", "line", "last", "unkeyed")


@query(
    "f030_function_extents",
    f"""WITH {_FILES}, web AS ({_ends("brace", "NOT a.py AND a.p = 0", "a.n_lines")}), py AS (SELECT a.repo, a.n, a.k, a.p, coalesce(min(b.n) - 1, a.n_lines) AS last FROM l a LEFT JOIN l b ON a.repo = b.repo AND b.n > a.n AND b.p IN (0, 2, 4, 6) WHERE a.py AND a.p IN (0, 4) GROUP BY a.repo, a.n, a.k, a.p, a.n_lines),
e AS (SELECT * FROM web UNION ALL SELECT * FROM py) SELECT e.repo, CAST(e.n AS INT) AS line, concat(CASE e.p WHEN 4 THEN 'g' ELSE 'f' END, e.k) AS name, CAST(last AS INT) AS last, CAST(sum(l.logic) AS INT) AS logic FROM e JOIN l ON l.repo = e.repo AND l.n BETWEEN e.n AND e.last GROUP BY e.repo, e.n, e.p, e.k, last""",
)
def function_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where functions end, by braces or by indentation, and how many lines of logic they have."""
    return extents.function_extents(_files(spark, sf_dir)).select("repo", "line", "name", "last", "logic")


@query("f031_logic_counts", f"WITH {_FILES} SELECT repo, CAST(sum(logic) AS INT) AS n FROM l GROUP BY repo")
def logic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each file that are neither blank nor markup."""
    return extents.logic_counts(_files(spark, sf_dir)).select("repo", "n")


@query(
    "f032_nesting",
    f"""WITH RECURSIVE {_FILES}, walk AS (SELECT repo, CAST(0 AS BIGINT) AS n, '' AS stack FROM l WHERE NOT py GROUP BY repo UNION ALL SELECT l.repo, l.n, CASE WHEN p IN (0, 2) THEN concat(stack, 'o') WHEN p = 1 THEN concat(stack, 'c') WHEN p IN (3, 4) THEN left(stack, greatest(length(stack) - 1, 0)) ELSE stack END FROM walk JOIN l ON l.repo = walk.repo AND l.n = walk.n + 1),
d AS (SELECT repo, n, length(replace(stack, 'o', '')) AS depth FROM walk), m AS (SELECT repo, max(depth) AS depth FROM d GROUP BY repo)
SELECT repo, CAST(depth AS INT) AS depth, CAST(CASE WHEN depth = 0 THEN 0 ELSE min(n) END AS INT) AS line FROM d JOIN m USING (repo, depth) GROUP BY repo, depth""",
)
def nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest nesting of control flow, where a brace of an object is none."""
    return extents.nesting(_files(spark, sf_dir).where("language = 'javascript'")).select("repo", "depth", "line")


@query("f033_signatures", f"WITH {_FILES}, e AS ({_ends('round', 'a.py AND a.p IN (0, 4)', '21')}) SELECT repo, CAST(n AS INT) AS line, concat(CASE p WHEN 4 THEN 'g' ELSE 'f' END, k) AS name, CAST(last AS INT) AS last, EXISTS (SELECT 1 FROM l WHERE l.repo = e.repo AND l.n BETWEEN e.n AND e.last AND l.p IN (1, 4)) AS shared FROM e")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where signatures end that may go over several lines, and whether a default in them is shared by calls."""
    return extents.signature_extents(_files(spark, sf_dir).where("language = 'python'")).select("repo", "line", "name", "last", "shared")

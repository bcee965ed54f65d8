"""Files and lines: documents and pages as sources, parts as paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findlake.functions import paths, text
from findlake.operators import rules
from findlake.plans import bindings as b
from findlake.registry import query

_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_LINES = f"{b.FILES}, parts AS (SELECT *, regexp_split_to_array(text, '{_END}') AS p FROM files), lines AS (SELECT * EXCLUDE (p), CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS raw FROM parts)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.files(spark, sf_dir).withColumn("raw", text.split_lines(F.col("text")))


@query("f001_directory_order", f"WITH {b.FILES} SELECT repo, path, row_number() OVER (PARTITION BY repo, length(path) ORDER BY string_split(path, '/')) AS place FROM files")
def directory_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of paths by their parts, among paths of a length in a repository."""
    w = Window.partitionBy("repo", F.length("path")).orderBy(F.split("path", "/"))
    return b.files(spark, sf_dir).select("repo", "path", F.row_number().over(w).alias("place"))


@query("f002_text_decode", "SELECT page_id, CASE WHEN octet_length(encode(html)) <= 1000000 THEN length(html) END AS characters, octet_length(encode(html)) AS size FROM pages")
def text_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes as text: null where too large or binary, replacement characters where malformed."""
    from findlake.sources.archives import decoded

    pages = b.table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return pages.select("page_id", F.length(decoded(F.col("content"))).cast("long").alias("characters"), F.octet_length("content").cast("long").alias("size"))


_MEMBERS = "members AS (SELECT page_id AS seq, page_id // 50 AS archive, octet_length(encode(html)) AS size, CASE page_id % 8 WHEN 0 THEN concat('/etc/p', page_id) WHEN 1 THEN concat('a/../../p', page_id) WHEN 2 THEN concat('C:\\x\\', page_id) WHEN 3 THEN concat(repeat('d/', 30), page_id) ELSE concat('src/p', page_id, '.html') END AS name FROM pages)"
_REASON = "CASE WHEN starts_with(name, '/') THEN 'absolute_path' WHEN regexp_matches(name, '^[A-Za-z]:') THEN 'drive_letter' WHEN list_contains(string_split(name, '/'), '..') THEN 'traversal' WHEN len(string_split(name, '/')) > 24 THEN 'too_deep' WHEN size > 20000 THEN 'too_large' END"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as members of archives of fifty, with hostile names among them."""
    p = F.col("page_id")
    name = F.when(p % 8 == 0, F.concat(F.lit("/etc/p"), p)).when(p % 8 == 1, F.concat(F.lit("a/../../p"), p)).when(p % 8 == 2, F.concat(F.lit("C:\\x\\"), p)).when(p % 8 == 3, F.concat(F.lit("d/" * 30), p)).otherwise(F.concat(F.lit("src/p"), p, F.lit(".html")))
    return b.table(spark, sf_dir, "pages").select(p.alias("seq"), F.floor(p / 50).alias("archive"), F.octet_length(F.encode("html", "UTF-8")).cast("long").alias("size"), name.alias("name"))


_READ = f"""r AS (SELECT archive, row_number() OVER (PARTITION BY archive ORDER BY seq) - 1 AS seq, name, size, html, {_REASON.replace("WHEN size > 20000 THEN 'too_large' ", "")} AS refused FROM members JOIN pages ON page_id = members.seq WHERE size > 0),
u AS (SELECT *, coalesce(sum(CASE WHEN refused IS NULL AND size <= 20000 THEN size END) OVER (PARTITION BY archive ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM r),
s AS (SELECT archive, min(seq) AS stop FROM u WHERE refused IS NULL AND used + CASE WHEN size <= 20000 THEN size ELSE least(size, 65536) END > 60000 GROUP BY archive)
SELECT archive, CAST(seq AS INT) AS seq, CASE WHEN stop = seq THEN NULL ELSE name END AS name, CASE WHEN stop = seq OR size > 20000 THEN NULL ELSE size END AS size, CASE WHEN stop = seq THEN 'total_bytes' ELSE coalesce(refused, CASE WHEN size > 20000 THEN 'too_large' END) END AS reason, CASE WHEN stop = seq OR size > 20000 THEN NULL ELSE md5(html) END AS content FROM u LEFT JOIN s USING (archive) WHERE stop IS NULL OR seq <= stop"""


def _archives_of_pages(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Pages written to archives of fifty, and read from them within limits, a few members a task."""
    from uuid import uuid4

    from findlake.sources.archive_source import archive_members, write_archives
    from findlake.sources.archives import Limits
    from findlake.sources.folders import shared_folder

    pages = b.table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.encode("html", "UTF-8").alias("content"))
    members = _members(spark, sf_dir).join(pages, "seq").where("size > 0")
    folder = f"{shared_folder(spark)}/archives-{uuid4().hex}"
    write_archives(members, folder, kind).write.format("noop").mode("overwrite").save()
    found = archive_members(spark, folder, "*.zip" if kind == "zip" else "*.tar.gz", Limits(member=20_000, total=60_000), per_task=10_000)
    number = F.regexp_extract("archive", r"([0-9]+)\.[a-z.]+$", 1).cast("long")
    return found.select(number.alias("archive"), "seq", "name", "size", "reason", F.md5("content").alias("content"))


@query("f003_zip_members", f"WITH {_MEMBERS}, {_READ}")
def zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archives_of_pages(spark, sf_dir, "zip")


@query("f004_tar_members", f"WITH {_MEMBERS}, {_READ}")
def tar_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archives_of_pages(spark, sf_dir, "tar")


@query("f005_path_containment", f"WITH {_MEMBERS} SELECT seq, name, {_REASON} AS reason FROM (SELECT * REPLACE (0 AS size) FROM members)")
def path_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).select("seq", "name", paths.rejection(F.col("name")).alias("reason"))


@query("f006_byte_budget", f"WITH {_MEMBERS}, r AS (SELECT *, {_REASON} AS reason FROM members), s AS (SELECT *, coalesce(sum(CASE WHEN reason IS NULL THEN size END) OVER (PARTITION BY archive ORDER BY seq), 0) AS total FROM r) SELECT archive, seq, reason, CAST(total AS BIGINT) AS total, total > 150000 AS aborted FROM s")
def byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    from findlake.sources.archives import budgeted

    return budgeted(_members(spark, sf_dir), per_file=20_000, total=150_000).select("archive", "seq", "reason", "total", "aborted")


@query("f007_ratio_guard", f"WITH {_MEMBERS} SELECT archive, CAST(sum(size) AS BIGINT) AS extracted, round(sum(size)::DOUBLE / (count(*) * 4000)::DOUBLE, 2) AS ratio, round(sum(size)::DOUBLE / (count(*) * 4000)::DOUBLE, 2) > 1.5 AS unsafe FROM members GROUP BY archive")
def ratio_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted over stored size (a member is taken to be stored in 4000 bytes)."""
    ratio = F.round(F.sum("size") / (F.count("*") * 4000).cast("double"), 2)
    return _members(spark, sf_dir).groupBy("archive").agg(F.sum("size").alias("extracted"), ratio.alias("ratio")).withColumn("unsafe", F.col("ratio") > 1.5)


@query("f008_rejections", f"WITH {_MEMBERS} SELECT archive, reason, count(*) AS n FROM (SELECT archive, {_REASON} AS reason FROM members) r WHERE reason IS NOT NULL GROUP BY archive, reason")
def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from findlake.sources.archives import budgeted

    return budgeted(_members(spark, sf_dir), per_file=20_000, total=150_000).where("reason is not null").groupBy("archive", "reason").agg(F.count("*").alias("n"))


@query("f010_url_parse", r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS section, regexp_extract(url, '/([0-9]+)', 1) AS number, regexp_extract(url, '[?]([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages")
def url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = lambda p: F.regexp_extract("url", p, 1)
    return b.table(spark, sf_dir, "pages").select("page_id", u("^https?://([^/]+)/").alias("host"), u("^https?://[^/]+/([a-z]+)/").alias("section"), u("/([0-9]+)").alias("number"), u("[?]([^#]*)").alias("query"), u("#(.*)$").alias("fragment"))


@query("f023_line_count", f"WITH {_LINES} SELECT repo, path, len(raw) AS lines FROM lines")
def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("repo", "path", F.size("raw").alias("lines"))


@query("f024_viewer_line_count", f"WITH {b.FILES} SELECT path, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS lines FROM files")
def viewer_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.files(spark, sf_dir).select("path", text.viewer_line_count(F.col("text")).alias("lines"))


def _context_query(name: str, before: int, after: int, doc: str) -> None:
    at = "(1 + n % len(raw))"

    @query(name, f"WITH {_LINES}, placed AS (SELECT *, CAST(string_split(path, '/')[2] AS BIGINT) AS n FROM lines) SELECT path, CAST(greatest({at} - {before}, 1) AS INT) AS start_line, array_to_string(raw[greatest({at} - {before}, 1):{at} + {after}], chr(10)) AS snippet FROM placed WHERE len(raw) > 0")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = (F.split_part("path", F.lit("/"), F.lit(2)).cast("long") % F.size("raw") + 1).cast("int")
        lines = _lines(spark, sf_dir).where(F.size("raw") > 0).withColumn("line", at)
        return lines.select("path", F.greatest(F.col("line") - before, F.lit(1)).alias("start_line"), text.context(F.col("raw"), F.col("line"), before, after).alias("snippet"))

    run.__doc__ = doc


_context_query("f025_snippet", 3, 3, "Three lines around a line of each document.")
_context_query("f026_forward_context", 0, 2, "A line of each document and the two after it.")
_context_query("f027_around_context", 3, 3, "Three lines before and after.")
_context_query("f028_wide_window", 80, 79, "Up to 160 lines around a line.")


@query("f031_logic_lines", f"WITH {_LINES} SELECT path, len(list_filter(raw, lambda x: trim(x) <> '' AND NOT regexp_matches(trim(x), '^[A-Z][a-z]+[.]$'))) AS n FROM lines")
def logic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are neither blank nor of one kind (here: a single word)."""
    return _lines(spark, sf_dir).select("path", F.size(F.filter("raw", lambda x: (F.trim(x) != "") & ~F.trim(x).rlike("^[A-Z][a-z]+[.]$"))).alias("n"))


@query("f021_code_lines")
def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines of the derived source files with comments and strings blanked (a state machine over each file: no SQL)."""
    from findlake.plans.corpus import source_files

    files = text.with_lines(source_files(spark, sf_dir))
    return files.select("repo", "path", F.posexplode("code").alias("line", "code")).withColumn("line", F.col("line") + 1)


@query("f022_literal_lines")
def literal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines of the derived source files that hold more than a comment."""
    from findlake.plans.corpus import source_files

    files = text.with_lines(source_files(spark, sf_dir))
    rows = files.select("repo", "path", F.posexplode(F.arrays_zip("raw", "code")).alias("line", "z")).where(F.trim("z.code") != "")
    return rows.select("repo", "path", (F.col("line") + 1).alias("line"), F.col("z.raw").alias("raw"))


_SUFFIXES = (".py", ".ts", ".min.js", ".d.ts", ".png", ".lock", ".JSX", ".md", "", ".tar.gz", ".go", ".map")
_DIRS = ("src", "node_modules/x", "vendor", "app/tests", "static/js", "lib", "build", "a/site-packages")
_NAMES = ("Dockerfile", "package.json", "Cargo.lock", "test_a.py", "a.spec.ts", "latest_contest.ts")


def _path_column(key: Column) -> Column:
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    file = F.when(key % 5 == 0, pick(_NAMES, F.floor(key / 5) % len(_NAMES))).otherwise(F.concat(F.lit("p"), key, pick(_SUFFIXES, F.floor(key / 7) % len(_SUFFIXES))))
    return F.concat(pick(_DIRS, key % len(_DIRS)), F.lit("/"), file)


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_PATHS = f"paths AS (SELECT p_partkey AS key, concat({_list(_DIRS)}[1 + p_partkey % {len(_DIRS)}], '/', CASE WHEN p_partkey % 5 = 0 THEN {_list(_NAMES)}[1 + (p_partkey // 5) % {len(_NAMES)}] ELSE concat('p', p_partkey, {_list(_SUFFIXES)}[1 + (p_partkey // 7) % {len(_SUFFIXES)}]) END) AS path FROM part)"
_LOW = "lower(string_split(path, '/')[-1])"
_SUFFIX_SQL = f"regexp_extract({_LOW}, '^.+([.][^.]+)$', 1)"
_SKIPPED = f"len(list_intersect(string_split(path, '/')[:-2], {_list(paths.SKIP_DIRECTORIES)})) > 0"
_LANG = "CASE WHEN " + f"list_contains({_list(paths.NAMED)}, {_LOW}) THEN {_LOW} WHEN {_LOW} LIKE '%.min.js' OR {_LOW} LIKE '%.min.css' OR {_LOW} LIKE '%.d.ts' THEN NULL " + " ".join(f"WHEN {_SUFFIX_SQL} = '{suffix}' THEN '{lang}'" for suffix, lang in paths.LANGUAGES.items()) + " END"


def _part_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), _path_column(F.col("p_partkey")).alias("path"))


def _path_query(name: str, sql: str, value: Callable[[Column], Column], doc: str) -> None:
    @query(name, f"WITH {_PATHS} SELECT key, path, {sql} AS value FROM paths")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _part_paths(spark, sf_dir).select("key", "path", value(F.col("path")).alias("value"))

    run.__doc__ = doc


_TEST = r"(?i)(^|/)(tests?|testing|__tests__|spec|e2e|fixtures?)/|(^|/)(test_[^/]+|[^/]+_test)\.py$|\.(test|spec)\.[jt]sx?$"
_path_query("f034_language_detect", _LANG, paths.language, "Language of a path by name or suffix.")
_path_query("f035_should_read", f"NOT ({_SKIPPED}) AND (list_contains({_list(paths.ALWAYS_READ)}, {_LOW}) OR NOT (list_contains({_list(paths.SKIP_SUFFIXES)}, {_SUFFIX_SQL}) OR {_LOW} LIKE '%.min.js' OR {_LOW} LIKE '%.min.css'))", paths.should_read, "Whether a file is read.")
_path_query("f036_should_analyse", f"NOT ({_SKIPPED}) AND coalesce(list_contains({_list(paths.ANALYSABLE)}, {_LANG}), false)", paths.should_analyse, "Whether rules run on a file.")
_path_query("f038_test_path", f"regexp_matches(path, '{_TEST}')", lambda p: p.rlike(rules.TEST_PATH), "Whether a path is a test.")
_path_query("f039_vendored_path", f"regexp_matches(path, '{rules.VENDOR_PATH}')", lambda p: p.rlike(rules.VENDOR_PATH), "Whether a path is third-party or built.")
_path_query("f044_safe_path", "CASE WHEN key % 3 = 0 THEN NULL ELSE path END", lambda p: paths.safe_path(F.concat(F.when(F.col("key") % 3 == 0, "../").when(F.col("key") % 3 == 1, "./").otherwise(" "), p)), "A path as asked for, or null if it leaves the tree.")


@query(
    "f001_directory_scan",
    f"WITH {_PATHS}, files AS (SELECT key, concat('k', key % 7, '/', path) AS path, concat('part ', key, chr(10)) AS text FROM paths WHERE key % 11 <> 0), r AS (SELECT * FROM files WHERE NOT ({_SKIPPED}) AND (list_contains({_list(paths.ALWAYS_READ)}, {_LOW}) OR NOT (list_contains({_list(paths.SKIP_SUFFIXES)}, {_SUFFIX_SQL}) OR {_LOW} LIKE '%.min.js' OR {_LOW} LIKE '%.min.css'))),"
    f" one AS (SELECT path, max(key) AS key FROM r GROUP BY path) SELECT row_number() OVER (ORDER BY string_split(path, '/')) AS place, path, length(concat('part ', key, chr(10))) AS size, {_LANG} AS language, coalesce(list_contains({_list(paths.ANALYSABLE)}, {_LANG}), false) AS analysable, concat('part ', key, chr(10)) AS text FROM one",
)
def directory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files made from parts in folders of many kinds, with links among them, scanned in two phases."""
    from uuid import uuid4

    from findlake.sources.directories import scan_directory, write_files
    from findlake.sources.folders import shared_folder

    key = F.col("key")
    files = _part_paths(spark, sf_dir).where(key % 11 != 0).select(F.concat(F.lit("k"), key % 7, F.lit("/"), "path").alias("path"), key.alias("key"))
    files = files.repartition(4 * spark.sparkContext.defaultParallelism, "path")  # few bytes, but a file each: they are written by many tasks
    files = files.groupBy("path").agg(F.max("key").alias("key")).select("path", F.encode(F.concat(F.lit("part "), "key", F.lit("\n")), "UTF-8").alias("content"))
    folder = f"{shared_folder(spark)}/directory-{uuid4().hex}"
    write_files(files, folder).write.format("noop").mode("overwrite").save()
    return scan_directory(spark, folder)


@query("f037_snapshot_views", f"WITH {_PATHS}, l AS (SELECT path, {_LANG} AS language FROM paths) SELECT coalesce(language, 'none') AS language, count(*) AS files, count_if(lower(string_split(path, '/')[-1]) = 'package.json') AS manifests FROM l GROUP BY ALL")
def snapshot_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by language, and those with a name in any case."""
    p = _part_paths(spark, sf_dir).withColumn("language", F.coalesce(paths.language(F.col("path")), F.lit("none")))
    return p.groupBy("language").agg(F.count("*").alias("files"), F.count_if(F.lower(F.element_at(F.split("path", "/"), -1)) == "package.json").alias("manifests"))


@query("f064_language_stats", f"WITH {_LINES}, s AS (SELECT repo, language, count(*) AS files, CAST(sum(len(raw)) AS BIGINT) AS lines FROM lines GROUP BY ALL), t AS (SELECT *, round_even(lines / sum(lines) OVER (PARTITION BY repo), 4) AS share, row_number() OVER (PARTITION BY repo ORDER BY lines DESC, language) AS place FROM s) SELECT repo, language, files, lines, share, place FROM t WHERE place <= 12")
def language_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _lines(spark, sf_dir).groupBy("repo", "language").agg(F.count("*").alias("files"), F.sum(F.size("raw")).alias("lines"))
    w = Window.partitionBy("repo")
    t = s.withColumns({"share": F.bround(F.col("lines") / F.sum("lines").over(w), 4), "place": F.row_number().over(w.orderBy(F.desc("lines"), "language"))})
    return t.where("place <= 12")


@query("f055_file_tree", f"WITH {b.FILES}, hits AS (SELECT concat(source, '/', doc_id) AS path, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE toxic = 1 GROUP BY ALL) SELECT repo, path, size, language, coalesce(n, 0) AS findings FROM files LEFT JOIN hits USING (path) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path) <= 5000")
def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 5000 files of each repository by path, with their numbers of findings."""
    d = b.table(spark, sf_dir, "documents").select("doc_id", "source")
    hits = b.table(spark, sf_dir, "labels").where("toxic = 1").join(d, "doc_id").groupBy(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path")).agg(F.count("*").alias("n"))
    tree = b.files(spark, sf_dir).drop("text").join(hits, "path", "left")
    place = F.row_number().over(Window.partitionBy("repo").orderBy("path"))
    return tree.withColumn("place", place).where("place <= 5000").select("repo", "path", "size", "language", F.coalesce("n", F.lit(0)).alias("findings"))


@query("f056_file_findings", f"WITH {b.FINDINGS} SELECT file, repo, line, rule_id, severity, row_number() OVER (PARTITION BY file ORDER BY line, rule_id, repo) AS place FROM findings")
def file_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every file, numbered from its top."""
    place = F.row_number().over(Window.partitionBy("file").orderBy("line", "rule_id", "repo"))
    return all_file_findings(spark, sf_dir).withColumn("place", place)


@query("f056_all_file_findings", f"WITH {b.FINDINGS} SELECT file, repo, line, rule_id, severity FROM findings")
def all_file_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every file."""
    return b.findings(spark, sf_dir).select("file", "repo", "line", "rule_id", "severity")


@query("f068_storage_aggregates", f"WITH {b.FILES} SELECT repo, CAST(coalesce(sum(size), 0) AS BIGINT) AS stored, min(path) AS first_path, count(*) AS files FROM files GROUP BY repo")
def storage_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.files(spark, sf_dir).groupBy("repo").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("stored"), F.min("path").alias("first_path"), F.count("*").alias("files"))


@query("f107_clamp_context", f"WITH {b.FILES}, c AS (SELECT path, text, string_split(text, chr(10)) AS l FROM files), s AS (SELECT *, array_to_string(l[1:5], chr(10)) AS short FROM c) SELECT path, CASE WHEN len(l) > 5 OR length(short) > 300 THEN concat(short[1:300], chr(10), '… (truncated)') ELSE text END AS text FROM s")
def clamp_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.files(spark, sf_dir).select("path", text.clamp(F.col("text"), 5, 300).alias("text"))


@query("f109_entropy", f"WITH {b.FILES}, v AS (SELECT path, regexp_extract(text, 'token = \"([^\"]+)\"', 1) AS value FROM files), c AS (SELECT path, value, unnest(string_split(value, '')) AS ch FROM v WHERE value <> ''), n AS (SELECT path, value, ch, count(*) AS k FROM c GROUP BY ALL) SELECT path, concat(value[1:3], '…', value[-2:], ' (', length(value), ' characters)') AS shown, round(-sum(k / length(value) * log2(k / length(value))), 6) AS bits FROM n GROUP BY ALL")
def secret_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of each document's token value, which is only shown redacted."""
    v = b.files(spark, sf_dir).withColumn("value", F.regexp_extract("text", 'token = "([^"]+)"', 1)).where("value <> ''")
    return v.select("path", text.redacted(F.col("value")).alias("shown"), F.round(text.entropy(F.col("value")), 6).alias("bits"))


@query("f108_output_validation", "SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'empty' WHEN length(text) > 2000 THEN 'too_long' WHEN NOT contains(text, '. ') THEN 'no_sentence' WHEN regexp_matches(text, '[*]{3}') THEN 'markup' END AS reason FROM conversations WHERE role = 'assistant'")
def output_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    reason = F.when(F.trim(t) == "", "empty").when(F.length(t) > 2000, "too_long").when(~F.contains(t, F.lit(". ")), "no_sentence").when(t.rlike("[*]{3}"), "markup")
    return b.table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", reason.alias("reason"))


@query(
    "f104_join_summaries",
    "WITH s AS (SELECT conv_id, array_to_string(list_transform((list(trim(text) ORDER BY turn, text) FILTER (trim(text) <> ''))[1:3], lambda t: CASE WHEN t[-1] IN ('.', '!', '?') THEN t ELSE concat(t, '.') END), ' ') AS joined FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN length(joined) > 400 THEN concat(rtrim(regexp_replace(joined[1:400], ' [^ ]*$', ''), ',;:'), '…') ELSE coalesce(joined, '') END AS summary FROM s",
)
def join_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three turns that say something, with their sentences ended, cut at a word."""
    from findlake.operators.guards import joined_summaries

    turns = b.table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", joined_summaries(F.transform("t", lambda x: x["text"])).alias("summary"))

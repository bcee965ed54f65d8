"""Dependencies and advisories: parts as packages, line items as declarations, suppliers as advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.functions import versions as v
from findlake.operators import dependencies as deps
from findlake.plans import bindings as b
from findlake.registry import query

_DECLARED = """declared AS (SELECT l_orderkey AS repo, concat('Pkg_', l_partkey % 300) AS name,
  min(CASE l_linenumber % 5 WHEN 0 THEN concat('^', CAST(l_quantity AS INT), '.2.', l_linenumber) WHEN 1 THEN concat('==', CAST(l_quantity AS INT), '.0.1') WHEN 2 THEN 'workspace:*' WHEN 3 THEN concat('>=', CAST(l_quantity AS INT), '.1') ELSE concat('~', CAST(l_quantity AS INT), '.4.0') END) AS spec FROM lineitem GROUP BY ALL)"""
_LOCKED = """locked AS (SELECT DISTINCT l_orderkey AS repo, concat('Pkg_', l_suppkey % 300) AS name, concat(l_suppkey % 9, '.', l_suppkey % 300, '.0') AS version FROM lineitem WHERE l_linenumber < 3)"""
_LOCKED += ", locks AS (SELECT repo, name, max(version) AS version FROM locked GROUP BY ALL)"
_ADVISORIES = """advisories AS (SELECT CASE s_suppkey % 2 WHEN 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, concat('Pkg_', s_suppkey * 7 % 300) AS name, concat('ADV-', s_suppkey) AS id,
  (['critical','high','medium','low','info'])[1 + s_nationkey % 5] AS severity, CASE WHEN s_suppkey % 3 > 0 THEN concat(s_suppkey, '.0.0') END AS fixed FROM supplier)"""


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, k = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber") % 5
    spec = F.when(k == 0, F.concat(F.lit("^"), q, F.lit(".2."), "l_linenumber")).when(k == 1, F.concat(F.lit("=="), q, F.lit(".0.1"))).when(k == 2, "workspace:*").when(k == 3, F.concat(F.lit(">="), q, F.lit(".1"))).otherwise(F.concat(F.lit("~"), q, F.lit(".4.0")))
    return b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("repo"), F.concat(F.lit("Pkg_"), F.col("l_partkey") % 300).alias("name")).agg(F.min(spec).alias("spec"))


def _locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_suppkey")
    version = F.concat_ws(".", (s % 9).cast("string"), (s % 300).cast("string"), F.lit("0"))
    return b.table(spark, sf_dir, "lineitem").where("l_linenumber < 3").groupBy(F.col("l_orderkey").alias("repo"), F.concat(F.lit("Pkg_"), s % 300).alias("name")).agg(F.max(version).alias("version"))


def _advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return b.table(spark, sf_dir, "supplier").select(
        F.when(s % 2 == 0, "npm").otherwise("pypi").alias("ecosystem"),
        F.concat(F.lit("Pkg_"), s * 7 % 300).alias("name"),
        F.concat(F.lit("ADV-"), s).alias("id"),
        F.element_at(F.array(*[F.lit(x) for x in ("critical", "high", "medium", "low", "info")]), (F.col("s_nationkey") % 5 + 1).cast("int")).alias("severity"),
        F.when(s % 3 > 0, F.concat(s, F.lit(".0.0"))).alias("fixed"),
    )


_COERCED = r"CASE WHEN regexp_matches(spec, '^(?:workspace|git|file|link|https?|npm):|^\*$|/') THEN NULL ELSE nullif(regexp_extract(spec, '(\d+\.\d+\.\d+)', 1), '') END"
_EXACT = r"nullif(regexp_extract(trim(spec), '^==\s*(\d+(?:\.\d+)*(?:\.[A-Za-z0-9]+)?)$', 1), '')"


@query("f048_lockfile_join", f"WITH {_DECLARED}, {_LOCKED} SELECT repo, name, spec, coalesce(version, {_COERCED}) AS resolved, version IS NOT NULL AS from_lockfile FROM declared LEFT JOIN locks USING (repo, name)")
def lockfile_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.resolved(_declared(spark, sf_dir), _locked(spark, sf_dir)).select("repo", "name", "spec", "resolved", "from_lockfile")


@query("f049_declared_or_locked", f"WITH {_DECLARED}, {_LOCKED} SELECT repo, name, spec IS NOT NULL AS direct, coalesce(version, {_EXACT}) AS resolved FROM declared FULL JOIN locks USING (repo, name)")
def declared_or_locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.merged(_declared(spark, sf_dir), _locked(spark, sf_dir), v.exact_version(F.col("spec")))


@query("f051_transitive", f"WITH {_DECLARED}, {_LOCKED} SELECT repo, name, version FROM locks ANTI JOIN declared USING (repo, name)")
def transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.transitive(_declared(spark, sf_dir), _locked(spark, sf_dir)).select("repo", "name", "version")


_PACKAGES = f"{_DECLARED}, {_LOCKED}, {_ADVISORIES}, packages AS (SELECT repo, CASE repo % 2 WHEN 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, name, spec IS NOT NULL AS direct FROM declared FULL JOIN locks USING (repo, name))"
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = deps.merged(_declared(spark, sf_dir), _locked(spark, sf_dir), v.exact_version(F.col("spec")))
    return both.withColumn("ecosystem", F.when(F.col("repo") % 2 == 0, "npm").otherwise("pypi"))


@query("f063_vulnerability_rollup", f"WITH {_PACKAGES}, rolled AS (SELECT ecosystem, name, count(*) AS n, min({_RANK}) AS worst, list_sort(list(DISTINCT id)) AS ids, min_by(fixed, id) FILTER (fixed IS NOT NULL) AS fixed FROM advisories GROUP BY ALL) SELECT repo, ecosystem, name, n, (['critical','high','medium','low','info'])[1 + CASE WHEN direct THEN worst ELSE least(worst + 1, 4) END] AS severity, array_to_string(ids[1:6], ',') AS ids, fixed FROM packages JOIN rolled USING (ecosystem, name) WHERE direct OR worst <= 1")
def vulnerability_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.vulnerable(_packages(spark, sf_dir), _advisories(spark, sf_dir))


# Forty repositories that declare and lock up to nine hundred packages, and three ranges of advisories for each supplier.
_BY_VERSION = """lines AS (SELECT l_orderkey % 40 AS repo, l_linenumber AS k, l_partkey % 900 AS p, CAST(l_quantity AS INT) % 20 AS q, l_suppkey % 7 AS s FROM lineitem),
direct AS (SELECT repo, concat('pkg-', p) AS name, min(q) AS a, min(s) AS b, count(*) % 2 = 0 AS from_lockfile FROM lines WHERE k = 3 GROUP BY ALL),
locked AS (SELECT repo, concat('pkg-', p * 7 % 900) AS name, min(q) AS a, min(s) AS b, min(p) AS place FROM lines WHERE k < 3 GROUP BY ALL),
counted AS (SELECT repo, count(*) AS n FROM direct GROUP BY repo),
fill AS (SELECT repo, name, a, b, row_number() OVER (PARTITION BY repo ORDER BY place, name) AS k FROM locked ANTI JOIN direct USING (repo, name)),
asked AS (SELECT repo, name, a, b, true AS direct, from_lockfile FROM direct UNION ALL SELECT repo, name, a, b, false, true FROM fill LEFT JOIN counted USING (repo) WHERE k <= 400 - coalesce(n, 0)),
adv AS (SELECT concat('pkg-', (s_suppkey * 13 + j * 50) % 900) AS name, concat('ADV-', s_suppkey % 50, '-', j) AS id, (s_nationkey + j) % 5 AS rank, 3 * j AS since, CASE WHEN s_suppkey % 4 > 0 THEN 3 * j + 9 END AS until, CASE WHEN s_suppkey % 2 = 1 THEN concat('CVE-', s_suppkey % 30) END AS alias,
  CASE s_suppkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN repeat(concat('long text, of ', s_suppkey, '; '), 12) WHEN 2 THEN 'Stop!' ELSE concat('Problem ', s_suppkey % 9) END AS summary FROM supplier, (VALUES (0), (1), (2)) v(j)),
held AS (SELECT DISTINCT repo, name, direct, id, rank, until, alias, summary FROM asked JOIN adv USING (name) WHERE (since < a OR (since = a)) AND (until IS NULL OR a < until OR (a = until AND b < 2))),
one AS (SELECT repo, name, direct, id, min(rank) AS rank, min(CASE WHEN until IS NOT NULL THEN concat(until, '.2.0') END) AS fixed, min(summary) AS summary, min(alias) AS alias FROM held GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY repo, name ORDER BY id) AS k FROM one),
rolled AS (SELECT repo, name, direct, count(*) AS n, min(rank) FILTER (k <= 8) AS worst, min_by(fixed, k) FILTER (k <= 8 AND fixed IS NOT NULL) AS fixed,
  list(coalesce(alias, id) ORDER BY k) FILTER (k <= 8) AS names, list(trim(summary) ORDER BY k) FILTER (k <= 8 AND trim(summary) <> '') AS said, string_agg(concat('https://osv.dev/vulnerability/', id), ' ' ORDER BY k) FILTER (k <= 8) AS refs FROM numbered GROUP BY ALL),
texts AS (SELECT *, list_filter(names, lambda x, i: list_position(names, x) = i) AS shown, array_to_string(list_transform(coalesce(list_filter(said, lambda x, i: list_position(said, x) = i), [])[1:3], lambda t: CASE WHEN t[-1] IN ('.', '!', '?') THEN t ELSE concat(t, '.') END), ' ') AS text FROM rolled)"""


@query(
    "f063_advisories_by_version",
    f"""WITH {_BY_VERSION} SELECT repo, name, direct, n, (['critical','high','medium','low','info'])[1 + CASE WHEN direct THEN worst ELSE least(worst + 1, 4) END] AS severity, fixed, coalesce(refs, '') AS refs,
concat(array_to_string(shown[1:6], ', '), CASE WHEN direct THEN '' ELSE ' (pulled in transitively)' END, '. ', CASE WHEN text = '' THEN 'See the advisories for detail.' WHEN length(text) > 400 THEN concat(rtrim(regexp_replace(text[1:400], ' [^ ]*$', ''), ',;:'), '…') ELSE text END) AS description FROM texts WHERE direct OR worst <= 1""",
)
def advisories_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages at versions that advisories hold: direct ones, and transitive ones up to 400 of a repository, with what is said about them."""
    p, k = F.col("l_partkey") % 900, F.col("l_linenumber")
    lines = b.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 40).alias("repo"), k.alias("k"), p.alias("p"), (F.col("l_quantity").cast("int") % 20).alias("q"), (F.col("l_suppkey") % 7).alias("s"))
    version = lambda: F.concat_ws(".", F.min("q").cast("string"), F.min("s").cast("string"), F.lit("0"))
    direct = lines.where("k = 3").groupBy("repo", F.concat(F.lit("pkg-"), "p").alias("name")).agg(version().alias("version"), (F.count("*") % 2 == 0).alias("from_lockfile")).withColumn("ecosystem", F.lit("npm"))
    locked = lines.where("k < 3").groupBy("repo", F.concat(F.lit("pkg-"), F.col("p") * 7 % 900).alias("name")).agg(version().alias("version"), F.min("p").alias("place"))
    s, j = F.col("s_suppkey"), F.col("j")
    adv = b.table(spark, sf_dir, "supplier").withColumn("j", F.explode(F.array(*map(F.lit, range(3))))).select(
        F.lit("npm").alias("ecosystem"),
        F.concat(F.lit("pkg-"), (s * 13 + j * 50) % 900).alias("name"),
        F.concat(F.lit("ADV-"), s % 50, F.lit("-"), j).alias("id"),
        F.element_at(F.array(*[F.lit(x) for x in ("critical", "high", "medium", "low", "info")]), ((F.col("s_nationkey") + j) % 5 + 1).cast("int")).alias("severity"),
        F.concat(j * 3, F.lit(".0")).alias("introduced"),
        F.when(s % 4 > 0, F.concat(j * 3 + 9, F.lit(".2.0"))).alias("fixed"),
        F.when(s % 5 == 0, " ").when(s % 5 == 1, F.repeat(F.concat(F.lit("long text, of "), s, F.lit("; ")), 12)).when(s % 5 == 2, "Stop!").otherwise(F.concat(F.lit("Problem "), s % 9)).alias("summary"),
        F.when(s % 2 == 1, F.array(F.concat(F.lit("CVE-"), s % 30))).alias("aliases"),
    )
    found = deps.advised(deps.looked_up(direct, locked), adv)
    return found.select("repo", "name", "direct", "n", "severity", "fixed", F.array_join("references", " ").alias("refs"), "description")


@query("f050_vulnerability_ids", f"WITH {_PACKAGES}, a AS (SELECT ecosystem, name, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids FROM advisories GROUP BY ALL) SELECT repo, name, coalesce(ids, '') AS ids FROM packages LEFT JOIN a USING (ecosystem, name)")
def vulnerability_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _advisories(spark, sf_dir).groupBy("ecosystem", "name").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids"))
    return _packages(spark, sf_dir).join(a, ["ecosystem", "name"], "left").select("repo", "name", F.coalesce("ids", F.lit("")).alias("ids"))


@query("f018_advisory_lookup", f"WITH {_ADVISORIES}, p AS (SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, concat('Pkg_', p_partkey % 300) AS name FROM part) SELECT p_partkey, id FROM p JOIN advisories USING (ecosystem, name)")
def advisory_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    packages = b.table(spark, sf_dir, "part").select("p_partkey", F.when(p % 2 == 0, "npm").otherwise("pypi").alias("ecosystem"), F.concat(F.lit("Pkg_"), p % 300).alias("name"))
    return packages.join(_advisories(spark, sf_dir), ["ecosystem", "name"]).select("p_partkey", "id")


@query("f081_dependency_order", f"WITH {_PACKAGES}, a AS (SELECT DISTINCT ecosystem, name FROM advisories) SELECT repo, packages.name AS name, row_number() OVER (PARTITION BY repo ORDER BY a.name IS NULL, packages.name) AS place FROM packages LEFT JOIN a ON packages.ecosystem = a.ecosystem AND packages.name = a.name")
def dependency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vulnerable packages first, then by name."""
    from pyspark.sql import Window

    a = _advisories(spark, sf_dir).select("ecosystem", "name").distinct().withColumn("bad", F.lit(True))
    marked = _packages(spark, sf_dir).join(a, ["ecosystem", "name"], "left")
    return marked.select("repo", "name", F.row_number().over(Window.partitionBy("repo").orderBy(F.col("bad").isNull(), "name")).alias("place"))


@query("f092_normal_names", "SELECT p_partkey, lower(regexp_replace(replace(p_name, ' ', CASE p_partkey % 3 WHEN 0 THEN '_' WHEN 1 THEN '-.' ELSE '.' END), '[-_.]+', '-', 'g')) AS name FROM part")
def normal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    sep = F.when(F.col("p_partkey") % 3 == 0, "_").when(F.col("p_partkey") % 3 == 1, "-.").otherwise(".")
    return b.table(spark, sf_dir, "part").select("p_partkey", v.normal_name(F.replace("p_name", F.lit(" "), sep)).alias("name"))


@query("f093_exact_pins", f"WITH {_DECLARED} SELECT repo, name, {_EXACT} AS version FROM declared WHERE version IS NOT NULL")
def exact_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _declared(spark, sf_dir).select("repo", "name", v.exact_version(F.col("spec")).alias("version")).where("version is not null")


@query("f094_coerced_ranges", f"WITH {_DECLARED} SELECT repo, name, spec, {_COERCED} AS version FROM declared")
def coerced_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _declared(spark, sf_dir).select("repo", "name", "spec", v.coerced(F.col("spec")).alias("version"))


@query("f095_package_pair_mismatch", f"WITH {_DECLARED}, {_LOCKED}, r AS (SELECT repo, name, coalesce(version, {_COERCED}) AS resolved FROM declared LEFT JOIN locks USING (repo, name)) SELECT a.repo, a.name AS name, b.name AS other, split_part(a.resolved, '.', 1) AS major, split_part(b.resolved, '.', 1) AS other_major FROM r a JOIN r b ON a.repo = b.repo AND CAST(substr(b.name, 5) AS INT) = CAST(substr(a.name, 5) AS INT) + 1 WHERE split_part(a.resolved, '.', 1) <> split_part(b.resolved, '.', 1)")
def package_pair_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages that belong together (here: neighbours by number) with different major versions in a repository."""
    r = deps.resolved(_declared(spark, sf_dir), _locked(spark, sf_dir)).select("repo", "name", F.substring("name", 5, 9).cast("int").alias("n"), v.major(F.col("resolved")).alias("major"))
    o = r.select("repo", F.col("name").alias("other"), (F.col("n") - 1).alias("n"), F.col("major").alias("other_major"))
    return r.join(o, ["repo", "n"]).where("major <> other_major").select("repo", "name", "other", "major", "other_major")


@query("f095_major_versions", f"WITH {_LOCKED} SELECT split_part(version, '.', 1) AS major, count(*) AS packages FROM locks GROUP BY ALL")
def major_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _locked(spark, sf_dir).groupBy(v.major(F.col("version")).alias("major")).agg(F.count("*").alias("packages"))


_REQ_LINE = "concat(CASE l_linenumber WHEN 1 THEN '# ' WHEN 2 THEN '-r ' ELSE '' END, 'Some.Pkg_', l_partkey % 300, CASE l_linenumber % 3 WHEN 0 THEN '[extra]' ELSE '' END, ' >= ', CAST(l_quantity AS INT), '.0 ; python_version > \"3\"')"


@query("f096_requirements", rf"WITH r AS (SELECT l_orderkey AS repo, l_linenumber AS n, {_REQ_LINE} AS line FROM lineitem) SELECT repo, lower(regexp_replace(regexp_extract(line, '^\s*([A-Za-z0-9._-]+)', 1), '[-_.]+', '-', 'g')) AS name, trim(regexp_extract(line, '^\s*([A-Za-z0-9._-]+)\s*(?:\[[^\]]*\])?\s*([^;#]*)', 2)) AS spec FROM r WHERE NOT regexp_matches(line, '^\s*[-#]')")
def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    line = F.concat(F.when(n == 1, "# ").when(n == 2, "-r ").otherwise(""), F.lit("Some.Pkg_"), F.col("l_partkey") % 300, F.when(n % 3 == 0, "[extra]").otherwise(""), F.lit(" >= "), F.col("l_quantity").cast("int"), F.lit('.0 ; python_version > "3"'))
    return b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("repo"), v.requirement(line).alias("r")).where("r is not null").select("repo", "r.name", "r.spec")


_MANIFEST = """concat('{"dependencies":{', string_agg(concat('"', name, '":"', spec, '"'), ',' ORDER BY name), '}}')"""


@query("f100_manifest_rows", f"WITH {_DECLARED} SELECT repo, name, spec FROM declared")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations out of JSON manifests: each repository's are written to one, parsed, and exploded to rows."""
    d = _declared(spark, sf_dir)
    made = d.groupBy("repo").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("name", "spec"))).alias("dependencies"))).alias("manifest"))
    parsed = made.select("repo", F.from_json("manifest", "struct<dependencies:map<string,string>>").alias("m"))
    return parsed.select("repo", F.explode("m.dependencies").alias("name", "spec"))


_LOCK = """concat('{"packages":{"":{"version":"0"},"node_modules/outer/node_modules/pkg', p_partkey % 7, '":{"version":"', p_size, '.0.0"}},"dependencies":{"pkg', p_partkey % 5, '":{"version":"1.', p_partkey, '.0","dependencies":{"pkg', p_partkey % 7, '":{"version":"2.0.0"},"deep', p_partkey % 3, '":{"version":"3.0.0","dependencies":{"pkg', p_partkey % 11, '":{"version":"4.0.', p_partkey, '"},"deep', p_partkey % 3, '":{"version":"5.0.0"}}}}},"last":{"resolved":"x"}}}')"""


@query(
    "f101_lockfile_packages",
    f"""WITH RECURSIVE files AS (SELECT p_partkey AS repo, {_LOCK} AS text FROM part),
flat AS (SELECT repo, string_split(k, 'node_modules/')[-1] AS name, json_extract_string(text, concat('$.packages."', k, '".version')) AS version, [0] AS spot FROM (SELECT repo, text, unnest(json_keys(text, '$.packages')) AS k FROM files) WHERE contains(k, 'node_modules/')),
walk AS (SELECT repo, k AS name, json_extract(text, concat('$.dependencies."', k, '"')) AS node, [1, i] AS spot FROM (SELECT repo, text, unnest(json_keys(text, '$.dependencies')) AS k, generate_subscripts(json_keys(text, '$.dependencies'), 1) AS i FROM files)
  UNION ALL SELECT repo, k, json_extract(node, concat('$.dependencies."', k, '"')), list_append(spot, i) FROM (SELECT repo, node, spot, unnest(json_keys(node, '$.dependencies')) AS k, generate_subscripts(json_keys(node, '$.dependencies'), 1) AS i FROM walk WHERE json_exists(node, '$.dependencies'))),
every AS (SELECT * FROM flat UNION ALL SELECT repo, name, json_extract_string(node, '$.version'), spot FROM walk)
SELECT repo, name, min_by(version, spot) AS version FROM every WHERE version IS NOT NULL GROUP BY repo, name""",
)
def lockfile_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of lock files with a flat list and a nested one, each name as it is first met."""
    from findlake.functions.manifests import locked_packages

    # the table is narrow and may be a single split: it is dealt out before texts are made of it
    parts = b.table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    files = parts.select(F.col("p_partkey").alias("repo"), F.lit("package-lock.json").alias("path"), F.expr(_LOCK).alias("text"))
    return locked_packages(files).select("repo", "name", "version")


@query("f105_worst_severity", f"WITH {_ADVISORIES} SELECT ecosystem, name, (['critical','high','medium','low','info'])[1 + min({_RANK})] AS worst, (['critical','high','medium','low','info'])[1 + least(min({_RANK}) + 1, 4)] AS downgraded FROM advisories GROUP BY ALL")
def worst_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from findlake.operators.scoring import severity_rank
    from findlake.schemas import SEVERITIES

    names = F.array(*[F.lit(s) for s in SEVERITIES])
    worst = F.min(severity_rank())
    return _advisories(spark, sf_dir).groupBy("ecosystem", "name").agg(F.element_at(names, worst + 1).alias("worst"), F.element_at(names, F.least(worst + 1, F.lit(4)) + 1).alias("downgraded"))

"""Stores, table changes, guards and small scalar operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findlake.operators import rules, stores
from findlake.plans import bindings as b
from findlake.registry import query

_NEW = "changes AS (SELECT id + 0 AS id, created_at + INTERVAL 1 DAY AS created_at, owner_id, repository, truncated, custkey, size + 1 AS size FROM reports WHERE id % 4 = 0 UNION ALL SELECT id + 100000000, created_at, owner_id, repository, truncated, custkey, size FROM reports WHERE id % 50 = 1)"


@query("f011_report_upsert", f"WITH {b.REPORTS}, {_NEW} SELECT id, created_at, size FROM changes UNION ALL SELECT id, created_at, size FROM reports WHERE id % 4 <> 0")
def report_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = b.reports(spark, sf_dir)
    changed = r.where("id % 4 = 0").withColumns({"created_at": F.expr("created_at + interval '1' day"), "size": F.col("size") + 1})
    added = r.where("id % 50 = 1").withColumn("id", F.col("id") + 100_000_000)
    return stores.upsert(r, changed.union(added), ["id"]).select("id", "created_at", "size")


@query("f013_greedy_budget", f"WITH RECURSIVE {b.REPORTS}, o AS (SELECT custkey, id, size, row_number() OVER (PARTITION BY custkey ORDER BY created_at, id) AS k FROM reports), g AS (SELECT custkey, k, id, size, CASE WHEN size <= 900000 THEN size ELSE 0 END AS used, size <= 900000 AS kept FROM o WHERE k = 1 UNION ALL SELECT o.custkey, o.k, o.id, o.size, g.used + CASE WHEN g.used + o.size <= 900000 THEN o.size ELSE 0 END, g.used + o.size <= 900000 FROM g JOIN o ON o.custkey = g.custkey AND o.k = g.k + 1) SELECT custkey, id, size FROM g WHERE kept")
def greedy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of each customer that a budget of 900000 takes in order of time, passing over those that do not fit."""
    return stores.greedy(b.reports(spark, sf_dir), "custkey", "size", ["created_at", "id"], 900_000).select("custkey", "id", "size")


@query("f014_blob_prune", f"WITH {b.REPORTS}, u AS (SELECT owner_id, custkey, sum(size) AS size, min(created_at) AS age FROM reports WHERE owner_id IS NOT NULL GROUP BY ALL), m AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY owner_id ORDER BY age, custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER (PARTITION BY owner_id) AS total FROM u) SELECT owner_id, custkey, CAST(size AS BIGINT) AS size FROM m WHERE total - before > 20000000")
def blob_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each owner that go, oldest first, until 20 million are left."""
    return stores.evicted(b.reports(spark, sf_dir).where("owner_id is not null"), "owner_id", "custkey", "size", "created_at", 20_000_000)


@query("f016_markdown_comment", f"WITH {b.FINDINGS}, n AS (SELECT owner, fingerprint, title, min(file) AS file FROM findings WHERE severity = 'critical' GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY file, fingerprint) AS place, count(*) OVER (PARTITION BY owner) AS total FROM n) SELECT owner, concat('## ', max(total), ' new', chr(10), string_agg(concat('- ', title, ' in ', file), chr(10) ORDER BY place), CASE WHEN max(total) > 10 THEN concat(chr(10), '- +', max(total) - 10, ' more') ELSE '' END) AS comment FROM p WHERE place <= 10 GROUP BY owner")
def markdown_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comment for each customer: how many critical findings, the first ten, and how many more."""
    n = b.findings(spark, sf_dir).where("severity = 'critical'").groupBy("owner", "fingerprint", "title").agg(F.min("file").alias("file"))
    w = Window.partitionBy("owner")
    p = n.withColumns({"place": F.row_number().over(w.orderBy("file", "fingerprint")), "total": F.count("*").over(w)}).where("place <= 10")
    line = F.concat(F.lit("- "), "title", F.lit(" in "), "file")
    g = p.groupBy("owner").agg(F.max("total").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("t")))), lambda x: x["t"]), "\n").alias("lines"))
    more = F.when(F.col("total") > 10, F.concat(F.lit("\n- +"), F.col("total") - 10, F.lit(" more"))).otherwise("")
    return g.select("owner", F.concat(F.lit("## "), "total", F.lit(" new\n"), "lines", more).alias("comment"))


@query("f015_sarif_documents")
def sarif_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole exchange documents as JSON, one a repository; their parts are held against SQL in f015_sarif and in tests."""
    from findlake.sources.sarif import documents

    return documents(b.findings(spark, sf_dir))


_EXPRESSION = "concat(CASE doc_id % 6 WHEN 0 THEN '`a ${' WHEN 1 THEN 'f\"' WHEN 2 THEN '\"a\" + ' WHEN 3 THEN '\"%s\" % ' WHEN 4 THEN '\"a\".format(' ELSE '\"' END, CASE doc_id % 4 WHEN 0 THEN 'req.query.' WHEN 1 THEN 'request.args' WHEN 2 THEN 'user' ELSE 'urlparse' END, lang)"
_BUILT_SQL = "regexp_matches(e, '\\$\\{') OR regexp_matches(e, '[\"''`]\\s*\\+|\\+\\s*[\"''`]') OR regexp_matches(e, '\\bf[\"'']') OR regexp_matches(e, '[\"'']\\s*%\\s*[\\w(]|%s') OR regexp_matches(e, '[\"''][^\"'']*[\"'']\\s*\\.\\s*format\\s*\\(')"


@query("f040_built_and_tainted", f"WITH x AS (SELECT doc_id, {_EXPRESSION} AS e FROM documents) SELECT doc_id, {_BUILT_SQL} AS built, doc_id % 4 = 0 OR (doc_id % 4 = 1 AND false) AS tainted FROM x")
def built_and_tainted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an expression (made from each document's number) is assembled, and whether a request reaches it."""
    d = F.col("doc_id")
    form = F.when(d % 6 == 0, "`a ${").when(d % 6 == 1, 'f"').when(d % 6 == 2, '"a" + ').when(d % 6 == 3, '"%s" % ').when(d % 6 == 4, '"a".format(').otherwise('"')
    source = F.when(d % 4 == 0, "req.query.").when(d % 4 == 1, "request.args").when(d % 4 == 2, "user").otherwise("urlparse")
    e = F.concat(form, source, F.col("lang"))
    return b.table(spark, sf_dir, "documents").select("doc_id", rules.built(e).alias("built"), rules.tainted(e).alias("tainted"))


@query("f046_private_guard", f"WITH {b.REPORTS} SELECT id, CASE WHEN custkey % 3 = 0 AND owner_id IS NULL THEN 'refused' ELSE 'open' END AS verdict FROM reports")
def private_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when((F.col("custkey") % 3 == 0) & F.col("owner_id").isNull(), "refused").otherwise("open")
    return b.reports(spark, sf_dir).select("id", verdict.alias("verdict"))


@query("f052_positional_zip", "SELECT conv_id, q.turn AS turn, q.text AS question, a.text AS answer FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user') q JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant') a USING (conv_id, k)")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The i-th question with the i-th answer of each conversation; what one side has more of drops out."""
    c = b.table(spark, sf_dir, "conversations")
    numbered = lambda role, name: c.where(F.col("role") == role).select("conv_id", "turn", F.col("text").alias(name), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("k"))
    return numbered("user", "question").join(numbered("assistant", "answer").drop("turn"), ["conv_id", "k"]).select("conv_id", "turn", "question", "answer")


@query("f054_new_findings_lookup", f"WITH {b.FINDINGS}, p AS (SELECT owner, repo, lag(repo) OVER (PARTITION BY owner ORDER BY repo) AS before FROM (SELECT DISTINCT owner, repo FROM findings)) SELECT f.repo, f.fingerprint, f.rule_id FROM findings f JOIN p ON f.repo = p.repo WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM findings g WHERE g.repo = p.before AND g.rule_id = f.rule_id)")
def new_findings_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of rules that the report before did not have."""
    f = b.findings(spark, sf_dir)
    p = f.select("owner", "repo").distinct().withColumn("before", F.lag("repo").over(Window.partitionBy("owner").orderBy("repo"))).where("before is not null").drop("owner")
    held = f.select(F.col("repo").alias("before"), "rule_id").distinct()
    return f.join(p, "repo").join(held, ["before", "rule_id"], "left_anti").select("repo", "fingerprint", "rule_id")


@query("f058_report_with_owner", f"WITH {b.REPORTS} SELECT owner_id, c_name, count(*) AS reports, max(id) AS last FROM reports JOIN customer ON custkey = c_custkey GROUP BY ALL")
def report_with_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reports by their owner and customer; `f058_all_reports_with_owner` has a row for each."""
    return all_reports_with_owner(spark, sf_dir).groupBy("owner_id", "c_name").agg(F.count("*").alias("reports"), F.max("id").alias("last"))


@query("f058_all_reports_with_owner", f"WITH {b.REPORTS} SELECT id, owner_id, c_name FROM reports JOIN customer ON custkey = c_custkey")
def all_reports_with_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each report with its owner and the name of its customer."""
    c = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_name")
    return b.reports(spark, sf_dir).join(c, "custkey").select("id", "owner_id", "c_name")


@query("f057_candidate_changes", f"WITH {b.FINDINGS}, c AS (SELECT file, count(*) AS findings FROM findings GROUP BY file), h AS (SELECT concat('src/part', l_partkey, '.py') AS file, count(*) AS changes FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01' GROUP BY ALL) SELECT file, findings, changes FROM c JOIN h USING (file)")
def candidate_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = b.findings(spark, sf_dir).groupBy("file").agg(F.count("*").alias("findings"))
    h = b.table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz'2001-01-01 00:00:00'").groupBy(F.concat(F.lit("src/part"), "l_partkey", F.lit(".py")).alias("file")).agg(F.count("*").alias("changes"))
    return c.join(h, "file")


@query("f106_context_label", "SELECT doc_id, concat(source, '/', doc_id, ' (', CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE 'other' END, ')', CASE WHEN n_chars > 2000 THEN ', excerpt' ELSE '' END) AS label FROM documents")
def context_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.when(F.col("lang") == "en", "English").when(F.col("lang") == "de", "German").when(F.col("lang") == "fr", "French").otherwise("other")
    return b.table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id", F.lit(" ("), lang, F.lit(")"), F.when(F.col("n_chars") > 2000, ", excerpt").otherwise("")).alias("label"))


@query("f110_digests", "SELECT doc_id, substr(sha1(text), 1, 12) AS short, sha256(text) AS long FROM documents")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("text").cast("binary")
    return b.table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha1(raw), 1, 12).alias("short"), F.sha2(raw, 256).alias("long"))


@query("f111_base64", "SELECT doc_id, length(to_base64(encode(text))) AS encoded, sha256(text) AS back FROM documents")
def base64_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.table(spark, sf_dir, "documents").withColumn("e", F.base64(F.col("text").cast("binary")))
    plain = F.regexp_replace("e", r"\s", "")
    return d.select("doc_id", F.length(plain).cast("long").alias("encoded"), F.sha2(F.unbase64("e"), 256).alias("back"))


@query("f113_rounding", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 0) AS even, greatest(0, least(40, l_quantity)) AS clamped, round(sqrt(l_quantity), 6) AS root FROM lineitem")
def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.bround(q / 4, 0).alias("even"), F.greatest(F.lit(0.0), F.least(F.lit(40.0), q)).alias("clamped"), F.round(F.sqrt(q), 6).alias("root"))


_ACCEPTED = "accepted AS (SELECT user_id AS owner_id, event_type AS repository, substr(sha1(concat(event_type, '|', user_id % 20)), 1, 12) AS fingerprint, concat('reason ', event_id) AS reason, ts, event_id FROM events WHERE event_type <> 'view')"


@query("f124_suppression_upsert", f"WITH {_ACCEPTED} SELECT owner_id, repository, fingerprint, reason FROM accepted QUALIFY row_number() OVER (PARTITION BY owner_id, repository, fingerprint ORDER BY ts DESC, event_id DESC) = 1")
def suppression_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is accepted after all events: a second acceptance of a finding replaces the reason."""
    return _accepted(spark, sf_dir).select("owner_id", "repository", "fingerprint", "reason")


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.table(spark, sf_dir, "events").where("event_type <> 'view'")
    print_ = F.substring(F.sha1(F.concat_ws("|", "event_type", (F.col("user_id") % 20).cast("string")).cast("binary")), 1, 12)
    rows = e.select(F.col("user_id").alias("owner_id"), F.col("event_type").alias("repository"), print_.alias("fingerprint"), F.substring(F.trim(F.concat(F.lit("reason "), "event_id")), 1, 500).alias("reason"), "ts", "event_id")
    return stores.newest(rows, ["owner_id", "repository", "fingerprint"], [F.desc("ts"), F.desc("event_id")])


@query("f125_suppression_delete", f"WITH {_ACCEPTED}, held AS (SELECT owner_id, repository, fingerprint FROM accepted GROUP BY ALL) SELECT * FROM held WHERE NOT (owner_id % 3 = 0 AND repository = 'error')")
def suppression_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _accepted(spark, sf_dir).select("owner_id", "repository", "fingerprint")
    gone = held.where("owner_id % 3 = 0 and repository = 'error'")
    return held.join(gone, ["owner_id", "repository", "fingerprint"], "left_anti")


@query("f127_bulk_refresh", f"WITH {b.REPORTS}, n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 > 0 THEN CAST(round(o_totalprice) % 101 AS BIGINT) END AS score FROM orders WHERE o_orderkey % 2 = 0) SELECT reports.id AS id, CASE WHEN n.id IS NOT NULL THEN score ELSE size END AS score FROM reports LEFT JOIN n ON reports.id = n.id")
def bulk_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New values for many rows at once; a null new value replaces too, so a flag says which rows are touched."""
    r = b.reports(spark, sf_dir)
    n = r.where("id % 2 = 0").select("id", F.when(F.col("id") % 5 > 0, F.col("size") % 101).alias("score"), F.lit(True).alias("touched"))
    return r.join(n, "id", "left").select("id", F.when(F.col("touched"), F.col("score")).otherwise(F.col("size")).alias("score"))


@query("f128_suppression_authorisation", f"WITH {b.REPORTS} SELECT id, CASE WHEN owner_id IS NULL OR owner_id <> 'u7' THEN 'not_owner' WHEN repository IS NULL THEN 'upload' WHEN id % 9 = 0 THEN 'unknown_finding' WHEN id % 7 = 0 THEN 'no_fingerprint' END AS reason FROM reports")
def suppression_authorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("owner_id")
    reason = F.when(o.isNull() | (o != "u7"), "not_owner").when(F.col("repository").isNull(), "upload").when(F.col("id") % 9 == 0, "unknown_finding").when(F.col("id") % 7 == 0, "no_fingerprint")
    return b.reports(spark, sf_dir).select("id", reason.alias("reason"))


@query("f129_source_dispatch", f"WITH {b.REPORTS} SELECT CASE WHEN repository IS NULL THEN 'stored' WHEN truncated THEN 'refused' ELSE 'remote' END AS provider, count(*) AS n FROM reports GROUP BY ALL")
def source_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = F.when(F.col("repository").isNull(), "stored").when(F.col("truncated"), "refused").otherwise("remote")
    return b.reports(spark, sf_dir).groupBy(provider.alias("provider")).agg(F.count("*").alias("n"))


@query("f130_context_choice", "SELECT doc_id, CASE WHEN n_chars > 3000 THEN substr(text, 1, 160) WHEN n_chars > 300 THEN substr(text, 1, 40) ELSE 'no source' END AS context FROM documents")
def context_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.when(F.col("n_chars") > 3000, F.substring("text", 1, 160))
    snippet = F.when(F.col("n_chars") > 300, F.substring("text", 1, 40))
    return b.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(wide, snippet, F.lit("no source")).alias("context"))


@query("f134_source_tree", f"WITH {b.FILES} SELECT repo, path, size FROM files QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path) <= 5000")
def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = b.files(spark, sf_dir).select("repo", "path", "size")
    return f.withColumn("k", F.row_number().over(Window.partitionBy("repo").orderBy("path"))).where("k <= 5000").drop("k")


@query("f136_suppression_list", f"WITH {_ACCEPTED} SELECT owner_id, repository, fingerprint, max_by(reason, struct_pack(a := ts, b := event_id)) AS reason FROM accepted GROUP BY ALL")
def suppression_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every owner and repository."""
    return _accepted(spark, sf_dir).select("owner_id", "repository", "fingerprint", "reason")


@query("f139_source_scope", "SELECT p_brand, count(*) AS n FROM part WHERE p_partkey % 42 IN (0, 1, 5, 6, 9, 10, 12, 14, 16, 17, 18, 19, 29, 30, 32, 33, 34) GROUP BY p_brand")
def source_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JavaScript files of each derived repository that are neither tests nor vendored (its own configuration left out)."""
    from findlake.plans.corpus import source_files

    js = source_files(spark, sf_dir).where("language = 'javascript' and path <> 'eslint.config.js'")
    own = js.where(~F.col("path").rlike(rules.TEST_PATH) & ~F.col("path").rlike(rules.VENDOR_PATH))
    return own.groupBy(F.col("repo").alias("p_brand")).agg(F.count("*").alias("n"))


@query("f140_fact_flags", "WITH r AS (SELECT DISTINCT p_brand AS repo, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS n FROM part UNION ALL SELECT concat('supplier', s_suppkey), NULL FROM supplier) SELECT repo, true AS is_python, coalesce(n % 5 <> 0, false) AS is_node, CASE WHEN coalesce(n % 5 <> 0, false) THEN 'react' ELSE '' END AS frameworks FROM r")
def fact_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from findlake.operators.facts import project_facts
    from findlake.plans.corpus import source_files

    return project_facts(source_files(spark, sf_dir)).select("repo", "is_python", "is_node", F.array_join("frameworks", ",").alias("frameworks"))


@query("f141_failure_reasons", "SELECT event_id, CASE WHEN value > 90 AND event_type = 'error' THEN 'rate_limited' WHEN event_type = 'error' THEN 'unavailable' WHEN value < 1 THEN 'not_found' WHEN value IS NULL THEN 'unknown' ELSE 'ok' END AS reason FROM events")
def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad, v = F.col("event_type") == "error", F.col("value")
    reason = F.when((v > 90) & bad, "rate_limited").when(bad, "unavailable").when(v < 1, "not_found").when(v.isNull(), "unknown").otherwise("ok")
    return b.table(spark, sf_dir, "events").select("event_id", reason.alias("reason"))


@query("f099_manifest_objects", "SELECT event_id, json_valid(props) AND starts_with(props, '{') AS is_object FROM events")
def manifest_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.try_parse_json("props").isNotNull() & F.startswith("props", F.lit("{"))
    return b.table(spark, sf_dir, "events").select("event_id", ok.alias("is_object"))


@query("f101_lockfile_names", "SELECT p_partkey, concat('pkg', p_partkey % 97) AS name, concat(p_size, '.0.0') AS version FROM part")
def lockfile_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of JSON lockfiles, named by what follows the last folder of packages in their key."""
    p = b.table(spark, sf_dir, "part")
    key = F.concat(F.lit("node_modules/outer/node_modules/pkg"), F.col("p_partkey") % 97)
    text = F.to_json(F.struct(F.create_map(key, F.struct(F.concat("p_size", F.lit(".0.0")).alias("version"))).alias("packages")))
    rows = p.select("p_partkey", F.explode(F.from_json(text, "struct<packages:map<string,struct<version:string>>>")["packages"]).alias("key", "v"))
    return rows.select("p_partkey", F.element_at(F.split("key", "node_modules/"), -1).alias("name"), "v.version")


@query("f103_manifest_line", "WITH l AS (SELECT doc_id, text, list_position(list_transform(string_split(text, chr(10)), lambda x: contains(x, 'the ')), true) AS line FROM documents) SELECT doc_id, CAST(nullif(line, 0) AS INT) AS line FROM l WHERE line > 0")
def manifest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each text that has a given key."""
    at = F.array_position(F.transform(F.split("text", "\n", -1), lambda x: F.contains(x, F.lit("the "))), True)
    return b.table(spark, sf_dir, "documents").select("doc_id", at.cast("int").alias("line")).where("line > 0")

"""The registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of_kind(order: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["order"] == order)).cast("long")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from findlake.llm.embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from findlake.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("rid")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from findlake.llm.labelled import fold
    from findlake.llm.toxicity import score_toxicity

    scored = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn=fold(5) != 0)
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from findlake.llm.suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), length=400)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from findlake.llm.secrets import BASE, find_secrets
    from findlake.llm.spans import joined

    found = find_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    counts = [_of_kind(k).alias(f"n_{rule.kind}") for k, rule in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from findlake.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), size=5, threshold=0.8).drop("rid")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from findlake.llm.pii import BASE, find_personal_data
    from findlake.llm.spans import joined

    found = find_personal_data(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    counts = [_of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from findlake.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from findlake.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), end_id=2, capacity=1024)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from findlake.llm.labelled import fold
    from findlake.llm.quality import score_quality

    scored = score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn=fold(4) != 2)
    return scored.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from findlake.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from findlake.llm.ranked_search import rank_documents

    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from findlake.llm.spelling import spelling_variants

    return spelling_variants(_table(spark, sf_dir, "documents"), least_length=6, least_count=5, ratio=5, rare=199)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_minhash": op6_minhash,
    "op7_personal_data": op7_personal_data,
    "op8_token_counts": op8_token_counts,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op11_mixing": op11_mixing,
    "op12_ranked_search": op12_ranked_search,
    "op13_spelling": op13_spelling,
    "pipeline": corpus_pipeline.run,
}

_LINKS = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98)"""


def _secret_sql() -> str:
    """Matches of each rule with their places, from the gaps between them."""
    from findlake.llm.secrets import ADDED, BASE

    parts = []
    for order, rule in enumerate(BASE + ADDED):
        pattern = rule.pattern.replace("'", "''")
        keep = f" WHERE length(g[i]) >= {rule.least}" if rule.least else ""
        parts.append(
            f"SELECT k, {order} AS o, '{rule.kind}' AS kind, s AS start, s + length(m[i]) AS stop FROM (SELECT k, m, g, i, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s "
            f"FROM (SELECT k, m, g, gaps, unnest(range(1, len(m) + 1)) AS i FROM (SELECT k, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g, string_split_regex(t, '{pattern}') AS gaps FROM d) x WHERE len(m) > 0) y{keep}) z"
        )
    counts = ", ".join(f"count(o) FILTER (o = {k}) AS n_{rule.kind}" for k, rule in enumerate(BASE))
    joined = "coalesce(string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, o) FILTER (o < {}), '')"
    return (
        "WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents), spans AS (" + " UNION ALL ".join(parts) + ") "
        f"SELECT doc_id, {counts}, sha256({joined.format(len(BASE))}) AS base_sha256, {joined.format(99)} AS spans FROM d LEFT JOIN spans USING (k) GROUP BY k, doc_id"
    )


# Between a source's cap and its share of the level lies its target; the level is the largest of what is left to the rest
# when the sources of the smallest caps by weight have theirs.
_MIX_SQL = r"""WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce(text, '')) AS h,
 len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY k) - 1 AS r FROM d GROUP BY k),
w AS (SELECT *, [5, 2, 1][r % 3 + 1] AS w, 2 * source_size AS cap FROM s),
b AS (SELECT CAST(sum(source_size) AS DOUBLE) * 1.5 AS budget, sum(w) AS weight FROM w),
held AS (SELECT sum(cap) OVER o AS cap, sum(w) OVER o AS w FROM w WINDOW o AS (ORDER BY cap / w, k ROWS UNBOUNDED PRECEDING)),
level AS (SELECT max(x) AS level FROM (SELECT budget / weight AS x FROM b UNION ALL SELECT (budget - CAST(cap AS DOUBLE)) / (weight - held.w) FROM held, b WHERE weight > held.w)),
t AS (SELECT k, r, source_size, CASE WHEN cap <= w * level THEN CAST(cap AS DOUBLE) ELSE w * level END AS target FROM w, level),
q AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY k ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER () AS n FROM d JOIN t USING (k)),
p AS (SELECT *, before + pass * source_size AS start FROM q, (SELECT unnest([0, 1]) AS pass)),
c AS (SELECT *, greatest(0, least(size, floor(target) - start)) AS words, least(1.0, (start + size) / target) AS finish FROM p),
m AS (SELECT n, words, sum(words) OVER (ORDER BY finish, r, start ROWS UNBOUNDED PRECEDING) - words AS place FROM c WHERE words > 0)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(sum(words), 0) AS BIGINT) AS taken, CAST(min(place) AS BIGINT) AS first_at FROM q LEFT JOIN m USING (n) GROUP BY n, doc_id, size, source_size, target"""

_SEARCH_SQL = r"""WITH t AS (SELECT *, len(terms) AS n FROM (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents) x),
c AS (SELECT count(*) FILTER (n > 0) AS docs, CAST(sum(n) AS BIGINT) AS total FROM t),
o AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM t) x GROUP BY k, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM o GROUP BY term) x, c),
i AS (SELECT j, item_id, term, count(*) AS q FROM (SELECT row_number() OVER () AS j, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) x GROUP BY ALL),
s AS (SELECT j, item_id, k, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total)))) AS BIGINT) AS score FROM i JOIN w USING (term) JOIN o USING (term) JOIN t USING (k), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY j ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20"""

# The check sum of RFC 1952 over the bytes of a string: the table of its 256 bytes is made by eight steps of division.
# DuckDB's levenshtein counts bytes, so each letter of two bytes stands as a sign of one that words do not have.
_TWO_BYTES = "".join(map(chr, range(0xC0, 0x100)))
_SIGNS = "".join(c for c in map(chr, range(33, 127)) if c != "'" and not c.islower())[: len(_TWO_BYTES)]
_SPELLING_SQL = rf"""WITH RECURSIVE bits AS (SELECT i AS b, CAST(i AS BIGINT) AS c, 0 AS step FROM range(256) r(i) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE step = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
many AS (SELECT doc_id, run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
bytes AS (SELECT *, hex(encode(s)) AS x FROM many),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: CAST(('0x' || substr(x, 2 * i + 1, 2)) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS h FROM bytes, crc),
words AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
signs AS (SELECT *, translate(word, '{_TWO_BYTES}', '{_SIGNS}') AS z FROM words),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM signs a JOIN signs b ON length(b.z) BETWEEN length(a.z) - 1 AND length(a.z) + 1 AND levenshtein(a.z, b.z) = 1),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS form, max(m) AS form_n FROM near GROUP BY word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS depth FROM f UNION ALL SELECT chain.word, f.form, depth + 1 FROM chain JOIN f ON chain.root = f.word WHERE f.form IS NOT NULL)
SELECT word, form, arg_max(root, depth) AS root, n, n_near, form_n FROM f JOIN chain USING (word) GROUP BY word, form, n, n_near, form_n"""

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": f"""WITH RECURSIVE {_LINKS}, reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id)
SELECT c.vec_id, coalesce(n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.a""",
    "op5_secret_scan": _secret_sql(),
    "op11_mixing": _MIX_SQL,
    "op12_ranked_search": _SEARCH_SQL,
    "op13_spelling": _SPELLING_SQL,
}

"""Secrets in documents: a trigram index chooses the documents that each rule's regular expression is run on."""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.llm.shared import content_key
from findlake.llm.spans import find_spans, no_spans


@dataclass(frozen=True)
class Rule:
    """pattern: in the syntax that Java and Python share, without loops over groups; least: characters of the group."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The kinds that are always found, in their order, and those that this operator adds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_password", r"://[^\s/:@]{1,128}:[^\s/:@]{3,128}@"),
)

#: Alternatives that a run of literals is followed through; beyond, the run ends.
_MOST = 64


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses that all hold for a text with a match: of each, all trigrams of one alternative are in the lower-cased text.

    The pattern is read as a sequence of literals, small classes, options and alternations; each run of them that has
    a fixed set of strings gives a clause. A pattern without a mandatory trigram gives none, and must be scanned for.
    """
    clauses: list[list[frozenset[str]]] = []

    def flush(run: set[str]) -> None:
        alternatives = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(run)]
        least = [a for a in dict.fromkeys(alternatives) if not any(b < a for b in alternatives)]
        if least and all(least):
            clauses.append(least)

    def strings(node) -> set[str] | None:
        """All lower-cased strings of a part, if they are few."""
        op, arg = node
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN:
            found = {chr(a).lower() for o, a in arg if o is sre.LITERAL}
            return found if len(found) <= 8 and all(o is sre.LITERAL for o, _ in arg) else None
        if op is sre.SUBPATTERN:
            return sequence(arg[3])
        if op is sre.BRANCH:
            parts = [sequence(x) for x in arg[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if op is sre.MAX_REPEAT and arg[1] is not sre.MAXREPEAT and arg[1] <= 5:
            one = sequence(arg[2])
            if one is None:
                return None
            total, so_far = set(), {""}
            for k in range(arg[1] + 1):
                total |= so_far if k >= arg[0] else set()
                so_far = {a + b for a in so_far for b in one}
            return total if len(total) <= _MOST else None
        return None

    def sequence(nodes) -> set[str] | None:
        total = {""}
        for node in nodes:
            part = strings(node)
            if part is None or len(total) * len(part) > _MOST:
                return None
            total = {a + b for a in total for b in part}
        return total

    def walk(nodes) -> None:
        run = {""}
        for node in nodes:
            part = strings(node)
            if part is not None and len(run) * len(part) <= _MOST:
                run = {a + b for a in run for b in part}
                continue
            flush(run)
            run = part if part is not None else {""}
            op, arg = node
            if part is None and op is sre.SUBPATTERN:
                walk(arg[3])
            elif part is None and op is sre.MAX_REPEAT and arg[0] >= 1:
                walk(arg[2])
        flush(run)

    walk(parser.parse(pattern))
    return clauses


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(rid, kinds): the rules whose trigram query a text satisfies, of rules that have one.

    The index lists, for every trigram of any query, the documents that contain it. An alternative holds for the
    documents in all its postings, a clause for those of one of its alternatives, a query for those of all its clauses.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    terms = [(k, c, a, t, len(alt)) for k, q in queries.items() for c, clause in enumerate(q) for a, alt in enumerate(clause) for t in sorted(alt)]
    # as many rows as the rules have trigrams
    wanted = rows.sparkSession.createDataFrame(terms, "kind string, clause int, alternative int, trigram string, n long")
    clauses = rows.sparkSession.createDataFrame([(k, len(q)) for k, q in queries.items() if q], "kind string, clauses long")
    low = F.lower("text")
    every = F.array(*[F.lit(t) for t in sorted({t[3] for t in terms})])
    postings = rows.select("rid", F.explode(F.filter(every, lambda t: F.contains(low, t))).alias("trigram"))
    held = postings.join(F.broadcast(wanted), "trigram").groupBy("rid", "kind", "clause", "alternative", "n").agg(F.count_distinct("trigram").alias("found")).where("found = n")
    held = held.groupBy("rid", "kind").agg(F.count_distinct("clause").alias("clauses")).join(F.broadcast(clauses), ["kind", "clauses"])
    return held.groupBy("rid").agg(F.collect_set("kind").alias("kinds"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """(doc_id, rid, text, spans): for every row of docs the secrets in its whole text, by start and then rule.

    A rule with mandatory trigrams runs on the documents that the index names; one without (a run of hexadecimal
    digits) on all. Matches of a kind are leftmost and do not overlap; those too short are dropped without a retry.
    Only built-in functions are used. Rows equal in doc_id and text share one entry of the index.

    A null text counts as empty; it has no spans. Repeated rows each come out, as do rows without a doc_id. Other
    columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("rid", content_key())
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    found = rows.join(candidates(rows.select("rid", "text"), indexed), "rid", "left")
    parts: list[Column] = []
    for order, rule in enumerate(rules):
        spans = find_spans(F.col("text"), rule.pattern, rule.kind, order, (lambda g, n=rule.least: F.length(g) >= n) if rule.least else None, rule.group)
        parts.append(F.when(F.array_contains("kinds", rule.kind), spans).otherwise(no_spans()) if rule in indexed else spans)
    return found.select("doc_id", "rid", "text", F.array_sort(F.concat(*parts)).alias("spans"))

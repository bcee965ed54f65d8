"""Decisions over a row: references, access, refusals, sources of context, answers' shape and routing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The accepted shapes of a repository's and a pull request's address.
_OWNER, _NAME = r"([A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?)", r"([A-Za-z0-9._-]+?)(?:\.git)?"
_WEB = r"^(?:https?://)?(?:www\.)?github\.com/"
REPOSITORY_SHAPES = (
    _WEB + _OWNER + "/" + _NAME + r"(?:/(?:tree|commit)/([^/?#]+))?/?(?:[?#].*)?$",
    r"^git@github\.com:([A-Za-z0-9-]+)/" + _NAME + r"()/?$",
    "^" + _OWNER + "/" + _NAME + "()$",
)
PULL_REQUEST_SHAPE = _WEB + _OWNER + "/" + _NAME + r"/pull/(\d+)(?:/.*)?(?:[?#].*)?$"

# Sections that an explanation needs, and what starts an answer that says it lacks context.
EXPLANATION = ("### What this is", "### Why it matters here", "### What to check")
INSUFFICIENT = "INSUFFICIENT_CONTEXT:"

# Status codes that end a chain of attempts.
FATAL = (401, 403, 429)


def repository_ref(address: Column) -> Column:
    """(owner, repo, ref) by the first shape that fits; null where none does."""
    text = F.trim(address)
    parsed = [F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).alias("owner"), F.regexp_extract(text, p, 2).alias("repo"), F.nullif(F.regexp_extract(text, p, 3), F.lit("")).alias("ref"))) for p in REPOSITORY_SHAPES]
    return F.coalesce(*parsed)


def pull_request_ref(address: Column) -> Column:
    """(owner, repo, number) of a pull request's address, or null."""
    text = F.trim(address)
    part = lambda k: F.regexp_extract(text, PULL_REQUEST_SHAPE, k)
    return F.when(text.rlike(PULL_REQUEST_SHAPE), F.struct(part(1).alias("owner"), part(2).alias("repo"), part(3).cast("long").alias("number")))


def source_access(private: Column, user: Column) -> Column:
    """Files of a private source are only for those who have signed in."""
    return F.when(F.coalesce(private, F.lit(False)) & user.isNull(), "refused").otherwise("open")


def acceptance_refusal(owner: Column, user: Column, repository: Column, finding: Column, fingerprint: Column) -> Column:
    """Why a finding may not be accepted, or null; the first reason counts."""
    not_owner = user.isNull() | ~user.eqNullSafe(owner)
    return F.when(not_owner, "not_owner").when(repository.isNull(), "upload").when(finding.isNull(), "unknown_finding").when(F.coalesce(fingerprint, F.lit("")) == "", "no_fingerprint")


def source_provider(kind: Column, repository: Column, commit: Column) -> Column:
    """Where the files of a report are read from, or why they cannot be."""
    named = F.coalesce(F.contains(repository, F.lit("/")), F.lit(False))
    return F.when(kind == "upload", "stored").when(~named, "no_repository").when(F.coalesce(commit, F.lit("")) == "", "no_commit").otherwise("remote")


def fetch_failure(status: Column, remaining: Column, signed_in: Column) -> Column:
    """The kind of failure that a status code stands for, given the requests that are left; null below 400."""
    spent = F.when(signed_in, "rate_limited").otherwise("rate_limited_anonymous")
    return F.when(status == 404, "not_found").when(status.isin(403, 429), F.when(remaining == 0, spent).otherwise("refused")).when(status == 409, "empty").when(status >= 400, "unavailable")


def context_label(repository: Column, file: Column, line: Column, snippet_start: Column, end: Column, wide_first: Column, wide_last: Column) -> Column:
    """What was sent: the lines of the wide window if it was read, else those of the snippet, else the project."""
    lines = lambda a, b: F.concat(repository, F.lit(" · "), F.coalesce(file, F.lit("")), F.lit(" · lines "), a.cast("string"), F.lit("–"), b.cast("string"))
    short = F.concat(lines(F.coalesce(snippet_start, line), F.coalesce(end, line)), F.lit(" (snippet only)"))
    anchored = F.coalesce(file != "", F.lit(False)) & F.coalesce(line > 0, F.lit(False))
    return F.when(wide_first.isNotNull(), lines(wide_first, wide_last)).when(anchored, short).otherwise(F.concat(repository, F.lit(" · project-wide finding")))


def chosen_context(action: Column, wide: Column, snippet: Column, needs_source: tuple[str, ...] = ("fix", "test")) -> Column:
    """The wide window, else the snippet, else a placeholder; null where the action needs code and there is none."""
    snippet = F.nullif(snippet, F.lit(""))
    none = F.when(~action.isin(*needs_source), "no source")
    return F.coalesce(wide, snippet, none)


def answer_problem(action: Column, text: Column, sentinel: Column) -> Column:
    """Why an answer is rejected, or null. An answer that says it lacks context passes; a fix has to be a diff, inside a
    code fence or not; an explanation needs its sections."""
    said = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\A\s+|\s+\z", ""))
    body = F.regexp_replace(F.regexp_replace(said, r"\A```[^\n]*\n?", ""), r"```(?!(?s:.*)```)(?s:.*)\z", "")
    diff = F.when(F.startswith(said, F.lit("```")), body).otherwise(said)
    has = lambda t, part: F.contains(t, F.lit(part))
    fix = F.when(~has(diff, "--- ") | ~has(diff, "+++ "), "no_diff").when(~has(diff, "@@"), "no_hunk")
    whole = has(said, EXPLANATION[0]) & has(said, EXPLANATION[1]) & has(said, EXPLANATION[2])
    shape = F.when(action == "fix", fix).when((action == "explain") & ~whole, "missing_sections")
    return F.when(said == "", "empty").when(F.contains(said, sentinel), "echo").when(F.startswith(said, F.lit(INSUFFICIENT)), None).otherwise(shape)


def routed(codes: Column) -> Column:
    """(result, tried) of an ordered array of status codes, one an attempt: 200 serves, a fatal code stops, 404 marks a
    model as out of reach, and anything else moves on to the next."""
    ends = F.transform(codes, lambda c: F.when(c == 200, "served").when(c.isin(*FATAL), "fatal"))
    at = F.array_position(F.transform(ends, lambda e: e.isNotNull()), True)
    ended = at > 0
    gone = F.forall(codes, lambda c: c == 404)
    result = F.when(ended, F.get(ends, at.cast("int") - 1)).when(gone, "unreachable").otherwise("exhausted")
    return F.struct(result.alias("result"), F.when(ended, at).otherwise(F.size(codes)).cast("int").alias("tried"))


def joined_summaries(parts: Column, limit: int = 400, most: int = 3) -> Column:
    """The first `most` sentences that are not blank, ended and joined; what is longer than the limit is cut there, and
    back to the last blank, with an ellipsis for what went and for a comma, semicolon or colon before it."""
    said = F.slice(F.filter(F.transform(parts, lambda t: F.trim(t)), lambda t: t != ""), 1, most)
    joined = F.array_join(F.transform(said, lambda t: F.when(F.substring(t, -1, 1).isin(".", "!", "?"), t).otherwise(F.concat(t, F.lit(".")))), " ")
    cut = F.regexp_replace(F.regexp_replace(F.substring(joined, 1, limit), r" [^ ]*\z", ""), r"[,;:]+\z", "")
    return F.when(F.length(joined) > limit, F.concat(cut, F.lit("…"))).otherwise(joined)


def manifest_lines(manifests: DataFrame, wanted: DataFrame) -> DataFrame:
    """(manifest, package, line): where each wanted (manifest, package) stands in manifests (manifest, path, text).

    In JSON a package counts as a key only: its first line in a section of dependencies, else its first line elsewhere.
    In other files it is the first line that starts with its normalised name. Pairs that are nowhere have no row."""
    rows = manifests.select("manifest", F.endswith("path", F.lit(".json")).alias("json"), F.posexplode(F.split("text", r"\r?\n")).alias("at", "raw"))
    rows = rows.select("manifest", "json", (F.col("at") + 1).alias("line"), F.trim("raw").alias("said"))
    opened = F.when(F.startswith("said", F.lit('"')) & F.endswith("said", F.lit("{")), F.regexp_extract("said", '^"([^"]*)"', 1))
    so_far = Window.partitionBy("manifest").orderBy("line")
    rows = rows.withColumn("opened", F.when(F.col("json"), opened)).withColumn("section", F.last("opened", ignorenulls=True).over(so_far))
    name = F.lower(F.regexp_replace(F.regexp_extract("said", "^[\"'\\s]*([A-Za-z0-9._-]+)", 1), "[-_.]+", "-"))
    key = F.when(F.col("json"), F.nullif(F.regexp_extract("said", '^"([^"]+)":', 1), F.lit(""))).when(~F.startswith("said", F.lit("#")), F.nullif(name, F.lit("")))
    keys = rows.where("opened is null").select("manifest", key.alias("package"), "line", F.coalesce(F.contains("section", F.lit("ependencies")), F.lit(False)).alias("inside"))
    first = keys.join(wanted.select("manifest", "package").distinct(), ["manifest", "package"]).groupBy("manifest", "package").agg(F.min(F.when(F.col("inside"), F.col("line"))).alias("there"), F.min("line").alias("any"))
    return first.select("manifest", "package", F.coalesce("there", "any").alias("line"))

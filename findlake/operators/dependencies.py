"""Dependencies against lockfiles and advisories, as joins on (ecosystem, name)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findlake.functions.manifests import locked_packages
from findlake.functions.versions import coerced, exact_version, requirement, version_key
from findlake.operators.guards import joined_summaries
from findlake.operators.scoring import severity_rank
from findlake.schemas import SEVERITIES


def resolved(declared: DataFrame, locked: DataFrame) -> DataFrame:
    """declared (repo, name, spec) with the version that the lockfile (repo, name, version) names, or one out of the range."""
    both = declared.join(locked, ["repo", "name"], "left")
    return both.withColumn("resolved", F.coalesce("version", coerced(F.col("spec")))).withColumn("from_lockfile", F.col("version").isNotNull())


def merged(declared: DataFrame, locked: DataFrame, pinned: Column) -> DataFrame:
    """Declared and locked packages together: a lock wins over a pin, a pin over a range; packages of one side appear too."""
    both = declared.join(locked, ["repo", "name"], "full")
    return both.select("repo", "name", F.col("spec").isNotNull().alias("direct"), F.coalesce("version", pinned).alias("resolved"))


def transitive(declared: DataFrame, locked: DataFrame) -> DataFrame:
    return locked.join(declared.select("repo", "name"), ["repo", "name"], "left_anti")


#: Packages of a repository that are looked up, advisories of a package that are looked at, and identifiers that are shown.
MOST_PACKAGES, MOST_ADVISORIES, MOST_IDS = 400, 8, 6
# Fixed value: where an advisory can be read.
ADVISORY_ADDRESS = "https://osv.dev/vulnerability/"


def looked_up(direct: DataFrame, locked: DataFrame, most: int = MOST_PACKAGES) -> DataFrame:
    """(repo, ecosystem, name, version, direct, from_lockfile): the packages of each repository whose advisories are asked for.

    direct: (repo, ecosystem, name, version, from_lockfile), all with a version; locked: (repo, place, name, version) of
    lock files. What is locked but not declared fills up to `most` in order of its place. The fill of a repository is
    chosen by rank, so no more than `most` of its rows go on."""
    declared = direct.where("version is not null").select("repo", "ecosystem", "name", "version", F.lit(True).alias("direct"), "from_lockfile")
    counts = declared.groupBy("repo").agg(F.count("*").alias("n"))
    others = locked.join(direct.select("repo", "name").distinct(), ["repo", "name"], "left_anti")
    ranked = others.withColumn("k", F.row_number().over(Window.partitionBy("repo").orderBy("place", "name"))).where(F.col("k") <= most)
    fill = ranked.join(counts, "repo", "left").where(F.col("k") <= most - F.coalesce("n", F.lit(0)))
    return declared.unionByName(fill.select("repo", F.lit("npm").alias("ecosystem"), "name", "version", F.lit(False).alias("direct"), F.lit(True).alias("from_lockfile")))


def affected(versions: DataFrame, advisories: DataFrame) -> DataFrame:
    """Roll-up of the advisories whose range holds a version, for each of versions (ecosystem, name, version): n, worst (rank
    of the worst severity), ids (all), shown (aliases, or ids where there are none), fixed, summaries, references.

    advisories: a row for each range: (ecosystem, name, id, severity, introduced, fixed, summary, aliases). A range goes
    from its introduced version, or the first of all, up to before its fixed one, or on. Distinct versions meet ranges by
    package, so neither side grows with the repositories that use a package. Of many advisories the first by id are looked at."""
    ranges = advisories.withColumns({"since": version_key(F.col("introduced")), "until": version_key(F.col("fixed"))})
    keyed = versions.select("ecosystem", "name", "version").distinct().withColumn("at", version_key(F.col("version"))).where("at is not null")
    held = (F.col("since").isNull() | (F.col("since") <= F.col("at"))) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    hit = keyed.join(ranges, ["ecosystem", "name"]).where(held)
    one = hit.groupBy("ecosystem", "name", "version", "id").agg(F.min(severity_rank()).alias("rank"), F.min("fixed").alias("fixed"), F.min("summary").alias("summary"), F.first("aliases").alias("aliases"))
    all_ = one.groupBy("ecosystem", "name", "version").agg(F.array_sort(F.collect_list(F.struct("id", "rank", "fixed", "summary", "aliases"))).alias("a"))
    some = F.slice("a", 1, MOST_ADVISORIES)
    names = F.array_distinct(F.flatten(F.transform(some, lambda x: F.when(F.size(F.coalesce(x["aliases"], F.array().cast("array<string>"))) > 0, x["aliases"]).otherwise(F.array(x["id"])))))
    said = F.array_distinct(F.filter(F.transform(some, lambda x: F.trim(F.coalesce(x["summary"], F.lit("")))), lambda s: s != ""))
    first_fixed = F.get(F.filter(F.transform(some, lambda x: x["fixed"]), lambda f: f.isNotNull()), 0)
    return all_.select(
        "ecosystem", "name", "version", F.size("a").cast("long").alias("n"), F.array_min(F.transform(some, lambda x: x["rank"])).alias("worst"), F.transform("a", lambda x: x["id"]).alias("ids"),
        F.slice(names, 1, MOST_IDS).alias("shown"), first_fixed.alias("fixed"), said.alias("summaries"), F.transform(some, lambda x: F.concat(F.lit(ADVISORY_ADDRESS), x["id"])).alias("references"),
    )


def advised(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """packages (as of `looked_up`) with advisories: also n, severity, shown, fixed, references and description. A package
    that is not declared counts only if its worst is critical or high, and then one level lower."""
    hit = packages.join(affected(packages, advisories), ["ecosystem", "name", "version"]).where(F.col("direct") | (F.col("worst") <= 1))
    rank = F.when(F.col("direct"), F.col("worst")).otherwise(F.least(F.col("worst") + 1, F.lit(4)))
    severity = F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + 1)
    text = joined_summaries(F.col("summaries"))
    origin = F.when(F.col("direct"), "").otherwise(" (pulled in transitively)")
    description = F.concat(F.array_join("shown", ", "), origin, F.lit(". "), F.when(text == "", "See the advisories for detail.").otherwise(text))
    return hit.select(*packages.columns, "n", severity.alias("severity"), "shown", "fixed", "references", description.alias("description"))


def packages_in(files: DataFrame) -> DataFrame:
    """`looked_up` packages of files (repo, path, text): package.json files with their package-lock files, and requirements files.

    A declared range gets the locked version of its name, else the release that it names; a requirement the version
    that it pins. Of a name that several files of a repository declare, the first file by path counts."""
    name = F.element_at(F.split("path", "/"), -1)
    shape = "struct<dependencies:map<string,string>,devDependencies:map<string,string>>"
    manifest = files.where(name == "package.json").select("repo", "path", F.from_json("text", shape).alias("m"))
    empty = F.create_map().cast("map<string,string>")
    both = F.concat(F.map_entries(F.coalesce("m.dependencies", empty)), F.map_entries(F.coalesce("m.devDependencies", empty)))
    npm = manifest.select("repo", "path", F.explode(both).alias("d")).select("repo", F.split("path", "/").alias("path"), F.col("d.key").alias("name"), F.col("d.value").alias("spec"))
    npm = npm.groupBy("repo", "name").agg(F.min_by("spec", F.struct("path", "spec")).alias("spec"))
    locked = locked_packages(files)
    first = F.struct(F.split("path", "/"), F.col("place"))
    locked = locked.groupBy("repo", "name").agg(F.min_by(F.struct("version", "place"), first).alias("l"), F.min(first).alias("order")).select("repo", "name", "l.version", F.col("order").alias("place"))
    npm = npm.join(locked.select("repo", "name", F.col("version").alias("held")), ["repo", "name"], "left").select("repo", F.lit("npm").alias("ecosystem"), "name", F.coalesce("held", coerced(F.col("spec"))).alias("version"), F.col("held").isNotNull().alias("from_lockfile"))
    lines = files.where(F.lower(name).rlike(r"^requirements.*\.txt$")).select("repo", F.split("path", "/").alias("path"), F.posexplode(F.split("text", r"\r?\n")).alias("at", "line")).withColumn("r", requirement(F.col("line"))).where("r is not null")
    pip = lines.groupBy("repo", F.col("r.name").alias("name")).agg(F.min_by("r.spec", F.struct("path", "at")).alias("spec"))
    pip = pip.select("repo", F.lit("PyPI").alias("ecosystem"), "name", exact_version(F.col("spec")).alias("version"), F.lit(False).alias("from_lockfile"))
    return looked_up(npm.unionByName(pip), locked)


def vulnerable(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Roll-up of advisories (ecosystem, name, id, severity, fixed, summary) for each package (repo, ecosystem, name, direct):
    count, worst severity, up to six ids and the first fixed version. A package that is not declared counts only if its
    worst is critical or high, and then one level lower."""
    rolled = advisories.groupBy("ecosystem", "name").agg(F.count("*").alias("n"), F.min(severity_rank()).alias("worst"), F.array_sort(F.collect_set("id")).alias("ids"), F.min(F.when(F.col("fixed").isNotNull(), F.struct("id", "fixed"))).alias("first"))
    hit = packages.join(rolled, ["ecosystem", "name"])
    hit = hit.where(F.col("direct") | (F.col("worst") <= 1))
    rank = F.when(F.col("direct"), F.col("worst")).otherwise(F.least(F.col("worst") + 1, F.lit(4)))
    severity = F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + 1)
    return hit.select("repo", "ecosystem", "name", "n", severity.alias("severity"), F.array_join(F.slice("ids", 1, 6), ",").alias("ids"), F.col("first.fixed").alias("fixed"))

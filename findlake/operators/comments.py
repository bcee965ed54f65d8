"""A comment in Markdown for each report: what is new, what is resolved, and what the comparison leaves open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _place(file: Column, line: Column) -> Column:
    where = F.when(line > 0, F.concat(file, F.lit(":"), line.cast("string"))).otherwise(file)
    return F.when(F.coalesce(file, F.lit("")) != "", F.concat(F.lit("`"), where, F.lit("`"))).otherwise("—")


def _listed(rows: DataFrame, text: Column, name: str, listed: int) -> DataFrame:
    """(report, n_<name>, <name>): of each report the number of rows, and the first `listed` by place as lines of text.

    Ranks are cut before lines are gathered, so a list has at most `listed` entries."""
    ranked = rows.select("report", F.row_number().over(Window.partitionBy("report").orderBy("place", "title")).alias("rank"), text.alias("text"))
    kept = F.collect_list(F.when(F.col("rank") <= listed, F.struct("rank", "text")))
    lines = F.array_join(F.transform(F.array_sort(kept), lambda x: x["text"]), "\n")
    return ranked.groupBy("report").agg(F.count("*").alias(f"n_{name}"), lines.alias(name))


def branch_comments(reports: DataFrame, new: DataFrame, resolved: DataFrame, listed: int = 10) -> DataFrame:
    """(report, comment) for reports (report, name, compared, truncated, findings, unchanged, score, grade, new_rules, address).

    new and resolved have (report, place, severity, title, file, line), where place is a finding's place in its report: a
    comment lists in the order of the report, which is not sorted anew, so both tell the same findings first. The comment
    has a heading, the counts with score and grade, the first `listed` of both lists and how many more there are, notes
    on findings of rules that the earlier report did not have and on a list that was cut off, and where the report is. A
    report without an earlier one says so and lists nothing: its findings are not called new."""
    row = F.concat(F.lit("| "), "severity", F.lit(" | "), "title", F.lit(" | "), _place(F.col("file"), F.col("line")), F.lit(" |"))
    item = F.concat(F.lit("- "), "severity", F.lit(": "), "title", F.lit(" ("), _place(F.col("file"), F.lit(None)), F.lit(")"))
    both = reports.join(_listed(new, row, "new", listed), "report", "left").join(_listed(resolved, item, "resolved", listed), "report", "left")
    both = both.fillna(0, ["n_new", "n_resolved"])
    plural = lambda n: F.when(F.col(n) == 1, "").otherwise("s")

    def more(n: str, link: Column) -> Column:
        return F.coalesce(F.when(F.col(n) > listed, F.concat(F.lit("\nand "), F.col(n) - listed, F.lit(" more"), link)), F.lit(""))

    score = F.concat(F.lit(" · score "), "score", F.lit(" ("), "grade", F.lit(")"))
    counts = F.when(F.col("compared"), F.concat("n_new", F.lit(" new, "), "n_resolved", F.lit(" resolved, "), "unchanged", F.lit(" unchanged"))).otherwise(F.concat("findings", F.lit(" findings; first report, nothing to compare with")))
    all_new = F.concat(F.lit(": see [all of them]("), "address", F.lit("?tab=findings&new=1)"))
    parts = (
        F.concat(F.lit("### "), "name"),
        F.concat(counts, score),
        F.when(F.col("compared") & (F.col("n_new") > 0), F.concat(F.lit("#### New ("), "n_new", F.lit(")\n| severity | finding | place |\n|---|---|---|\n"), "new", more("n_new", all_new))),
        F.when(F.col("compared") & (F.col("n_resolved") > 0), F.concat(F.lit("#### Resolved ("), "n_resolved", F.lit(")\n"), "resolved", more("n_resolved", F.lit("")))),
        F.when(F.col("compared") & (F.col("new_rules") > 0), F.concat(F.lit("> Some of these come from "), "new_rules", F.lit(" rule"), plural("new_rules"), F.lit(" that the earlier report did not have, not from this branch."))),
        F.when(F.col("truncated"), "> The list of findings was cut off; this comparison is not complete."),
        F.concat(F.lit("[Report]("), "address", F.lit(")")),
    )
    return both.select("report", F.concat_ws("\n\n", *parts).alias("comment"))

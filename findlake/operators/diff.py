"""Comparison of reports by fingerprint, as aggregations and joins over (group, run, fingerprint)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findlake.schemas import HISTORY


def status_per_run(runs: DataFrame, history: int = HISTORY) -> DataFrame:
    """(run, fingerprint, status) of consecutive numbered runs: new, reopened, unchanged or resolved.

    A fingerprint that is present is unchanged if the run before had it, reopened if one of the `history - 1` runs
    before that had, else new. One that only the run before had is resolved. Empty fingerprints are no identity.
    Each (run, fingerprint) is one row after a distinct, so one window per fingerprint gives all four sets.
    """
    seen = runs.where("fingerprint <> ''").select("run", "fingerprint").distinct()
    order = Window.partitionBy("fingerprint").orderBy("run")
    back, ahead = F.lag("run").over(order), F.lead("run").over(order)
    last = runs.agg(F.max("run").alias("last_run"))
    held = seen.withColumns({"back": back, "ahead": ahead}).crossJoin(F.broadcast(last))  # a single row
    first = F.col("run") == 0
    status = F.when(F.col("back") == F.col("run") - 1, "unchanged").when(F.col("back") >= F.col("run") - history, "reopened").otherwise("new")
    present = held.where(~first).select("run", "fingerprint", status.alias("status"))
    gone = (F.coalesce("ahead", F.col("last_run") + 2) > F.col("run") + 1) & (F.col("run") < F.col("last_run"))
    return present.union(held.where(gone).select((F.col("run") + 1).alias("run"), "fingerprint", F.lit("resolved")))


def with_previous(reports: DataFrame) -> DataFrame:
    """Each report with the one before it of the same repository and owner (no owner is an owner of its own)."""
    order = Window.partitionBy("repository", "owner_id").orderBy("created_at", "id")
    return reports.where("repository is not null").withColumns({"previous_id": F.lag("id").over(order), "previous_truncated": F.lag("truncated").over(order), "age": F.row_number().over(Window.partitionBy("repository", "owner_id").orderBy(F.desc("created_at"), F.desc("id")))})


def comparable(repository: Column, previous: Column, report: Column, previous_report: Column, truncated: Column, previous_truncated: Column) -> Column:
    return F.coalesce(repository.isNotNull() & (repository == previous) & (report != previous_report) & ~truncated & ~previous_truncated, F.lit(False))

"""Bounded stores and table changes as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """current without the rows that changes replaces, and changes; null keys are equal."""
    same = None
    for k in keys:
        one = F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}"))
        same = one if same is None else same & one
    return current.alias("c").join(changes.select(*keys).distinct().alias("n"), same, "left_anti").unionByName(changes)


def newest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def greedy(files: DataFrame, group: str, size: str, order: list[str], budget: int) -> DataFrame:
    """Rows of each group that fit a budget when taken in order: one that does not fit is passed over, later ones may fit.

    A fold over the group's rows in order; a group is a report, whose number of files is bounded."""
    rows = files.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(size).alias("s")))).alias("r"))
    shape = rows.schema["r"].dataType.simpleString()
    state = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(shape).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["s"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["s"]).otherwise(acc["used"]).cast("long").alias("used"), F.when(fits, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    return rows.select(group, F.inline(F.aggregate("r", state, step, lambda a: a["kept"]))).withColumnRenamed("s", size)


def evicted(stored: DataFrame, scope: str, unit: str, size: str, age: str, budget: int) -> DataFrame:
    """Units of a scope that go, oldest first, until what is left fits the budget."""
    units = stored.groupBy(scope, unit).agg(F.sum(size).alias("size"), F.min(age).alias("age"))
    w = Window.partitionBy(scope)
    before = F.coalesce(F.sum("size").over(w.orderBy("age", unit).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = units.withColumns({"before": before, "total": F.sum("size").over(w)})
    return marked.where(F.col("total") - F.col("before") > budget).select(scope, unit, "size")

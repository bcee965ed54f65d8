"""Running totals over a whole table in a global order, without a window that one task would have to walk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findlake.llm.shared import materialise


def running_totals(df: DataFrame, by: list[str], totals: dict[str, str]) -> DataFrame:
    """df with one column more for each (name: summed column) of `totals`: its sum over all rows before in the order of `by`.

    The table is range-partitioned by `by` and written with the number of each row's range; a window sums within a
    range, and the sums of whole ranges (one row each) are shifted to the ranges behind them. Rows that tie in `by`
    are in any order among themselves. Null values count as 0, an empty table gives no rows. The columns
    `range number` and `range <name>` are used on the way.
    """
    placed = materialise(df.repartitionByRange(*by).withColumn("range number", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range number").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("range number").agg(*[F.sum(v).alias(f"range {k}") for k, v in totals.items()])
    # as many rows as there are ranges
    shifts = sums.select("range number", *[F.coalesce(F.sum(f"range {k}").over(before), F.lit(0)).alias(f"range {k}") for k in totals])
    inside = Window.partitionBy("range number").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(k) for k, v in totals.items()])
    joined = summed.join(F.broadcast(shifts), "range number")
    return joined.withColumns({k: F.col(k) + F.col(f"range {k}") for k in totals}).drop("range number", *[f"range {k}" for k in totals])

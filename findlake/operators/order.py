"""Places in one order of a whole table, without a window that one task would have to walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findlake.sources.folders import written


def placed(df: DataFrame, by: list[Column], name: str = "place") -> DataFrame:
    """df with `name`, each row's place from 1 in the order `by` of all rows.

    Rows are dealt to ranges and written with the number of their range; a window counts within a range, and the sizes
    of the ranges before, one row each, are added. Rows that tie stand in any order."""
    dealt = written(df.repartitionByRange(*by).withColumn("range number", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("range number").agg(F.count("*").alias("range size"))
    before = F.coalesce(F.sum("range size").over(Window.orderBy("range number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.withColumn(name, F.row_number().over(Window.partitionBy("range number").orderBy(*by)))
    shifted = ranked.join(F.broadcast(sizes.select("range number", before.alias("range start"))), "range number")
    return shifted.withColumn(name, F.col(name) + F.col("range start")).drop("range number", "range start")

"""Running values over long groups, block by block, so that no group is one task's work.

A row's block is its order value divided by ``BLOCK``. Within a block a window runs as usual; what a block needs of the
blocks before it comes from one row a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def with_previous(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``rows`` with ``previous``: the value of the row before in the group, null for its first; ``_block`` stays."""
    rows = rows.withColumn("_block", F.floor(F.col(order) / BLOCK))
    ends = rows.groupBy(key, "_block").agg(F.max_by(value, order).alias("_end"))
    ends = ends.select(key, "_block", F.lag("_end").over(Window.partitionBy(key).orderBy("_block")).alias("_before"))
    within = F.lag(value).over(Window.partitionBy(key, "_block").orderBy(order))
    return rows.withColumn("_lag", within).join(ends, [key, "_block"]).withColumn("previous", F.coalesce("_lag", "_before")).drop("_lag", "_before")


def runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``rows`` with ``run``: the number, from 1, of the stretch of equal values of its group that a row lies in."""
    marked = with_previous(rows, key, order, value).withColumn("_new", F.coalesce((F.col("previous") != F.col(value)).cast("int"), F.lit(1)))
    sums = marked.groupBy(key, "_block").agg(F.sum("_new").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    upto = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumn("_run", F.sum("_new").over(upto)).join(sums, [key, "_block"])
    return numbered.withColumn("run", F.col("_base") + F.col("_run")).drop("_new", "_run", "_base", "_block", "previous")

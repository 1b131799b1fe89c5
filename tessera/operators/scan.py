"""Exclusive prefix sums. Large inputs are summed in two levels, so no task sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exclusive_scan(rows: DataFrame, order: str, value: str, out: str = "prefix", block: int = 100_000) -> DataFrame:
    """rows with `out` = sum of `value` over all rows of smaller `order` (unique integers), 0 for the first.

    Rows go into blocks of `block` order numbers; totals of the blocks are scanned in one small task, and each block adds
    its offset to its own running sum. Null values count as 0.
    """
    amount = F.coalesce(F.col(value), F.lit(0)).cast("long")
    rows = rows.withColumn("_block", F.floor(F.col(order) / block))
    totals = rows.groupBy("_block").agg(F.sum(amount).alias("_total"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    scanned = rows.join(totals, "_block").withColumn(out, (F.col("_base") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).cast("long"))
    return scanned.drop("_block", "_base")

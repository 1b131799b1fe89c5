"""Repeated timing of a query: a warm-up run, then measured ones, as rows for the CSV writer."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINT = "query string, warm_up boolean, run int, seconds double, tuples long, tuples_per_second double"


def measure(spark: SparkSession, name: str, query: Callable[[], DataFrame], repeat: int = 3, tuples: int | None = None) -> DataFrame:
    """One row for each run; the first is marked as warm-up."""
    rows = []
    for k in range(repeat + 1):
        begin = time.perf_counter()
        query().write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - begin
        rows.append((name, k == 0, k, took, tuples, tuples / took if tuples else None))
    return spark.createDataFrame(rows, POINT)

"""User functions over chunks of rows: stateless and stateful folds with Arrow batches, and dot products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def morsels(chunks: Iterator[pd.DataFrame], size: int | None) -> Iterator[pd.DataFrame]:
    """The chunks cut to at most `size` rows each."""
    for chunk in chunks:
        for first in range(0, len(chunk), size or max(len(chunk), 1)):
            yield chunk.iloc[first : first + (size or len(chunk))]


def fold(rows: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, morsel_rows: int | None = None) -> DataFrame:
    """function applied to each chunk, of morsel_rows rows at most; unset, the chunk size is Spark's Arrow batch size."""
    return rows.mapInPandas(lambda chunks: map(function, morsels(chunks, morsel_rows)), schema)


def fold_with_state(rows: DataFrame, start: Callable[[], object], step: Callable[[object, pd.DataFrame], object], finish: Callable[[object], pd.DataFrame], schema: str) -> DataFrame:
    """Each task starts a state, steps it through its chunks and gives its rows at the end; combine them by an aggregate."""

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = start()
        for chunk in chunks:
            state = step(state, chunk)
        yield finish(state)

    return rows.mapInPandas(run, schema)


def dot_product(rows: DataFrame, x: Column, y: Column) -> DataFrame:
    """One row: dot, the sum of products, 0 without rows."""
    return rows.agg(F.coalesce(F.sum(x * y), F.lit(0)).alias("dot"))

"""Conjunctive range filter with a fused product sum (TPC-H Query 6), in two plan shapes.

Dates, discounts and quantities arrive as Parquet timestamp and double columns; money is summed as exact
integers (cents times percent), so results do not depend on the order of addition. An empty selection sums to 0.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Day 0 of the day-number encoding.
DAY_ZERO = date(1992, 1, 1)


@dataclass(frozen=True)
class RevenueWindow:
    """Half-open date window, closed percent range and exclusive quantity limit."""

    first: date
    last: date
    low_percent: int = 5
    high_percent: int = 7
    quantity_below: int = 24

    @classmethod
    def year(cls, year: int, **more: int) -> RevenueWindow:
        return cls(date(year, 1, 1), date(year + 1, 1, 1), **more)

    @classmethod
    def day_numbers(cls, first: int, last: int, **more: int) -> RevenueWindow:
        """The window given as days since DAY_ZERO."""
        return cls(DAY_ZERO + timedelta(first), DAY_ZERO + timedelta(last), **more)


def _percent() -> Column:
    return F.round(F.col("l_discount") * 100).cast("bigint")


def _cents() -> Column:
    return F.round(F.col("l_extendedprice") * 100).cast("bigint")


def _predicate(w: RevenueWindow) -> Column:
    """Exact conditions on encoded values."""
    return (
        (F.col("l_shipdate") >= F.lit(w.first).cast("timestamp_ntz"))
        & (F.col("l_shipdate") < F.lit(w.last).cast("timestamp_ntz"))
        & _percent().between(w.low_percent, w.high_percent)
        & (F.col("l_quantity") < float(w.quantity_below))
    )


def _pushable(w: RevenueWindow) -> Column:
    """A raw-column range that holds whenever the encoded condition does; the Parquet scan can use it."""
    return F.col("l_discount").between((w.low_percent - 0.6) / 100, (w.high_percent + 0.6) / 100)


def revenue(lineitem: DataFrame, window: RevenueWindow, variant: str = "branching") -> DataFrame:
    """SUM(price * discount) of the selected rows in 1e-4 currency units, as one BIGINT `revenue`.

    branching: a filter, pushed to the scan. predication: every row is read and a mask decides its share.
    Null columns fail the predicate and add nothing; an empty table gives 0.
    """
    product = _cents() * _percent()
    if variant == "branching":
        picked = lineitem.filter(_predicate(window) & _pushable(window))
        return picked.agg(F.coalesce(F.sum(product), F.lit(0).cast("bigint")).alias("revenue"))
    if variant == "predication":
        masked = F.when(_predicate(window), product).otherwise(F.lit(0).cast("bigint"))
        return lineitem.agg(F.coalesce(F.sum(masked), F.lit(0).cast("bigint")).alias("revenue"))
    raise ValueError(f"unknown variant {variant!r}: branching or predication")
